"""Cross-tokenizer alignment (dealt operator 13).

Two tokenizers cut the same bytes. Token ids of many texts lie in one flat Arrow list column per tokenizer; the parent index
of each token, and segmented cumulative sums of token lengths, give the byte at which it ends in its text. An Acero hash join on
(text, end) finds the pairs of tokens that end together. Table.group_by counts id pairs within a task, and Spark merges the counts.

Long texts are aligned in segments, cut where both tokenizers start anew, so memory follows the tokens of a segment.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe_automaton import byte_letters
from lectern.llm.graph import by_pointer
from lectern.llm.shared import each_text, is_small, stored, text_batches

#: Tokens of one tokenizer that are aligned at once, distinct pairs that a task counts before it gives counts away, and pieces that it remembers in each of two generations.
TOKENS, PAIRS, MEMO = 400_000, 500_000, 300_000
#: A space, or before a line feed, between two characters that are not white space: both tokenizers start anew there.
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: Letters and marks after them, which tokenizer A's pattern takes as one word each.
_WORD = re.compile(r"([^\W\d_]+)([^\w\s']*)")


class Labels:
    """Each id as decimal text with each sign that may follow it, as one Arrow column."""

    def __init__(self, a: int, b: int):
        parts = [[f"{i}{sign}" for i in range(n)] for n, signs in ((a, ",|"), (b, ",;")) for sign in signs]
        self.starts = {"a,": 0, "a|": a, "b,": 2 * a, "b;": 2 * a + b}
        self.texts = pa.array([x for part in parts for x in part], pa.large_string())


class TokenizerPair:
    """Tokenizer A of a byte-level file and tokenizer B of a sentencepiece file, over texts that a space precedes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.letters, self.model = byte_letters(), self.a.model
        numbers = {x: i for i, x in enumerate(self.letters)}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(map(numbers.__contains__, token))
            self.a_bytes[i] = bytes(map(numbers.__getitem__, token)) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        level = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or level.get("type") != "ByteLevel" or level["add_prefix_space"] or not level["use_regex"]:
            raise ValueError(f"{a_path}: not a byte-level file of the known form")
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError(f"{b_path}: a piece holds a space after another character, or a line feed")
        self.a_sizes, self.b_sizes = (pa.array([len(x) for x in t], pa.int64()) for t in (self.a_bytes, self.b_bytes))
        self.labels = Labels(len(self.a_bytes), len(self.b_bytes))
        self.memo: dict[str, tuple[bytes, bytes]] = {}  # two generations of it: pieces that are met again move to the newer one
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.lost: set[str] = set()  # pieces that are not given back

    def _a(self, text: str) -> array:
        """A's ids of a text that a space or a line feed begins."""
        word = _WORD.fullmatch(text, 1) if text[0] == " " else None
        if word and word[1].isalpha():  # one word, or two, of A's pattern: only its model has work to do
            parts = [text[: word.end(1)], word[2]] if word[2] else [text]
            spelt = ["".join([self.letters[b] for b in x.encode()]) for x in parts]
            return array("i", [t.id for x in spelt for t in self.model.tokenize(x)])
        return array("i", self.a.encode(text, add_special_tokens=False).ids)

    def whole(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of a space and a text, as the libraries give them; None if their bytes are not the text's."""
        return self._same(array("i", self.a.encode(" " + text, add_special_tokens=False).ids), array("i", self.b.encode(text)), b" " + text.encode()) if text else None

    def _same(self, a: array, b: array, wanted: bytes) -> tuple[bytes, bytes] | None:
        same = b"".join(map(self.a_bytes.__getitem__, a)) == wanted and b"".join(map(self.b_bytes.__getitem__, b)) == wanted
        return (a.tobytes(), b.tobytes()) if same else None

    def _learn(self, pieces: set[str]) -> None:
        """Puts pieces into the memo: those that it held before it started anew, and others encoded together."""
        known = {x for x in pieces if x in self.old}
        self.memo.update((x, self.old[x]) for x in known)
        # a piece that a line feed begins has no space before it: that which B adds is a token of its own and goes
        for sign, gone, group in ((" ", 0, [x for x in pieces - known if x[0] != "\n"]), ("", 1, [x for x in pieces - known if x[0] == "\n"])):
            for piece, b in zip(group, self.b.encode(group, num_threads=1) if group else [], strict=True):
                piece_text = sign + piece
                ids = self._same(self._a(piece_text), array("i", b[gone:]), piece_text.encode())
                self.memo[piece] = ids or (b"", b"")
                if ids is None:
                    self.lost.add(piece)

    def pieces(self, text: str | None) -> list[tuple[bytes, bytes]] | None:
        """Ids of a text piece by piece; None for a text without tokens."""
        if not text:
            return None
        first, cut = [], _CUT.split(text)
        if text[0] == "\n":  # here a space does stand before the line feed
            ids = self.whole(cut.pop(0))
            if ids is None:
                return self._uncut(text)
            first = [ids]
        if len(self.memo) >= MEMO:
            self.old, self.memo = self.memo, {}
        if len(self.lost) >= MEMO:
            self.old, self.memo, self.lost = {}, {}, set()
        missing = set(cut).difference(self.memo)
        if missing:
            self._learn(missing)
        if self.lost and not self.lost.isdisjoint(cut):
            return self._uncut(text)
        return first + list(map(self.memo.__getitem__, cut))

    def _uncut(self, text: str) -> list[tuple[bytes, bytes]] | None:
        """Where a piece is not given back, only the whole text can tell."""
        ids = self.whole(text)
        return None if ids is None else [ids]


@lru_cache(maxsize=2)
def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    """One pair per Python worker."""
    return TokenizerPair(a_path, b_path)


def ends_of(tokens: pa.ListArray, sizes: pa.Array) -> pa.Table:
    """parent, end, id and place of each token of a list column; end is where its bytes end in its list's text."""
    ids = tokens.flatten()
    parent = pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pc.take(sizes, ids))
    # segmented: what the lists before a token's own add up to is taken away
    before = pa.array(np.append(0, total.to_numpy())[tokens.offsets.to_numpy()[:-1] - tokens.offsets[0].as_py()])
    return pa.table({"parent": parent, "end": pc.subtract(total, pc.take(before, parent)), "id": ids, "place": pa.array(np.arange(len(ids)))})


class Alignment:
    """Tokens of segments, side by side in list columns; both lists of a segment cover the same bytes."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, pair: TokenizerPair):
        self.a, self.b = ends_of(a, pair.a_sizes), ends_of(b, pair.b_sizes)
        self.links = self.a.join(self.b, ["parent", "end"], join_type="inner", right_suffix="_b", use_threads=False)
        keys = self.links.group_by(["parent", "end"], use_threads=False).aggregate([])
        # the ends that both have cut the tokens into groups: how many of them lie before each token
        parent, end = (keys.column(c).to_numpy().astype(np.int64) for c in ("parent", "end"))
        self.reach = int(max([0, *(pc.max(t.column("end")).as_py() or 0 for t in (self.a, self.b))])) + 1
        self.cuts = np.sort(parent * self.reach + end)
        self.sizes = np.bincount(parent, minlength=len(a))

    def groups(self, side: pa.Table) -> np.ndarray:
        """The group of each token: those that end with a cut belong before it."""
        return np.searchsorted(self.cuts, side.column("parent").to_numpy().astype(np.int64) * self.reach + side.column("end").to_numpy())

    def rendered(self, labels: Labels) -> tuple[memoryview, np.ndarray]:
        """Text of all groups, `a1,a2|b1;a3|b2;` with a sign after each, and where each segment's part ends."""
        a, b = self.groups(self.a), self.groups(self.b)
        n = len(a) + len(b)
        before = lambda own, other: np.searchsorted(other, own, "left")
        last = lambda g: np.append(g[1:] != g[:-1], True)
        where = np.zeros(n, np.int64)
        at_a, at_b = np.arange(len(a)) + before(a, b), np.arange(len(b)) + np.searchsorted(a, b, "right")
        where[at_a] = self.a.column("id").to_numpy() + np.where(last(a), labels.starts["a|"], labels.starts["a,"])
        where[at_b] = self.b.column("id").to_numpy() + np.where(last(b), labels.starts["b;"], labels.starts["b,"])
        made = pc.take(labels.texts, pa.array(where))
        offsets = np.frombuffer(made.buffers()[1], np.int64)[: n + 1]
        counts = sum(np.bincount(t.column("parent").to_numpy(), minlength=len(self.sizes)) for t in (self.a, self.b))
        return memoryview(made.buffers()[2] or b""), offsets[np.cumsum(counts)]

    def pairs(self) -> pa.Table:
        """parent, code (of both ids) and n of the links of each segment."""
        code = pc.add(pc.multiply(pc.cast(self.links.column("id"), pa.int64()), 1 << 32), pc.cast(self.links.column("id_b"), pa.int64()))
        return pa.table({"parent": self.links.column("parent"), "code": code}).group_by(["parent", "code"], use_threads=False).aggregate([([], "count_all")])


class Counts:
    """Partial counts of id pairs of one task."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.held = 0

    def add(self, pairs: pa.Table) -> pa.Table | None:
        """Adds counts (code, n); gives what is held once it has PAIRS rows."""
        self.parts.append(pairs)
        self.held += len(pairs)
        if self.held < 2 * PAIRS:
            return None
        made = self.take()
        if len(made) >= PAIRS:
            return made
        self.parts, self.held = [made], len(made)
        return None

    def take(self) -> pa.Table:
        made = pa.concat_tables(self.parts).group_by("code", use_threads=False).aggregate([("n", "sum")]).rename_columns(["code", "n"]) if self.parts else pa.table({"code": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        self.parts, self.held = [], 0
        return made


_ROWS = pa.schema([("at", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


class _Open:
    """What is known of a text so far."""

    def __init__(self, at: int):
        self.at, self.sha, self.n_a, self.n_b, self.n_groups, self.n_links, self.any = at, hashlib.sha256(), 0, 0, 0, 0, False


class Aligner:
    """Aligns texts as they come, by pieces, TOKENS or a little more at once: add() and flush() give tables of finished rows (at, ..., codes, counts); a text's links may be spread over several of them."""

    def __init__(self, pair: TokenizerPair):
        self.pair, self.counts = pair, Counts()
        self.owners: list[_Open] = []
        self.last: list[bool] = []
        self.ids = (array("i"), array("i"))
        self.offsets: tuple[list[int], list[int]] = ([0], [0])

    def add(self, at: int, text: str | None) -> Iterator[pa.RecordBatch]:
        pieces, owner = self.pair.pieces(text), _Open(at)
        if pieces is None:
            yield pa.record_batch([[at], [0], [0], [0], [0], [""], [None], [None]], schema=_ROWS)
            return
        step = max(1, TOKENS // 8)
        for start in range(0, len(pieces), step):
            part = pieces[start : start + step]
            for k, ids in enumerate(self.ids):
                ids.frombytes(b"".join([x[k] for x in part]))
            if max(map(len, self.ids)) >= TOKENS:
                self._close(owner, last=False)
                yield from self.flush()
        self._close(owner, last=True)

    def _close(self, owner: _Open, last: bool) -> None:
        """Ends a segment of a text."""
        self.owners.append(owner)
        self.last.append(last)
        for offsets, ids in zip(self.offsets, self.ids, strict=True):
            offsets.append(len(ids))

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows of the segments that were ended."""
        if not self.owners:
            return
        a, b = (pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(np.array(x, np.int32))) for o, x in zip(self.offsets, self.ids, strict=True))
        met = Alignment(a, b, self.pair)
        data, ends = met.rendered(self.pair.labels)
        pairs = met.pairs().sort_by("parent")
        owner, n = pairs.column("parent").to_numpy(), pairs.column("count_all").combine_chunks()
        bounds = np.searchsorted(owner, np.arange(len(a) + 1))
        codes, links = pairs.column("code").combine_chunks(), np.append(0, np.cumsum(n.to_numpy()))
        columns, start = [[] for _ in range(6)], 0
        for k, (who, last) in enumerate(zip(self.owners, self.last, strict=True)):
            end = int(ends[k])
            if end > start:  # the sign after a segment is told once another one follows
                who.sha.update(b";" * who.any)
                who.sha.update(data[start : end - 1])
                who.any = True
            start = end
            who.n_a, who.n_b, who.n_groups = who.n_a + len(a[k]), who.n_b + len(b[k]), who.n_groups + int(met.sizes[k])
            who.n_links += int(links[bounds[k + 1]] - links[bounds[k]])
            told = (who.at, who.n_a, who.n_b, who.n_groups, who.n_links, who.sha.hexdigest()) if last else (who.at, None, None, None, None, None)
            for column, value in zip(columns, told, strict=True):
                column.append(value)
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (codes, n)]
        self.owners, self.last, self.ids, self.offsets = [], [], (array("i"), array("i")), ([0], [0])
        yield pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, _ROWS.types, strict=False)), *lists], schema=_ROWS)
        full = self.counts.add(pa.table({"code": codes, "n": n}))
        if full is not None:
            yield self._counted(full)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.flush()
        yield self._counted(self.counts.take())

    @staticmethod
    def _counted(made: pa.Table) -> pa.RecordBatch:
        """Partial counts as one row, whose place is -1."""
        one = [pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made.column(c).combine_chunks()) for c in ("code", "n")]
        return pa.record_batch([pa.array([-1]), *(pa.array([None], t) for t in _ROWS.types[1:6]), *one], schema=_ROWS)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows of docs (doc_id, text) aligned, with what stands in _ROWS, and partial counts of pairs (code, n).

    A text without tokens (null, empty, or not given back by both tokenizers) has zeros. A long text has several rows of links,
    of which the last has its figures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a_path, b_path)
        aligner = Aligner(pair)
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), each_text(batch.column(1)), strict=True):
                yield from aligner.add(at, text)
            yield from aligner.flush()
        yield from aligner.end()

    schema = "at long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, counts array<long>"
    made = stored(text_batches(docs).select("at", "text").mapInArrow(run, schema), "aligned")
    counted = made.where("at < 0").select(F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("x.codes", "x.counts")
    return made.where("at >= 0"), counted.groupBy(F.col("codes").alias("code")).agg(F.sum("counts").alias("n"))


def alignment(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text).

    A link is a pair of tokens that end at the same byte; its count is how many links of all docs hold its two ids. n_best counts
    the links whose count is the highest of their B id, ties included. Null and empty texts, and texts that a tokenizer does not
    give back byte by byte, have zeros and an empty digest. Rows that repeat an id or a text are rows like any other; other columns
    are ignored; an empty table gives no rows.
    """
    rows = stored(docs.select("doc_id", "text").withColumn("at", F.monotonically_increasing_id()).select("doc_id", "at", "text"), "texts")
    made, counts = aligned(rows, a_path, b_path)
    counts = stored(counts.withColumn("b", F.col("code").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    told = stored(counts.join(top, "b").select("code", "n", (F.col("n") == F.col("top")).alias("best")), "told-counts")
    links = made.where("codes is not null").select("at", F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("at", F.col("x.codes").alias("code"), F.col("x.counts").alias("times"))
    met = links.join(F.broadcast(told), "code") if is_small(told) else by_pointer(links, told, "code", "at")
    sums = met.groupBy("at").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    figures = made.where("n_a is not null").drop("codes", "counts")
    return rows.select("doc_id", "at").join(figures, "at").join(sums, "at", "left").na.fill(0, ["n_best", "count_sum"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
