"""BPE encoding and decoding with a tokenization automaton (dealt operator 3).

A merge list is compiled by applying one merge gadget per merge, in order. The automaton reads tokens, and it accepts a
token sequence exactly when BPE produces it. The gadget of a merge (u, v) does two things: the state after u is copied
without its arc for v, and every state that had an arc for u gets an arc for the new token uv into the state that v led to.

All arcs of one token lead to one state, so states are numbered by the last token read. A state's arcs differ from those
of the state it was copied from in the arc of one merge, so each gadget is stored as that difference: the rank of its
merge and the two halves of its token. arc() resolves an arc through these differences, and the answer stays in the
transition table. A word is then encoded left to right: the automaton is deterministic and accepts one tokenization of
each prefix, so the last token of a prefix is the one whose arc leaves the state reached at the token's start.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.chunks import ChunkMemo, split_chunks
from lectern.llm.shared import each_text, text_batches

END = "</w>"
#: Arcs that the transition table holds before it starts anew.
TABLE = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton of a merge list. vocab: token text to id; merges: pairs of token texts, in order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = dict(vocab)  # less the tokens that no state has an arc for
        self.longest = max(map(len, vocab), default=1)
        self.size = max(vocab.values(), default=0) + 1
        self.born = [0] * self.size  # rank of the merge that made a token; 0: a base symbol
        self.halves: list[tuple[int, int]] = [(-1, -1)] * self.size
        self.cut: dict[int, int] = {}  # (state, token) whose arc a gadget cut, and that gadget's rank
        self.dead: set[int] = set()
        self.text = {i: t for t, i in vocab.items()}
        self.table: dict[int, bool] = {}  # arcs of the finished automaton, as far as resolved
        for rank, (left, right) in enumerate(merges, 1):
            self._gadget(rank, vocab[left], vocab[right], vocab[left + right])

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        if self.born[uv] or self.cut.get(u * self.size + v):
            raise ValueError("two merges make the same token")
        if not self._arc_at(u, v, rank - 1):  # no sequence has u and v side by side when the merge's turn comes
            self.vocab.pop(self.text[uv], None)
            self.dead.add(uv)
            return
        self.cut[u * self.size + v] = rank
        self.born[uv], self.halves[uv] = rank, (u, v)

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has an arc for the token from the state."""
        key = state * self.size + token
        if (known := self.table.get(key)) is None:
            if len(self.table) >= TABLE:
                self.table.clear()
            known = self.table[key] = self._arc_at(state, token, len(self.halves) + len(self.cut))
        return known

    def _arc_at(self, state: int, token: int, rank: int) -> bool:
        """The same once the gadgets up to a rank were applied."""
        born = self.born
        if state in self.dead or token in self.dead:
            return False
        while True:
            if self.cut.get(state * self.size + token, rank + 1) <= rank:
                return False
            if born[state] > born[token]:  # the state was shared with its right half's until it was made
                rank, state = born[state] - 1, self.halves[state][1]
            elif born[token]:  # the arc was added where there was one for the left half
                rank, token = born[token], self.halves[token][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of a word of byte letters, by transitions only; its last letter carries the end of the word."""
        n = len(word)
        if not n:
            return []
        vocab, arc, longest = self.vocab, self.arc, self.longest
        last: list[int] = [-1] * (n + 1)
        start = [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                token = vocab.get(word[j:i] if i < n else word[j:] + END)
                if token is not None and (not j or arc(last[j], token)):
                    last[i], start[i] = token, j
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]


class BpeCodec:
    """Encoder and decoder of a word-level BPE file in the tokenizers library's JSON form (NFC, lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != END or not split["invert"] or level["type"] != "ByteLevel" or spec["decoder"]:
            raise ValueError(f"{path}: not a word-level BPE file of the known form")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.words = regex.compile(split["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.labels = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        self.digits = {i: str(i) for i in self.labels}
        self.memo = ChunkMemo(lambda chunk: tuple(self.encode_chunk(chunk)))

    def encode_chunk(self, chunk: str) -> Iterator[int]:
        """Ids of a piece of text without white space."""
        for piece in self.specials.split(chunk) if self.specials else [chunk]:
            if piece in self.special:
                yield self.special[piece]
                continue
            folded = "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
            for word in self.words.findall(folded):
                yield from self.automaton.encode("".join([self.letters[b] for b in word.encode()]))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, split_chunks(text or ""))))

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels; files of this form have no decoder, so labels are joined by spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec per Python worker."""
    return BpeCodec(path)


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text, ...); with keep_ids also the ids.

    A null text counts as empty: no ids, digests of the empty string. Rows that repeat an id are encoded one by one, other
    columns are ignored, and an empty table gives no rows. There is no shuffle: tasks stream batches of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            out = []
            for text in each_text(batch.column(1)):
                ids = bpe.encode(text)
                said = " ".join(map(bpe.digits.__getitem__, ids))
                row = (len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                out.append((*row, array("i", ids)) if keep_ids else row)
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)] if out else [pa.array([], t) for t in kinds]
            yield pa.record_batch([batch.column(0), *made], names=names)

    kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if keep_ids else [])]
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kind = docs.schema["doc_id"].dataType
    return text_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
