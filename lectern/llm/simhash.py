"""SimHash near-duplicates by a byte-position inverted index with count filtering (dealt operator 10).

Fingerprints that differ in at most 3 of 64 bits share at least 5 of their 8 positional bytes: that is the guaranteed
minimum number of matches. Lists of a single byte and position would hold 1/256 of all fingerprints each, so the index is
kept by 14 combinations of four positions, chosen so that any five positions hold one: two fingerprints with the minimum
meet in a list. There the positional bytes that each pair shares are tallied, pairs under the minimum are dropped, and
the others are verified bit by bit and reduced to a spanning forest, so a dense list gives fewer links than it has members.
A list over LONGEST is dealt anew by a fifth byte, which such pairs also share, and a list by five bytes has at most 2^24
members whatever the number of documents. Equal fingerprints are one member. Components follow from contraction (graph.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.graph import by_pointer, components
from lectern.llm.shared import SPACES, each_text, small, stored, text_batches, text_key

BITS, BYTES = 3, 8
MATCHES = BYTES - BITS
#: A list by four bytes that is longer is dealt anew by a fifth one.
LONGEST = 8192
#: Lists by five bytes up to this length are tallied member by member; in longer ones every member looks up its neighbours instead.
PAIRWISE = 2048
#: Members that are looked up at once, and masks after which those of the largest component are told anew.
CHUNK, MASKS = 1 << 20, 24
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPLIT = str.maketrans(dict.fromkeys(SPACES, " "))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the shingles of a text, repeats included; fewer words are one shingle, and no word gives zero."""
    words = [w for w in (text or "").translate(_FOLD).translate(_SPLIT).split(" ") if w]
    if not words:
        return 0
    shingles = map(" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s.encode(), 42) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for long texts
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), h and n (the fields of text_key) of each row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter(map(fingerprint, each_text(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(got.view(np.int64)), batch.column(2), batch.column(3)], names=["doc_id", "fp", "h", "n"])

    kind = docs.schema["doc_id"].dataType
    named = text_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text", text_key(F.col("text")).alias("key")).select("doc_id", "text", "key.h", "key.n")
    return named.mapInArrow(run, "doc_id string, fp long, h long, n int").withColumn("doc_id", F.col("doc_id").cast(kind))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of differing bits. They are taken of unsigned values: of signed ones NumPy counts the bits of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally: how many positional bytes are equal."""
    x = (a ^ b).view(np.uint64)
    return sum((((x >> np.uint64(8 * i)) & np.uint64(0xFF)) == 0).astype(np.int8) for i in range(BYTES))


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs pass the count filter and differ in at most BITS bits; only those that pass are verified."""
    found = np.flatnonzero(_shared_bytes(a, b) >= MATCHES)
    out = np.zeros(np.broadcast(a, b).shape, bool)
    out[found] = _differing(a[found] if len(a) > 1 else a, b[found]) <= BITS
    return out


def tallied_forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) between members that pass the count filter and the check, one fewer than the members they join."""
    left, links = members, []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = _linked(front[:1], left)
            found, left = left[near], left[~near]
            links += [(int(front[0]), int(x)) for x in found]
            front = np.concatenate([front[1:], found])
    return links


def forest(members: np.ndarray, bits: int = BITS) -> list[tuple[int, int]] | np.ndarray:
    """tallied_forest() of members that share five bytes, by looking up neighbours where they are many.

    A mask of differing bits at a time, few bits first, all members of a chunk are looked up together. Members of the component that is
    largest so far are not: a link of theirs to another component is found from its other end. So a dense list, most of which one bit
    joins, costs about a look-up a member and bit, and no member is walked by itself.
    """
    if len(members) <= PAIRWISE:
        return tallied_forest(members)
    # members share five bytes: squeeze the other three to 24 bits
    same = int(np.bitwise_or.reduce(members ^ members[0]).view(np.uint64))
    free = [8 * i for i in range(BYTES) if same >> 8 * i & 0xFF]
    raw = members.view(np.uint64)
    small = np.zeros(len(members), np.int32)
    for k, shift in enumerate(free):
        small |= (((raw >> np.uint64(shift)) & np.uint64(0xFF)) << np.uint64(8 * k)).astype(np.int32)
    where = np.full(1 << 8 * len(free), -1, np.int32)
    where[small] = np.arange(len(members), dtype=np.int32)
    root, links = np.arange(len(members), dtype=np.int32), []

    def join(u: np.ndarray, v: np.ndarray) -> None:
        """Joins the components of u and v, pair by pair: of the links that would hang a component under an older one, one each."""
        nonlocal root
        while True:
            apart = root[u] != root[v]
            u, v = u[apart], v[apart]
            if not len(u):
                return
            high, low = np.maximum(root[u], root[v]), np.minimum(root[u], root[v])
            hung, pick = np.unique(high, return_index=True)
            root[hung] = low[pick]
            links.append(np.stack([members[u[pick]], members[v[pick]]], 1))
            while not np.array_equal(up := root[root], root):
                root = up

    for most in range(1, bits + 1):
        masks = [sum(1 << x for x in c) for c in combinations(range(8 * len(free)), most)]
        for first in range(0, len(masks), MASKS):
            active = np.flatnonzero(root != np.bincount(root).argmax()).astype(np.int32) if most > 1 or first else np.arange(len(members), dtype=np.int32)
            for mask in masks[first : first + MASKS] if len(active) else []:
                for at in range(0, len(active), CHUNK):
                    u = active[at : at + CHUNK]
                    v = where[small[u] ^ np.int32(mask)]
                    join(u[v >= 0], v[v >= 0])
    return np.concatenate(links) if links else []


def _lists(n: int) -> list[tuple[int, ...]]:
    """Combinations of n positions such that any MATCHES positions hold one: each time that which most of those without one hold."""
    left, out = {frozenset(c) for c in combinations(range(BYTES), MATCHES)}, []
    while left:
        best = max(combinations(range(BYTES), n), key=lambda c: sum(x.issuperset(c) for x in left))
        left = {x for x in left if not x.issuperset(best)}
        out.append(best)
    return out


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << 8 * p for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _keys_change(rows: np.ndarray) -> np.ndarray:
    """Where the lists of sorted postings (g, bytes, fp) start."""
    return np.append(0, 1 + np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)))[: len(rows)]


def _tallied(rows: np.ndarray) -> np.ndarray:
    """Links a, b of whole lists of postings; all lists of two members are tallied together."""
    starts, fps = _keys_change(rows), np.ascontiguousarray(rows[:, 2])
    sizes = np.diff(np.append(starts, len(fps)))
    two = starts[sizes == 2]
    near = _linked(fps[two], fps[two + 1])
    more = [link for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True) for link in tallied_forest(fps[s : s + n])]
    return np.concatenate([np.stack([fps[two][near], fps[two + 1][near]], 1), np.array(more, np.int64).reshape(-1, 2)])


def _by_list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links a, b (g is -1) of sorted postings (g, bytes, fp), list by list; a list over LONGEST is given back as g, fp, fp."""
    held, back = np.zeros((0, 3), np.int64), None  # the list that may go on, and the key of the one that goes back
    for batch in chain(batches, [None]):
        rows = held if batch is None else np.concatenate([held, batch[["g", "bytes", "fp"]].to_numpy(np.int64)])
        if not len(rows):
            continue
        starts = _keys_change(rows)
        sizes = np.diff(np.append(starts, len(rows)))
        long = sizes > LONGEST
        long[0] |= back == tuple(rows[0, :2])
        again = np.repeat(long, sizes)
        yield pd.DataFrame({"g": rows[again, 0], "a": rows[again, 2], "b": rows[again, 2]})
        back = tuple(rows[-1, :2]) if long[-1] else None
        held = rows[:0] if long[-1] or batch is None else rows[starts[-1] :]
        found = _tallied(rows[: len(rows) - len(held)][~again[: len(rows) - len(held)]])
        yield pd.DataFrame({"g": np.full(len(found), -1), "a": found[:, 0], "b": found[:, 1]})


def links(fps: DataFrame) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that keep every component whole."""
    four = _lists(MATCHES - 1)
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.array(*[F.struct(F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for g, c in enumerate(four)])
    # a fingerprint is few bytes but gives many rows, so few input partitions are dealt anew (by another key, or Spark takes them as dealt)
    postings = fps.repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(at).alias("at")).select("at.g", "at.bytes", "fp")
    lists = postings.repartition("g", "bytes").sortWithinPartitions("g", "bytes", "fp")
    met = stored(lists.mapInPandas(_by_list, "g int, a long, b long"), "links")
    found, again = met.where("g < 0").select("a", "b"), met.where("g >= 0").select("g", F.col("a").alias("fp"))
    return (found if again.isEmpty() else found.union(_by_five_bytes(again, four))).distinct()


def _by_five_bytes(again: DataFrame, four: list[tuple[int, ...]]) -> DataFrame:
    """Links a, b of the lists given back (g, fp), from lists by one more byte; each has at most 2^24 members."""
    more = [F.lit([_mask((*c, p)) for p in range(BYTES) if p not in c]) for c in four]
    keys = again.select("fp", F.explode(F.get(F.array(*more), F.col("g"))).alias("mask"))
    lists = keys.distinct().groupBy("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("bytes")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch["fps"]:
                found = forest(np.sort(np.asarray(x, np.int64)))
                yield pd.DataFrame(np.asarray(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return lists.where(F.size("fps") > 1).select("fps").mapInPandas(run, "a long, b long")


def _row() -> Column:
    """What orders rows: by id, those without one last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h", "n")


def _first_rows(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """fp and first, the first row of its component, of each distinct fingerprint."""
    own = stored(prints.groupBy("fp").agg(F.min(_row()).alias("first")), "distinct-fingerprints")
    roots = components(spark, links(own.select("fp")))
    placed = stored(own.join(roots.withColumnRenamed("node", "fp"), "fp", "left"), "placed-fingerprints")
    firsts = placed.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    linked = by_pointer(placed.where("root is not null"), firsts, "root", "fp").select("fp", F.col("least").alias("first"))
    # fingerprints without links are their own component
    return linked.union(placed.where("root is null").select("fp", "first"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of each row of docs.

    Null and empty texts share fingerprint zero. Rows that repeat a text or an id are members like any other; a null id
    never names a component unless all its members lack one. Other columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    return prints.join(_first_rows(spark, prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, whatever its other columns, without near-duplicates: of each component one row stays, that with the smallest id and, among
    texts that share it, the smallest text_key. Rows without an id come last; null and empty texts are one component, of which
    one row stays too. Of equal rows one stays; an empty table gives no rows."""
    prints = stored(fingerprints(docs), "fingerprints")
    keys = prints.groupBy("doc_id", "h", "n", "fp").agg(F.count("*").alias("copies")).join(_first_rows(spark, prints), "fp")
    # the fewer rows, those that go, are joined with the texts; of those that stay, the repeated ones are thinned
    touched = keys.withColumn("stays", F.col("first").eqNullSafe(_row())).where("copies > 1 or not stays")
    touched = stored(touched.select("doc_id", F.struct("h", "n").alias("text_key"), "stays"), "touched-rows")

    def join(rows: DataFrame, how: str) -> DataFrame:
        met = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & text_key(F.col("d.text")).eqNullSafe(F.col("k.text_key"))
        return docs.alias("d").join(small(rows.select("doc_id", "text_key")).alias("k"), met, how)

    kept, repeated = join(touched, "left_anti"), touched.where("stays")
    return kept if repeated.isEmpty() else kept.unionByName(join(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
