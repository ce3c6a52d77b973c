"""Operators 11 to 13: against brute force on small tables with nulls, ties, repeated rows and long texts, and on the given ones."""

import hashlib
import math
import os
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment, exact_topk, hard_negatives, queries

SF = "/root/testdata/sf0.001"
DDL = "vec_id long, embedding array<float>, label int, score string"


def vectors(n, width, seed):
    """Rows in clusters, with ties, repeated vectors and rows, a hot vector, nulls, short vectors and extra columns."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        v = centres[0] if i % 3 == 0 else [round(x + r.gauss(0, 0.3), 1) for x in c]
        rows.append((i, v, r.randrange(3), "extra"))
    odd = [
        (n, None, 1, None), (n + 1, [None] * width, 1, ""), (n + 2, [math.nan] * width, 0, ""), (n + 3, [math.inf] * width, 0, ""),
        (None, centres[1], 1, ""), (n + 50 - n % 50, [], 1, ""), (n + 4, [1.0], None, ""), (n + 5, [2.0, -1.0], 2, ""), rows[50], rows[50], rows[7], rows[9],
    ]
    return rows + odd


def scored(rows):
    """Rows that take part, as integers, with an inner product."""
    usable = [(i, [math.floor(256 * x) for x in map(float, v)], label) for i, v, label, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return usable, lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))


def single(rows):
    """The floats that a column of floats holds."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, s) for i, v, label, s in rows]


def brute_topk(rows, k=5):
    usable, dot = scored(single(rows))
    out = []
    for q, (i, v, _) in enumerate(usable):
        if i % 50 == 0:
            best = sorted((-dot(v, w), j) for x, (j, w, _) in enumerate(usable) if x != q)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows):
    usable, dot = scored(single([r for r in rows if r[2] is not None]))
    out = []
    for q, (i, v, label) in enumerate(usable):
        if i % 50:
            continue
        pairs = sorted((-dot(v, w), j, m) for x, (j, w, m) in enumerate(usable) if x != q)
        for s, p, _ in [x for x in pairs if x[2] == label][:5]:
            inside = [(j, -t) for t, j, m in pairs if m != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, p, rank, j, -s, t) for rank, (j, t) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "width", "cells"), [(700, 8, 4), (130, 3, 7), (3, 2, 2)])
def test_searches_equal_brute_force(spark, n, width, cells, monkeypatch):
    rows = vectors(max(n, 60), width, n)
    if n == 3:
        rows = [(0, [0.5, 0.5], 1, ""), (50, [0.5, 0.5], 1, ""), (3, [0.1, 0.2], 2, "")]
    table = spark.createDataFrame(rows, DDL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", cells)
    try:
        assert sorted(map(tuple, exact_topk.top_k(spark, table).collect())) == brute_topk(rows)
        assert sorted(map(tuple, hard_negatives.hard_negatives(spark, table).collect())) == brute_negatives(rows)
        from lectern.llm import vectors as v

        monkeypatch.setattr(v, "QUERY_BYTES", 16 << 10)  # several groups of queries
        monkeypatch.setattr(hard_negatives, "QUERIES", 4)
        assert sorted(map(tuple, exact_topk.top_k(spark, table).collect())) == brute_topk(rows)
        assert sorted(map(tuple, hard_negatives.hard_negatives(spark, table).collect())) == brute_negatives(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_searches_without_rows(spark):
    for rows in ([], [(50, None, 1, "")], [(1, [1.0], 1, "")], [(50, [1.0], 1, "")]):
        table = spark.createDataFrame(rows, DDL)
        assert exact_topk.top_k(spark, table).collect() == []
        assert hard_negatives.hard_negatives(spark, table).collect() == []


def test_pivots_eliminate_candidates():
    import numpy as np

    r = np.random.default_rng(3)
    v = np.floor(256 * (r.normal(size=(40, 6))[r.integers(0, 40, 3000)] + 0.02 * r.normal(size=(3000, 6)))).astype(np.int64)
    pivots = exact_topk.farthest_first(v[:200], 16)
    d, near = exact_topk.distances(v, pivots), exact_topk.distances(v, pivots).argmin(1)
    import pyarrow as pa

    def batch(rows):
        lists = lambda x: pa.array(x.tolist())
        return pa.record_batch([pa.array(rows), pa.array(rows), lists(v[rows]), pa.array(exact_topk.norms(v[rows])), lists(d[rows]), pa.array([exact_topk.LEAST] * len(rows))], names=["row", "vec_id", "v", "norm", "d", "least"])

    search, order = exact_topk.Search(batch(np.arange(0, 3000, 50)), 6, len(pivots), 5), np.lexsort((d.min(1), near))
    for at in range(0, 3000, 100):
        search.see(batch(order[at : at + 100]))
    assert search.evaluated < 60 * 3000 / 4  # most candidates are never evaluated
    scores = v[::50] @ v.T
    scores[np.arange(60), np.arange(0, 3000, 50)] = exact_topk.LEAST
    assert (np.sort(scores, 1)[:, :-6:-1] == search.scores).all()


def test_keys_order_pairs():
    pairs = [(5, -3, False, 2), (5, 7, True, -1), (5, 7, False, 9), (5, 7, True, 3), (-2, 0, True, 1)]
    assert [hard_negatives.unpack(k) for k in sorted(hard_negatives.pack(*p) for p in pairs)] == [pairs[4], pairs[2], pairs[1], pairs[3], pairs[0]]


A, B = (queries.tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, by loops over whole texts."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(alignment.byte_letters())}
    names = {i: t for t, i in tok.get_vocab().items()}
    all_links, rows = [], []
    for text in texts:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        a_bytes = [bytes(letters[c] for c in names[i]) for i in a]
        pieces = [sp.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            rows.append((0, 0, 0, ""))
            all_links.append([])
            continue

        def placed(ids, parts):
            at, out = 0, []
            for i, part in zip(ids, parts, strict=True):
                at += len(part)
                out.append((i, at))
            return out

        pa_, pb = placed(a, a_bytes), placed(b, b_bytes)
        ends = {}
        for j, e in pb:
            ends.setdefault(e, []).append(j)
        all_links.append([(i, j) for i, e in pa_ for j in ends.get(e, [])])
        cuts = sorted({e for _, e in pa_} & set(ends))
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, e in side if low < e <= cut) for side in (pa_, pb)))
            low = cut
        rows.append((len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(x for links in all_links for x in links)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(a, b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for (a, b, g, sha), links in zip(rows, all_links, strict=True)]


HARD = [
    None, "", " ", "\n", "a", "Hello world", "Hello world", "  two  spaces ", "\nfirst\nlines\n\nthen", "▁ marks ▁▁", "it's don't 'll 's", "naïve café über-straße", "日本語テキスト。\n次の行 です", "🙂🙂 🙃",
    "<|endoftext|> <s> </s> <unk>", "tab\tand\rreturn\r\nline", "a\u0000b", "x\x1cy z", "é combined", "12345 67.89 ²³", "snake_case_name __init__", "a" * 3000, "word " * 2000, "ab cd 　ef",
]


@pytest.mark.parametrize("tokens", [400_000, 50])
def test_alignment_equals_brute_force(spark, tokens, monkeypatch):
    monkeypatch.setattr(alignment, "TOKENS", tokens)
    monkeypatch.setattr(alignment, "PAIRS", 20)
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(HARD)] + [(7, "again", "y"), (7, "again", "y")], "doc_id long, text string, code string").repartition(3)
    texts = [*HARD, "again", "again"]
    ids = [i if i != 4 else None for i in range(len(HARD))] + [7, 7]
    want = [(i, *x) for i, x in zip(ids, brute_alignment(texts), strict=True)]
    got = alignment.alignment(spark, docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(alignment, "is_small", lambda df: False)  # counts joined by shuffle
    assert sorted(map(tuple, alignment.alignment(spark, docs, A, B).collect()), key=repr) == sorted(want, key=repr)


def test_segments_in_one_task(monkeypatch):
    """Segments of few tokens, in this process: the same figures as brute force, links spread over rows."""
    pair = alignment.tokenizer_pair(A, B)
    for tokens in (1, 7, 400_000):
        monkeypatch.setattr(alignment, "TOKENS", tokens)
        aligner, rows = alignment.Aligner(pair), []
        for at, text in enumerate(HARD):
            for batch in aligner.add(at, text):
                rows += batch.to_pylist()
        for batch in aligner.end():
            rows += batch.to_pylist()
        told = {r["at"]: r for r in rows if r["at"] >= 0 and r["n_a"] is not None}
        want = brute_alignment(HARD)
        assert [tuple(told[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) for i in range(len(HARD))] == [(*w[:4], w[6]) for w in want]
        links = Counter()
        for r in rows:
            if r["at"] < 0:
                links.update(dict(zip(r["codes"], r["counts"], strict=True)))
        assert sum(links.values()) == sum(w[3] for w in want)


def test_alignment_without_rows(spark):
    assert alignment.alignment(spark, spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_alignment_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(d["doc_id"], *x) for d, x in zip(docs, brute_alignment([d["text"] for d in docs]), strict=True)]
    got = queries.op13_alignment(spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
