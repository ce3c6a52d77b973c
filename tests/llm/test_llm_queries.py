"""The registered queries of the dealt operators on the given tables: against their SQL, and by held-out labels."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lectern.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def cells(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert cells(got.columns, got.collect()) == cells(columns, want.fetchall())


@pytest.mark.parametrize(("name", "label", "least"), [("op6_toxicity", "toxic", 0.9), ("op4_quality_classifier", "quality", 0.8)])
def test_held_out_labels(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", label).collect()
    right = sum(r["predicted"] == r[label] for r in got)
    print(name, right, len(got), sum(r[label] for r in got), sum(r["predicted"] for r in got))
    assert right >= least * len(got)


def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def test_token_queries_equal_the_library(spark):
    """op1 and op3 on every given document against the tokenizers library."""
    tok, start, files, codes = Tokenizer.from_file(queries.tokenizer_path()), 0, [], []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, text in texts():
        ids = tok.encode(text, add_special_tokens=False).ids
        codes.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
        files.append((i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(map(tuple, queries.op1_token_files(spark, SF).collect())) == files
    assert sorted(map(tuple, queries.op3_bpe(spark, SF).collect())) == codes


def test_simhash_query_equals_brute_force(spark):
    prints, low = {}, {}
    for i, text in texts():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        low[i] = i
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    want = [(i, f"{x:016x}", low[i]) for i, x in prints.items()]
    assert sorted(map(tuple, queries.op10_simhash(spark, SF).collect())) == sorted(want)
