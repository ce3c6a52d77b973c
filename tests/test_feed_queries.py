"""Queries on feeds against their SQL, on texts that a feed cannot hold as they are, and on keys at the edges."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.plans import registry

TEXTS = [
    None, "", " ", "\n\t ", "&", "<>& &", "a]]b", "ends]", "ends]]", "]]", "\x01", "a\x01b\x0b", "\x0b", "\\", "\\N", "\\x41", "\u3000", "\u00a0a\u2003", "x" * 29 + " y", "x" * 29 + "\u00a0y",
    "a \x85", "a \u2028", "\ufffe\uffff", "\ufeff", "null", "\U0001f600" * 40, "&amp; <b>b</b>", "plain text", "\r\n lead",
]


def both(spark, folder, name):
    """Rows of a query, and those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, registry.queries()[name](spark, folder).select(*columns).collect()), key=repr), sorted(want.fetchall(), key=repr)


def write(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["feed_entries", "feed_entries_whole"])
def test_texts_that_feeds_cannot_hold(spark, tmp_path, name):
    """Null and blank texts are entries of the SQL too; no character is added or lost. One source has null texts alone."""
    rows = [(k, t, s) for k, (s, t) in enumerate((s, t) for s in ("a", "bc") for t in TEXTS * 3)] + [(1000, None, "none"), (1001, None, "none")]
    got, want = both(spark, write(spark, tmp_path, rows), name)
    assert got == want


@pytest.mark.parametrize("name", ["feed_sync_alone", "feed_sync_totals"])
def test_sync_of_odd_texts_and_keys(spark, tmp_path, name):
    """Null and blank texts are stored and repeated as others are; ids may be negative, and a source may be null, empty or written like a sign."""
    texts = TEXTS + [f"text {k}" for k in range(60)]
    sources = ["a", "bc", None, "", "\\N"]
    rows = [(sign * (7 * k + j) - (sign < 0), texts[(5 * k + j) % len(texts)], s) for j, s in enumerate(sources) for sign in (1, -1) for k in range(70)]
    got, want = both(spark, write(spark, tmp_path, rows), name)
    assert got == want
