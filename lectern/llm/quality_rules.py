"""Quality rules as a bitmask ledger (dealt operator 5), in DataFrame operations only.

ledger() evaluates every rule once and stores the measurements and a mask with a bit for each rule that fails. Policies
are versioned sets of bits: verdicts() applies one to a ledger, and ablation() tells what each rule does in it, both
without reading a text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import SPACES, let, space_words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules in the order of their bits: name and the condition on the measurements under which it fails.
RULES: list[tuple[str, str]] = [
    ("short", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 10 and 2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars > 40 * n_words"),
]
BASE = 0b00011
#: Versions of the policy: the bits that reject a document.
POLICIES = {1: BASE, 2: 0b11111}
CURRENT = 2


def _repeated(hashes: Column) -> Column:
    """Words in windows that stand twice or more: windows are sorted by hash, and spans of those with an equal neighbour are joined."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(ranked, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
    twice = F.array_sort(F.transform(F.filter(twice, lambda x: x.isNotNull()), lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(twice, none, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n")), lambda a: a["n"])


def measurements(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of text (all long).

    Columns of docs with these names, or called _words, _lines or _hashes, are replaced or dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    out = docs.withColumns({"_words": space_words(F.col("text")), "_lines": lines})
    # the words are bound outside the loop: filters on a ledger put the split in the place of its column
    hashes = F.when(F.size("_words") >= WINDOW, let(F.col("_words"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))))
    out = out.withColumn("_hashes", F.coalesce(hashes, F.array().cast("array<bigint>")))
    repeated = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeated(F.col("_hashes"))).otherwise(0)
    made = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated,
    }
    return out.withColumns({k: v.cast("long") for k, v in made.items()}).drop("_words", "_lines", "_hashes")


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the measurements and failed, the mask of the rules that fail.

    Null and empty texts have no words, so they fail the rule on short texts only. Every row is judged by itself, so ties
    and repeated rows are kept; an empty table gives no rows. Columns of docs with the names of measurements are replaced.
    """
    bits = [F.when(F.expr(rule), 1 << i).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    return measurements(docs).withColumn("failed", reduce(Column.bitwiseOR, bits).cast("long"))


def verdicts(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger with base_failed and kept under a version of the policy.

    Each row is judged by its mask alone, so equal rows agree; a null mask gives null verdicts; an empty ledger gives no rows;
    other columns stay, but for base_failed and kept, which are replaced.
    """
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumns({"base_failed": hit(BASE), "kept": ~hit(BASE | POLICIES[version])})


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: failed (rows that fail it) and alone (rows that only it rejects, kept if it were dropped).

    A rule that no row fails has no row here, and an empty ledger gives none. Repeated rows count each; a null mask fails nothing.
    """
    mask = F.col("failed").bitwiseAND(F.lit(POLICIES[version]))
    by_mask = rows.groupBy(mask.alias("mask")).count()  # at most one row for each combination of rules
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (n, _) in enumerate(RULES) if POLICIES[version] >> i & 1]))
    told = by_mask.select("mask", "count", rules.alias("r")).where(F.col("mask").bitwiseAND(F.col("r.bit")) != 0)
    return told.groupBy("r.rule").agg(F.sum("count").alias("failed"), F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("alone"))
