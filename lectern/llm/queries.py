"""Queries of the dealt operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    alignment,
    bpe_automaton,
    chat,
    decontaminate,
    exact_topk,
    hard_negatives,
    licenses,
    quality_classifier,
    quality_rules,
    simhash,
    token_files,
    toxicity,
    warc,
)

#: Where the public tokenizers' files are described and found.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str = TOKENIZERS) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{folder}/{name}"
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.verdicts(quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(spark, _table(spark, sf_dir, "conversations"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label that reaches the threshold, but for lesser versions of the same license."""
    return licenses.scan(_table(spark, sf_dir, "documents"), families=licenses.FAMILIES)


def op8_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which op8_license_scan was first registered with all labels."""
    return op8_license_scan(spark, sf_dir)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archives(spark, _table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(spark, _table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are read as the next of ten."""
    rows = _table(spark, sf_dir, "embeddings")
    read = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark, rows.withColumn("label", read))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    here = [
        op1_token_files,
        op2_decontamination,
        op3_bpe,
        op4_quality_classifier,
        op5_quality_rules,
        op6_toxicity,
        op7_chat_formatting,
        op8_license_scan,
        op8_license_labels,
        op9_warc,
        op10_simhash,
        op11_exact_topk,
        op12_hard_negatives,
        op13_alignment,
        pipeline,
    ]
    return {f.__name__: f for f in here}


_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _FOLD + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP2 = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS size FROM wins),
spots AS (SELECT r, i, size, w[i : i + size - 1] AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
met AS (SELECT s.r, s.i, s.size, k.item_id FROM spots s JOIN wins k ON s.win = k.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM met) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, i, w[i : i + 7] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, (n_words < 20) AS f0, (100 * n_repeat_words > 30 * n_words) AS f1, (n_symbols > n_words) AS f2, (n_lines >= 10 AND 2 * n_dup_lines > n_lines) AS f3, (word_chars > 40 * n_words) AS f4 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f0 OR f1) AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4) AS kept,
  (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT)::BIGINT AS failed FROM b
"""

_CONTROLS = "len(list_filter(range(1, length({0}) + 1), lambda i: substr({0}, i, 3) = '###' OR substr({0}, i, 7) = '</turn>' OR substr({0}, i, 1) = chr(92)))"
_OP7 = f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
sized AS (SELECT *, 14 + length(role) + length(text) + {_CONTROLS.format("text")} + {_CONTROLS.format("role")} + length(role) - length(replace(role, ':', '')) AS n FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM s WHERE payload_bytes >= 100 GROUP BY 1)
SELECT s.page_id, payload_bytes, s.payload_digest, CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM s.page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM s.page_id THEN first END AS refers_to
FROM s LEFT JOIN f ON s.payload_digest = f.payload_digest AND s.payload_bytes >= 100
"""


_VECTORS = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_OP11 = f"""
WITH {_VECTORS},
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.r <> x.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5
"""
_OP12 = f"""
WITH {_VECTORS},
l AS (SELECT r, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
s AS (SELECT a.r, a.vec_id AS anchor_id, x.r AS x, x.vec_id, a.label = x.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score FROM l a JOIN l x ON a.r <> x.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, x) AS n FROM s WHERE same),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.r = s.r WHERE p.n <= 5 AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
"""


def _op8(families: dict[str, str] | None = None) -> str:
    family = "CASE {0}.label " + " ".join(f"WHEN '{label}' THEN '{name}'" for label, name in (families or {}).items()) + " ELSE {0}.label END"
    same = f" AND {family.format('o')} = {family.format('a')}" if families else ""
    phrases = ", ".join(f"('{t}', '{label}')" for t, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{label}', '{t}')" for label, t in licenses.TEMPLATES.items())
    size, stride = licenses.BLOCK, licenses.STRIDE
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("text")} AS w FROM documents),
phrases AS (SELECT string_split(t, ' ') AS p, label FROM (VALUES {phrases}) v(t, label)),
templates AS (SELECT label, list_distinct(string_split(t, ' ')) AS p FROM (VALUES {templates}) v(label, t)),
places AS (SELECT r, i - 1 AS i, label FROM (SELECT r, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM docs, phrases WHERE len(w) >= len(p)) WHERE w[i : i + len(p) - 1] = p),
base AS (SELECT r, count(*)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
blocks AS (SELECT r, i, w[i + 1 : i + {size}] AS b FROM (SELECT r, w, unnest(range(0, greatest(len(w), 1), {stride})) AS i FROM docs)),
near AS (SELECT r, i, label, len(list_intersect(b, p)) / len(p)::DOUBLE AS part FROM blocks, templates WHERE len(list_intersect(b, p)) >= ceil({licenses.THRESHOLD} * len(p) - 1e-9)),
best AS (SELECT a.r, a.label, a.part FROM near a WHERE NOT EXISTS (SELECT 1 FROM near o WHERE o.r = a.r AND abs(o.i - a.i) <= {stride} AND o.part > a.part{same})),
told AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM best) GROUP BY r),
score AS (SELECT r, max(part) AS score FROM (SELECT r, part FROM near UNION ALL SELECT r, 1.0 FROM places) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN told USING (r) LEFT JOIN score USING (r)
"""


def oracle_sql() -> dict[str, str]:
    out = {
        "op2_decontamination": _OP2,
        "op5_quality_rules": _OP5,
        "op7_chat_formatting": _OP7,
        "op8_license_scan": _op8(licenses.FAMILIES),
        "op8_license_labels": _op8(licenses.FAMILIES),
        "op9_warc": _OP9,
        "op11_exact_topk": _OP11,
        "op12_hard_negatives": _OP12,
    }
    import corpus_pipeline

    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
