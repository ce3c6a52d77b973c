"""The dealt operators against brute-force versions, with nulls, empty and long texts, repeats, empty tables and odd columns."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import bpe_automaton, chat, decontaminate, graph, licenses, quality_classifier, quality_rules, shared, simhash, token_files, toxicity, warc
from lectern.llm.queries import tokenizer_path

LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"
NOTICE = "Licensed under the Apache License, Version 2.0. " + "word " * 30
LONG = " ".join(f"w{i % 97} x{i % 13}." for i in range(6000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here now."), (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (6, NOTICE), (7, NOTICE), (7, NOTICE), (7, "another text under the same id"),
    (8, "line one here\nline one here\n" * 8), (9, "élan NAÏVE <|endoftext|> a#b ### İstanbul ΣΑΣ 你好 😀 ½ 'S don'T"), (10, "one two"), (11, "The quick brown fox jumps over the lazy dog and runs far away from here today."), (None, "no id " * 12), (12, "x" * 5000),
]
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 13)]


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    """documents with columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), "k", 5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*LABELS, (None, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, start, ids = [], 0, []
    for i, t in order:
        e = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        start, ids = start + len(e), ids + e
    assert rows(token_files.token_files(spark, docs, tokenizer_path())) == sorted(want, key=repr)
    folder = token_files.new_folder(spark, "t")
    first = token_files.write_token_files(docs.coalesce(1), folder, tokenizer_path(), length=16, rows=3).orderBy("shard").first()
    tokens, mask = token_files.sequence(pa.memory_map(first["path"]), 4, rows=3)
    assert tokens.to_pylist() == ids[64:80] and mask.true_count == 16
    assert token_files.token_files(spark, docs.limit(0), tokenizer_path()).count() == 0


def test_decontamination(spark, docs):
    bench = [(1, "brown fox jumps over the lazy dog and runs far away"), (2, "one"), (3, ""), (4, None), (5, "under the same"), (None, "lazy dog"), (6, "one"), (7, LONG[:200])]
    table = spark.createDataFrame(bench, "item_id long, text string")
    wins = {}
    for i, t in bench:
        w = re.findall(LETTERS, fold(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = []
    for i, t in TEXTS:
        w = re.findall(LETTERS, fold(t))
        hit, items = set(), set()
        for g, its in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit, items = hit | set(range(k, k + len(g))), items | (its - {None})
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    assert rows(decontaminate.contamination(docs, table)) == sorted(want, key=repr)
    assert decontaminate.drop_contaminated(docs, table).count() == sum(not x[5] for x in want)
    assert decontaminate.contamination(docs, table.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), table).count() == 0


def test_decontamination_by_shuffle(spark, docs, monkeypatch):
    bench = [(1, "brown fox jumps over the lazy dog and runs far away"), (2, "one"), (None, "lazy dog"), (6, "one"), (7, LONG[:200])]
    table = spark.createDataFrame(bench, "item_id long, text string")
    want = rows(decontaminate.contamination(docs, table)), rows(decontaminate.drop_contaminated(docs, table))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = decontaminate.contamination(docs, table)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString().replace("autoBroadcast", "")
        assert (rows(got), rows(decontaminate.drop_contaminated(docs, table))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert decontaminate.drop_contaminated(docs.limit(0), table).count() == 0


def test_bpe(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in TEXTS:
        e = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(bpe_automaton.encode_decode(docs, tokenizer_path())) == sorted(want, key=repr)
    assert bpe_automaton.encode_decode(docs.limit(0), tokenizer_path()).count() == 0


def test_merge_automaton_against_merging():
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("aa", "a</w>"), ("b", "b"), ("bb", "b"), ("ab", "ab</w>"), ("a", "b</w>")]
    merges = [m for m in merges if m != ("ab", "ab</w>")] + [("ab", "ab</w>")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(["a", "b", "a</w>", "b</w>", *("".join(m) for m in merges)]))}
    auto = bpe_automaton.MergeAutomaton(vocab, merges)

    def merge(word):
        s = [*word[:-1], word[-1] + "</w>"]
        for u, v in merges:
            i, out = 0, []
            while i < len(s):
                if s[i : i + 2] == [u, v]:
                    out, i = [*out, u + v], i + 2
                else:
                    out, i = [*out, s[i]], i + 1
            s = out
        return [vocab[x] for x in s]

    for n in range(1, 10):
        for k in range(1 << n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert auto.encode(word) == merge(word), word


def test_quality_rules(spark, docs):
    want = []
    for i, t in TEXTS:
        w = re.findall(SPACED, t or "")
        c, cov = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                cov |= set(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if re.search(SPACED, x)]
        base = len(w) < 20 or 100 * len(cov) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov), base))
    led = quality_rules.ledger(docs)
    got = quality_rules.verdicts(led)
    assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=repr)
    assert got.where("base_failed and kept").count() == 0
    masks = [r["failed"] for r in led.collect()]
    told = {r["rule"]: (r["failed"], r["alone"]) for r in quality_rules.ablation(led).collect()}
    for b, (name, _) in enumerate(quality_rules.RULES):
        n = sum(m >> b & 1 for m in masks)
        assert told.get(name, (0, 0)) == (n, sum(m == 1 << b for m in masks))
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_licenses(docs):
    want = {}
    for i, t in TEXTS:
        w = re.findall(LETTERS, fold(t))
        places = [(k, label) for p, label in licenses.PHRASES.items() for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
        want.setdefault(i, []).append((len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:6])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert licenses.scan(docs.where("doc_id = 6")).first()["labels"] == "apache,apache-2.0"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_filters_drop_candidates_and_lose_none(spark):
    """Every block that meets the threshold passes the filters, and fewer pairs pass than share a word of a prefix."""
    rng = np.random.default_rng(4)
    vocabulary = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()}) + ["x", "y", "z"]
    texts = []
    for i in range(60):
        base = list(licenses.TEMPLATES.values())[i % len(licenses.TEMPLATES)].split()
        some = [w for w in base if rng.random() < 0.85] + list(rng.choice(vocabulary, rng.integers(0, 60)))
        texts.append((i, " ".join(some)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = docs.selectExpr("doc_id", "split(text, ' ') as words")
    known = licenses.patterns(spark, {}, licenses.TEMPLATES)
    met = licenses.candidates(words, known).where("label is not null").collect()
    passed = {(r["doc_id"], r["start"], r["label"]) for r in met}
    true, prefixed = set(), set()
    count = Counter(w for _, t in texts for w in t.split())
    for i, t in texts:
        w = t.split()
        for at in range(0, len(w), licenses.STRIDE):
            block = set(w[at : at + licenses.BLOCK])
            for label, said in licenses.TEMPLATES.items():
                toks = set(said.split())
                need = int(np.ceil(0.8 * len(toks) - 1e-9))
                prefix = sorted(toks, key=lambda x: (count[x], x))[: len(toks) - need + 1]
                if block & set(prefix):
                    prefixed.add((i, at, label))
                if len(block & toks) >= need:
                    true.add((i, at, label))
    assert true <= passed < prefixed and len(true) > 60
    positional = {(r["doc_id"], r["start"], r["label"]) for r in met if r["shared"] < r["need"]}
    assert len(passed) < len(prefixed) and len(passed) - len(positional) == len(true)


def test_licenses_of_other_families_stay(spark):
    texts = ["Copyright 2020 Acme. All rights reserved. Redistribution and use in source form, with or without modification, are permitted", "Licensed under the GNU General Public License version 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs, families=licenses.FAMILIES).collect()} == {0: "bsd-clause,reserved", 1: "gpl,gpl-3.0"}


def toxic_table(spark, n=240):
    rng = np.random.default_rng(3)
    out, known = [], []
    for i in range(n):
        words = [f"v{rng.integers(26) + 97:c}{rng.integers(26) + 97:c}{chr(97 + rng.integers(26))}" for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[5] = words[20] = ["blorg", "zmeck"][i // 4 % 2]
        out.append((i, " ".join(words)))
        known.append((i, 1, int(bad)))
    out += [(1000, "such a Bl0rg here, a BLORG and zмeck zmeck indeed"), (1001, "plain words of no harm at all"), (1002, None), (1003, ""), (1001, "plain words of no harm at all")]
    return spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, labels):
    table, known = toxic_table(spark)
    got = toxicity.toxicity(table, known)
    by = {r["doc_id"]: r for r in got.collect()}
    right = [by[i]["predicted"] == (i % 4 == 0) for i in range(240) if by[i]["held_out"]]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    assert by[1000]["predicted"] == 1 and by[1001]["predicted"] == by[1002]["predicted"] == by[1003]["predicted"] == 0
    assert got.count() == table.count() and all(0 <= r["score"] <= 1 for r in by.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by.items())
    assert toxicity.drop_toxic(table, known).where("doc_id in (1000, 1001)").count() == 2
    assert toxicity.toxicity(docs, labels).count() == len(TEXTS)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_exceptions_spare_terms():
    model = toxicity.ToxicityModel({" clown ": 3.0}, (), ("clown fish",))
    assert toxicity.evidence(["a", "clown", "fish"], model.automaton())[0] == 0 < toxicity.evidence(["a", "clown"], model.automaton())[0]


def test_evidence_against_naive_matching():
    rng = np.random.default_rng(5)
    alphabet = "abc"
    draw = lambda n: "".join(alphabet[k] for k in rng.integers(0, 3, n))
    for _ in range(200):
        lexicon = {}
        for _ in range(8):
            word = draw(rng.integers(1, 6))
            lexicon[f" {word} " if rng.random() < 0.5 else f" {word}"] = float(rng.integers(1, 9))
        spared = tuple(f"{draw(2)} {draw(2)}" for _ in range(2))
        words = [draw(rng.integers(1, 7)) for _ in range(rng.integers(0, 30))]
        best = {}
        for k, w in enumerate(words):
            if any(words[j : j + 2] == p.split() for p in spared for j in (k - 1, k) if j >= 0):
                continue
            found = [x for t, x in lexicon.items() if t == f" {w} " or not t.endswith(" ") and f" {w}".startswith(t) and len(w) >= len(t)]
            if found:
                best[w] = max(found)
        total = sum(best.values())
        want = (np.log1p(total), total / max(20, len(words)), total / max(20, len(words)) ** 0.5, max(best.values(), default=0.0))
        assert np.allclose(toxicity.evidence(words, toxicity.ToxicityModel(lexicon, (), spared).automaton()), want)


def test_scores_of_empty_tied_and_repeated_texts(spark):
    table, known = toxic_table(spark)
    toxic = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table, known).collect()}
    assert toxic[1002] == toxic[1003] == toxic[1001] < 0.5
    same = [r["score"] for r in toxicity.toxicity(table, known).where("doc_id = 1001").collect()]
    assert len(same) == 2 and same[0] == same[1]
    judged = quality_classifier.quality(table.selectExpr("*", "'en' as lang", "'s' as source"), known).collect()
    good = {}
    for r in judged:
        good.setdefault(r["doc_id"], set()).add(r["score"])
    assert good[1002] == good[1003] and all(len(x) == 1 for x in good.values())


def test_quality_against_numpy(spark, monkeypatch):
    """Posteriors and scores once more from chances, labels and sites, without Spark."""
    rng = np.random.default_rng(9)
    table = [(i, " ".join(f"w{x}{'!' * (i % 3)}" for x in rng.integers(0, 50, 5 + i % 40)), "abc"[i % 3], f"h{i % 7}" if i % 11 else None) for i in range(300)]
    known = [(i, int(rng.random() < 0.7), 0) for i in range(0, 300, 2)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_classifier.quality(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()}
    y = {i: q for i, q, _ in known if zlib.crc32(str(i).encode()) % 3 != 1}
    weight = {i: 1.0 if i in y else quality_classifier.EVIDENCE for i, *_ in table}
    good = {i: weight[i] * y.get(i, got[i]["chance"]) for i, *_ in table}

    def strength(mean, n, spread, sites):
        between = spread / n - mean * (1 - mean) * (sites - 1) / n
        k = mean * (1 - mean) / between - 1 if between > 0 else np.inf
        return min(max(k, quality_classifier.STRENGTH[0]), quality_classifier.STRENGTH[1])

    def sums(key):
        out = {}
        for i, _, lang, source in table:
            g, n = out.get(key(source, lang), (0.0, 0.0))
            out[key(source, lang)] = (g + good[i], n + weight[i])
        return out

    hosts, paths = sums(lambda s, p: s), sums(lambda s, p: (s, p))
    n = sum(weight.values())
    mean = sum(good.values()) / n
    k = strength(mean, n, sum(m * (g / m - mean) ** 2 for g, m in hosts.values()), len(hosts))
    host = {s: (g + k * mean) / (m + k) for s, (g, m) in hosts.items()}
    k = strength(mean, n, sum(m * (g / m - host[s]) ** 2 for (s, _), (g, m) in paths.items()), len(paths))
    logit = lambda p: np.log(p / (1 - p))
    for i, _, lang, source in table:
        g, m = paths[source, lang]
        site = (g + k * host[source]) / (m + k)
        assert np.isclose(got[i]["site"], site)
        assert np.isclose(got[i]["score"], 1 / (1 + np.exp(-(logit(got[i]["chance"]) + logit(site) - logit(mean)))))


def test_quality_classifier(spark, docs, labels):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 211}" for k in range(60)), "en", f"h{i % 3}") for i in range(150)]
    bad = [(i, " ".join(f"w{k}%%% ###" for k in range(60)), "en", f"h{i % 3}") for i in range(150, 200)]
    table = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = [r for r in quality_classifier.quality(table, known).collect() if r["held_out"]]
    assert got and all(r["predicted"] == (r["doc_id"] < 150) for r in got)
    assert quality_classifier.drop_poor(table, known).where("doc_id >= 150").count() <= 2
    assert quality_classifier.quality(docs, labels).count() == len(TEXTS)
    assert quality_classifier.quality(docs.limit(0), labels.limit(0)).count() == 0


def test_filters_keep_columns_as_they_are(spark):
    names = "doc_id text host path p posterior score row y _key key _x lang source big".split()
    table = spark.createDataFrame([(i, "good plain words " * 9, *[None if i % 2 else "z"] * 12, None if i % 2 else 2**62 + i) for i in range(6)], ", ".join(f"{n} {'long' if n in ('doc_id', 'big') else 'string'}" for n in names))
    known = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string")
    want = rows(table)
    for kept in (toxicity.drop_toxic(table, known), quality_classifier.drop_poor(table, known), decontaminate.drop_contaminated(table, bench)):
        assert kept.columns == names and rows(kept) == want
    assert simhash.one_of_each(spark, table).columns == names


def test_sparse_sites_shrink(spark):
    sites = spark.createDataFrame([("a", "x", 0.0, 1.0), ("a", "y", 900.0, 1000.0), ("b", "x", 100.0, 1000.0)], "host string, path string, good double, n double")
    got = {(r["host"], r["path"]): r["posterior"] for r in quality_classifier.site_posteriors(sites)[0].collect()}
    assert got["a", "x"] > 0.5 > got["b", "x"] and abs(got["a", "y"] - 0.9) < 0.05


def test_chat(spark):
    hard = ["####", "\\", "a\\###b</turn></turn>", "#####</turn>\\\n: x", "\\\\###", "", "é\U0001f600"]
    table = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(2, 0, "a: b\\", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "lost")]
    got = {r["conv_id"]: r for r in chat.formatted_digests(spark, spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, None, -7} and got[2]["n_turns"] == 3
    said = "".join(t for k, t in enumerate(hard) if k % 2)
    assert got[1]["loss_chars"] == len(said) and got[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    turns = "".join(f"{r}\n{t}\n" for _, _, r, t in table[: len(hard)])
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    probe = r"\### Assistant: </turn> ok"
    assert got[-7]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()


def test_chat_folds_events(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 0, "message", "assistant", ""), (1, 1, 1, "delta", "assistant", "wro"), (1, 1, 2, "regenerate", "assistant", None), (1, 1, 3, "delta", "assistant", "ri"), (1, 1, 4, "delta", "assistant", "ght"), (1, 0, 1, "edit", "user", "hello")]
    out = chat.format_chats(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string"))
    assert [chat.parse(r["formatted"]) for r in out.orderBy("turn", "part").collect()] == [("user", "hello"), ("assistant", "right")]


def test_warc(spark):
    page = "<p>" + "a" * 200 + "é</p>"
    table = [(5, "http://A.com:80/x?b#f", page), (3, "https://www.a.com/x", page), (9, None, page), (4, "http://b.org", "short"), (6, "http://b.org", "short"), (7, "u r\nl", None), (3, "https://www.a.com/x", page), (None, "http://c.net/", page)]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    got = rows(warc.archives(spark, df))
    want = []
    for i, _, h in table:
        b = (h or "").encode()
        first = 3 if len(b) >= 100 else i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(want, key=repr)
    assert warc.archives(spark, df.limit(0)).count() == 0
    # columns of other uses, and capture times, some of them null
    more = df.selectExpr("*", "cast(null as string) as ts", "1 as digest", "'f' as file", "if(page_id > 4, '2020-01-01T00:00:00Z', null) as seen")
    assert rows(warc.archives(spark, more, captured=more["seen"])) == got == rows(warc.archives(spark, more))


def test_index_is_in_global_order(spark, monkeypatch):
    df = spark.range(60).selectExpr("id as page_id", "concat('http://h', id % 7, '.com/', id % 5) as url", "repeat('z', cast(id as int)) as html").repartition(6)
    folder = warc.new_folder(spark, "warc")
    runs = warc.write_archives(df, folder)
    monkeypatch.setattr(warc, "FAN_IN", 2)
    got = [tuple(r) for r in warc.merged_index(spark, folder, runs, ranges=3).collect()]
    assert got == sorted(got) and len(got) == 60 and runs.count() == 6  # three passes: whole runs, runs by range, rows
    assert warc.merged_index(spark, folder, runs.limit(0), ranges=3).count() == 0
    one = df.selectExpr("page_id", "'http://one.org/' as url", "html")  # captures of one URL are dealt over ranges, too
    index = warc.merged_index(spark, folder := warc.new_folder(spark, "warc"), warc.write_archives(one, folder), ranges=3)
    sizes = [r["count"] for r in index.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 40


@pytest.mark.parametrize("k", [1, 2, 3, 7, 64])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted((int(x), i) for x in rng.integers(0, 50, rng.integers(0, 9))) for i in range(k)]
    assert list(warc.LoserTree(map(iter, runs))) == sorted(x for r in runs for x in r)


def brute_print(t):
    w = re.findall(SPACED, fold(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    near = [(20, LONG), (21, LONG + " w5"), (22, LONG.replace("x3.", "x3", 1))]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string")).where("doc_id is not null")
    all_ = [x for x in [*TEXTS, *near] if x[0] is not None]
    prints = [brute_print(t) for _, t in all_]
    parent = list(range(len(all_)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(all_)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for k, (i, _) in enumerate(all_):
        low[root(k)] = min(i, low.get(root(k), i))
    want = [(i, f"{prints[k]:016x}", low[root(k)]) for k, (i, _) in enumerate(all_)]
    assert rows(simhash.near_duplicates(spark, table)) == sorted(want, key=repr)
    kept = [r["doc_id"] for r in simhash.one_of_each(spark, table).collect()]
    assert 5 in kept and not {20, 21, 22} & set(kept) and len(kept) == len(set(kept))
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_forest_by_both_ways(monkeypatch):
    rng = np.random.default_rng(1)
    members = np.unique(np.array([0x123456789ABCDEF0 ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 7), replace=False)) for _ in range(3000)], np.uint64).view(np.int64))
    small = simhash.forest(members)
    monkeypatch.setattr(simhash, "PAIRWISE", 10)
    assert len(small) == len(simhash.forest(members)) and all((a ^ b).bit_count() <= 3 for a, b in small)


def grouped(pairs, nodes):
    """The smallest node that pairs reach from each of nodes."""
    low = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_forest_of_many_members():
    """Lists over PAIRWISE, sparse and dense, and one that one bit joins, have the components of the tally."""
    rng = np.random.default_rng(7)
    for n, bits in ((4000, 24), (4000, 13), (9000, 16)):
        members = np.unique(rng.integers(0, 1 << bits, n)) << 40
        roots = {}
        for links in (simhash.tallied_forest(members), simhash.forest(members)):
            up = {m: m for m in members.tolist()}

            def top(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in ((int(a), int(b)) for a, b in links):
                assert ((a ^ b) % 2**64).bit_count() <= 3
                assert (high := max(top(a), top(b))) != (low := min(top(a), top(b)))  # a link never closes a circle
                up[high] = low
            roots[len(roots)] = {m: top(m) for m in up}
        assert roots[0] == roots[1]


#: XORs with bit 63 that make three bits at most, or more; signed counts give 1 for 0xF0... and 63 for 0x80...01.
TOP_BITS = [0x8000000000000001, 0x8000000000100000, 0xC000000000000001, 0xF000000000000000, 0xFFFFFF0000000000, 0x8000000000000007]


@pytest.mark.parametrize("pairwise", [2048, 1])
def test_forest_counts_the_top_bit(monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(2)
    for xor in TOP_BITS:  # the members of a list differ in three bytes at most
        some = [0x123456789ABCDEF0, 0x123456789ABCDEF0 ^ xor]
        free = [b for b in range(64) if xor >> (b // 8 * 8) & 0xFF]
        more = [some[0] ^ sum(1 << int(b) for b in rng.choice(free, rng.integers(1, 6), replace=False)) for _ in range(40)]
        for prints in (some, some + more):
            members = np.unique(np.array(prints, np.uint64).view(np.int64))
            nodes = members.tolist()
            brute = [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
            assert grouped(simhash.forest(members), nodes) == grouped(brute, nodes)


@pytest.mark.parametrize("longest", [8192, 3])
def test_links_against_brute_force(spark, monkeypatch, longest):
    """Links of lists by four bytes, and of those dealt anew by five, keep the components of brute force."""
    monkeypatch.setattr(simhash, "LONGEST", longest)
    rng = np.random.default_rng(6)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    prints = {int(x) for x in rng.integers(0, 2**63, 40)}
    for base in list(prints)[:12]:
        prints |= {flip(base, k) for k in rng.integers(1, 6, 12)}
    chain = [5]
    for _ in range(30):
        chain.append(flip(chain[-1], 2))
    prints = sorted(prints | set(chain))
    signed = dict(zip(prints, np.array(prints, np.uint64).view(np.int64).tolist(), strict=True))
    brute = [(signed[a], signed[b]) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long")).collect()]
    assert set(map(frozenset, found)) <= set(map(frozenset, brute))
    assert grouped(found, signed.values()) == grouped(brute, signed.values())


def test_lists_hold_any_five_positions():
    from itertools import combinations

    lists = simhash._lists(4)
    assert all(any(set(c) <= set(five) for c in lists) for five in combinations(range(8), 5))


def test_near_duplicates_count_the_top_bit(spark, monkeypatch):
    bases = [int(x) for x in np.random.default_rng(3).integers(0, 2**63, len(TOP_BITS) + 1)]
    prints = [x for base, xor in zip(bases, TOP_BITS, strict=False) for x in (base, base ^ xor)] + [bases[-1] ^ x for x in (0, *TOP_BITS)]
    brute = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    low = grouped(brute, range(len(prints)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(i, x, i, 0) for i, x in enumerate(signed)], "doc_id long, fp long, h long, n int")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, table).collect()}
    assert got == low and len(set(low.values())) > 5


def test_one_row_of_each_component_stays(spark):
    """Rows without an id, or with the id of another text, are members of components of their own."""
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"]
    table = [
        (None, words[0]), (None, words[0]), (None, words[1]), (None, words[2]), (9, words[2]), (1, words[3]), (1, words[4]), (1, words[4]), (3, words[4]),
        (1, words[5]), (0, words[5]), (2, words[6]), (2, words[6]), (4, ""), (None, None), (5, " "),
    ]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    want = [(None, words[0]), (None, words[1]), (9, words[2]), (1, words[3]), (1, words[4]), (0, words[5]), (2, words[6]), (4, "")]
    assert rows(simhash.one_of_each(spark, docs)) == sorted(want, key=repr)
    assert rows(simhash.one_of_each(spark, docs.where("doc_id is null"))) == sorted([*((None, x) for x in words[:3]), (None, None)], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (101, 102), (7, 7)]
    got = {}
    for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(31)), [100, 101, 102]]


def test_pipeline_stages_apply(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    table, known = toxic_table(spark)
    table = table.where("text is not null and text <> ''").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    dup = table.where("doc_id = 1").selectExpr("2000L as doc_id", "text", "lang", "source", "n_chars")
    leak = spark.createDataFrame([(3000, "some words before " + NOTICE[:40] + " and the secret passage of ten plain words in a row here it ends", "en", "s", 1)], table.schema)
    table.union(dup).union(leak).write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the secret passage of ten plain words in a row here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = []
    new = shared.new_folder
    monkeypatch.setattr(shared, "new_folder", lambda s, what: made.append(new(s, what)) or made[-1])
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [x for x in made if os.path.isdir(x.removeprefix("file://"))]
    assert len(made) > 10 and not left
    assert rows(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)) == []
    assert not ids & {2000, 3000, 0, 4, 8} and {1, 2, 3, 5} <= ids
