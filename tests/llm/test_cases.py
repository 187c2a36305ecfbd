"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; and the methods' own parts."""

import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from gneiss.llm import bpe, chat_format, html_extract, language_id, license_scan, merkle, mixing, ngram_join, quality_rules, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, labels string, _words string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "a b c d", "A b  C d\te f.", "same text of a few words here it is", "same text of a few words here it is", LONG, LONG + " end", "x" * 50_000, "é ß 漢字 🙂\n\n\nnext\n", "Licensed under the Apache License, Version 2.0.\nMIT License mit license"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "x", "x", "x", "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None, None), rows[6]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def one(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def test_quality_rules(odd):
    out = quality_rules.quality_rules(odd)
    assert {"score", "_words"} <= set(out.columns) and out.count() == len(TEXTS) + 2
    for r in out.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(r["text"])
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_repeated_words_in_both_forms(spark):
    texts = ["a b c a b c a b c d", " ".join(f"{i} y z" for i in range(100)) * 2, "a b a b a b", "x y z " * 300, r"\E q \E q \E q \E", "a b c x a b c", "p q r s p q r t q r s p"]
    many = " ".join(f"u{i} v{i} w{i}." for i in range(200))
    texts.append(f"{many} {many}")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in quality_rules.quality_rules(df).collect():
        assert r["n_repeat_words"] == brute.quality(r["text"])[4]


def test_line_rules(spark):
    good = "This is a line of clean prose that ends as it should."
    bad = ["home login search", "Home | About | Contact | Help", "a*** b### c$$$ d%%%", "All Rights Reserved.", "one two three four five six seven eight nine ten eleven twelve", good]
    r = quality_rules.quality_rules(spark.createDataFrame([("\n".join([good, *bad]),)], "text string")).first()
    assert r["cleaned_text"] == good


GOOD_LINE = "This is a line of clean prose that ends as it should."
PLAIN_LINE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("ends", ["\n", "\r\n", " \r\n\n", "\u2028\n", "\x85\n"])
def test_lines_end_at_a_line_feed_alone(spark, ends):
    """Lines that fail a rule fail it whatever else stands at their ends, and in any case of letters."""
    bad = [PLAIN_LINE, "pRivacy pOlicy here.", "Terms OF uSe apply.", "a | b | c | d", "a*** b### c$$$ d%%%"]
    # other ends than white space belong to the last word, which then is no menu word
    bad += ["HoMe LOGIN sEarch", "\tmenu next"] if ends.isascii() else []
    for line in bad:
        texts = [ends.join([GOOD_LINE, line, "Here is more of it, as well."]), ends.join([f"{line}", f"{GOOD_LINE}"]), ends.join([GOOD_LINE, line])]
        for r in quality_rules.quality_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
            assert r["kept_share"] < 1.0 and line.strip() not in r["cleaned_text"] and "clean prose" in r["cleaned_text"]


def test_every_line_rule_against_a_plain_reading(spark):
    """Cleaned texts equal those of a plain loop over lines, for texts of random lines and line ends."""
    rng = np.random.default_rng(4)
    pool = [GOOD_LINE, PLAIN_LINE, "home", "Home about", "homely words", "x | y | z | w", "Back To Top", "short line", "#tag #tag", "a" * 30, PLAIN_LINE.replace(" ", "\x0b"), "", " ", "all rights reserved", "menu\u00a0x"]
    texts = ["".join(str(rng.choice(pool)) + str(rng.choice(["\n", "\r\n", "\n\n", " \n", "\r", "\u2028"])) for _ in range(int(rng.integers(1, 9)))) for _ in range(250)]

    def fails(line):
        w = brute.WS.findall(line)
        symbols, bars, marked = sum(c in "#*$%&|<>" for c in line), sum(c in "|»›→·" for c in line), any(c in ".!?…。！？؟।" for c in line)
        low = [x.lower() for x in w]
        return symbols > 0.3 * max(len(w), 1) or (bars >= 3 and 2 * bars >= len(w)) or (not marked and len(w) >= 12) or any(p in line.lower() for p in quality_rules.BOILERPLATE) or (not marked and len(w) <= 8 and all(x in quality_rules.MENU for x in low))

    def cleaned(text):
        return "\n".join(x for x in dict.fromkeys(text.split("\n")) if brute.WS.search(x) and not fails(x))

    for r in quality_rules.quality_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert r["cleaned_text"] == cleaned(r["text"])


CLASHES = ["one", "lines", "windows", "unique", "may_plain", "fields", "Lower", "_one", "_kept", "_any", "_n", "_p", "_d", "_base", "any_", "key", "row", "hits"]


@pytest.mark.parametrize("apply", [quality_rules.quality_rules, license_scan.license_scan, lambda d: language_id.language_id(d, language_id.Profiles({}, language_id.LanguageParams())), lambda d: bpe.bpe_digest(d, bpe.default_path()), lambda d: bpe.bpe_encode(d, bpe.default_path()), lambda d: toxicity.toxicity(d, toxicity.train([], []))])
def test_other_columns_stay(spark, apply):
    df = spark.createDataFrame([("some words of a text", *CLASHES)], "text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    r = apply(df).first().asDict()
    assert [r[c] for c in CLASHES] == CLASHES and r["text"] == "some words of a text"


def test_licenses(odd):
    out = license_scan.license_scan(odd)
    for r in out.collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.license_base(r["text"])
    assert license_scan.license_scan(odd.limit(0)).count() == 0


def test_license_join_equals_a_plain_one(spark):
    """Prefix, length and position filters lose no block, over texts of several lines."""
    rng = np.random.default_rng(1)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + ["foo", "bar"] * 40
    texts = []
    for _, t in license_scan.TEMPLATES:
        for _ in range(6):
            words = t.split()
            for _ in range(int(rng.integers(0, len(words) // 3 + 1))):
                k = int(rng.integers(len(words)))
                words[k : k + 1] = [[], ["foo"], [words[k], "bar"], ["the"]][int(rng.integers(4))] or []
            texts.append(" ".join(rng.choice(pool, int(rng.integers(0, 20)))) + "\n" + "".join(w + str(rng.choice([" ", "\n", ", ", "\r\n  "])) for w in words) + " ".join(rng.choice(pool, 9)))
    texts += [" ".join(rng.choice(pool, 60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for threshold in (0.6, 0.9):
        for r in license_scan.license_scan(df, threshold=threshold).collect():
            have, want = brute.re.findall("[a-z0-9]+", r["text"]), []
            for label, t in license_scan.TEMPLATES:
                tokens, width = set(t.split()), len(t.split()) * 3 // 2
                for i, w in enumerate(have):
                    share = len(tokens & set(have[i : i + width])) / len(tokens)
                    if w in tokens and share >= threshold - 1e-9:
                        want.append((label, pytest.approx(share), i))
            assert [tuple(b) for b in r["blocks"]] == want


WRAPPED = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "apache-2.0-notice": """# Licensed under the Apache License, Version 2.0 (the "License");\r
# you may not use this file except in compliance with the License.\r
# You may obtain a copy of the License at\r
#\r
#     http://www.apache.org/licenses/LICENSE-2.0\r
#\r
# Unless required by applicable law or agreed to in writing, software\r
# distributed under the License is distributed on an "AS IS" BASIS,\r
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\r""",
}


def test_wrapped_notices(spark):
    """Notices over several lines, after and before other text; the same words far apart are none."""
    prose = "Some lines of prose stand here.\nThey go on and on.\n"
    texts = [prose + t + "\n" + prose for t in WRAPPED.values()] + [(prose * 4).join(WRAPPED["mit-text"].split())]
    got = [r["labels"].split(",") for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert all(label in g for label, g in zip(WRAPPED, got)) and got[-1] == [""]


def test_phrases_that_overlap_themselves(spark):
    r = license_scan.license_scan(spark.createDataFrame([("A a a! b a",)], "text string"), phrases=(("a a", "x"),)).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (2, 0, 1, "x")


def test_merkle(spark, odd):
    out = merkle.op5_merkle(odd)
    assert out.count() == len(TEXTS) + 2
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute.merkle(list(enumerate(TEXTS)))
    assert {i: (got[i]["n_chars"], got[i]["edited_sha256"]) for i in want} == want
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[6]["near_next"] == 1.0
    assert merkle.op5_merkle(odd.limit(0)).count() == 0
    for k, i in enumerate(sorted(want)):
        own, after = (TEXTS[j] or "" for j in (i, sorted(want)[(k + 1) % len(want)]))
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        trees = [brute.merkle_tree(t) for t in (own, edited, after)]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (trees[0][0], trees[1][0])
        assert got[i]["near_edited"] == pytest.approx(1.0 if trees[0][0] == trees[1][0] else brute.tree_likeness(trees[0][1], trees[1][1]))
        assert got[i]["near_next"] == pytest.approx(brute.tree_likeness(trees[0][1], trees[2][1]))


def test_tree_likeness_and_place_of_an_edit(spark):
    """Random texts of few sentences, so that equal nodes recur at every level, on either side and in other places."""
    rng = np.random.default_rng(8)
    text = lambda: "".join(str(rng.choice(["A one. ", "Two! ", "B", "c? ", " "])) + str(rng.choice(["", "", "\n", "\n\n", "\n \n"])) for _ in range(int(rng.integers(0, 12))))
    pairs = [(text(), text()) for _ in range(300)] + [("A one. Two.\n\nB.", "A one. Two.\n\nC."), ("a", "a\n\nb"), ("a\n\nb", "a")]
    df = spark.createDataFrame(pairs, "x string, y string").select("*", merkle.tree(F.col("x")).alias("a"), merkle.tree(F.col("y")).alias("b"))
    rows = df.select("x", "y", F.col("a.root").alias("root"), merkle.likeness(F.col("a.sections"), F.col("b.sections")).alias("near"), merkle.first_difference(F.col("a.sections"), F.col("b.sections")).alias("first")).collect()
    for r in rows:
        (root, a), (_, b) = brute.merkle_tree(r["x"]), brute.merkle_tree(r["y"])
        assert r["root"] == root and r["near"] == pytest.approx(brute.tree_likeness(a, b))
        assert r["first"] == next((i for i, s in enumerate(a) if i >= len(b) or b[i][0] != s[0]), None)
    assert [r["first"] for r in rows[-3:]] == [1, None, 1]


def test_bpe(odd):
    p = bpe.default_path()
    out = bpe.bpe_decode(bpe.bpe_encode(odd, p), p)
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in out.collect())
    assert bpe.bpe_encode(odd.limit(0), p).count() == 0


def test_transducer_keeps_little(spark):
    v = bpe.vocabulary(bpe.default_path())
    t, ids, most = bpe.Transducer(v), [], 0
    data = ("abcde" * 4000).encode()
    for k in range(0, len(data), 100):
        ids += t.push(data[k : k + 100])
        most = max(most, len(t.data))
    ids += t.end()
    assert b"".join(v.bytes_of[i] for i in ids) == data and most < 1000
    assert ids == bpe.np.frombuffer(b"".join(bpe.Encoder(v).encode(data.decode())), "<u4").tolist()


def test_languages(odd):
    p = language_id.fit_languages(odd)
    out = {r["doc_id"]: r for r in language_id.language_id(odd, p).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == "und" and out[0]["score"] == 0.0
    none = language_id.fit_languages(odd.limit(0))
    assert {r["lang_pred"] for r in language_id.language_id(odd, none).collect()} == {"und"}
    g, n = language_id.ngram_counts("Ab ab!")
    assert n[g == ord("a")].tolist() == [2] and n[g == (ord("a") | ord("b") << 21 | ord(" ") << 42)].tolist() == [2]


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        m = toxicity.fit_toxicity(odd, lab)
        out = toxicity.toxicity(odd, m)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in out.collect())
    texts = [f"some words {'awfulness' if i % 3 == 0 else 'kindness'} in line {i} of a text" for i in range(300)]
    m = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)])
    s = m.scorer()
    assert s("here is awfulness again") > 0.7 > s("here is kindness again") and s("it is awfulnes now") > s("it is plain now")
    assert 0 <= s(None) <= 1


def test_toxicity_scores_against_plain_loops(odd):
    """Every window counts: scores equal those of loops over a frozen model, and a telling word counts at any place."""
    rng = np.random.default_rng(6)
    plain = [f"w{i}" for i in range(300)]
    texts = [" ".join([*rng.choice(plain, 30), *(["awfulness"] if i % 3 == 0 else []), *rng.choice(plain, int(rng.integers(0, 9)))]) for i in range(300)]
    m = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)])
    got = {r["text"]: r["score"] for r in toxicity.toxicity(odd, m).collect()}
    p = m.p
    for t in [*got, *texts[:40]]:
        want = brute.toxicity_score(t, m.part, m.bias, m.slope, m.offset, p.window, p.buckets, p.shortest, p.longest)
        assert (got[t] if t in got else m.scorer()(t)) == pytest.approx(want, abs=1e-9)
    places = [m.scorer()(" ".join([*plain[:k], "awfulness", *plain[k:40]])) for k in range(0, 41)]
    assert min(places) > 0.7
    assert toxicity.toxicity(odd.limit(0), m).count() == 0


def test_toxicity_of_repeated_ids(spark):
    """Which rows are learned from doesn't depend on their order: of an id the smallest text counts."""
    rows = [(i % 50, f"text {i} {'bad' if i % 50 < 20 else 'good'}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(50)] * 2, "doc_id long, toxic int")
    fits = [toxicity.fit_toxicity(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 5))]
    assert np.array_equal(fits[0].part, fits[1].part) and (fits[0].slope, fits[0].offset) == (fits[1].slope, fits[1].offset)


def test_languages_against_plain_dictionaries(spark):
    rows = [r for r in duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()] if os.path.isdir("/root/testdata/sf0.001") else []
    rows = rows[:60] + [(900, "abc déf", "x"), (901, "Zzz zz z", "y"), (902, "e\u0301a \u0301", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language_id.LanguageParams(profile=60)
    known = language_id.fit_languages(df, p)
    learned = [(t, lang) for i, t, lang in rows if lang is not None and brute.zlib.crc32(str(i).encode()) % 4 != 2]
    profiles = {x: brute.rank_order(sum((brute.ngrams(t) for t, lang in learned if lang == x), brute.Counter()), 60) for x in {lang for _, lang in learned}}
    texts = [t for _, t, _ in rows] + [*TEXTS, "\u0301\u0302", "1 2 3", "ab", "¿é?"]
    got = language_id.language_id(spark.createDataFrame([(t,) for t in texts], "text string"), known).collect()
    for r in got:
        assert r["lang_pred"] == brute.language(r["text"], profiles, 60) and (r["score"] == 0.0) == (r["lang_pred"] == "und")
    assert language_id.language_id(df.limit(0), known).count() == 0


def test_ngram_join(spark, odd):
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_components(odd).collect() if r[0] is not None}
    want = brute.components(list(enumerate(TEXTS)))
    assert got == want
    assert ngram_join.ngram_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("params", [ngram_join.JoinParams(), ngram_join.JoinParams(group_rows=3, block_rows=4, sample_docs=1, orders=1), ngram_join.JoinParams(group_rows=2, block_rows=2, orders=1, fan_out=2)])
def test_ngram_join_near_the_threshold(spark, params):
    """Chains of edits whose neighbours lie on either side of the threshold, and a passage in all of them."""
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(30)]
    docs = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(int(rng.integers(20, 120)))]
        for _ in range(8):
            docs.append((len(docs), " ".join(shared[: int(rng.integers(0, 31))] + words)))
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"n{rng.integers(1 << 30)}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.ngram_components(df, params, counts=True).select("doc_id", "n_shingles", "component_id", "n_links", "n_texts_linked").collect()
    assert sorted(map(tuple, got)) == sorted(brute.join_rows(docs))


@pytest.mark.parametrize("params", [ngram_join.JoinParams(), ngram_join.JoinParams(orders=0), ngram_join.JoinParams(orders=0, group_rows=2, block_rows=3, block_tokens=200, sample_docs=1)])
def test_ngram_join_of_repeated_ids(spark, params):
    """Rows of one id with equal and other texts, and rows without an id: components and numbers of links."""
    rng = np.random.default_rng(11)
    docs = [(5, "a b c d e f g h"), (5, "p q r s t u v w"), (3, "a b c d e f g h"), (7, "P q r s t u v w"), (5, ""), (8, None), (8, "a b c d e f g h"), (None, "p q r s t u v w"), (None, "x y"), (9, "x y z")]
    for g in range(5):
        words = [f"g{g}w{i}" for i in range(40)]
        for _ in range(7):
            docs.append((int(rng.integers(20, 45)) if rng.random() < 0.9 else None, " ".join(words)))
            if rng.random() < 0.7:
                words[int(rng.integers(len(words)))] = f"n{rng.integers(1 << 30)}"
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_components(df, params, counts=True).select("doc_id", "n_shingles", "component_id", "n_links", "n_texts_linked").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.join_rows(docs), key=str)


def test_overlaps_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 200)))).astype(np.uint64) for _ in range(40)]
    a, b = np.nonzero(rng.random((40, 40)) < 0.5)
    assert ngram_join.overlaps(sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]


def test_signature_tree_bounds():
    rng = np.random.default_rng(2)
    p = ngram_join.JoinParams()
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 300, replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 90))).astype(np.uint64)])) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    sid, bits, yes = np.arange(60), [ngram_join.signature(s) for s in sets], np.ones(60, bool)
    a, b = ngram_join.group_pairs(sid, n, sid, bits, yes, yes, p)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(60):
        for j in range(i + 1, 60):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 5 * k >= 4 * (n[i] + n[j] - k):
                assert (i, j) in found


def test_mixing(spark, odd):
    out, _ = mixing.mix(odd)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(odd.limit(0))[0].count() == 0
    assert mixing.mix(odd.where("doc_id = 1"))[0].collect()[0]["taken"] == 0
    # many buckets and blocks
    big = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 37 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    got = mixing.mix(big, bucket_docs=100, block_words=50)[0].groupBy("target").agg(F.sum("taken").alias("t"), F.max(F.expr("taken - 2 * size")).alias("over")).collect()
    # two sources of one weight may have equal targets
    assert len(got) > 1 and all(min(abs(r["t"] - k * r["target"]) for k in (1, 2)) <= 0.02 * r["target"] and r["over"] <= 0 for r in got)


@pytest.mark.parametrize("few", [50_000, 0])
def test_mix_against_a_plain_schedule(spark, monkeypatch, few):
    """Taken words of each document, with sources broadcast and joined by shuffles; a null source, an empty one, one that stops at its size."""
    monkeypatch.setattr(mixing, "small", lambda df, n, most=few: F.broadcast(df) if n <= most else df)
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 40)) + f"d{i}", [None, "hot", "hot", "é", "z", "a", "tiny"][int(rng.integers(7))]) for i in range(200)]
    rows = [(i, t, s) for i, t, s in rows if s != "tiny"] + [(300, "one two", "tiny"), (301, None, "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block_words=50, min_blocks=7, bucket_docs=30)[0].collect()
    source = {i: s for i, _, s in rows}
    want = brute.mix([(r["doc_id"], source[r["doc_id"]], r["size"], r["key"]) for r in got], (3, 1, 2), 1.5, 2, 50, 7, len(rows) // 30)
    assert {r["key"]: r["taken"] for r in got} == want


def test_water_level(spark):
    rng = np.random.default_rng(2)
    for _ in range(5):
        sizes, weights = rng.integers(0, 100, 12).tolist(), [float((3, 1, 2)[i % 3]) for i in range(12)]
        level = mixing.water_level(spark.createDataFrame(list(zip(sizes, weights)), "size long, weight double"), 1.5 * sum(sizes), 2)
        assert [min(2.0 * s, level * w) for s, w in zip(sizes, weights)] == pytest.approx(brute.water_fill(sizes, weights, 1.5, 2))
    assert brute.water_fill([10, 100], [3, 1], 1.5, 2) == [20.0, 145.0]
    assert mixing.water_level(spark.createDataFrame([(1, 1.0)], "size long, weight double"), 5.0, 2) is None


def test_html():
    f = html_extract.main_text
    assert f(None) == f("") == f("<nav>a</nav>") == ""
    page = "<body><header>Top</header><div class='cookie-notice'>Ok?</div><main><h1>T &amp; U</h1><p>A first, longer paragraph&nbsp;of text.<p>Second <b>bold\n one</b>.<ul><li>x<li>y</ul><section id='comments'><p>Nice, I agree!</p></section></main><aside>More</aside><footer>F</footer>"
    assert f(page) == "T & U\n\nA first, longer paragraph of text.\n\nSecond bold one.\n\nx\n\ny"
    assert f("<p>unclosed <script>x</p><b") == "unclosed"
    assert f("plain text, no markup.") == "plain text, no markup."


BODY = "".join(f"<p>This is paragraph {i} of the text, and it says a thing or two.</p>" for i in range(6))
PLAIN = "\n\n".join(f"This is paragraph {i} of the text, and it says a thing or two." for i in range(6))


@pytest.mark.parametrize("wrapper", ["post has-sidebar", "content-with-comments", "social-issues", "header-fixed page", "share-price", "widget", "no-footer x", "ad-hoc"])
def test_html_wrappers(wrapper):
    """A class that only looks like a hint leaves its element alone, and ratios decide for one that is a hint."""
    f = html_extract.main_text
    noise = "<nav>Menu, with a comma.</nav><div class='ad'>Buy now. It is good.</div><ul><li><a>Home</a></li><li><a>News</a></li></ul>"
    for attribute in ("class", "id"):
        assert f(f"<html><body>{noise}<div {attribute}='{wrapper}'>{BODY}</div><footer>End</footer></body></html>") == PLAIN
        assert f(f"<body>{noise}<article {attribute}='{wrapper}'>{BODY}</article><div id='comments'>{BODY * 3}</div>") == PLAIN


def test_html_parts_of_an_article():
    f = html_extract.main_text
    assert f(f"<article><header><h1>Title</h1></header><p class='ad-hoc note'>Ad hoc.</p>{BODY}<div class='comment-list'><p>Me too!</p></div></article>") == f"Title\n\nAd hoc.\n\n{PLAIN}"
    assert f(f"<article><p>So <math><mi>a</mi><mo>=</mo><mn>1</mn></math> and <svg><title>t</title><text>b</text></svg>, <button>x</button>done.</p>{BODY}</article>") == f"So a=1 and b, done.\n\n{PLAIN}"
    assert f(f"<article><h1>T</h1><p>Lead, in short.</p><div>{BODY}</div></article>") == f"T\n\nLead, in short.\n\n{PLAIN}"
    assert f("<p>1 < 2 and <3, a<b>c</b> <span hidden>x <i>y</i></span>&lt;p&gt; <a title='a > b' href=\"'\">z</a></p>") == "1 < 2 and <3, ac <p> z"
    assert f(f"<div><div>{BODY}</div></div><p>Cut off <a href='x>and lost") == f"{PLAIN}\n\nCut off"


def test_html_of_any_depth():
    """Time and memory grow with the length: deep nesting, tags that nothing closes, tags without an end."""
    import time

    f, n = html_extract.main_text, 100_000
    start = time.perf_counter()
    assert f("<div>" * n + "Some text, at last.") == "Some text, at last."
    assert f("<div><b>" * n + "</i></section>" * n + "x") == "x"
    assert f("<b>" * n + "</i>" * n + "x.") == "x."
    assert f("y " + "<a " * n) == f("y " + "<a b='" * n) == f("y <!--" + "<!-- " * n) == f("y <script>" + "<script>" * n) == "y"
    assert f("<ul>" + "<div>" * n + "<li>x" * 1000).count("x") == 1000
    assert f("<span hidden>" + "<i>" * n + "</u>" * n + "x") == ""
    assert f("<a x='1' " * n + ">z") == "z" and f("<" * n).count("<") == n
    assert time.perf_counter() - start < 60


def test_html_table(spark):
    df = spark.createDataFrame([(1, None, "u", "clash"), (2, "<p>A b.</p>", "u", "clash")], "page_id int, html string, url string, text string")
    assert one(html_extract.html_extract(df), "page_id", "text") == [(1, ""), (2, "A b.")]
    assert html_extract.html_extract(df.limit(0)).count() == 0 and html_extract.html_extract(df.union(df)).count() == 4


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra string")
    assert chat_format.digest(chat_format.format_windows(df)).count() == 0
    assert chat_format.op4_chat_format(df).count() == 1


def test_chat_of_nulls_and_repeats(spark):
    """A null conversation is one of its own; null turns come first, equal turns by role and text; repeated rows stay."""
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (None, None, None, None), (1, 2, "assistant", "y"), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (1, 2, "user", "\x00<|end|>"), (2, 0, "assistant", "")]
    got = {r[0]: tuple(r[1:5]) for r in chat_format.digest(chat_format.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=2, history=1)).collect()}
    want = brute.chat([(c, -1 if n is None else n, r or "", t) for c, n, r, t in rows])
    assert got == {c: v for c, v in want.items() if c != -7}


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and what it kept, over the smallest tables and some odd rows."""
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = " ".join(f"w{i % 91}x{i}." for i in range(20_000))
    odd = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, long, None, None, 7), (-4, long + " end.", "de", "s", None), (None, long.replace("x", "y"), "en", None, 1), (-5, long.replace("w", "v"), "en", "s", 2), (-5, long.replace("w", "v"), "en", "s", 2)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"score": F.lit("x"), "kept": F.lit("x"), "key": F.lit("x"), "copies": F.lit("x"), "predicted": F.lit("x")})
    out, at = {}, tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(at / str(k)))
        out[name] = (docs, docs := spark.read.parquet(str(at / str(k))))
    return out


def texts_of(df):
    return sorted(((r[0], r[1]) for r in df.select("doc_id", "text").collect()), key=str)


def test_every_stage_returns_the_columns_of_documents(stages):
    for name, (_, kept) in stages.items():
        assert kept.columns == (["doc_id", "source", "n_tokens", "ids", "decodes"] if name == "bpe" else list(corpus_pipeline.COLUMNS))


def test_toxicity_stage(spark, stages):
    docs, kept = stages["toxicity"]
    m = toxicity.fit_toxicity(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    p = m.p
    score = lambda t: brute.toxicity_score(t, m.part, m.bias, m.slope, m.offset, p.window, p.buckets, p.shortest, p.longest)
    want = [(i, t) for i, t in texts_of(docs) if score(t) < 0.7]
    assert texts_of(kept) == want and 0 < len(want) < docs.count()


def test_quality_stage(spark, stages):
    docs, kept = stages["quality rules"]
    share = {r["text"]: r["kept_share"] for r in quality_rules.quality_rules(docs).collect()}
    want = [(i, t) for i, t in texts_of(docs) if not brute.quality(t)[5] and share[t] >= 0.3]
    assert texts_of(kept) == want and 0 < len(want) < docs.count()


def test_join_stage(stages):
    docs, kept = stages["n-gram Jaccard join"]
    before = texts_of(docs)
    group = {i: c for i, _, c, *_ in brute.join_rows(before) if i is not None}
    assert texts_of(kept) == sorted({(i, t) for i, t in before if i is None or group[i] == i}, key=str) and kept.count() < docs.count()


def test_mixing_stage(stages):
    docs, kept = stages["mixing"]
    size = {x: len(brute.WS.findall(x[1] or "")) for x in texts_of(docs)}
    copies, taken, target = brute.Counter(texts_of(kept)), brute.Counter(), {}
    key = {(r["doc_id"], r["text"]): r["k"] for r in docs.select("doc_id", "text", mixing.row_key().alias("k")).collect()}
    source = {(r["doc_id"], r["text"]): r["source"] for r in docs.collect()}
    for r in mixing.mix(docs)[0].collect():
        taken[r["key"]] += r["taken"]
        target[r["key"]] = r["target"]
    assert set(copies) <= set(size)
    words, want = brute.Counter(), {}
    for x, n in size.items():
        # next to the words that the mix takes, and never more than twice
        assert abs(copies[x] * n - taken[key[x]]) < max(n, 1) and copies[x] <= 2
        words[source[x]] += copies[x] * n
        want[source[x]] = target[key[x]]
    # the parts at the blocks' edges are rounded by chance: all sources together come near
    assert sum(words.values()) == pytest.approx(sum(want.values()), rel=0.05)


def test_token_stage(stages):
    from tokenizers import Tokenizer

    docs, kept = stages["bpe"]
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    ids = {x: t.encode(x[1] or "", add_special_tokens=False).ids for x in set(texts_of(docs))}
    want = sorted((str(x[0]), ids[x]) for x in texts_of(docs))
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in kept.collect()) == want
    assert kept.where("not decodes or n_tokens <> size(ids)").count() == 0 and kept.count() == docs.count()


def test_stages_of_an_empty_table(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema)


@pytest.mark.parametrize("params", [ngram_join.JoinParams(orders=0, few=1, more=1), ngram_join.JoinParams(orders=1, few=1, more=2, block_rows=16)])
def test_copies_of_one_hidden_original(spark, params):
    """Copies that link with their original alone: pairs held back come in later rounds, and none is lost."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for _ in range(60):
        copy = list(words)
        for k in rng.choice(200, int(rng.integers(3, 7)), replace=False):
            copy[int(k)] = f"n{rng.integers(1 << 40)}"
        docs.append((len(docs), " ".join(copy)))
    docs.append((99, " ".join(words)))
    for start in range(0, 140, 20):
        docs.append((len(docs) + 200, " ".join(words[start : start + 60] + [f"z{start}x{i}" for i in range(9)])))
    got = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), params, counts=True).select("doc_id", "n_shingles", "component_id", "n_links", "n_texts_linked").collect()
    assert sorted(map(tuple, got)) == sorted(brute.join_rows(docs))


def test_likeliest_pairs():
    a, b, s = np.array([1, 1, 1, 2, 2, 3]), np.array([2, 3, 4, 3, 4, 4]), np.array([0.5, 0.9, 0.1, 0.2, 0.8, 0.3])
    assert ngram_join.likeliest(a, b, s, 1).tolist() == [False, True, False, False, True, False]
    assert ngram_join.likeliest(a, b, s, 3).all() and not len(ngram_join.likeliest(a[:0], b[:0], s[:0], 2))
