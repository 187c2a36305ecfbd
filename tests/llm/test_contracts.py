"""The registered queries against plain versions and their SQL, over whole tables."""

import hashlib
import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from gneiss.llm import queries as q  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def run(spark, name):
    df = q.queries()[name](spark, SF)
    return {r[0]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = q.queries()[name](spark, SF)
    said = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in said.description]
    plain = lambda v: "~" if v is None else f"{v:.9f}" if isinstance(v, float) else str(v)
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in said.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


def test_quality_base_metrics(spark, docs):
    got = run(spark, "op9_quality_rules")
    assert all(tuple(got[i][1:7]) == brute.quality(t) for i, t, *_ in docs)


def test_license_base(spark, docs):
    got = run(spark, "op7_license_scan")
    assert all(tuple(got[i][1:6]) == brute.license_base(t) for i, t, *_ in docs)
    assert all(set(filter(None, got[i][5].split(","))) <= set(got[i][6].split(",")) for i, *_ in docs)


def test_components(spark, docs):
    got, want = run(spark, "op3_ngram_join"), brute.components([d[:2] for d in docs])
    assert {i: (r[1], r[2]) for i, r in got.items()} == want


def test_edits(spark, docs):
    got, want = run(spark, "op5_merkle"), brute.merkle([d[:2] for d in docs])
    assert {i: (r[1], r[2]) for i, r in got.items()} == want
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9


def test_tokens_equal_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    from gneiss.llm.bpe import default_path

    t = Tokenizer.from_file(default_path())
    t.no_truncation()
    t.no_padding()
    got = run(spark, "op6_bpe")
    for i, text, *_ in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == brute.sha(t.decode(ids, skip_special_tokens=False))


def test_languages_on_held_out_documents(spark, docs):
    got = run(spark, "op2_language_id")
    held = [(i, lang) for i, _, lang, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, _ in held}
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95


def test_toxicity_on_held_out_documents(spark):
    """On the larger table, as the small one has too few labels to learn from."""
    from gneiss.llm.toxicity import train

    big = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{big}/documents.parquet' JOIN '{big}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    model = train([t for i, t, _ in rows if fold(i) != 1], [y for i, _, y in rows if fold(i) != 1])
    score = model.scorer()
    held = [(score(t) >= 0.7, y) for i, t, y in rows if fold(i) == 1]
    assert sum(p and y for p, y in held) >= 0.65 * sum(y for _, y in held)
    assert sum(p and not y for p, y in held) <= 0.01 * len(held)
    got = run(spark, "op1_toxicity")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (fold(i) == 1) for i, r in got.items())


def test_mix(spark, docs):
    got = run(spark, "op8_mixing")
    size = {i: len(brute.WS.findall(t or "")) for i, t, *_ in docs}
    assert {i: r["size"] for i, r in got.items()} == size
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, _, x in docs if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else left * weight[s] / w
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = dict.fromkeys(sources, 0)
    for i, _, _, s in docs:
        assert got[i]["target"] == pytest.approx(target[s]) and got[i]["source_size"] == total[s]
        assert 0 <= got[i]["taken"] <= 2 * size[i]
        taken[s] += got[i]["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 1 for s in sources)
    again = run(spark, "op8_mixing")
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in again.items()}


def test_chat_over_several_windows(spark):
    from gneiss.llm.chat_format import CONTEXT, digest, format_windows, loss_text, read_back

    rows = [(1, 0, "system", "be <|end|> \\ kind <\\|")] + [(1, k, ("user", "assistant")[k % 2], f"word{k} " * 9 + "<|turn|>\\") for k in range(1, 40)]
    rows += [(2, 0, "assistant", None), (2, 0, "user", "x"), (3, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = format_windows(df, budget=50, history=15)
    assert w.where("conv_id = 1").count() > 5 and w.where("n_context > 0").count() > 3
    want = brute.chat([(c, n, r or "", t) for c, n, r, t in rows])
    got = {r[0]: tuple(r[1:5]) for r in digest(w).collect()}
    assert got == {c: v for c, v in want.items() if c != -7}
    one = w.where("conv_id = 1 and window = 2").select("formatted", read_back(w["formatted"]).alias("t"), loss_text(w["formatted"], w["loss"]).alias("l")).first()
    assert one["formatted"].startswith(CONTEXT) and one["t"][0]["text"] == "be <|end|> \\ kind <\\|"
    assert one["l"] == "".join(t["text"] for t in one["t"] if t["role"] == "assistant" and not t["context"])


def test_main_text_of_pages(spark):
    import html

    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = run(spark, "op10_html_extract")
    for i, page in pages:
        body = page[page.index("<article>") + 9 :].split("</article>")[0].split("<footer")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert got[i]["text"] == "\n\n".join(p for p in parts if p)
