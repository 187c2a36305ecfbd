import datetime
import json

import pytest
from pyspark.sql import functions as F

from gneiss.functions import names
from gneiss.operators import findings as fi
from gneiss.operators import graph, ratchet, relops, schema, similarity, stats, temporal, text
from gneiss.plans import contracts
from gneiss.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_finding_key_leaves_the_line_out_and_repeats_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9)], "p string, l int")
    f = fi.findings(df, "r", F.col("p"), "m", F.col("l"))
    assert {r["key"] for r in f.collect()} == {"r::a::m"}
    assert sorted(r["key"] for r in fi.with_ordinals(f, "key", ["line"]).collect()) == ["r::a::m", "r::a::m #2"]


def test_unknown_severity_fails(spark):
    ok = fi.check_severity(spark.createDataFrame([("P0",)], "severity string"))
    assert rows(ok) == [("P0", 1)]
    with pytest.raises(Exception, match="unknown severity"):
        fi.check_severity(spark.createDataFrame([("P9",)], "severity string")).collect()


def test_suppression_needs_its_rule_and_a_reason(spark):
    lines = spark.createDataFrame([("a", 1, "x  # audit-ok: r known"), ("a", 2, "x  # audit-ok: r"), ("a", 3, "x  # audit-ok: other known")], "path string, line int, text string")
    f = spark.createDataFrame([("a", i, "r") for i in (1, 2, 3)], "path string, line int, rule string")
    assert [r["line"] for r in fi.suppress(f, fi.inline_suppressions(lines)).orderBy("line").collect()] == [2, 3]


def test_relational_shapes(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (3, 3.0)], "k int, v double")
    assert rows(relops.without_support(a, b, ["k"])) == [(2, 2.0), (None, 3.0)]
    assert (2, "left_only") in rows(relops.parity(a, b, ["k"])) and (3, "right_only") in rows(relops.parity(a, b, ["k"]))
    assert rows(relops.differing(a, b, ["k"], ["v"])) == [(1, 1.0, 1.5)]
    assert rows(relops.differing(a, b, ["k"], ["v"], tolerance=0.6)) == []
    spans = spark.createDataFrame([("f", 1, 1000)], "p string, s int, e int")
    points = spark.createDataFrame([("f", 700), ("f", 2000), ("g", 5)], "p string, x int")
    assert rows(relops.contained(points, spans, ["p"], "x", "s", "e").select("x")) == [(700,)]
    has = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "h string, v int")
    assert rows(relops.holders_of_all(has, spark.createDataFrame([(1,), (2,)], "v int"), "h", "v")) == [("a",)]
    fam = spark.createDataFrame([("f", 1, True), ("f", 2, True), ("f", 3, False), ("g", 4, False)], "fam string, id int, ok boolean")
    assert [r["id"] for r in relops.majority_outliers(fam, ["fam"], "ok").collect()] == [3]


def test_baseline_shapes_and_rejects():
    p = ratchet.parse_baseline
    assert p('["a", "a", "b"]') == [("a", 2, ""), ("b", 1, "")]
    assert p('[["a", "b"]]') == [("a|b", 1, "")]
    assert p('{"a": "why"}') == [("a", 1, "why")]
    assert p('{"a": 3, "_comment": "x"}') == [("a", 3, "")]
    assert p('{"accepted": {"a": "why"}}') == [("a", 1, "why")]
    assert p('{"schema": 1, "entries": {"a": {"count": 2, "note": "n"}}}') == [("a", 2, "n")]
    assert p('{"entries": {"a": {"count": 3}}}') == [("a", 3, "")] and p('{"entries": "x"}') == [("entries", 1, "x")]
    assert p('[["a", "b", "c"], ["d"], "e"]') == [("a|b|c", 1, ""), ("d", 1, ""), ("e", 1, "")]
    assert p('{"a": null, "b": ["x", 1], "c": {"note": {"y": 1}}}') == [("a", 1, ""), ("b", 1, '["x", 1]'), ("c", 1, '{"y": 1}')]
    for bad in ('[[]]', '[["a", 1]]', '{"a": {"count": true}}', '{"a": true}', '{"a": 0}', '{"a": 1, "a": 2}', '["a|b", ["a", "b"]]', "3"):
        with pytest.raises(ratchet.BaselineError):
            p(bad)


def test_multiset_diff_shrink_only_and_hygiene(spark):
    c = lambda **k: spark.createDataFrame(list(k.items()), "key string, count int")
    assert rows(ratchet.multiset_diff(c(a=2, b=1), c(a=1, b=2, d=1))) == [("a", 1, 0), ("b", 0, 1), ("d", 0, 1)]
    got = {r["key"]: (r["kept"], r["grown"]) for r in ratchet.shrink_only(c(a=3, b=1, g=1), c(a=2, b=5, n=1)).collect()}
    assert got == {"a": (2, False), "b": (1, True), "n": (None, True)}
    assert rows(ratchet.shrink_only(c(a=3, b=1), c(a=0, n=0, m=-1))) == []
    acc = ratchet.baseline(spark, '{"/abs/x": "a good long note", "k": "short", "m": "TODO: justify"}')
    assert {(r["key"], r["problem"]) for r in ratchet.hygiene(acc).collect()} == {("/abs/x", "absolute path"), ("k", "note too short"), ("m", "unjustified")}
    with pytest.raises(ratchet.BaselineError):
        ratchet.baseline(spark, None)
    with pytest.raises(ratchet.BaselineError):
        ratchet.parse_baseline("[1]")


def test_drift_boundaries(spark):
    pairs = {"same": (100, 120), "jump": (100, 121), "small": (5, 10), "up": (0, 6), "blind": (7, 0), "gone": (7, None), "new": (None, 7)}
    a = spark.createDataFrame([(k, x, None) for k, (x, _) in pairs.items()], "f string, count long, error string")
    b = spark.createDataFrame([(k, y, None) for k, (_, y) in pairs.items()], "f string, count long, error string")
    got = {r["f"]: r["kind"] for r in temporal.drift(a, b, ["f"], error="error").collect()}
    assert got == {"jump": "jump", "up": "jump", "blind": "blind", "gone": "gone", "new": "new"}
    a = spark.createDataFrame([("e", 3, None), ("s", None, "x"), ("r", None, "x")], "f string, count long, error string")
    b = spark.createDataFrame([("e", None, "x"), ("s", None, "x"), ("r", 4, None)], "f string, count long, error string")
    assert {r["f"]: r["kind"] for r in temporal.drift(a, b, ["f"], error="error").collect()} == {"e": "errored", "s": "still-errored", "r": "recovered"}
    rows_ = lambda *x: spark.createDataFrame(list(x), "repo string, f string, count long, error string")
    a = rows_(("p", "x", 1, None), ("p", "both", 3, "x"), ("gone", "x", 9, None))
    b = rows_(("p", "x", 1, None), ("p", "fresh", None, "x"), ("p", "both", None, "x"), ("new", "x", 7, None))
    assert rows(temporal.drift(a, b, ["repo", "f"], error="error", repo="repo").select("repo", "f", "kind")) == [("p", "both", "errored"), ("p", "fresh", "errored")]
    assert rows(temporal.repo_gone(a, b)) == [("gone", "repo-gone")]


def test_shards_may_not_share_a_repository(spark):
    a, b = spark.createDataFrame([("x", 1)], "repo string, n int"), spark.createDataFrame([("y", 1)], "repo string, n int")
    assert temporal.merge_shards([a, b]).count() == 2
    with pytest.raises(Exception, match="in two shards"):
        temporal.merge_shards([a, a]).collect()


def test_red_streak_and_lower_bound(spark):
    t = datetime.datetime(2024, 1, 1)
    runs = [("w", 1, t, "success"), ("w", 2, t.replace(day=2), "failure"), ("w", 3, t.replace(day=3), "cancelled"), ("w", 4, t.replace(day=4), "failure"), ("v", 5, t, "failure"), ("u", 6, t, "failure"), ("u", 7, t.replace(day=2), "neutral")]
    got = {r["w"]: (r["red_since"], r["n_red"], r["lower_bound"]) for r in temporal.red_streaks(spark.createDataFrame(runs, "w string, id int, created_at timestamp, conclusion string"), ["w"]).collect()}
    assert got == {"w": (t.replace(day=2), 2, False), "v": (t, 1, True)}


def test_row_count_of_a_text(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",)], "b string")
    assert [r[0] for r in df.select(temporal.row_count(F.col("b"))).collect()] == [0, 1, 1, 2]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (4, 4), (5, 6), (6, 7), (8, 9), (9, 8), (7, 8)], "src long, dst long")
    assert rows(graph.cycles(e)) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert dict(rows(graph.components(e))) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
    r = {x[0]: (x[1], x[2]) for x in graph.reachable(e, spark.createDataFrame([(5,)], "node long")).collect()}
    assert r == {5: (0, None), 6: (1, 5), 7: (2, 6), 8: (3, 7), 9: (4, 8)}
    assert graph.cycles(e.limit(0)).count() == 0


def test_statistics_edges(spark):
    edge = stats.edge_rows(spark)
    got = {r["case"]: r["rho"] for r in stats.spearman(edge, ["case"], "y_true", "y_pred").collect()}
    assert "empty" not in got
    for case in ("one_row", "constant", "single_class"):
        assert got[case] != got[case]
    assert "all_nan" not in got and got["some_nan"] == pytest.approx(0.8660254)
    ties = spark.createDataFrame([(1, float(v)) for v in (1, 2, 2, 3)], "g int, v double")
    assert sorted(r["r"] for r in stats.average_ranks(ties, ["g"], "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]
    res = spark.createDataFrame([("a", float("nan"), None), ("b", 1.0, None), ("c", None, "ValueError")], "case string, value double, error string")
    con = spark.createDataFrame([("a", "nan"), ("b", "finite"), ("c", "nan_or_valueerror"), ("c", "raise:ValueError"), ("c", "no_crash"), ("z", "any")], "case string, contract string")
    assert {(r[0], r[1]): r[2] for r in stats.edge_verdicts(res, con).collect()} == {("a", "nan"): True, ("b", "finite"): True, ("c", "nan_or_valueerror"): True, ("c", "raise:ValueError"): True, ("c", "no_crash"): True, ("z", "any"): True}
    errors = ("ValueError", "TypeError", "UnicodeDecodeError", "KeyError", "IndexError", "ZeroDivisionError", "RuntimeWarning", "Own")
    res = spark.createDataFrame([(e, None, e) for e in errors] + [("none", None, None), ("x", 2.0, None), ("inf", float("inf"), None), ("nan", float("nan"), None)], "case string, value double, error string")
    tokens = ("nan", "finite", "nan_or_valueerror", "no_crash", "any", "raise:ValueError", "raise:LookupError", "raise:Own")
    ok = {(r[0], r[1]) for r in stats.edge_verdicts(res, spark.createDataFrame([(c, k) for c in [*errors, "x", "inf", "nan"] for k in tokens], "case string, contract string")).collect() if r[2]}
    soft = {(e, k) for e in ("ValueError", "TypeError", "UnicodeDecodeError") for k in ("nan_or_valueerror", "no_crash")}
    assert ok == soft | {(e, "any") for e in ("ValueError", "TypeError", "UnicodeDecodeError", "KeyError", "Own", "x", "inf", "nan")} | {
        ("ValueError", "raise:ValueError"), ("UnicodeDecodeError", "raise:ValueError"), ("KeyError", "raise:LookupError"), ("Own", "raise:Own"),
        ("x", "finite"), ("x", "no_crash"), ("inf", "no_crash"), ("nan", "no_crash"), ("nan", "nan"), ("nan", "nan_or_valueerror"),
    }
    with pytest.raises(Exception, match="unknown contract"):
        stats.edge_verdicts(res, spark.createDataFrame([("x", "fine")], "case string, contract string")).collect()


def test_text_queries(spark):
    t = text.lines(spark.createDataFrame([("p", "# TODO x\n# fixme (ann)\ncafé\n  a  b\na b")], "p string, text string"), F.col("p"))
    assert [(r["line"], r["marker"], r["attributed"]) for r in text.markers(t).orderBy("line").collect()] == [(1, "TODO", False), (2, "FIXME", True)]
    assert [r["line"] for r in text.glyph_lines(t).collect()] == [3]
    assert "p::a b #2" in {r["key"] for r in text.keyed_lines(t).collect()}
    broken = "Привет".encode().decode("cp1251")
    m = text.mojibake(spark.createDataFrame([("p", 1, broken), ("p", 2, "Привет")], "path string, line int, text string"))
    assert [(r["line"], r["means"]) for r in m.collect()] == [(1, "Привет")]


def test_cue_verdicts(spark):
    rec = [("1", "red", "a red-ish red car"), ("2", "red", "plain"), ("3", "", "a red car"), ("4", "blue", "a red car"), ("5", "blue", "not red at all"), ("6", None, "RED")]
    df = spark.createDataFrame(rec, "id string, d string, t string")
    got = {r["id"]: (r["verdict"], r["kind"]) for r in text.cue_agreement(df, "id", "d", "t", [("red", "red"), ("blue", "blue")], anti=["not red"]).collect()}
    assert got == {"1": ("agree", None), "2": ("uncheckable", None), "3": ("contradict", "unfilled_but_cued"), "4": ("contradict", "declared_opposes_text"), "5": ("uncheckable", None), "6": ("contradict", "unfilled_but_cued")}


def test_similarity(spark):
    base = [f"t{i}" for i in range(60)]
    b = spark.createDataFrame([(1, base), (2, base), (3, [*base[:30], "new", *base[31:]]), (4, ["z"] * 30)], "fn_id long, tokens array<string>")
    c = {(r["a"], r["b"]): r["shared"] for r in similarity.near_candidates(b).collect()}
    sets = {1: base, 3: [*base[:30], "new", *base[31:]]}
    sh = {k: {tuple(v[i : i + 8]) for i in range(len(v) - 7)} for k, v in sets.items()}
    assert c == {(1, 2): 53, (1, 3): len(sh[1] & sh[3]), (2, 3): len(sh[1] & sh[3])}
    got = {(r["a"], r["b"]) for r in similarity.near_copies(b, ratio=0.95).collect()}
    assert got == {(1, 3), (2, 3)}
    x = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, body string")
    assert rows(similarity.exact_copies(x, "body", "id")) == [(2, 1, 2)]
    d = spark.createDataFrame([("f", 1, "abcdefghij"), ("f", 2, "abcdefghiX"), ("g", 3, "x")], "n string, id int, body string")
    assert [(r["n"], r["members"], r["bodies"]) for r in similarity.drifted_copies(d, ["n"], "id", "body").collect()] == [("f", 2, 2)]


def test_schema_queries(spark):
    ev = [(1, "create_table", "s", "t", "a", None), (2, "add_column", "s", "t", "b", None), (3, "rename_column", "s", "t", "b", "c"), (4, "rename_table", "s", "t", None, "u"), (5, "create_table", "s", "v", "x", None), (6, "drop_table", "s", "v", None, None)]
    events = spark.createDataFrame(ev, "seq int, action string, schema string, tbl string, col string, new_name string")
    assert rows(schema.replayed_columns(events)) == [("s", "u", "a"), ("s", "u", "c")]
    st = spark.createDataFrame([("s", "u", "a"), ("s", "u", "b"), ("s", "zz", "q")], "schema string, tbl string, col string")
    assert rows(schema.unknown_columns(st, events)) == [("s", "u", "b")]
    sql = spark.createDataFrame([("f", "INSERT INTO t (a, b) VALUES (1, 2)"), ("f", "UPDATE t SET c = 1 WHERE a = 2"), ("f", "SELECT d, e FROM t WHERE a = 1")], "path string, sql string")
    assert {r["col"] for r in schema.statement_columns(sql).collect()} == {"a", "b", "c", "d", "e"}


def test_contracts(spark, tmp_path):
    src = spark.createDataFrame([("a",), ("b",)], "key string")
    spec = contracts.QuerySpec("q", lambda s, d: d.where("key = 'b'"), min_rows=2, aliases=("alias",))
    assert contracts.run_query(spark, spec, src).status == "FAILED"
    assert contracts.run_query(spark, spec, src.limit(1)).status == "ERROR"
    ok = ratchet.baseline(spark, '{"b": "a known one"}')
    assert contracts.run_query(spark, spec, src, ok).status == "PASSED"
    assert "stale" in contracts.run_query(spark, spec, src.where("key = 'a'").union(src.where("key = 'a'")), ok).message
    bad = contracts.QuerySpec("p", spec.run, problems=lambda s, d: d.limit(1))
    assert contracts.run_query(spark, bad, src).status == "ERROR"
    reg = contracts.Registry()
    reg.register(spec)
    with pytest.raises(ValueError):
        reg.register(contracts.QuerySpec("alias", spec.run))
    assert reg.get("alias") is spec
    path = str(tmp_path / "b.json")
    with pytest.raises(ValueError, match="grown"):
        contracts.refresh_baseline(path, src)
    assert not (tmp_path / "b.json").exists()
    contracts.refresh_baseline(path, src, grow=True)
    contracts.refresh_baseline(path, src.where("key = 'a'"))
    assert list(json.loads((tmp_path / "b.json").read_text())["entries"]) == ["a"]
    cache = contracts.ResultCache(str(tmp_path / "c.json"))
    clean = contracts.QuerySpec("clean", lambda s, d: d.where("false"))
    assert not cache.run(spark, clean, src).cached and cache.run(spark, clean, src).cached
    assert not cache.run(spark, clean, src.limit(1)).cached
    assert not cache.run(spark, contracts.QuerySpec("clean", lambda s, d: d.where("1 = 0")), src).cached
    limits = [contracts.QuerySpec("n", (lambda n: lambda s, d: d.where(f"length(key) > {n}"))(n)) for n in (5, 6)]
    assert not cache.run(spark, limits[0], src).cached and not cache.run(spark, limits[1], src).cached and cache.run(spark, limits[1], src).cached


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "a.py").write_bytes("﻿x = 1\n".encode())
    (tmp_path / "sub" / "b.py").write_bytes(b"\xff\xfe")
    (tmp_path / "build" / "c.py").write_bytes(b"x")
    (tmp_path / "z.py").write_bytes(b"a\0b")
    d = {r["path"]: (r["text"], r["error"]) for r in files.decoded(files.list_files(spark, str(tmp_path), "*.py")).collect()}
    assert d["a.py"] == ("x = 1\n", None) and d["z.py"] == (None, "binary") and d["sub/b.py"][0] is None and "build/c.py" not in d
    cfg = spark.createDataFrame([("p.toml", "[a]\nb = [1, 2]\n"), ("x.json", '{"a": 1, "a": 2}'), (".env", "A=1\n"), ("c.ini", "[s]\nk=v\n")], "path string, text string")
    got = {(r["path"], r["entry"], r["value"]) for r in files.config_entries(cfg).collect()}
    assert ("p.toml", "a.b[1]", "2") in got and (".env", "A", '"1"') in got and ("c.ini", "s.k", '"v"') in got and ("x.json", None, None) in got


def test_names(spark):
    df = spark.createDataFrame([("np.random.seed", "numpy", "tests/a.py"), ("f", None, "src/a_test.py")], "d string, t string, p string")
    got = [tuple(r) for r in df.select(names.final_name(F.col("d")), names.head_name(F.col("d")), names.resolved(F.col("d"), F.col("t")), names.is_core_test_path(F.col("p")), names.is_text_test_path(F.col("p"))).collect()]
    assert got == [("seed", "np", "numpy.random.seed", True, True), ("f", "f", "f", False, True)]


def test_deep_expressions_are_parsed(spark):
    """A long sum nests deeper than the interpreter recurses; it doesn't take the other files with it."""
    from gneiss.sources import pysource

    files_ = [("sum.py", "x = " + "+".join(["1"] * 3000) + "\n"), ("deep.py", "x = " + "-" * 20000 + "1\n"), ("ok.py", "y = 2  # note\n"), ("call.py", "z" + ".a()" * 1500 + "\n")]
    nodes = pysource.parse(spark.createDataFrame(files_, "path string, text string")).select("path", "kind", "name", "code").collect()
    by = {p: [r for r in nodes if r["path"] == p] for p, _ in files_}
    assert {r["kind"] for r in by["ok.py"]} == {"Module", "Assign", "Name", "Constant", "Comment"}
    for p, text in files_:
        assert by[p][0]["kind"] == "Problem" or any(len(r["code"]) >= len(text) - 10 for r in by[p])
    assert sum(r["kind"] == "Call" for r in by["call.py"]) in (0, 1500)
