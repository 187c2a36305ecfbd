"""Queries and operators over inputs that an earlier cut left out."""

import inspect
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from gneiss.operators import graph
from gneiss.plans import catalogue, rules
from gneiss.sources import pysource


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


def test_near_copies_query_equals_brute_force_on_long_bodies(spark, tmp_path):
    a, b, c = words("a", 800), words("b", 2990), words("c", 650)
    bodies = {1: a, 2: [*a[:400], "new", *a[401:]], 3: a[:601], 4: b, 5: [*b, "x", "y"], 6: c, 7: [*c[:300], *words("d", 350)], 8: a[:50], 9: words("e", 3001), 10: [*words("e", 3001), "z"]}
    spark.createDataFrame([(k, " ".join(v)) for k, v in bodies.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sh = {k: {tuple(v[i : i + 8]) for i in range(len(v) - 7)} for k, v in bodies.items() if 20 <= len(v) <= 3000}
    df = defaultdict(int)
    for s in sh.values():
        for h in s:
            df[h] += 1
    want = set()
    for x, y in combinations(sorted(sh), 2):
        shared = sum(df[h] <= 80 for h in sh[x] & sh[y])
        if shared < 0.5 * min(len(sh[x]), len(sh[y])) or not shared or bodies[x] == bodies[y]:
            continue
        m = SequenceMatcher(None, bodies[x], bodies[y], autojunk=False)
        small, large = sorted((len(bodies[x]), len(bodies[y])))
        if m.ratio() >= 0.99:
            want.add((x, y, "near"))
        elif sum(s.size for s in m.get_matching_blocks()) / small >= 0.98 and small / large >= 0.30:
            want.add((x, y, "contained"))
    assert want == {(1, 2, "near"), (1, 3, "contained"), (2, 3, "contained"), (4, 5, "near")}
    got = catalogue.queries()["near_copies_of_documents"](spark, str(tmp_path))
    assert {(r["a"], r["b"], r["kind"]) for r in got.collect()} == want


@pytest.fixture(scope="module")
def trade(spark, tmp_path_factory):
    """Customers over 300 and of any remainder; two cycles, a tail and a component apart: the tables' folder and their links."""
    d = str(tmp_path_factory.mktemp("trade"))
    orders = [(1, 301), (2, 302), (3, 5000), (4, 7), (5, 302)]
    lines = [(1, 11, "N"), (1, 12, "R"), (2, 12, "N"), (2, 13, "R"), (3, 900, "R"), (4, 77, "N"), (5, 11, "A")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    of = dict(orders)
    links = {(3 * c, 3 * o + 1) for o, c in orders} | {(3 * o + 1, 3 * p + 2) for o, p, _ in lines} | {(3 * p + 2, 3 * of[o]) for o, p, f in lines if f == "R"}
    return d, links


def depths(links, start):
    seen, front = {start: 0}, [start]
    for v in front:
        for a, b in links:
            if a == v and b not in seen:
                seen[b] = seen[v] + 1
                front.append(b)
    return seen


def test_graph_queries_see_all_orders_and_lines(spark, trade):
    d, links = trade
    q = catalogue.queries()
    nodes = {x for e in links for x in e}
    to = {v: set(depths(links, v)) for v in nodes}
    either = {v: set(depths(links | {(b, a) for a, b in links}, v)) for v in nodes}
    cycle = {v: min(w for w in nodes if w in to[v] and v in to[w]) for v in nodes if any(w != v and w in to[v] and v in to[w] for w in nodes)}
    assert {tuple(r) for r in q["reachable_trade_nodes"](spark, d).select("node", "depth").collect()} == set(depths(links, 21).items())
    assert {tuple(r) for r in q["trade_cycle_members"](spark, d).select("node", "cycle").collect()} == set(cycle.items())
    assert {tuple(r) for r in q["trade_components"](spark, d).select("node", "component").collect()} == {(v, min(either[v])) for v in nodes}
    assert len(set(cycle.values())) == 3 and len({min(x) for x in either.values()}) == 3


def test_reachable_has_no_greatest_depth(spark):
    chain = spark.range(30).selectExpr("id as src", "id + 1 as dst")
    got = graph.reachable(chain, spark.createDataFrame([(0,)], "node long"))
    assert {(r["node"], r["depth"]) for r in got.collect()} == {(k, k) for k in range(31)}
    assert "max_depth" not in inspect.signature(graph.reachable).parameters


def test_except_all_compares_every_event(spark, tmp_path):
    events = [(k, k % 4, "x") for k in range(20)] + [(2, 9, "y"), (None, 0, "x")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    side = lambda even: Counter((u, e) for k, u, e in events if (k is not None and k % 2 == 0) == even)
    got = Counter(map(tuple, catalogue.queries()["except_all_event_halves"](spark, str(tmp_path)).collect()))
    assert got == side(True) - side(False)


def test_debt_markers_reads_late_lines(spark, tmp_path):
    body = "\n".join([f"line {i}" for i in range(40)] + ["x = 1  # HACK (ann) late", "end"])
    spark.createDataFrame([(3, body), (7, "a text that is long\nb\nc\nd\n# todo")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.queries()["debt_markers"](spark, str(tmp_path)).select("path", "line", "marker", "attributed").collect()}
    assert got == {("doc/3", 42, "HACK", True), ("doc/7", 6, "TODO", False)}


def test_audit_rules_read_calls_of_over_400_characters(spark):
    long = ", ".join(f"'argument number {i}'" for i in range(40))
    same = "\n".join(f"def test_{k}():\n    _fit({long}, {k})\n" for k in range(3))
    files = [
        ("a.py", f"@njit([{long}], fastmath=True)\ndef f(x):\n    return x\n"),
        ("b.py", f"try:\n    f()\nexcept ValueError as e:\n    raise HTTPException({long}, str(e))\n"),
        ("c.py", f"r = np.argsort(g({long}, np.argsort(x)))\n"),
        ("tests/test_x.py", same),
    ]
    n = pysource.parse(spark.createDataFrame(files, "path string, text string")).persist()
    names = ["njit_fastmath_nan", "validation_errors_echo_input", "ordinal_rank_scatter", "redundant_test_fit_call"]
    got = {(r["rule"], r["path"]) for r in rules.findings(spark, n, names).collect()}
    assert got == {("njit_fastmath_nan", "a.py"), ("validation_errors_echo_input", "b.py"), ("ordinal_rank_scatter", "c.py")}
