import pytest
from pyspark.sql import functions as F

from gneiss.plans import rules
from gneiss.sources import pysource


@pytest.fixture(scope="module")
def nodes(spark):
    """Both corpora of all rules, each rule's files under a folder of its own, so that whole-corpus rules stay apart by running alone."""

    def of(kind):
        rows = [(f"{r.name}/{p}", x) for r in rules.RULES.values() for p, x in getattr(r, kind).items()]
        return pysource.parse(spark.createDataFrame(rows, "path string, text string")).persist()

    return of("bad"), of("good")


#: Rules that look at the whole corpus: run alone on their own files.
WHOLE = [r for r in rules.RULES.values() if r.sql.count("nodes") > 1 or "OVER" in r.sql or "GROUP BY" in r.sql]
LOCAL = [r for r in rules.RULES.values() if r not in WHOLE]


def own(nodes, name):
    return nodes.where(F.col("path").startswith(f"{name}/")).withColumn("path", F.substr("path", F.lit(len(name) + 2)))


def test_local_rules_tell_the_seeded_violation_from_its_clean_twin(spark, nodes):
    names = [r.name for r in LOCAL]
    bad = {(r["rule"], r["path"].split("/")[0]) for r in rules.findings(spark, nodes[0], names).collect()}
    good = {(r["rule"], r["path"].split("/")[0]) for r in rules.findings(spark, nodes[1], names).collect()}
    assert [n for n in names if (n, n) not in bad] == []
    assert [n for n in names if (n, n) in good] == []


@pytest.mark.parametrize("name", [r.name for r in WHOLE])
def test_corpus_rules(spark, nodes, name):
    assert rules.findings(spark, own(nodes[0], name), [name]).count() >= 1
    assert rules.findings(spark, own(nodes[1], name), [name]).count() == 0


def test_problems_and_unknown_rules(spark):
    n = pysource.parse(spark.createDataFrame([("a.py", "def ("), ("b.py", None), ("c.py", "﻿x = 1\n")], "path string, text string"))
    assert {(r["path"], r["kind"]) for r in pysource.problems(n).collect()} == {("a.py", "unparsable"), ("b.py", "unreadable")}
    with pytest.raises(ValueError):
        rules.findings(spark, n, ["nothing"])


def test_import_cycle_and_inline_suppression(spark):
    files = [("p/a.py", "import p.b\n"), ("p/b.py", "import p.a\n"), ("p/c.py", "try:\n    f()\nexcept:  # audit-ok: bare_except the last resort\n    raise\n")]
    n = pysource.parse(spark.createDataFrame(files, "path string, text string")).persist()
    assert {r["path"] for r in rules.findings(spark, n, ["import_cycle"]).collect()} == {"p/a.py", "p/b.py"}
    assert rules.findings(spark, n, ["bare_except"]).count() == 0


#: Source, and the names of its calls in order of lines.
RESOLVED = [
    ("import requests as rq\nrq.get(u)\n", ["requests.get"]),
    ("from time import sleep as nap\ndef f():\n    nap(1)\n", ["time.sleep"]),
    ("import os.path\nos.path.join(a)\n", ["os.path.join"]),
    ("from . import a\nfrom .b import c\na.f()\nc()\n", [".a.f", ".b.c"]),
    ("import pickle\np = pickle\np.loads(x)\n", ["pickle.loads"]),
    ("import requests\ndef f(requests):\n    requests.get(u)\n", ["?.get"]),
    ("import requests\ndef f():\n    requests = 1\n    def g():\n        requests.get(u)\n", ["?.get"]),
    ("def f():\n    import json as j\n    j.loads(x)\ndef g():\n    j.loads(x)\n", ["json.loads", "j.loads"]),
    ("import a as x\nimport b as x\nx.f()\n", ["x.f"]),
    ("class C:\n    import json as j\n    k = j.loads(x)\n    def m(self):\n        j.loads(x)\n", ["json.loads", "j.loads"]),
    ("import a\ndef f():\n    global a\n    a = 1\n    a.g()\n", ["a.g"]),
    ("import a as b\n@b.deco(1)\ndef f(b, c=b.g()):\n    pass\n", ["a.deco", "a.g"]),
    ("import a as b\nh = lambda b: b.f()\nb.g()\n", ["?.f", "a.g"]),
]


def test_calls_have_the_names_that_their_scopes_say(spark):
    n = pysource.parse(spark.createDataFrame([(f"{k}.py", x) for k, (x, _) in enumerate(RESOLVED)], "path string, text string")).where("kind = 'Call'").orderBy("path", "line", "node_id")
    got = {}
    for r in n.collect():
        got.setdefault(int(r["path"][:-3]), []).append(r["name"])
    assert got == {k: names for k, (_, names) in enumerate(RESOLVED)}


TIMEOUTS_BAD = [
    "import requests as rq\nrq.get(u)\n",
    "from requests import post\npost(u, timeout=None)\n",
    "import requests\ns = requests.Session()\ndef f():\n    s.get(u)\n",
    "from requests import Session\nclass C:\n    def __init__(self):\n        self.s = Session()\n    def m(self):\n        return self.s.post(u)\n",
    "import requests\nwith requests.Session() as s:\n    s.put(u)\n",
    "from urllib.request import urlopen\nurlopen(u)\n",
    "import httpx as h\nh.delete(u)\n",
]
TIMEOUTS_GOOD = [
    "import requests as rq\nrq.get(u, timeout=LIMIT)\n",
    "import requests\nrequests.get(u, **options)\n",
    "import requests\ndef f(requests):\n    requests.get(u)\n",
    "import requests\ns = requests.Session()\ns.get(u, timeout=LIMIT)\n",
    "s = Own()\ns.get(u)\n",
    "import requests\ns = requests.Session()\ns = other()\ns.get(u)\n",
    "def get(u):\n    pass\nget(u)\n",
]
BLOCKING_BAD = ["from time import sleep\nasync def f():\n    sleep(1)\n", "import subprocess as sp\nasync def f():\n    sp.run(a)\n", "import requests as r\nasync def f():\n    r.get(u)\n", "import time as t\nclass C:\n    async def f(self):\n        t.sleep(1)\n", "async def f():\n    import time\n    time.sleep(1)\n"]
BLOCKING_GOOD = ["from asyncio import sleep\nasync def f():\n    await sleep(1)\n", "import time\nasync def f(time):\n    time.sleep(1)\n", "from time import sleep\ndef f():\n    sleep(1)\n", "import time\nasync def f():\n    def g():\n        time.sleep(1)\n", "from own import sleep\nasync def f():\n    sleep(1)\n"]
LOADS_BAD = ["import pickle as p\np.load(f)\n", "from pickle import loads\nloads(b)\n", "from yaml import load\nload(f)\n", "import marshal\nm = marshal\nm.loads(b)\n", "from dill import loads as u\nu(b)\n"]
LOADS_GOOD = ["from json import loads\nloads(b)\n", "import own as pickle\npickle.load(f)\n", "from yaml import load, SafeLoader\nload(f, SafeLoader)\n", "import pickle\ndef f(pickle):\n    pickle.load(g)\n", "from yaml import load\nload(f, Loader=L)\n"]


@pytest.mark.parametrize("name, bad, good", [("missing_network_timeout", TIMEOUTS_BAD, TIMEOUTS_GOOD), ("sync_blocking_in_async", BLOCKING_BAD, BLOCKING_GOOD), ("unsafe_deserialization", LOADS_BAD, LOADS_GOOD)])
def test_rules_see_through_imports(spark, name, bad, good):
    files = [(f"bad/{k}.py", x) for k, x in enumerate(bad)] + [(f"good/{k}.py", x) for k, x in enumerate(good)]
    n = pysource.parse(spark.createDataFrame(files, "path string, text string"))
    assert {r["path"] for r in rules.findings(spark, n, [name]).collect()} == {f"bad/{k}.py" for k in range(len(bad))}
