"""Audit rules over Python source: each is a query over the ``nodes`` relation, with a seeded violation and a clean twin.

A rule's SQL gives path, line and message. Row-local rules are a condition; the others join or group by
path and scope, or over the whole corpus, so they shuffle on those keys alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import findings as fi
from gneiss.operators import graph
from gneiss.sources import pysource


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    sql: str
    bad: dict[str, str]
    good: dict[str, str]
    #: of a row-local rule: its condition and its message
    where: str | None = None
    message: str | None = None


RULES: dict[str, Rule] = {}


def _files(x: str | dict[str, str]) -> dict[str, str]:
    return {"pkg/mod.py": x} if isinstance(x, str) else x


def rule(name: str, severity: str, sql: str, bad: str | dict[str, str], good: str | dict[str, str], where: str | None = None, message: str | None = None) -> None:
    """Registers a rule; the SQL reads ``nodes``. A name is taken once."""
    if name in RULES:
        raise ValueError(f"rule {name!r} is registered twice")
    RULES[name] = Rule(name, severity, sql, _files(bad), _files(good), where, message)


def local(name: str, severity: str, where: str, message: str, bad: str | dict[str, str], good: str | dict[str, str]) -> None:
    """A rule that looks at one node alone; all of them run in one pass."""
    rule(name, severity, f"SELECT path, line, {message} AS message FROM nodes WHERE {where}", bad, good, where, message)


def test_file(text: str) -> dict[str, str]:
    return {"tests/test_x.py": text}


# --- row-local: exceptions ---
HANDLER = "kind = 'ExceptHandler'"
BROAD = "(name = '' OR name IN ('Exception', 'BaseException'))"
local("bare_except", "P1", f"{HANDLER} AND (name = '' OR name = 'BaseException')", "'catches everything'", "try:\n    f()\nexcept:\n    raise\n", "try:\n    f()\nexcept ValueError:\n    raise\n")
local("broad_except_swallow", "P1", f"{HANDLER} AND {BROAD} AND attrs['raises'] = 'false' AND attrs['logs'] = 'false' AND attrs['uses'] = 'false'", "'a broad handler hides the failure'", "try:\n    f()\nexcept Exception:\n    pass\n", "try:\n    f()\nexcept Exception:\n    log.error('f failed')\n")
local("log_only_except", "P2", f"{HANDLER} AND {BROAD} AND attrs['only_logs'] = 'true' AND attrs['logs'] = 'true'", "'the failure is logged and goes no further'", "try:\n    f()\nexcept Exception:\n    log.error('x')\n", "try:\n    f()\nexcept Exception:\n    log.error('x')\n    raise\n")
local("swallowed_exceptions", "P1", f"{HANDLER} AND attrs['only'] IN ('Pass', 'Continue') AND NOT is_test", "'the exception is dropped: ' || name", "try:\n    f()\nexcept KeyError:\n    pass\n", "try:\n    f()\nexcept KeyError:\n    g()\n")
local("systemexit_in_library", "P2", "kind = 'Raise' AND name = 'SystemExit' AND NOT is_test AND NOT module_level AND scope NOT LIKE '%main'", "'a library function ends the process'", "def load():\n    raise SystemExit(2)\n", "def main():\n    raise SystemExit(2)\n")

# --- row-local: calls ---
CALL = "kind = 'Call'"
#: A timeout of None is none; what was made with a session class has no timeout of its own.
NO_TIMEOUT = "(NOT contains(attrs['kwargs'], ',timeout,') OR contains(attrs['none_kwargs'], ',timeout,')) AND NOT contains(attrs['kwargs'], ',**,')"
ON_SESSION = "(attrs['instance'] IN ('requests.Session', 'requests.sessions.Session') AND substring_index(name, '.', -1) RLIKE '^(get|post|put|patch|delete|head|options|request)$')"
local("missing_network_timeout", "P1", f"{CALL} AND (name RLIKE '^(requests|httpx)\\\\.(get|post|put|patch|delete|head|options|request)$|(^|\\\\.)urlopen$' OR {ON_SESSION}) AND {NO_TIMEOUT}", "name || ' without a timeout'", "import requests\nrequests.get('u')\n", "import requests\nrequests.get('u', timeout=3)\n")
local("sync_blocking_in_async", "P1", f"{CALL} AND in_async AND attrs['awaited'] = 'false' AND name RLIKE '^(requests\\\\..*|httpx\\\\.(get|post|put|delete|request)|time\\\\.sleep|subprocess\\\\.(run|call|check_call|check_output))$'", "name || ' blocks the event loop'", "async def f():\n    time.sleep(1)\n", "async def f():\n    await asyncio.sleep(1)\n")
local("async_primitive_reinit_per_call", "P1", f"{CALL} AND name RLIKE '^asyncio\\\\.(Lock|Event|Semaphore|Condition)$' AND scope_kind = 'function' AND NOT endswith(scope, '__init__')", "name || ' is new in each call'", "async def f():\n    async with asyncio.Lock():\n        pass\n", "lock = asyncio.Lock()\nasync def f():\n    async with lock:\n        pass\n")
local("console_unicode", "Low", f"{CALL} AND (name = 'print' OR substring_index(name, '.', -1) IN ('info', 'warning', 'error', 'debug')) AND attrs['text'] RLIKE '[^\\\\x00-\\\\x7F]'", "'prints a character beyond ASCII'", "print('caf\\u00e9')\n".encode().decode("unicode_escape"), "print('cafe')\n")
local("locals_get_fragile_lookup", "P2", f"{CALL} AND name IN ('?.get', 'locals.get', 'globals.get') AND code RLIKE '^(locals|globals)\\\\(\\\\)\\\\.get'", "'looks a variable up by name'", "def f():\n    return locals().get('x', 1)\n", "def f(d):\n    return d.get('x', 1)\n")
local("locals_globals_as_output", "P2", f"{CALL} AND attrs['args'] RLIKE '(^|, )(locals|globals)\\\\(\\\\)'", "'passes the name space on'", "def f():\n    fill(locals())\n", "def f():\n    fill({})\n")
local("unthrottled_hot_loop_log", "Low", f"{CALL} AND in_loop AND NOT in_handler AND NOT is_test AND substring_index(name, '.', -1) IN ('warning', 'error') AND name LIKE 'log%.%'", "'logs in each pass of a loop'", "for x in xs:\n    log.warning('x')\n", "for x in xs:\n    n += 1\nlog.warning('x')\n")
local("resource_handle_safety", "P2", f"{CALL} AND name IN ('open', 'tempfile.NamedTemporaryFile', 'tempfile.TemporaryFile', 'subprocess.Popen') AND attrs['with_item'] = 'false' AND (attrs['attribute_of'] = 'true' OR attrs['statement'] = 'true')", "name || ' is never closed'", "x = open('f').read()\n", "with open('f') as f:\n    x = f.read()\n")
local("salted_hash_seed", "P1", f"{CALL} AND (name LIKE '%seed%' OR name RLIKE 'default_rng$') AND attrs['args'] RLIKE '(^|[^.\\\\w])hash\\\\('", "'the seed differs from run to run'", "random.seed(hash('a'))\n", "random.seed(7)\n")
local("naive_utcnow", "P2", f"{CALL} AND name RLIKE '(^|\\\\.)datetime\\\\.(utcnow|utcfromtimestamp)$' AND NOT is_test", "'a time without a zone'", "t = datetime.utcnow()\n", "t = datetime.now(UTC)\n")
local("unsafe_deserialization", "P0", f"{CALL} AND (name IN ('pickle.load', 'pickle.loads', 'marshal.loads', 'dill.loads', 'shelve.open') OR (name = 'yaml.load' AND NOT contains(attrs['args'], 'Safe') AND NOT contains(attrs['kwargs'], ',Loader,')))", "name || ' runs what it reads'", "import pickle\nx = pickle.loads(b)\n", "import json\nx = json.loads(b)\n")
local("predictable_tmp_path", "P2", "kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '^/tmp/.+' AND NOT is_test", "'a path that others can guess'", "p = '/tmp/out.txt'\n", "p = 'out.txt'\n")
local("unpruned_tree_walk", "Low", f"{CALL} AND (name RLIKE '\\\\.rglob$' OR name = 'os.walk') AND NOT is_test", "'walks every folder'", "for p in root.rglob('*.py'):\n    f(p)\n", "for p in root.glob('*.py'):\n    f(p)\n")
local("timing_literal_in_call", "Low", f"{CALL} AND NOT is_test AND (attrs['literal_kwargs'] RLIKE ',(timeout|interval|delay|backoff|wait),' OR (name = 'time.sleep' AND attrs['args'] RLIKE '^[0-9.]+$'))", "'a waiting time stands in the call: ' || name", "f(timeout=3)\n", "f(timeout=LIMIT)\n")
local("hash_fed_by_array_copy", "Low", f"{CALL} AND name RLIKE '(sha\\\\d+|md5|blake2b|xxh\\\\d+.*|update)$' AND attrs['args'] RLIKE '\\\\.tobytes\\\\(\\\\)'", "'copies an array to hash it'", "h.update(a.tobytes())\n", "h.update(a)\n")
local("lf_file_writes", "Low", f"{CALL} AND name = 'open' AND attrs['args'] RLIKE ', .[wa]t?.$' AND NOT contains(attrs['kwargs'], ',newline,') AND NOT is_test", "'line ends depend on the system'", "with open('a', 'w') as f:\n    pass\n", "with open('a', 'w', newline='') as f:\n    pass\n")
local("hardcoded_seed_in_library", "Low", f"{CALL} AND name RLIKE '(^|\\\\.)(seed|default_rng|RandomState)$' AND attrs['args'] RLIKE '^[0-9]+$' AND NOT is_test", "'the seed is fixed: ' || attrs['args']", "r = np.random.default_rng(7)\n", "r = np.random.default_rng(seed)\n")
local("unseeded_rng_fallback", "Low", f"{CALL} AND name RLIKE '(^|\\\\.)(default_rng|RandomState)$' AND attrs['n_args'] = '0' AND attrs['kwargs'] = ',,'", "'no seed'", "r = np.random.default_rng()\n", "r = np.random.default_rng(seed)\n")
local("wallclock_test_waits", "Low", f"{CALL} AND is_test AND name IN ('time.sleep', 'sleep')", "'a test waits'", test_file("def test_a():\n    time.sleep(1)\n"), test_file("def test_a():\n    wait_for(x)\n"))
local("stdlib_json_ban", "Low", "kind = 'Import' AND array_contains(split(name, ','), 'json') AND NOT is_test", "'imports json'", "import json\n", "import orjson\n")
local("sql_limit_without_order_by", "P2", "kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '(?is)^\\\\s*select\\\\b.*\\\\blimit\\\\s' AND NOT attrs['value'] RLIKE '(?i)order\\\\s+by'", "'which rows come is left open'", "q = 'SELECT a FROM t LIMIT 5'\n", "q = 'SELECT a FROM t ORDER BY a LIMIT 5'\n")
local("sql_offset_pagination", "Low", "kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '(?is)\\\\blimit\\\\b.*\\\\boffset\\\\b'", "'pages by offset'", "q = 'SELECT a FROM t ORDER BY a LIMIT 5 OFFSET 5'\n", "q = 'SELECT a FROM t ORDER BY a LIMIT 5'\n")
local("sql_migration_not_idempotent", "P2", "kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '(?i)\\\\b(create\\\\s+(table|index|schema)|drop\\\\s+(table|index)|add\\\\s+column)\\\\s+(?!if\\\\b)\\\\w'", "'fails when it runs again'", "q = 'CREATE TABLE t (a int)'\n", "q = 'CREATE TABLE IF NOT EXISTS t (a int)'\n")
local("sql_aggregate_before_cast", "P2", "kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '(?i)\\\\b(min|max)\\\\(\\\\s*[\\\\w.]+\\\\s*->>\\\\s*.\\\\w+.\\\\s*\\\\)'", "'compares numbers as text'", "q = \"SELECT max(d->>'n') FROM t\"\n", "q = \"SELECT max((d->>'n')::int) FROM t\"\n")
local("sqlalchemy_text_binds", "P2", f"{CALL} AND substring_index(name, '.', -1) = 'text' AND attrs['text'] RLIKE ':\\\\w+::'", "'a cast behind a bind parameter'", "q = text('SELECT :a::int')\n", "q = text('SELECT CAST(:a AS int)')\n")

# --- row-local: definitions and statements ---
FUNC = "kind IN ('FunctionDef', 'AsyncFunctionDef')"
local("mutable_default", "P1", f"{FUNC} AND attrs['mutable'] <> ''", "name || ' shares its default ' || attrs['mutable']", "def f(x=[]):\n    pass\n", "def f(x=None):\n    pass\n")
local("nan_equality", "P1", "kind = 'Compare' AND attrs['ops'] RLIKE '^(Eq|NotEq)$' AND (attrs['right'] RLIKE '(?i)^((np|math|numpy)\\\\.nan|float\\\\(.nan.\\\\))$' OR attrs['left'] RLIKE '(?i)^((np|math|numpy)\\\\.nan|float\\\\(.nan.\\\\))$')", "'nothing equals NaN'", "ok = x == np.nan\n", "ok = np.isnan(x)\n")
local("identity_comparisons", "P1", "kind = 'Compare' AND attrs['ops'] RLIKE '^(Is|IsNot)$' AND attrs['string'] = 'true'", "'compares a value by identity'", "ok = x is 'a'\n", "ok = x == 'a'\n")
local("additive_epsilon_denominator", "P2", "kind = 'BinOp' AND name = 'Div' AND attrs['epsilon'] IS NOT NULL AND cast(attrs['epsilon'] AS double) <= 1e-3", "'a small constant bends the quotient: ' || attrs['epsilon']", "x = a / (b + 1e-9)\n", "x = a / max(b, 1e-9)\n")
local("default_via_or", "P2", "kind = 'BoolOp' AND name = 'Or' AND attrs['first_kind'] = 'Name' AND attrs['last_kind'] IN ('Constant', 'List', 'Dict', 'Call') AND attrs['last'] NOT IN ('None', 'False', '\"\"', \"''\", '0', '[]', '{}') AND scope_kind = 'function'", "'replaces a valid falsy value'", "def f(x):\n    y = x or 5\n", "def f(x):\n    y = 5 if x is None else x\n")
local("duplicate_condition", "P2", "(kind = 'BoolOp' OR kind = 'If' OR kind = 'Dict') AND attrs['repeats'] = 'true'", "'the same condition or key twice'", "x = a or a\n", "x = a or b\n")
local("duplicate_module_docstring", "Low", "kind = 'Module' AND attrs['two_docstrings'] = 'true'", "'the second docstring does nothing'", "'a'\n'b'\n", "'a'\nx = 1\n")
local("definition_after_entry_guard", "P2", "kind = 'Module' AND attrs['after_guard'] = 'true'", "'defined after the entry guard'", "if __name__ == '__main__':\n    f()\ndef f():\n    pass\n", "def f():\n    pass\nif __name__ == '__main__':\n    f()\n")
local("assert_in_loop_first_failure_only", "Low", "kind = 'Assert' AND in_loop AND is_test", "'stops at the first bad item'", test_file("def test_a():\n    for x in xs:\n        assert x\n"), test_file("def test_a():\n    assert all(xs)\n"))
local("value_bearing_asserts", "P2", "kind = 'Assert' AND NOT is_test AND attrs['test'] NOT LIKE 'isinstance%'", "'vanishes under -O'", "def f(x):\n    assert x > 0\n", "def f(x):\n    if x <= 0:\n        raise ValueError(x)\n")
local("vacuous_assertion", "P1", "kind = 'Assert' AND is_test AND (attrs['test'] IN ('True', '1') OR attrs['test_kind'] = 'Tuple')", "'can not fail'", test_file("def test_a():\n    assert True\n"), test_file("def test_a():\n    assert f()\n"))
local("tautological_is_not_none_only_test", "P2", f"{FUNC} AND is_test AND name LIKE 'test%' AND attrs['asserts'] > '0' AND attrs['asserts'] = attrs['not_none_asserts']", "'asserts no more than that something is there'", test_file("def test_a():\n    assert f() is not None\n"), test_file("def test_a():\n    assert f() == 3\n"))
local("nondiscriminating_test", "P2", f"{FUNC} AND is_test AND name LIKE 'test%' AND attrs['asserts'] = '0' AND NOT attrs['reads'] RLIKE ',(pytest|self|raises),'", "'asserts nothing'", test_file("def test_a():\n    f()\n"), test_file("def test_a():\n    assert f()\n"))
local("mutation_during_iteration", "P1", "kind = 'For' AND contains(attrs['changes'], ',' || name || ',') AND attrs['leaves'] = 'false'", "'changes what it walks over: ' || name", "for x in xs:\n    xs.remove(x)\n", "for x in list(xs):\n    xs.remove(x)\n")
local("retry_loop", "P2", "kind = 'While' AND name = 'True' AND attrs['tries'] = 'true' AND attrs['bounded'] = 'false' AND attrs['sleeps'] = 'false'", "'tries again at once and for ever'", "while True:\n    try:\n        f()\n    except OSError:\n        pass\n", "while True:\n    try:\n        f()\n    except OSError:\n        time.sleep(1)\n")
local("hardcoded_absolute_path_in_test", "Low", "kind = 'Constant' AND name = 'str' AND is_test AND attrs['value'] RLIKE '^([A-Za-z]:[\\\\\\\\/]|/(home|Users)/[^/]+/|/root/)'", "'a path of one machine'", test_file("P = '/home/ann/data'\n"), test_file("P = 'data'\n"))
local("machine_specific_paths", "Low", "kind = 'Constant' AND name = 'str' AND NOT is_test AND attrs['value'] RLIKE '^([A-Za-z]:[\\\\\\\\/]|/(home|Users)/[^/]+/)'", "'a path of one machine'", "P = 'C:/data'\n", "P = 'data'\n")
local("estimator_mixin_order", "P2", "kind = 'ClassDef' AND attrs['bases'] RLIKE 'BaseEstimator.*,.*Mixin'", "'a mixin behind BaseEstimator'", "class A(BaseEstimator, RegressorMixin):\n    pass\n", "class A(RegressorMixin, BaseEstimator):\n    pass\n")
local("todo_hygiene", "Low", "kind = 'Comment' AND code RLIKE '(?i)#\\\\s*(TODO|FIXME|XXX|HACK)\\\\b' AND NOT code RLIKE '\\\\([^)]*\\\\)|\\\\d{4}-\\\\d{2}-\\\\d{2}|@\\\\w+'", "'nobody is named: ' || trim(code)", "# TODO later\n", "# TODO(ann) later\n")
local("comment_cites_absolute_line", "Low", "kind = 'Comment' AND code RLIKE '(?i)\\\\bline\\\\s+\\\\d+'", "'a line number moves'", "# see line 40\n", "# see f()\n")

# --- joins within a file ---
rule("missed_await", "P1", "SELECT c.path, c.line, c.name || ' is never awaited' AS message FROM nodes c LEFT SEMI JOIN nodes f ON f.path = c.path AND f.kind = 'AsyncFunctionDef' AND f.name = c.name WHERE c.kind = 'Call' AND c.attrs['statement'] = 'true'", "async def f():\n    pass\nasync def g():\n    f()\n", "async def f():\n    pass\nasync def g():\n    await f()\n")
rule("possibly_dead_import", "Low", "SELECT i.path, i.line, i.b || ' is imported and never read' AS message FROM (SELECT path, line, explode(split(attrs['bound'], ',')) AS b FROM nodes WHERE kind IN ('Import', 'ImportFrom') AND module_level AND NOT endswith(path, '__init__.py') AND name <> '__future__') i LEFT ANTI JOIN nodes u ON u.path = i.path AND u.kind = 'Name' AND u.name = i.b", "import os\n", "import os\nos.getcwd()\n")
rule("unread_function_params", "P2", "SELECT path, line, p || ' is never read' AS message FROM (SELECT path, line, attrs, explode(split(attrs['params'], ',')) AS p FROM nodes WHERE kind IN ('FunctionDef', 'AsyncFunctionDef') AND attrs['method'] = 'false' AND attrs['stub'] = 'false' AND NOT is_test AND attrs['decorators'] = '') WHERE p <> '' AND NOT startswith(p, '_') AND NOT contains(attrs['reads'], ',' || p || ',')", "def f(a, b):\n    return a\n", "def f(a, b):\n    return a + b\n")
rule("docstring_args_incomplete", "Low", "SELECT path, line, p || ' lacks in Args' AS message FROM (SELECT path, line, attrs, explode(split(attrs['params'], ',')) AS p FROM nodes WHERE kind IN ('FunctionDef', 'AsyncFunctionDef') AND attrs['docstring'] RLIKE '(?m)^\\\\s*Args:') WHERE p NOT IN ('', 'self', 'cls') AND NOT attrs['docstring'] RLIKE ('(?m)^\\\\s*\\\\*{0,2}' || p || '\\\\b')", "def f(a, b):\n    '''x\n\n    Args:\n        a: one\n    '''\n    return a, b\n", "def f(a):\n    '''x\n\n    Args:\n        a: one\n    '''\n    return a\n")
rule("sleep_then_assert", "P2", "SELECT a.path, min(a.line) AS line, 'asserts after a real wait' AS message FROM nodes s JOIN nodes a ON a.path = s.path AND a.scope = s.scope AND a.kind = 'Assert' AND a.line > s.line WHERE s.kind = 'Call' AND s.name IN ('time.sleep', 'sleep') AND s.is_test GROUP BY a.path, a.scope", test_file("def test_a():\n    time.sleep(1)\n    assert x\n"), test_file("def test_a():\n    assert x\n"))
rule("wall_clock_assertion", "P2", "SELECT a.path, a.line, 'asserts on elapsed time' AS message FROM nodes a JOIN nodes t ON t.path = a.path AND t.scope = a.scope AND t.kind = 'Assign' AND t.attrs['value'] RLIKE '(perf_counter|monotonic|time\\\\.time)\\\\(\\\\) -' AND contains(a.attrs['test'], t.name) WHERE a.kind = 'Assert' AND a.is_test", test_file("def test_a():\n    t = time.time()\n    d = time.time() - t\n    assert d < 1\n"), test_file("def test_a():\n    d = f()\n    assert d < 1\n"))
rule("unreachable_import_fallback", "Low", "SELECT t.path, t.line, t.name || ' is imported anyway' AS message FROM nodes t LEFT SEMI JOIN nodes p ON p.path = t.path AND p.kind = 'Import' AND p.module_level AND NOT p.in_try AND p.name = t.name WHERE t.kind = 'Import' AND t.in_try", "import a\ntry:\n    import a\nexcept ImportError:\n    a = None\n", "try:\n    import a\nexcept ImportError:\n    a = None\n")
rule("persisted_negative_probe", "P2", "SELECT path, line, 'a failure is kept as an answer: ' || name AS message FROM nodes WHERE kind = 'Assign' AND in_handler AND name RLIKE '(?i)cache.*\\\\[' AND attrs['value'] IN ('None', 'False', '{}', '[]')", "try:\n    f()\nexcept OSError:\n    _cache['k'] = None\n", "try:\n    f()\nexcept OSError:\n    raise\n")
rule("state_before_work", "P2", "SELECT s.path, s.line, s.name || ' is stamped before the work' AS message FROM nodes s JOIN nodes w ON w.path = s.path AND w.scope = s.scope AND w.kind = 'Call' AND w.line > s.line AND w.name RLIKE '(^|\\\\.)(run|send|process|fetch|execute)\\\\w*$' WHERE s.kind = 'Assign' AND s.name RLIKE '(last_run|last_seen|processed_at|_done)$' AND s.scope_kind = 'function'", "def f(self):\n    self.last_run = now()\n    self.send()\n", "def f(self):\n    self.send()\n    self.last_run = now()\n")
rule("lock_held_across_io", "P1", "SELECT path, line, name || ' blocks while a lock may be held' AS message FROM nodes c WHERE kind = 'Call' AND in_with AND name RLIKE '^(requests|httpx)\\\\.|urlopen$|\\\\.connect$|^time\\\\.sleep$' AND EXISTS (SELECT 1 FROM nodes w WHERE w.path = c.path AND w.scope = c.scope AND w.kind IN ('Name', 'Attribute') AND w.name RLIKE '(?i)lock$' AND w.line <= c.line)", "def f():\n    with lock:\n        requests.get('u', timeout=1)\n", "def f():\n    with session:\n        requests.get('u', timeout=1)\n")

# --- the whole corpus ---
rule("duplicate_function_body", "P2", "SELECT path, line, name || ' repeats ' || first.path || ':' || first.name AS message FROM (SELECT *, first_value(struct(path, name)) OVER w AS first, row_number() OVER w AS k FROM (SELECT path, line, name, attrs['body'] AS body FROM nodes WHERE kind IN ('FunctionDef', 'AsyncFunctionDef') AND cast(attrs['size'] AS int) >= 8 AND name NOT LIKE '\\\\_\\\\_%') WINDOW w AS (PARTITION BY sha2(body, 256) ORDER BY path, line)) WHERE k > 1", {"a.py": "def f(x):\n    y = x + 1\n    return y * 2\n", "b.py": "def g(x):\n    y = x + 1\n    return y * 2\n"}, {"a.py": "def f(x):\n    y = x + 1\n    return y * 2\n", "b.py": "def g(x):\n    y = x + 3\n    return y * 4 - x\n"})
rule("dead_cli_flag", "P2", "SELECT a.path, a.line, a.attrs['text'] || ' is never read' AS message FROM nodes a LEFT ANTI JOIN (SELECT DISTINCT name FROM nodes WHERE kind = 'Attribute' AND attrs['ctx'] = 'Load') r ON r.name = replace(ltrim('-', a.attrs['text']), '-', '_') WHERE a.kind = 'Call' AND a.name LIKE '%add_argument' AND startswith(a.attrs['text'], '--')", "p.add_argument('--dry-run')\n", "p.add_argument('--dry-run')\nprint(args.dry_run)\n")
rule("unread_declared_field", "P2", "SELECT f.path, f.line, f.name || ' is declared and never read' AS message FROM (SELECT n.path, n.line, n.name, n.scope FROM nodes n JOIN nodes c ON c.path = n.path AND c.kind = 'ClassDef' AND n.scope = ltrim('.', c.scope || '.' || c.name) AND contains(c.attrs['decorators'], 'dataclass') WHERE n.kind = 'AnnAssign' AND n.attrs['in_class'] = 'true' AND NOT startswith(n.name, '_')) f LEFT ANTI JOIN (SELECT DISTINCT name FROM nodes WHERE kind = 'Attribute' AND attrs['ctx'] = 'Load') r ON r.name = f.name", "@dataclass\nclass A:\n    x: int\n", "@dataclass\nclass A:\n    x: int\ndef f(a):\n    return a.x\n")
rule("unraised_exception_class", "Low", "SELECT c.path, c.line, c.name || ' is never raised' AS message FROM nodes c LEFT ANTI JOIN (SELECT DISTINCT substring_index(name, '.', -1) AS name FROM nodes WHERE kind IN ('Raise', 'Call')) r ON r.name = c.name LEFT ANTI JOIN (SELECT DISTINCT explode(split(attrs['bases'], ',')) AS name FROM nodes WHERE kind = 'ClassDef') b ON b.name = c.name WHERE c.kind = 'ClassDef' AND c.attrs['bases'] RLIKE '(Error|Exception)$' AND NOT c.is_test", "class A(ValueError):\n    pass\n", "class A(ValueError):\n    pass\ndef f():\n    raise A\n")
rule("uncalled_functions", "Low", "SELECT f.path, f.line, f.name || ' is never used' AS message FROM nodes f LEFT ANTI JOIN (SELECT DISTINCT name FROM nodes WHERE kind = 'Attribute' OR kind = 'Name' UNION SELECT explode(split(attrs['names'], ',')) FROM nodes WHERE kind = 'ImportFrom') u ON u.name = f.name WHERE f.kind IN ('FunctionDef', 'AsyncFunctionDef') AND f.module_level AND f.attrs['decorators'] = '' AND f.name NOT LIKE '\\\\_\\\\_%' AND f.name <> 'main' AND NOT f.is_test", "def f():\n    pass\n", "def f():\n    pass\nf()\n")
rule("getattr_unknown_attribute", "P2", "SELECT g.path, g.line, g.attrs['text'] || ' is an attribute of nothing' AS message FROM nodes g LEFT ANTI JOIN (SELECT DISTINCT name FROM nodes WHERE (kind = 'Attribute' AND attrs['ctx'] = 'Store') OR kind IN ('FunctionDef', 'AsyncFunctionDef') UNION SELECT name FROM nodes WHERE kind IN ('AnnAssign', 'Assign') AND attrs['in_class'] = 'true') k ON k.name = g.attrs['text'] WHERE g.kind = 'Call' AND g.name = 'getattr' AND g.attrs['text'] <> '' AND g.attrs['n_args'] = '3' AND NOT startswith(g.attrs['text'], '__')", "x = getattr(a, 'wdith', 1)\n", "class A:\n    width = 1\nx = getattr(A(), 'width', 1)\n")
rule("comment_names_missing_symbol", "Low", "SELECT c.path, c.line, c.s || ' is defined nowhere' AS message FROM (SELECT path, line, explode(regexp_extract_all(code, '`([A-Za-z_]\\\\w*)\\\\(\\\\)`', 1)) AS s FROM nodes WHERE kind = 'Comment') c LEFT ANTI JOIN (SELECT DISTINCT name FROM nodes WHERE kind IN ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')) d ON d.name = c.s", "# see `gone()`\nx = 1\n", "# see `f()`\ndef f():\n    pass\n")
rule("stale_source_citation", "Low", "SELECT c.path, c.line, c.f || ':' || c.n || ' is past the end or gone' AS message FROM (SELECT path, line, regexp_extract(code, '([\\\\w/]+\\\\.py):(\\\\d+)', 1) AS f, cast(regexp_extract(code, '([\\\\w/]+\\\\.py):(\\\\d+)', 2) AS int) AS n FROM nodes WHERE kind = 'Comment' AND code RLIKE '[\\\\w/]+\\\\.py:\\\\d+') c LEFT JOIN (SELECT path AS p, max(end_line) AS last FROM nodes GROUP BY path) e ON e.p = c.f WHERE e.last IS NULL OR c.n > e.last", "# see pkg/mod.py:90\nx = 1\n", "# see pkg/mod.py:2\nx = 1\n")
rule("uncurated_star_export", "Low", "SELECT i.path, i.line, 'exports all of ' || i.name AS message FROM nodes i JOIN nodes m ON m.path = i.path AND m.kind = 'Module' AND m.attrs['has_all'] = 'false' WHERE i.kind = 'ImportFrom' AND i.attrs['names'] = '*' AND endswith(i.path, '__init__.py') AND startswith(i.name, '.')", {"p/__init__.py": "from .a import *\n", "p/a.py": "x = 1\n"}, {"p/__init__.py": "from .a import *\n__all__ = ['x']\n", "p/a.py": "x = 1\n"})
rule("private_imports", "Low", "SELECT path, line, 'imports the private ' || p || ' of ' || name AS message FROM (SELECT path, line, name, is_test, explode(split(attrs['names'], ',')) AS p FROM nodes WHERE kind = 'ImportFrom' AND name <> '' AND NOT startswith(name, '.')) WHERE startswith(p, '_') AND NOT startswith(p, '__') AND NOT is_test AND split(name, '[.]')[0] <> split(path, '/')[0]", "from other import _x\nprint(_x)\n", "from other import x\nprint(x)\n")
rule("redundant_test_fit_call", "Low", "SELECT path, min(line) AS line, code || ' runs in ' || count(DISTINCT scope) || ' tests' AS message FROM nodes WHERE kind = 'Call' AND is_test AND scope LIKE 'test%' AND startswith(name, '_') AND attrs['n_args'] > '0' GROUP BY path, code HAVING count(DISTINCT scope) >= 2", test_file("def test_a():\n    assert _fit(3)\ndef test_b():\n    assert _fit(3)\n"), test_file("def test_a():\n    assert _fit(3)\ndef test_b():\n    assert _fit(4)\n"))
rule("partial_guard_across_siblings", "P2", "WITH m AS (SELECT path, line, name, attrs['guard'] RLIKE ('\\\\b' || split(attrs['params'], ',')[0] || '\\\\b') AS guarded, split(ltrim('_', name), '_')[0] AS family, split(attrs['params'], ',')[0] AS p FROM nodes WHERE kind = 'FunctionDef' AND attrs['params'] <> '' AND module_level), f AS (SELECT path, family, p, count(*) AS n, count_if(guarded) AS g FROM m GROUP BY path, family, p) SELECT m.path, m.line, m.name || ' lacks the guard of ' || g || ' siblings' AS message FROM m JOIN f ON f.path = m.path AND f.family = m.family AND f.p = m.p WHERE n >= 3 AND g >= 0.6 * n AND g < n AND NOT guarded", "def load_a(x):\n    if x is None:\n        return 0\n    return 1\ndef load_b(x):\n    if x is None:\n        return 0\n    return 2\ndef load_c(x):\n    return x\n", "def load_a(x):\n    if x is None:\n        return 0\n    return 1\ndef load_b(x):\n    return x\n")
rule("sibling_guard_missing", "P2", "WITH m AS (SELECT path, line, name, scope, attrs['guard'] AS guard FROM nodes WHERE kind = 'FunctionDef' AND attrs['method'] = 'true' AND NOT startswith(name, '_')), t AS (SELECT path, scope, guard, count(*) AS g FROM m WHERE guard <> '' GROUP BY path, scope, guard), s AS (SELECT path, scope, count(*) AS n FROM m GROUP BY path, scope) SELECT m.path, m.line, m.name || ' lacks: if ' || t.guard AS message FROM m JOIN t ON t.path = m.path AND t.scope = m.scope JOIN s ON s.path = m.path AND s.scope = m.scope WHERE s.n >= 3 AND t.g >= 0.6 * s.n AND t.g < s.n AND m.guard <> t.guard", "class A:\n    def a(self):\n        if self.closed:\n            return\n        f()\n    def b(self):\n        if self.closed:\n            return\n        g()\n    def c(self):\n        h()\n", "class A:\n    def a(self):\n        f()\n    def b(self):\n        g()\n    def c(self):\n        h()\n")
rule("override_signature_drift", "P2", "WITH c AS (SELECT path, name, scope, explode(split(attrs['bases'], ',')) AS base FROM nodes WHERE kind = 'ClassDef'), f AS (SELECT path, line, name, scope, attrs['params'] AS params FROM nodes WHERE kind = 'FunctionDef' AND attrs['method'] = 'true'), o AS (SELECT c.base, f.name, explode(split(f.params, ',')) AS p FROM c JOIN f ON f.path = c.path AND f.scope = ltrim('.', c.scope || '.' || c.name)) SELECT f.path, f.line, f.scope || '.' || f.name || ' lacks ' || o.p AS message FROM o JOIN f ON f.scope = o.base AND f.name = o.name WHERE NOT array_contains(split(f.params, ','), o.p) GROUP BY f.path, f.line, f.scope, f.name, o.p HAVING count(*) >= 2", "class A:\n    def f(self):\n        g()\nclass B(A):\n    def f(self, x):\n        g()\nclass C(A):\n    def f(self, x):\n        g()\n", "class A:\n    def f(self, x):\n        g()\nclass B(A):\n    def f(self, x):\n        g()\nclass C(A):\n    def f(self, x):\n        g()\n")


# --- further row-local rules ---
local("polars_null_equality", "P1", "kind = 'Compare' AND attrs['ops'] RLIKE '^(Eq|NotEq)$' AND attrs['right'] = 'None' AND attrs['left'] RLIKE '(pl\\\\.)?col\\\\('", "'a null is equal to nothing'", "e = pl.col('a') == None\n", "e = pl.col('a').is_null()\n")
local("connection_liveness_kwargs", "P2", f"{CALL} AND name RLIKE '(^|\\\\.)(psycopg2?|asyncpg)\\\\.connect$' AND NOT (contains(attrs['kwargs'], ',connect_timeout,') OR contains(attrs['kwargs'], ',timeout,') OR contains(attrs['kwargs'], ',**,'))", "'a dead peer is never noticed'", "c = psycopg2.connect(dsn)\n", "c = psycopg2.connect(dsn, connect_timeout=5)\n")
local("no_xfail_to_defer", "P2", f"{CALL} AND is_test AND name RLIKE '(^|\\\\.)xfail$' AND NOT contains(attrs['kwargs'], ',strict,')", "'a known failure that may pass unseen'", test_file("@pytest.mark.xfail(reason='later')\ndef test_a():\n    assert f()\n"), test_file("@pytest.mark.xfail(reason='later', strict=True)\ndef test_a():\n    assert f()\n"))
local("fail_message_quality", "Low", f"{CALL} AND is_test AND name = 'pytest.fail' AND length(attrs['text']) < 15", "'says nothing of what to do'", test_file("def test_a():\n    pytest.fail('bad')\n"), test_file("def test_a():\n    pytest.fail('regenerate the file with make x')\n"))
local("git_child_env", "P2", f"{CALL} AND is_test AND name RLIKE '^subprocess\\\\.' AND attrs['args'] RLIKE '^\\\\[.git.' AND NOT contains(attrs['kwargs'], ',env,')", "'git inherits the environment'", test_file("def test_a():\n    subprocess.run(['git', 'init'])\n"), test_file("def test_a():\n    subprocess.run(['git', 'init'], env=ENV)\n"))
local("env_flag_parsing", "Low", "kind = 'Compare' AND NOT is_test AND attrs['left'] RLIKE 'os\\\\.(environ|getenv)' AND attrs['right'] RLIKE '(?i)^.(1|true|yes|on).$'", "'reads a flag by hand'", "on = os.environ.get('X') == '1'\n", "on = flag('X')\n")
local("sentinel_or_fallback", "P2", "kind = 'BoolOp' AND name = 'Or' AND attrs['first'] RLIKE '(^|\\\\.)(get|pop)\\\\(' AND attrs['last_kind'] = 'Constant' AND attrs['last'] NOT IN ('None', 'False')", "'a valid empty value is replaced'", "x = d.get('a') or 5\n", "x = d.get('a', 5)\n")
local("hardcoded_token_ceilings", "Low", f"{CALL} AND NOT is_test AND attrs['literal_kwargs'] RLIKE ',(max_tokens|max_output_tokens),'", "'a limit stands in the call'", "f(max_tokens=512)\n", "f(max_tokens=LIMIT)\n")
local("fit_at_test_module_import", "P2", f"{CALL} AND is_test AND module_level AND name RLIKE '\\\\.fit$'", "'trains while tests are collected'", test_file("m = M().fit(x)\n"), test_file("def test_a():\n    assert M().fit(x)\n"))
local("import_time_global_side_effects", "P2", f"{CALL} AND module_level AND NOT is_test AND attrs['statement'] = 'true' AND name RLIKE '^(os\\\\.(chdir|putenv|umask)|warnings\\\\.(filterwarnings|simplefilter)|logging\\\\.basicConfig|random\\\\.seed|(np|numpy)\\\\.random\\\\.seed|sys\\\\.setrecursionlimit)$'", "name || ' at import'", "import random\nrandom.seed(1)\n", "import random\ndef f(seed):\n    random.seed(seed)\n")
local("latched_availability_flags", "P2", "kind = 'Assign' AND in_handler AND name RLIKE '^_?(HAS|HAVE|AVAILABLE)_?\\\\w*$|_AVAILABLE$' AND attrs['value'] = 'False' AND scope_kind = 'function'", "'one failure is remembered for ever'", "def f():\n    global HAS_X\n    try:\n        g()\n    except Exception:\n        HAS_X = False\n", "try:\n    import x\nexcept ImportError:\n    HAS_X = False\n")
local("ordinal_rank_scatter", "Low", f"{CALL} AND name RLIKE '(^|\\\\.)argsort$' AND code RLIKE 'argsort\\\\(.*\\\\.?argsort\\\\('", "'ties get different ranks'", "r = np.argsort(np.argsort(x))\n", "r = rankdata(x)\n")
local("njit_fastmath_nan", "P2", f"{CALL} AND name RLIKE '(^|\\\\.)n?jit$' AND code RLIKE 'fastmath=True'", "'NaN tests may be dropped'", "@njit(fastmath=True)\ndef f(x):\n    return x\n", "@njit\ndef f(x):\n    return x\n")
local("cuda_launch_bounds_literal", "Low", "kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '__launch_bounds__\\\\(\\\\s*[0-9]+'", "'a bound stands in the source'", "K = '__launch_bounds__(256) void f() {}'\n", "K = '__launch_bounds__(BLOCK) void f() {}'\n")
local("cuda_nvrtc_headers", "P2", "kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '(?s)#include\\\\s*<(cuda_runtime|stdio|stdlib|math)\\\\.h>.*__global__'", "'a header that run-time compilation lacks'", "K = '#include <math.h>\\\\n__global__ void f() {}'\n", "K = '__global__ void f() {}'\n")
local("cuda_kernel_fp_types", "Low", "kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '(?s)__global__.*[^\\\\w.][0-9]+\\\\.[0-9]+[^0-9fF]'", "'a double literal in a kernel'", "K = '__global__ void f(float* x) { x[0] = 1.5; }'\n", "K = '__global__ void f(float* x) { x[0] = 1.5f; }'\n")
local("truncating_discretisation", "P2", f"{CALL} AND name = 'int' AND attrs['args'] RLIKE '^[^()]* / [^()]*$'", "'rounds toward zero'", "k = int(x / w)\n", "k = round(x / w)\n")
local("constant_fallback_cache_key", "P1", "kind = 'BoolOp' AND name = 'Or' AND attrs['first'] RLIKE '(?i)(cache_?key|fingerprint|digest)' AND attrs['last_kind'] = 'Constant' AND attrs['last'] <> 'None'", "'different inputs share a key'", "k = cache_key or 'default'\n", "k = cache_key or None\n")
local("hash_key_determinism", "P2", f"{CALL} AND name = 'json.dumps' AND NOT contains(attrs['kwargs'], ',sort_keys,') AND attrs['attribute_of'] = 'true'", "'the order of keys decides the hash'", "h = sha(json.dumps(d).encode())\n", "h = sha(json.dumps(d, sort_keys=True).encode())\n")
local("atomic_write_staging", "P2", f"{CALL} AND NOT is_test AND name RLIKE '\\\\.write_text$' AND code RLIKE '(?i)(state|baseline|checkpoint|manifest)'", "'a reader may see half a file'", "state_path.write_text(x)\n", "atomic_write(state_path, x)\n")
local("validation_errors_echo_input", "P1", f"{CALL} AND in_handler AND name RLIKE '(HTTPException|JSONResponse|jsonify)$' AND code RLIKE '(errors\\\\(\\\\)|str\\\\((e|exc|err)\\\\))'", "'sends the input back'", "try:\n    f()\nexcept ValueError as e:\n    raise HTTPException(detail=str(e))\n", "try:\n    f()\nexcept ValueError as e:\n    raise HTTPException(detail='bad input')\n")
local("shared_mutable_placeholder", "P1", "kind = 'BinOp' AND name = 'Mult' AND code RLIKE '^\\\\[(\\\\[\\\\]|\\\\{\\\\}|set\\\\(\\\\)|dict\\\\(\\\\)|list\\\\(\\\\))\\\\] \\\\*'", "'all places hold the same object'", "x = [[]] * 3\n", "x = [[] for _ in range(3)]\n")
local("retry_without_backoff_literal", "Low", f"{CALL} AND in_loop AND in_handler AND name = 'time.sleep' AND attrs['args'] RLIKE '^[0-9.]+$' AND NOT is_test", "'waits the same time after each failure'", "for i in range(3):\n    try:\n        f()\n    except OSError:\n        time.sleep(1)\n", "for i in range(3):\n    try:\n        f()\n    except OSError:\n        time.sleep(2 ** i)\n")
local("order_losing_filters", "Low", f"{CALL} AND name RLIKE '(^|\\\\.)set$' AND attrs['attribute_of'] = 'false' AND attrs['n_args'] = '1' AND code RLIKE '^set\\\\(\\\\w+\\\\)$' AND NOT is_test AND in_loop", "'the order is lost in each pass'", "for x in xs:\n    y = set(x)\n", "for x in xs:\n    y = dict.fromkeys(x)\n")
local("survivorship_scoring", "P2", f"{CALL} AND name RLIKE '(mean|nanmean|average)$' AND attrs['args'] RLIKE '(is not None|dropna\\\\(\\\\)|isfinite)'", "'failed cases leave the score'", "m = np.mean([x for x in xs if x is not None])\n", "m = np.mean(xs)\n")
local("oof_buffer_zero_init", "P2", "kind = 'Assign' AND name RLIKE '(^|_)oof(_|$)' AND attrs['value'] RLIKE '(^|\\\\.)zeros(_like)?\\\\('", "'a row that no fold fills scores 0'", "oof_pred = np.zeros(n)\n", "oof_pred = np.full(n, np.nan)\n")

# --- further joins ---
rule("column_no_write_path", "P2", "WITH q AS (SELECT path, line, lower(attrs['value']) AS s FROM nodes WHERE kind = 'Constant' AND name = 'str'), d AS (SELECT path, line, explode(transform(split(regexp_extract(s, 'create\\\\s+table\\\\s+(?:if\\\\s+not\\\\s+exists\\\\s+)?\\\\w+\\\\s*\\\\(([^)]*)', 1), ','), x -> split(trim(x), '\\\\s+')[0])) AS col FROM q WHERE s RLIKE 'create\\\\s+table'), w AS (SELECT DISTINCT explode(transform(split(regexp_extract(s, 'insert\\\\s+into\\\\s+\\\\w+\\\\s*\\\\(([^)]*)', 1), ','), x -> trim(x))) AS col FROM q WHERE s RLIKE 'insert\\\\s+into' UNION SELECT regexp_extract(s, 'set\\\\s+(\\\\w+)\\\\s*=', 1) FROM q WHERE s RLIKE 'update\\\\s+\\\\w+\\\\s+set') SELECT d.path, d.line, d.col || ' is never written' AS message FROM d LEFT ANTI JOIN w ON w.col = d.col WHERE d.col <> ''", "A = 'CREATE TABLE t (a int, b int)'\nB = 'INSERT INTO t (a) VALUES (1)'\n", "A = 'CREATE TABLE t (a int, b int)'\nB = 'INSERT INTO t (a, b) VALUES (1, 2)'\n")
rule("sql_sibling_missing_time_bound", "P2", "WITH q AS (SELECT path, line, regexp_extract(lower(attrs['value']), '\\\\bfrom\\\\s+(\\\\w+)', 1) AS tbl, lower(attrs['value']) RLIKE '(created_at|ts|time)\\\\s*>' AS bound FROM nodes WHERE kind = 'Constant' AND name = 'str' AND attrs['value'] RLIKE '(?i)^\\\\s*select\\\\b'), g AS (SELECT tbl, count(*) AS n, count_if(bound) AS k FROM q GROUP BY tbl) SELECT q.path, q.line, 'reads all of ' || q.tbl AS message FROM q JOIN g ON g.tbl = q.tbl WHERE g.n >= 3 AND g.k >= 0.6 * g.n AND NOT q.bound AND q.tbl <> ''", "A = 'SELECT a FROM e WHERE ts > 1'\nB = 'SELECT b FROM e WHERE ts > 2'\nC = 'SELECT c FROM e'\n", "A = 'SELECT a FROM e WHERE ts > 1'\nC = 'SELECT c FROM e'\n")
rule("stats_key_coverage", "P2", "SELECT w.path, w.line, w.name || ' is never reset' AS message FROM nodes w LEFT ANTI JOIN nodes r ON r.path = w.path AND r.kind = 'Assign' AND r.name = w.name AND r.scope RLIKE '(reset|__init__)$' WHERE w.kind = 'AugAssign' AND w.name RLIKE '^self\\\\.stats\\\\['", "class A:\n    def reset(self):\n        self.stats['a'] = 0\n    def f(self):\n        self.stats['b'] += 1\n", "class A:\n    def reset(self):\n        self.stats['b'] = 0\n    def f(self):\n        self.stats['b'] += 1\n")
rule("unpicklable_resource_state", "P2", "SELECT a.path, a.line, a.name || ' can not be pickled' AS message FROM nodes a LEFT ANTI JOIN nodes g ON g.path = a.path AND g.name IN ('__getstate__', '__reduce__') AND g.kind = 'FunctionDef' AND startswith(a.scope, g.scope) WHERE a.kind = 'Assign' AND endswith(a.scope, '__init__') AND startswith(a.name, 'self.') AND a.attrs['value'] RLIKE '^(threading\\\\.(Lock|RLock|Event|Thread)|subprocess\\\\.Popen|socket\\\\.socket)\\\\('", "class A:\n    def __init__(self):\n        self.l = threading.Lock()\n", "class A:\n    def __init__(self):\n        self.l = threading.Lock()\n    def __getstate__(self):\n        return {}\n")
rule("sentinel_cached_as_answer", "P2", "SELECT path, line, name || ' keeps a failure' AS message FROM nodes WHERE kind = 'Assign' AND in_handler AND name RLIKE '(?i)(memo|lookup|results?)\\\\w*\\\\[' AND attrs['value'] IN ('None', 'False', '-1')", "try:\n    f()\nexcept OSError:\n    memo['k'] = -1\n", "try:\n    f()\nexcept OSError:\n    memo.pop('k', None)\n")
rule("lazy_log_assertion", "P2", "SELECT path, line, 'compares an unformatted record' AS message FROM nodes WHERE kind = 'Assert' AND is_test AND attrs['test'] RLIKE '\\\\.msg\\\\b'", test_file("def test_a(caplog):\n    assert 'x 3' in caplog.records[0].msg\n"), test_file("def test_a(caplog):\n    assert 'x 3' in caplog.records[0].getMessage()\n"))
rule("route_literal_after_catchall", "P1", "WITH r AS (SELECT path, line, split(name, '[.]')[0] AS router, substring_index(name, '.', -1) AS verb, attrs['text'] AS url FROM nodes WHERE kind = 'Call' AND name RLIKE '\\\\.(get|post|put|delete)$' AND startswith(attrs['text'], '/')) SELECT b.path, b.line, b.url || ' is hidden by ' || a.url AS message FROM r a JOIN r b ON b.path = a.path AND b.router = a.router AND b.verb = a.verb AND b.line > a.line AND a.url LIKE '%{%' AND b.url NOT LIKE '%{%' AND regexp_replace(a.url, '/[^/]*$', '') = regexp_replace(b.url, '/[^/]*$', '')", "@app.get('/a/{id}')\ndef f(id):\n    return id\n@app.get('/a/all')\ndef g():\n    return 1\n", "@app.get('/a/all')\ndef g():\n    return 1\n@app.get('/a/{id}')\ndef f(id):\n    return id\n")
rule("cross_package_private_names", "Low", "SELECT a.path, a.line, a.code || ' is private to its package' AS message FROM nodes a LEFT SEMI JOIN (SELECT path, explode(split(attrs['bound'], ',')) AS b FROM nodes WHERE kind = 'Import') i ON i.path = a.path AND startswith(a.code, i.b || '.') WHERE a.kind = 'Attribute' AND startswith(a.name, '_') AND NOT startswith(a.name, '__') AND NOT a.is_test", "import other\nx = other._y\n", "import other\nx = other.y\n")


# --- row-local: what a function does with its own names ---
FUNCTION = "kind IN ('FunctionDef', 'AsyncFunctionDef')"
local("late_binding_closure", "P1", "kind IN ('For', 'AsyncFor') AND attrs['late'] <> ''", "'a function made in the loop reads it when called: ' || attrs['late']", "fs = []\nfor i in xs:\n    fs.append(lambda: i)\n", "fs = []\nfor i in xs:\n    fs.append(lambda i=i: i)\n")
local("vacuous_empty_pattern_match", "P1", f"{FUNCTION} AND attrs['vacuous'] <> ''", "'true for nothing: ' || attrs['vacuous']", "def hits(text, stems):\n    return all(s in text for s in stems)\n", "def hits(text, stems):\n    if not stems:\n        return False\n    return all(s in text for s in stems)\n")
local("vacuous_loop_assertion", "P2", f"{FUNCTION} AND is_test AND name LIKE 'test%' AND attrs['only_in_loops'] = 'true'", "'asserts only in loops that may not run'", test_file("def test_a():\n    for x in rows():\n        assert x\n"), test_file("def test_a():\n    xs = rows()\n    assert xs\n    for x in xs:\n        assert x\n"))
local("regex_integer_parse_truncation", "P2", f"{CALL} AND name = 'int' AND attrs['args'] RLIKE 're\\\\.(search|match|findall)\\\\(.\\\\(?\\\\\\\\\\\\\\\\d\\\\+\\\\)?.,'", "'reads the first digits of a number'", "import re\nn = int(re.search(r'\\d+', t)[0])\n", "import re\nn = int(re.fullmatch(r'\\d+', t)[0])\n")
local("llm_call_missing_max_tokens_cap", "P2", f"{CALL} AND name LIKE '%.%' AND substring_index(name, '.', -1) IN ('generate', 'generate_json', 'generate_batch') AND (NOT contains(attrs['kwargs'], ',max_tokens,') OR contains(attrs['zero_kwargs'], ',max_tokens,')) AND NOT contains(attrs['kwargs'], ',**,') AND NOT is_test", "name || ' without a limit on tokens'", "r = model.generate(p, max_tokens=0)\n", "r = model.generate(p, max_tokens=LIMIT)\n")
local("except_skip_masks_call_under_test", "P1", f"{HANDLER} AND is_test AND attrs['skips'] = 'true' AND NOT name RLIKE 'ImportError|ModuleNotFoundError'", "'a failure becomes a skip'", test_file("def test_a():\n    try:\n        f()\n    except Exception:\n        pytest.skip('x')\n"), test_file("try:\n    import x\nexcept ImportError:\n    pytest.skip('x')\n"))
local("source_text_assertion", "P2", "kind = 'Assert' AND is_test AND attrs['test'] RLIKE '(getsource|getsourcelines|unparse)\\\\('", "'asserts on the text of the code'", test_file("def test_a():\n    assert 'x' in inspect.getsource(f)\n"), test_file("def test_a():\n    assert f() == 'x'\n"))
local("return_annotation_mismatch", "P2", f"{FUNCTION} AND attrs['returns'] IN ('int', 'float', 'str', 'bool') AND attrs['return_kinds'] RLIKE ',(Tuple|List|Dict|Set|ListComp|DictComp),'", "'returns a container, says ' || attrs['returns']", "def f(x) -> float:\n    return x, 1\n", "def f(x) -> tuple:\n    return x, 1\n")
local("constructor_param_overwritten", "P1", "kind = 'ClassDef' AND attrs['overwritten'] <> ''", "'a setting replaces what the constructor was given: ' || attrs['overwritten']", "class C:\n    def __init__(self, n):\n        self.n = n\n    def load(self):\n        self.n = cfg('n')\n", "class C:\n    def __init__(self, n):\n        self.n = n\n    def load(self, n):\n        self.n = n\n")
local("readonly_to_numpy_mutation", "P1", f"{FUNCTION} AND attrs['readonly'] <> ''", "'writes into a view: ' || attrs['readonly']", "def f(df):\n    a = df.to_numpy()\n    a[0] = 1\n", "def f(df):\n    a = df.to_numpy(copy=True)\n    a[0] = 1\n")
local("tautological_guard", "P2", "kind = 'BoolOp' AND name = 'And' AND code RLIKE '>= [0-9.]+ \\\\* \\\\w+' AND code RLIKE ' is (not )?\\\\w+(\\\\.\\\\w+)*\\\\[0\\\\]'", "'the pin makes the threshold empty'", "ok = c.mean >= 0.75 * lead and c is causes[0]\n", "ok = c.mean >= 0.75 * lead and c.n > 3\n")
local("function_length", "Low", f"{FUNCTION} AND end_line - line >= 100", "'a function of ' || (end_line - line + 1) || ' lines'", "def f():\n" + "    g()\n" * 100, "def f():\n" + "    g()\n" * 99)
local("function_complexity", "Low", f"{FUNCTION} AND CAST(attrs['branches'] AS INT) > 15", "attrs['branches'] || ' ways through a function'", "def f(x):\n" + "    if x:\n        g()\n" * 15, "def f(x):\n" + "    if x:\n        g()\n" * 14)
local("reiterated_iterable_params", "P2", f"{FUNCTION} AND attrs['reiterated'] <> ''", "'empty when run through again: ' || attrs['reiterated']", "def f(xs: Iterable[int]):\n    for x in xs:\n        g(x)\n    return [x for x in xs]\n", "def f(xs: Iterable[int]):\n    xs = list(xs)\n    for x in xs:\n        g(x)\n    return [x for x in xs]\n")
local("optional_truthiness", "P2", f"{FUNCTION} AND attrs['truth_tested'] <> ''", "'takes 0 for None: ' || attrs['truth_tested']", "def f(n: int | None):\n    if not n:\n        return 1\n", "def f(n: int | None):\n    if n is None:\n        return 1\n")
local("nan_admitted_by_reject_guard", "P2", "kind = 'If' AND attrs['raises'] = 'true' AND name RLIKE '^(\\\\w+) <=? [^ ]+ or \\\\1 >=? [^ ]+$'", "'lets NaN through: ' || name", "def f(x):\n    if x < 0 or x > 1:\n        raise ValueError(x)\n", "def f(x):\n    if not 0 <= x <= 1:\n        raise ValueError(x)\n")
local("fail_open_handlers", "P1", f"{HANDLER} AND attrs['allows'] = 'true' AND NOT is_test AND scope RLIKE '(^|[._])(is|can|may|has|allow|allowed|check|valid|validate|verify|authorize)[^.]*$'", "'a failed check passes'", "def is_allowed(u):\n    try:\n        return ask(u)\n    except OSError:\n        return True\n", "def is_allowed(u):\n    try:\n        return ask(u)\n    except OSError:\n        return False\n")
local("deprecated_docstring_without_warn", "Low", f"{FUNCTION} AND attrs['docstring'] RLIKE '(?i)\\\\bdeprecated\\\\b' AND attrs['warns'] = 'false' AND NOT contains(attrs['decorators'], 'deprecated')", "'says deprecated and warns nobody'", "def f():\n    'Deprecated: use g.'\n    return 1\n", "def f():\n    'Deprecated: use g.'\n    warnings.warn('use g', DeprecationWarning)\n")
local("free_text_in_get_route", "P2", f"{FUNCTION} AND attrs['decorators'] RLIKE '(^|,)\\\\w+\\\\.get(,|$)' AND attrs['params'] RLIKE '(^|,)(text|prompt|message|content|comment)(,|$)'", "'free text in a URL'", "@app.get('/x')\ndef f(prompt):\n    pass\n", "@app.post('/x')\ndef f(prompt):\n    pass\n")
rule("duplicate_test_body", "P2", f"SELECT path, line, 'the same body as ' || first AS message FROM (SELECT path, line, name, min(name) OVER (PARTITION BY path, attrs['body']) AS first FROM nodes WHERE {FUNCTION} AND is_test AND name LIKE 'test%' AND attrs['body'] <> '') WHERE name <> first", test_file("def test_a():\n    assert f(1)\ndef test_b():\n    assert f(1)\n"), test_file("def test_a():\n    assert f(1)\ndef test_b():\n    assert f(2)\n"))
TABLE = "lower(regexp_extract({0}.attrs['value'], '(?is)\\\\bfrom\\\\s+([\\\\w.]+)', 1))"
rule(
    "count_then_fetch_same_table", "P2",
    "SELECT b.path, b.line, 'counts ' || " + TABLE.format("b") + " || ' and fetches it' AS message FROM nodes a JOIN nodes b ON a.path = b.path AND a.scope = b.scope WHERE a.scope_kind = 'function' AND a.kind = 'Constant' AND a.name = 'str' AND b.kind = 'Constant' AND b.name = 'str' "
    "AND a.attrs['value'] RLIKE '(?is)^\\\\s*select\\\\s+count\\\\(' AND b.attrs['value'] RLIKE '(?is)^\\\\s*select\\\\s+(?!count\\\\()' AND " + TABLE.format("a") + " <> '' AND " + TABLE.format("a") + " = " + TABLE.format("b"),
    "def f(c):\n    n = c.run('SELECT count(*) FROM t')\n    return n, c.run('SELECT a FROM t ORDER BY a')\n", "def f(c):\n    n = c.run('SELECT count(*) FROM u')\n    return n, c.run('SELECT a FROM t ORDER BY a')\n",
)


def audit(spark: SparkSession, files: DataFrame, rules: list[str] | None = None, min_files: int = 1) -> tuple[DataFrame, DataFrame]:
    """(findings with severity, problems) of (path, text). The nodes are parsed once and kept while the rules run."""
    nodes = pysource.parse(files).persist()
    return findings(spark, nodes, rules), pysource.problems(nodes)


def findings(spark: SparkSession, nodes: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Findings of the chosen rules (all, if None), without those that a reasoned inline suppression names."""
    unknown = set(rules or ()) - set(RULES) - {"import_cycle"}
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    chosen = [r for r in RULES.values() if rules is None or r.name in rules]
    out = None
    if local_rules := [r for r in chosen if r.where]:
        # one pass: each node tries all row-local rules
        hits = [F.when(F.expr(r.where), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.expr(r.message).cast("string").alias("message"))) for r in local_rules]
        hit = nodes.select("path", "line", F.explode(F.array_compact(F.array(*hits))).alias("h"))
        out = fi.findings(hit, F.col("h.rule"), F.col("path"), F.col("h.message"), F.col("line"))
        rank = F.create_map(*[F.lit(x) for r in local_rules for x in (r.name, r.severity)])
        out = out.withColumn("severity", rank[F.col("rule")])
    for r in chosen:
        if r.where:
            continue
        found = fi.findings(spark.sql(r.sql.replace("{", "{{").replace("}", "}}").replace("FROM nodes", "FROM {nodes}").replace("JOIN nodes", "JOIN {nodes}"), nodes=nodes), r.name, F.col("path"), F.col("message"), F.col("line"))
        found = found.withColumn("severity", F.lit(r.severity))
        out = found if out is None else out.unionByName(found)
    if rules is None or "import_cycle" in rules:
        cyc = graph.cycles(pysource.import_edges(nodes))
        found = fi.findings(cyc, "import_cycle", F.concat(F.translate("node", ".", "/"), F.lit(".py")), F.concat(F.lit("in the cycle of "), F.col("cycle"))).withColumn("severity", F.lit("P1"))
        out = found if out is None else out.unionByName(found)
    marks = fi.inline_suppressions(nodes.where("kind = 'Comment'").select("path", "line", F.col("code").alias("text")))
    return fi.suppress(out, marks)
