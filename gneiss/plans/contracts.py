"""Running a query under its contract: a least input size, reported rejects, a budget, an accepted baseline.

An empty or unreadable input is never a clean result.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from types import CodeType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import ratchet


class EmptyScan(ValueError):
    pass


@dataclass(frozen=True)
class QuerySpec:
    """run(spark, **inputs) gives findings; problems(spark, **inputs), if given, what couldn't be read."""

    name: str
    run: Callable[..., DataFrame]
    problems: Callable[..., DataFrame] | None = None
    min_rows: int = 1
    allow_rejects: bool = False
    budget_s: float = 30.0
    opt_in: bool = False
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class QueryResult:
    name: str
    status: str  # PASSED, FAILED, SKIPPED or ERROR
    message: str
    seconds: float
    over_budget: bool = False
    cached: bool = False


@dataclass
class Registry:
    specs: dict[str, QuerySpec] = field(default_factory=dict)

    def register(self, spec: QuerySpec, allow_override: bool = False) -> None:
        for name in (spec.name, *spec.aliases):
            if name in self.names() and not allow_override:
                raise ValueError(f"{name!r} is taken")
        self.specs[spec.name] = spec

    def names(self) -> set[str]:
        return {n for s in self.specs.values() for n in (s.name, *s.aliases)}

    def get(self, name: str) -> QuerySpec:
        for s in self.specs.values():
            if name == s.name or name in s.aliases:
                return s
        raise KeyError(name)

    def default(self) -> list[QuerySpec]:
        return [s for s in self.specs.values() if not s.opt_in]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s.name, s.min_rows, s.allow_rejects, s.budget_s, s.opt_in) for s in self.specs.values()]
        return spark.createDataFrame(rows, "name string, min_rows int, allow_rejects boolean, budget_s double, opt_in boolean")


def check_floor(rows: DataFrame, at_least: int, what: str = "input") -> None:
    """An action: fails if there are fewer rows. It stops counting at the floor."""
    n = rows.limit(max(at_least, 1)).count()
    if n < at_least:
        raise EmptyScan(f"{what}: {n} rows, {at_least} are the least")


def check_rejects(problems: DataFrame, allow: bool, show: int = 20) -> None:
    if not allow and (some := problems.limit(show).collect()):
        raise ValueError("not read: " + "; ".join(str(tuple(r)) for r in some))


def run_query(spark: SparkSession, spec: QuerySpec, source: DataFrame, accepted: DataFrame | None = None, show: int = 20, clock: Callable[[], float] = time.monotonic) -> QueryResult:
    """Runs a spec over ``source``. With a baseline only what it doesn't accept fails, and so does what it accepts without need."""
    start = clock()

    def done(status: str, message: str) -> QueryResult:
        s = clock() - start
        return QueryResult(spec.name, status, message, s, status != "ERROR" and s > spec.budget_s)

    try:
        check_floor(source, spec.min_rows)
        if spec.problems is not None:
            check_rejects(spec.problems(spark, source), spec.allow_rejects)
        found = spec.run(spark, source)
        if accepted is None:
            rows = found.orderBy("key").limit(show).collect()
            return done("FAILED", "\n".join(r["key"] for r in rows)) if rows else done("PASSED", "")
        diff = ratchet.multiset_diff(ratchet.counted(found), accepted).orderBy("key").limit(show).collect()
        loose = ratchet.unjustified(accepted).orderBy("key").limit(show).collect()
        lines = [f"{r['key']}: {r['n_new']} new, {r['n_stale']} stale" for r in diff] + [f"{r['key']}: not justified" for r in loose]
        return done("FAILED", "\n".join(lines)) if lines else done("PASSED", "")
    except Exception as e:  # a broken run is reported as such, never as a pass
        return done("ERROR", f"{type(e).__name__}: {e}"[:2000])


def refresh_baseline(path: str, found: DataFrame, slack: int = 0, grow: bool = False) -> None:
    """Writes what remains of a baseline: removals and smaller counts; growth is an error unless asked for. A refused write leaves the file as it is.

    Keys come to the driver in order, one partition at a time, and go straight to the file.
    """
    current = ratchet.counted(found)
    old = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = {k: (n, note) for k, n, note in ratchet.parse_baseline(f.read())}

    def parts() -> Iterator[str]:
        yield '{\n "schema": 1,\n "entries": {'
        before, grown = "\n", []
        for r in current.orderBy("key").toLocalIterator():
            k, n = r["key"], r["count"]
            known, note = (old or {}).get(k, (None, ratchet.UNJUSTIFIED))
            if not grow and (known is None or n > known + slack):
                grown.append(k)
                if len(grown) >= 5:
                    break
                continue
            n = n if grow else min(n, known)
            yield f"{before}  {json.dumps(k, ensure_ascii=False)}: {json.dumps({'count': n, 'note': note}, ensure_ascii=False)}"
            before = ",\n"
        if grown:
            raise ValueError(f"grown: {grown}")
        yield "\n }\n}\n"

    write_atomically(path, parts())


def write_atomically(path: str, parts: Iterable[str]) -> None:
    """A reader sees the old file or the new one, never a part."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
            f.writelines(parts)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: count and an order-free digest of a table, from sums of row hashes, so nothing is collected."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(h).alias("xor"))


def library_digest() -> str:
    """Of all sources of this library, so that a result is known only as long as nothing in it changed."""
    here, out = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), hashlib.sha256()
    for folder, _, names in sorted(os.walk(here)):
        for n in sorted(names):
            if n.endswith(".py"):
                with open(os.path.join(folder, n), "rb") as f:
                    out.update(n.encode() + f.read())
    return out.hexdigest()


def code_digest(f: Callable) -> str:
    """Of a function's instructions, constants and closed-over values."""

    def told(code: CodeType) -> list:
        return [code.co_code.hex(), code.co_names, [told(c) if isinstance(c, CodeType) else repr(c) for c in code.co_consts]]

    code = getattr(f, "__code__", None)
    cells = [repr(c.cell_contents) for c in getattr(f, "__closure__", None) or ()]
    return hashlib.sha256(repr([told(code) if code else repr(f), cells, repr(getattr(f, "__defaults__", None))]).encode()).hexdigest()


class ResultCache:
    """Remembers passes by query, its code, the library's and the interpreter's version, parameters and the digest of the input; failures are run again."""

    def __init__(self, path: str, keep: int = 500):
        self.path, self.keep = path, keep

    def _read(self) -> list[str]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @staticmethod
    def key(spec: QuerySpec, source: DataFrame, **parameters: object) -> str:
        d = digest(source, source.columns).first()
        code = [code_digest(spec.run), code_digest(spec.problems) if spec.problems else "", library_digest(), sys.version, source.sparkSession.version]
        return hashlib.sha256(json.dumps([*code, spec.name, spec.min_rows, spec.allow_rejects, spec.budget_s, sorted((k, repr(v)) for k, v in parameters.items()), list(map(str, d))]).encode()).hexdigest()

    def run(self, spark: SparkSession, spec: QuerySpec, source: DataFrame, **kw: object) -> QueryResult:
        key, known = self.key(spec, source), self._read()
        if key in known:
            return QueryResult(spec.name, "PASSED", "", 0.0, cached=True)
        out = run_query(spark, spec, source, **kw)
        if out.status == "PASSED":
            write_atomically(self.path, [json.dumps([*known, key][-self.keep :])])
        return replace(out)
