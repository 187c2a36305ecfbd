"""Accepted results that may only shrink: multiset comparison, refresh, hygiene, trends of counts."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed keys of a baseline file that are no entries.
META = frozenset({"_comment", "_meta", "_schema", "_note"})
#: Fixed mark of an entry that nobody has justified yet.
UNJUSTIFIED = "TODO: justify"
BASELINE_SCHEMA = "key string, count int, note string"


class BaselineError(ValueError):
    pass


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    twice = [k for k, n in Counter(k for k, _ in pairs).items() if n > 1]
    if twice:
        raise BaselineError(f"repeated key: {twice[0]}")
    return dict(pairs)


def parse_baseline(text: str) -> list[tuple[str, int, str]]:
    """(key, count, note) of a baseline file in any accepted shape.

    An object of entries, as it is or as the object under ``entries`` or ``accepted``: each key has a note, a count, an
    object with ``count`` and ``note``, null, or any other JSON, which is a note. Or a list of keys (repeats count) and of lists of
    strings, joined by ``|``. Repeated JSON keys, counts that are no positive integers, booleans, and a plain key equal to
    a joined one are errors.
    """
    data = json.loads(text, object_pairs_hook=_no_repeats)
    if isinstance(data, list):
        plain = Counter(x for x in data if isinstance(x, str))
        joined = Counter("|".join(x) for x in data if isinstance(x, list) and x and all(isinstance(y, str) for y in x))
        if len(plain) and set(plain) & set(joined):
            raise BaselineError("a key equals a joined list")
        if sum(plain.values()) + sum(joined.values()) != len(data):
            raise BaselineError("entries are neither keys nor lists of strings")
        return sorted((k, n, "") for k, n in (plain + joined).items())
    if not isinstance(data, dict):
        raise BaselineError("neither an object nor a list")
    entries = next((data[k] for k in ("entries", "accepted") if isinstance(data.get(k), dict)), data)
    out = []
    for key, value in entries.items():
        if key in META:
            continue
        if isinstance(value, dict):
            count, note = value.get("count", 1), value.get("note", "")
        elif isinstance(value, int):
            count, note = value, ""
        else:
            count, note = 1, value or ""
        note = note if isinstance(note, str) else json.dumps(note, sort_keys=True)
        if isinstance(count, bool) or not isinstance(count, int) or count < 1:
            raise BaselineError(f"count of {key!r} is no positive integer")
        out.append((key, count, note))
    return sorted(out)


def baseline(spark: SparkSession, text: str | None) -> DataFrame:
    """The file's entries; a missing file is an error, not an empty set."""
    if text is None:
        raise BaselineError("no baseline")
    return spark.createDataFrame(parse_baseline(text), BASELINE_SCHEMA)


def counted(found: DataFrame, key: str = "key") -> DataFrame:
    return found.groupBy(F.col(key).alias("key")).agg(F.count("*").cast("int").alias("count"))


def multiset_diff(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """key, n_new = max(found - accepted, 0), n_stale = max(accepted - found, 0), for keys where one isn't 0."""
    a = found.select("key", F.col("count").alias("_f"))
    b = accepted.select("key", F.col("count").alias("_a"))
    f, g = F.coalesce("_f", F.lit(0)), F.coalesce("_a", F.lit(0))
    both = a.join(b, "key", "full_outer").where(f != g)
    return both.select("key", F.greatest(f - g, F.lit(0)).alias("n_new"), F.greatest(g - f, F.lit(0)).alias("n_stale"))


def unjustified(accepted: DataFrame) -> DataFrame:
    return accepted.where(F.coalesce("note", F.lit("")).contains(UNJUSTIFIED)).select("key")


def shrink_only(previous: DataFrame, current: DataFrame, slack: int = 0) -> DataFrame:
    """key, kept, grown. Common keys keep the smaller count; grown: new, or risen by more than ``slack``. A key whose count now is 0 or less is neither."""
    a = previous.select("key", F.col("count").alias("_old"))
    b = current.select("key", F.col("count").alias("_new"))
    both = a.join(b, "key", "full_outer")
    least = F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col("_new") > 0), F.least("_old", "_new"))
    grown = F.coalesce(F.col("_new") > 0, F.lit(False)) & (F.col("_old").isNull() | (F.col("_new") > F.col("_old") + slack))
    return both.select("key", least.alias("kept"), grown.alias("grown")).where("kept is not null or grown")


def hygiene(accepted: DataFrame, found: DataFrame | None = None, min_words: int = 3) -> DataFrame:
    """key, problem: absolute paths, notes of too few words or with the unjustified mark, and keys that nothing matches any more."""
    words = F.size(F.array_remove(F.split(F.coalesce("note", F.lit("")), r"\s+"), ""))
    path = F.col("key").rlike(r"(^|::)(/|[A-Za-z]:[\\/])")
    rules = F.array_compact(
        F.array(
            F.when(path, F.lit("absolute path")),
            F.when(F.coalesce("note", F.lit("")).contains(UNJUSTIFIED), F.lit("unjustified")).when(words < min_words, F.lit("note too short")),
        )
    )
    out = accepted.select("key", F.explode(rules).alias("problem"))
    if found is not None:
        out = out.unionByName(accepted.select("key").join(found.select("key"), "key", "left_anti").withColumn("problem", F.lit("stale")))
    return out


def trend(points: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, first, last, n, moved. moved: the value changed at any time, not first against last."""
    return points.groupBy(by).agg(
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("n"), (F.min(value) != F.max(value)).alias("moved")
    )


def unmoved(trends: DataFrame) -> DataFrame:
    """Series that never moved and aren't 0."""
    return trends.where("not moved and last <> 0")


def ledger_parity(observed: DataFrame, ledger: DataFrame, on: Iterable[str], value: str) -> DataFrame:
    """Keys whose observed value differs from the ledger's or that only one of the two has; nothing is excused."""
    keys = list(on)
    a = observed.select(*keys, F.col(value).alias("observed")).withColumn("_o", F.lit(True))
    b = ledger.select(*keys, F.col(value).alias("expected")).withColumn("_e", F.lit(True))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_e").isNull(), F.lit("unlisted")).when(F.col("_o").isNull(), F.lit("missing")).when(~F.col("observed").eqNullSafe(F.col("expected")), F.lit("changed"))
    return both.select(*keys, "observed", "expected", kind.alias("kind")).where("kind is not null")
