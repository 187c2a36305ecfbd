"""Queries over database schemas: covered indexes, and statements against a replayed catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covering_indexes(indexes: DataFrame) -> DataFrame:
    """name, covered_by: indexes that another of the same table and method makes needless.

    Columns are a prefix of the other's; directions and null orders (btree) equal or all reversed; included
    columns are had by the other; a unique index only by an identical unique one; predicates are equal, or the
    other has none. Of several covers the narrowest, then the first by name. Of identical ones the later name goes.
    """
    cols = ("columns", "descending", "nulls_first", "predicate", "is_unique", "include")
    a = indexes.select("tbl", "method", F.col("name").alias("name"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = indexes.select("tbl", "method", F.col("name").alias("other"), *[F.col(c).alias(f"b_{c}") for c in cols])
    n = F.size("a_columns")
    head = lambda c: F.slice(F.col(f"b_{c}"), 1, n)
    flipped = lambda c: F.transform(head(c), lambda x: ~x)
    same_way = (head("descending") == F.col("a_descending")) & (head("nulls_first") == F.col("a_nulls_first"))
    reverse = (flipped("descending") == F.col("a_descending")) & (flipped("nulls_first") == F.col("a_nulls_first"))
    identical = (F.size("b_columns") == n) & same_way & F.col("a_predicate").eqNullSafe(F.col("b_predicate")) & (F.col("a_is_unique") == F.col("b_is_unique")) & (F.size("a_include") == F.size("b_include"))
    both = a.join(b, ["tbl", "method"]).where(F.col("name") != F.col("other"))
    both = both.where(
        (F.size("b_columns") >= n)
        & (head("columns") == F.col("a_columns"))
        & ((F.col("method") != "btree") | same_way | reverse)
        & (F.size(F.array_except("a_include", F.array_union("b_include", "b_columns"))) == 0)
        & (F.col("b_predicate").isNull() | F.col("a_predicate").eqNullSafe(F.col("b_predicate")))
        & (~F.col("a_is_unique") | identical)
        & (~identical | (F.col("name") > F.col("other")))
    )
    best = both.groupBy("tbl", "name").agg(F.min(F.struct(F.size("b_columns"), "other")).alias("best"))
    return best.select("tbl", "name", F.col("best.other").alias("covered_by"))


def replayed_columns(events: DataFrame) -> DataFrame:
    """(seq, action, tbl, col, new_name) -> tbl, col: the columns after all events, in the order of seq.

    Actions: create_table, drop_table, rename_table, add_column, drop_column, rename_column. Tables that
    are renamed share a history, so the replay goes by schema; a schema's events are few.
    """
    out = "schema string, tbl string, col string"

    def replay(f: pd.DataFrame) -> pd.DataFrame:
        tables: dict[str, dict[str, None]] = {}
        for e in f.sort_values("seq").itertuples(index=False):
            t = tables.setdefault(e.tbl, {}) if e.action in ("create_table", "add_column") else tables.get(e.tbl)
            if t is None:
                continue
            if e.action in ("create_table", "add_column"):
                if e.col is not None:
                    t[e.col] = None
            elif e.action == "drop_table":
                tables.pop(e.tbl)
            elif e.action == "rename_table":
                tables[e.new_name] = tables.pop(e.tbl)
            elif e.action == "drop_column":
                t.pop(e.col, None)
            elif e.action == "rename_column" and e.col in t:
                t.pop(e.col)
                t[e.new_name] = None
        rows = [(f["schema"].iloc[0], t, c) for t, cs in tables.items() for c in cs]
        return pd.DataFrame(rows, columns=["schema", "tbl", "col"])

    return events.groupBy("schema").applyInPandas(replay, out)


def unknown_columns(statements: DataFrame, events: DataFrame) -> DataFrame:
    """Columns of statements (schema, tbl, col, ...) that the replayed catalogue of known tables doesn't have."""
    have = replayed_columns(events)
    known = statements.join(have.select("schema", "tbl").distinct(), ["schema", "tbl"], "left_semi")
    return known.join(have, ["schema", "tbl", "col"], "left_anti")


def statement_columns(statements: DataFrame) -> DataFrame:
    """(path, sql) -> path, tbl, col of plain INSERT, UPDATE and SELECT statements; others give no row."""
    import re

    insert = re.compile(r"insert\s+into\s+([\w.]+)\s*\(([^)]*)\)", re.I)
    update = re.compile(r"update\s+([\w.]+)\s+set\s+(.*?)(?:\bwhere\b|$)", re.I | re.S)
    select = re.compile(r"select\s+(.*?)\s+from\s+([\w.]+)\s*(?:where|order|group|limit|$)", re.I | re.S)

    def of(sql: str) -> list[tuple[str, str]]:
        out = []
        for m in insert.finditer(sql):
            out += [(m[1], c.strip()) for c in m[2].split(",")]
        for m in update.finditer(sql):
            out += [(m[1], c.split("=")[0].strip()) for c in m[2].split(",") if "=" in c]
        for m in select.finditer(sql):
            out += [(m[2], c.strip()) for c in m[1].split(",") if re.fullmatch(r"\w+", c.strip())]
        return out

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(p, t, c) for p, q in zip(f["path"], f["sql"], strict=True) if q for t, c in of(q)]
            yield pd.DataFrame(out, columns=["path", "tbl", "col"])

    return statements.select("path", "sql").mapInPandas(rows, "path string, tbl string, col string")
