"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: ``epochs`` times all words are dealt to the sources by weight; a target stops at
   ``max_repeat`` times its source's size and the excess is dealt again by weight.
2. Blocks: each source's documents, in a pseudo-random order fixed by a hash of the id, are one
   stream of words, cut into blocks of equal length (at least ``min_blocks`` a source).
3. Schedule: slot k is drawn at the golden-ratio point frac(k * phi); the cumulative weights (the blocks
   that a source's target needs) map it to a source. Slots are ranked within their source: slot number r takes block r mod n, the
   last one as much of it as the target leaves.
4. A join of slots with the blocks' document pieces gives what the mix takes of each document.

Prefix sums and ranks over a hot source run in two levels: sums per (source, bucket of the order
hash) first, then within a bucket, so no task holds a source. A few sources are broadcast, after their number is
checked, and any number is joined by shuffles. Equal input gives equal output.

Defined results: null text has size 0; a null source is a source of its own, the last; documents
of size 0 are taken 0 words; rows with equal ids are mixed each on its own, told apart by a hash of
their text and, if that is equal too, counted together (each gets an equal share by order); an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.common import WORD_RE, Scratch

WEIGHTS = (3, 1, 2)
GOLDEN = (math.sqrt(5) - 1) / 2


def running(df: DataFrame, group: str, order: Sequence[str], bucket: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of ``group`` before this one, in (bucket, order).

    Groups may be hot: buckets are summed first, so that no task holds more than a bucket of rows.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = W.partitionBy(group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = df.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return own.join(starts, [group, bucket]).withColumn(out, F.col("_start") + F.col("_own")).drop("_start", "_own")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The place of a document in its source's order: 60 bits of a digest of its id and text."""
    told = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("bigint")


def small(df: DataFrame, rows: int, most: int = 50_000) -> DataFrame:
    """``df``, to be broadcast if its number of rows, which the caller has counted, is at most ``most``; else a plain side of a join."""
    return F.broadcast(df) if rows <= most else df


def numbered(df: DataFrame, order: Sequence[Column], scratch: Scratch) -> DataFrame:
    """``df`` with ``number``: the rows from 0 in ``order``, which tells all of them apart. A range sort; the driver sees one number a partition."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    placed = scratch.keep(parts.withColumns({"part": F.shiftright("id", 33), "place": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("id"), "numbered")
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, before))
        before += n
    known = df.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    return placed.join(F.broadcast(known), "part").withColumn("number", F.col("before") + F.col("place")).drop("part", "place", "before")


def water_level(sources: DataFrame, total: float, max_repeat: int) -> float | None:
    """The words for each unit of weight at which the targets, none above ``max_repeat`` times its size, add up to ``total``; None if all stop there.

    Each round is one sum over the sources (size, weight): what the full ones take is settled, and the others share the rest.
    """
    level, full = 0.0, -1
    while True:
        # the weights are few, so the sums that aren't whole numbers are made of few parts, in one order
        stopped = max_repeat * F.col("size") < level * F.col("weight")
        rows = sources.groupBy("weight").agg(F.sum(F.when(stopped, F.col("size")).otherwise(0)).alias("settled"), F.count(F.when(stopped, 1)).alias("full"), F.count("*").alias("n")).orderBy("weight").collect()
        now = sum(r["full"] for r in rows)
        weight = sum(r["weight"] * (r["n"] - r["full"]) for r in rows)
        if not weight:
            return None
        if now == full:
            return level
        full, level = now, (total - max_repeat * sum(r["settled"] for r in rows)) / weight


def schedule(spark: SparkSession, sources: DataFrame, n_sources: int, quotas: int, scratch: Scratch, bucket_rows: int = 65536) -> DataFrame:
    """The slots in their order: slot, src, rank (of its source, from 0), block, pass_no.

    sources: (src, n_blocks, quota), with the quotas' sum. A slot beyond its source's quota falls out, so there are twice as
    many slots as quotas ask for. The cumulative quotas are cut into cells of equal width; a slot meets the sources of its cell alone.
    """
    cells = max(1, min(4 * n_sources, quotas))
    width = -(-quotas // cells)
    edges = running(sources.withColumns({"all": F.lit(0), "chunk": F.expr(f"src div {bucket_rows}")}), "all", ["src"], "chunk", "quota", "low")
    edges = edges.select("src", "n_blocks", "quota", "low", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(low + quota - 1) div {width}"))).alias("cell"))
    edges = scratch.keep(edges, "edges")
    points = spark.range(2 * quotas + 64 * n_sources).select(F.col("id").alias("slot"), F.least(F.floor(F.col("id") * F.lit(GOLDEN) % 1 * quotas), F.lit(quotas - 1)).cast("bigint").alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {width}"))
    drawn = points.join(small(edges, cells + 2 * n_sources), "cell").where("low <= point and point < low + quota")
    drawn = drawn.select("slot", "src", "n_blocks", "quota", F.expr(f"slot div {bucket_rows}").alias("chunk"), F.lit(1).cast("bigint").alias("one"))
    out = running(drawn, "src", ["slot"], "chunk", "one", "rank").where("rank < quota")
    return out.select("slot", "src", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"), F.expr("rank div n_blocks").alias("pass_no"))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    epochs: float = 1.5,
    max_repeat: int = 2,
    block_words: int = 65536,
    min_blocks: int = 256,
    bucket_docs: int = 5_000,
) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, size, source_size, target, taken, and its row's key; the schedule).

    Sources may be as many as the rows: they are numbered, filled and joined as tables.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_RE)).cast("bigint")
    docs = scratch.keep(documents.select("doc_id", "source", size.alias("size"), row_key().alias("key")), "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], scratch).withColumnRenamed("number", "src")
    sources = sources.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    totals = sources.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("docs").alias("docs")).first()
    n_sources = totals["n"]
    level = water_level(sources, epochs * (totals["size"] or 0), max_repeat)
    most = (max_repeat * F.col("size")).cast("double")
    sources = sources.withColumn("target", most if level is None else F.least(most, level * F.col("weight")))
    sources = sources.withColumn("n_blocks", F.least("size", F.greatest(F.lit(min_blocks), F.ceil(F.col("size") / block_words))).cast("bigint"))
    quota = F.when(F.col("size") > 0, F.ceil(F.col("target") * F.col("n_blocks") / F.col("size"))).otherwise(0).cast("bigint")
    sources = scratch.keep(sources.select(F.col("source").alias("name"), "src", F.col("size").alias("source_size"), "target", "n_blocks", quota.alias("quota")), "sources")
    docs = docs.join(small(sources.drop("quota"), n_sources), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    live = sources.where("quota > 0")
    sums = live.agg(F.count("*").alias("n"), F.sum("quota").alias("quota")).first()
    if not sums["n"]:
        return docs.select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), "key"), spark.range(0).select(F.col("id").alias("slot"))
    buckets = max(1, totals["docs"] // bucket_docs)
    docs = docs.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    placed = scratch.keep(running(docs, "src", ["key", "doc_id"], "bucket", "size", "start"), "placed")
    slots = schedule(spark, live.select("src", "n_blocks", "quota"), sums["n"], sums["quota"], scratch)
    end = F.col("start") + F.col("size")
    first = F.expr("cast((cast(start as decimal(38,0)) * n_blocks) div source_size as bigint)")
    last = F.expr("cast((cast(start + size - 1 as decimal(38,0)) * n_blocks) div source_size as bigint)")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))

    def edge(b: str) -> str:
        """The first place of a block: the least x with x * n_blocks div source_size = block."""
        return f"cast((cast({b} as decimal(38,0)) * source_size + n_blocks - 1) div n_blocks as bigint)"

    pieces = pieces.select(
        "src", "block", "doc_id", "key", "start", "n_blocks", "source_size", "target",
        F.greatest(F.col("start"), F.expr(edge("block"))).alias("lo"),
        F.least(end, F.expr(edge("(block + 1)"))).alias("hi"),
    )
    used = slots.join(pieces, ["src", "block"])
    # the place of a piece in what the source gives, pass after pass; the target cuts the last slot
    at = F.col("pass_no") * F.col("source_size") + F.col("lo")
    got = F.greatest(F.lit(0), F.least(F.col("hi") - F.col("lo"), F.floor("target") - at)).cast("bigint")
    taken = used.select(F.col("src").alias("s"), F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("start").alias("a"), got.alias("got")).groupBy("s", "d", "k", "a").agg(F.sum("got").alias("taken"))
    on = (F.col("src") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("start") == F.col("a")) & (F.col("size") > 0)
    out = placed.join(taken, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "key")
    return out, slots


def op8_mixing(documents: DataFrame) -> DataFrame:
    return mix(documents)[0].drop("key")
