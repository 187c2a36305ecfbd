"""The training-data pipeline: toxicity, quality rules, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Each is judged on what the stage before it kept.

Defined results: the toxicity stage learns from the labelled documents of ``sf_dir``, not from its input. A null or empty text
isn't toxic, and goes in the quality stage (too few words). Rows of equal id and text count once from the third stage on; a row
without an id is in no group of copies and stays. A null source is a source of its own. Columns other than those of ``documents``
are dropped, whatever their names. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.bpe import bpe_encode, default_path
from gneiss.llm.common import Scratch, table
from gneiss.llm.mixing import mix, row_key
from gneiss.llm.ngram_join import ngram_components
from gneiss.llm.quality_rules import quality_rules
from gneiss.llm.toxicity import fit_toxicity, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents of ``sf_dir``."""
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others stay as they are."""
    # a generator, not a filter: that would be pushed below the projections that share their parts, and
    # would hold a copy of each rule for each use
    row = F.when(F.col("kept"), F.array(F.struct(*COLUMNS)))
    return quality_rules(docs.select(*COLUMNS)).select(F.inline(row))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. A document without an id is in no group."""
    same = ngram_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0
    one = docs.dropDuplicates(["doc_id", "text"]) if repeated else docs
    return one.join(same, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of each document, as many as the mix takes of its words: none to two.

    The mix takes parts of a document only at the edges of its blocks. There a hash decides between the two numbers
    of copies next to the part, so that a source's words come near its target: on average they are those that the
    mix takes. Rows of equal id and text share what is taken of them.
    """
    docs = docs.select(*COLUMNS)
    taken, _ = mix(docs)
    share = taken.groupBy(F.col("doc_id").alias("id_taken"), F.col("key").alias("key_taken")).agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("share"))
    rows = docs.join(share, F.col("doc_id").eqNullSafe(F.col("id_taken")) & (row_key() == F.col("key_taken")))
    million = 1_000_000
    luck = F.pmod(F.xxhash64("key_taken", F.lit("copies")), F.lit(million)) / million
    rows = rows.withColumn("copies", F.floor(F.col("share") + luck).cast("int")).where("copies > 0")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What training reads: ids of the tokens. ``decodes``: whether they decode to the text again."""
    said = F.sha2(F.coalesce("text", F.lit("")), 256)
    out = bpe_encode(docs, default_path())
    return out.select("doc_id", "source", "n_tokens", "ids", (F.col("decoded_sha256") == said).alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: Trained scores and a hash order can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        done = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(docs, "scratch_path"):
            scratch.drop(docs)
        docs = done
    return docs
