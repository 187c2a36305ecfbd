"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """array<string> of the white-space separated words of ``text``; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def bound(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, as the variable of a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have (Spark doesn't tell upper and lower case apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def with_fields(df: DataFrame, struct: Column, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with the fields of a struct that is computed once; they replace columns of the same name."""
    [s] = unused(df, "fields")
    return df.withColumn(s, struct).withColumns({c: F.col(f"{s}.{c}") for c in fields}).drop(s)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local``) may lack the setting; it gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all machines share")
        at = tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


class Scratch:
    """Intermediate tables in the shared folder; they outlive lost executors and cut lineage.

    ``keep`` writes and rereads a DataFrame. ``drop`` deletes one early and lets Spark
    clean its shuffles; the rest goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/gneiss-{uuid.uuid4().hex}"
        self.n = 0

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        fs, p = self._fs(path)
        fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, p = self._fs(t.scratch_path)
            fs.delete(p, True)

    def tidy(self) -> None:
        """Asks the JVM to notice unreachable shuffles, so that their files go now and not at some later time."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
