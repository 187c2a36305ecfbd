from pyspark.sql import functions as F

from gneiss.streaming import growth


def test_shrinks_over_two_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "k string, v long"
    for n, data in enumerate(([("a", 5), ("b", 2)], [("a", 3), ("b", 4)])):
        spark.createDataFrame(data, schema).write.mode("append").parquet(src)
        growth.shrinks(spark.readStream.schema(schema).parquet(src), "k", "v", out, ck).awaitTermination(60)
    got = spark.read.parquet(out).select("k", "v", "previous").collect()
    assert [tuple(r) for r in got] == [("a", 3, 5)]


def test_windows_and_sessions(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = [(f"2024-01-01 00:{m:02d}:00", "x") for m in (0, 5, 50)]
    spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts")).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, k string").parquet(path)
    for name, df in (("w", growth.windowed_counts(stream, "k", width="10 minutes")), ("s", growth.sessions(stream, "k", gap="20 minutes"))):
        q = df.writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
    assert [r["n"] for r in spark.table("s").collect()] in ([2], [2, 1])
