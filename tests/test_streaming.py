"""Streams give what a batch over the same files gives."""

from pyspark.sql import functions as F

from geocadence.streaming import monitor


def _files(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("pixel_id"), F.col("ts").cast("timestamp").alias("at"), "value")
    for k in range(3):
        e.where(F.dayofmonth("at").between(k * 11 + 1, k * 11 + 11)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).toPandas()


def test_composite(spark, sf_dir, tmp_path):
    batch, stream = _files(spark, sf_dir, tmp_path)
    got = _drain(monitor.stream_composite(stream, 8, "60 days"), "composites", "complete")
    want = batch.groupBy("pixel_id", F.window("at", "8 days")).agg(F.count("value").alias("n")).count()
    assert len(got) == want and got["count"].sum() == batch.count()


def test_ewma(spark, sf_dir, tmp_path):
    _, stream = _files(spark, sf_dir, tmp_path)
    got = _drain(monitor.stream_ewma(stream, 50.0, 20.0), "chart", "append")
    assert len(got) and set(got.columns) == {"pixel_id", "at", "z", "flag", "alarm"}
    first = got.sort_values("at").groupby("pixel_id").first()
    assert first.z.notna().all()
