from pyspark.sql import functions as F

from voxtable.streaming.measurements import running_measurements, windowed_measurements


def test_streams_equal_batches(spark):
    sf = "/root/testdata/sf0.001/"
    batch = spark.read.parquet(f"{sf}events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    one = running_measurements(stream.select(F.col("user_id").alias("object_id"), "value"))
    q = one.writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    got = {r["object_id"]: (r["count"], round(r["sum"], 6)) for r in spark.table("running").collect()}
    want = {r["user_id"]: (r["n"], round(r["s"], 6)) for r in batch.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got == want
    timed = stream.select(F.col("user_id").alias("object_id"), "value", F.col("ts").cast("timestamp").alias("at"))
    q = windowed_measurements(timed, "at", "1 day", "1 hour").writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("count")).first()[0] <= batch.count()
