from pyspark.sql import functions as F

from lagloom.sources.fixtures import panel_events
from lagloom.streaming.panels import event_panel


def test_stream_equals_batch_for_closed_buckets(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = event_panel(s).writeStream.format("memory").queryName("panel_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.t, r.node, r.variable): r.value for r in spark.table("panel_stream").collect()}
    want = {(r.t, r.node, r.variable): r.value for r in panel_events(spark, sf_dir).collect()}
    assert got and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    last = max(k[0] for k in want)
    assert all(k in got for k in want if k[0] < last - 1)
