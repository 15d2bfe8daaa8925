"""The running spend of a stream does not depend on the files that calls lie in."""

import duckdb
from pyspark.sql import functions as F

from pathfold.plans import catalog
from pathfold.sources.storage import shared_path
from pathfold.streaming import ledger_stream as stream


def _same(spark, folder, got):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["stream_spend"]).fetchall()
    rows = [tuple(r) for r in got.select("user_id", "seq", "after", "stopped").collect()]
    assert sorted(rows) == sorted(want)


def test_more_files_than_a_batch_takes_in_another_order(spark, sf):
    folder = shared_path(spark, "events-of-many-files")
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 600")
    events = events.withColumn("user_id", F.col("user_id") % 3)
    events.repartitionByRange(100, F.desc("event_id")).write.parquet(f"{folder}/events.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a file, a task
    try:
        _same(spark, folder, catalog.QUERIES["stream_spend"](spark, folder))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_ranges_arrive_in_order_and_totals_are_exact(spark):
    # 0.1 added 8,000 times is 799.99...9 or 800.00...1 in doubles; with whole millionths the last call meets the cap and is made.
    calls = spark.range(8001).select(F.lit(1).cast("long").alias("account"), F.col("id").alias("seq"), F.lit(0.1).alias("cost"), F.lit(0.1).alias("bound"), F.lit(False).alias("failed"))
    calls = calls.repartition(7, F.hash("seq"))
    landing, staged, out, offsets = (shared_path(spark, n) for n in ("landing", "staged", "spend", "offsets"))
    start = lambda: stream.spend_stream(stream.file_stream(spark, landing, calls.schema, None), 800.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    stream.in_order(calls, "seq", landing, start, staged, at_once=3000)
    got = {r.seq: (r.after, r.stopped) for r in spark.read.parquet(out).collect()}
    assert got == {i: (round((i + 1) / 10, 1), i == 8000) for i in range(8001)}
