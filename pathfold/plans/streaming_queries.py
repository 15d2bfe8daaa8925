"""Streams run to completion over the driver's tables; each agrees with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathfold.plans.bridge import table
from pathfold.plans.ledger_queries import LEDGER_SQL
from pathfold.plans.registry import ORACLE_SQL, query
from pathfold.sources.storage import shared_path
from pathfold.streaming import ledger_stream as stream
from pathfold.streaming.run_ledger import RunLedger


def _events(spark, sf_dir):
    """The table as files that have arrived in a landing folder, read as a stream."""
    rows, landing = table(spark, sf_dir, "events"), shared_path(spark, "landing")
    rows.write.parquet(landing)
    return stream.file_stream(spark, landing, rows.schema)


@query("stream_upsert", LEDGER_SQL + "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def stream_upsert(spark, sf_dir):
    folder = shared_path(spark, "ledger")
    rows = _events(spark, sf_dir).select("user_id", "event_type", "event_id")
    stream.upsert_stream(rows, folder, ("user_id", "event_type"), "event_id", shared_path(spark, "offsets")).awaitTermination()
    return RunLedger(spark, folder, ("user_id", "event_type"), "event_id", rows.schema).read()


@query("stream_spend", ORACLE_SQL["spend_prefix"].replace("CAST(after AS DOUBLE) AS after", "round(CAST(after AS DOUBLE), 4) AS after"))
def stream_spend(spark, sf_dir):
    """The running spend of each account from a stream whose calls arrive in order, written to a table and read back."""
    landing, staged, out, offsets = (shared_path(spark, name) for name in ("landing", "staged", "spend", "offsets"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    failed = (F.col("event_id") % 10 >= 7) & (F.col("event_type") == "error")

    def start():
        calls = stream.file_stream(spark, landing, rows.schema, None)
        calls = calls.select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.col("value").cast("decimal(18,6)").alias("cost"), (F.col("value") * 1.5).cast("decimal(18,6)").alias("bound"), failed.alias("failed"))
        return stream.spend_stream(calls, 800.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start()

    stream.in_order(rows, "event_id", landing, start, staged)
    return spark.read.parquet(out).select(F.col("account").alias("user_id"), "seq", F.round("after", 4).alias("after"), "stopped")
