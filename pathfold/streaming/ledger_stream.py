"""Streaming twins of the ledger: outcomes are upserted as they come, and calls stop before the spend cap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from pathfold.streaming.run_ledger import RunLedger

MICRO = 1_000_000
#: Rows that arrive together where their order matters.
AT_ONCE = 4_000_000


def upsert_stream(stream: DataFrame, folder: str, keys: tuple[str, ...], order: str, checkpoint: str, available_now: bool = True):
    """Add every micro-batch to the ledger of runs below folder, and merge runs of a size. A batch that is run again is known by its
    number."""
    schema = stream.schema

    def add(batch: DataFrame, number: int) -> None:
        ledger = RunLedger(batch.sparkSession, folder, keys, order, schema)
        ledger.append(batch, number)
        ledger.compact()
        ledger.sweep()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def spend_stream(stream: DataFrame, cap: float) -> DataFrame:
    """stream(account, seq, cost, bound, failed) -> (account, seq, after, stopped). State is three values an account; within a
    batch an account's calls are taken in order of seq, and batches must come in that order (`in_order`). After the first call that could
    pass the cap, all are stopped. Sums are whole millionths, so a total that meets the cap is not above it. A call without a cost
    adds nothing; before the first with one there is neither total nor stop."""
    most = round(cap * MICRO)

    def step(key, batches: Iterator, state):
        import numpy as np
        import pandas as pd

        spent, stopped, begun = state.get if state.exists else (0, False, False)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        known = rows["known"].to_numpy(dtype=bool)
        bound = rows["bound"].to_numpy(dtype=np.int64)
        charge = np.where(rows["failed"].to_numpy(dtype=bool), bound, rows["cost"].to_numpy(dtype=np.int64))
        after = spent + np.cumsum(charge)
        stops = stopped | np.maximum.accumulate(known & (after - charge + bound > most))
        seen = begun | np.maximum.accumulate(known)
        state.update((int(after[-1]), bool(stops[-1]), bool(seen[-1])))
        yield pd.DataFrame({"account": key[0], "seq": rows["seq"].to_numpy(), "after": after, "stopped": stops, "seen": seen})

    micro = lambda c: F.coalesce((F.col(c).cast("decimal(18,6)") * MICRO).cast("long"), F.lit(0)).alias(c)
    charged = F.when(F.col("failed"), F.col("bound")).otherwise(F.col("cost"))
    known = (charged.isNotNull() & F.col("bound").isNotNull()).alias("known")
    rows = stream.select("account", "seq", micro("cost"), micro("bound"), F.coalesce("failed", F.lit(False)).alias("failed"), known)
    schema, kept = "account long, seq long, after long, stopped boolean, seen boolean", "spent long, stopped boolean, seen boolean"
    found = rows.groupBy("account").applyInPandasWithState(step, schema, kept, "append", "NoTimeout")
    return found.select("account", "seq", F.when(F.col("seen"), F.col("after") / F.lit(float(MICRO))).alias("after"), F.when(F.col("seen"), F.col("stopped")).alias("stopped"))


def in_order(rows: DataFrame, order: str, landing: str, run: Callable[[], StreamingQuery], staged: str, at_once: int = AT_ONCE) -> None:
    """rows arrive in landing in ascending `order`, about at_once at a time; run starts a stream over what is there, and what comes next
    lands when it has ended. So no batch has a row that belongs before one of an earlier batch, whatever files the rows were
    in. Where the ranges are cut decides the sizes only."""
    spark, n = rows.sparkSession, rows.count()
    parts = max(1, -(-n // at_once))
    cuts = sorted(set(rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    place = sum((F.coalesce((F.col(order) >= c).cast("int"), F.lit(1)) for c in cuts), F.lit(0))
    rows.withColumn("arrival", place).write.partitionBy("arrival").parquet(staged)
    schema = StructType([*rows.schema.fields, StructField("arrival", IntegerType())])
    for i in range(len(cuts) + 1):
        spark.read.schema(schema).parquet(staged).where(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(landing)
        run().awaitTermination()


def status_windows(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Outcomes by tumbling window and kind; rows later than `late` are not counted."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))


def file_stream(spark: SparkSession, path: str, schema, most: int | None = 64) -> DataFrame:
    """The files below path, `most` in a batch, or all that are there."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", most) if most else reader).parquet(path)
