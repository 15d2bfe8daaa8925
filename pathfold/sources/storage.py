"""Where intermediate tables and stream checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir. Only a local master may leave it unset
    (tests): then it is a folder of this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own[:] = _own or [tempfile.mkdtemp(prefix="pathfold-plans-")]
        folder = _own[0]
    return f"{folder.rstrip('/')}/pathfold-plans/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """DataFrame.checkpoint needs a folder; it is set only where the session has none."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))


def freeze(df: DataFrame, name: str, rows_of_file: int = 0) -> DataFrame:
    """Write df and read it back: what comes later cannot reach behind it, and what uses it twice computes it once. Where rows are large,
    rows_of_file bounds the files, so that tasks can be dealt evenly."""
    path = shared_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_of_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
