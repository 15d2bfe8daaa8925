"""Shared helpers of the training-data operators: shared storage, fixed settings, small column helpers."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir. Only a local master may leave it unset (tests):
    then it is a folder of this machine."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(shared_dir, "_own", None) or tempfile.mkdtemp(prefix="pathfold-")
        shared_dir._own = folder
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/pathfold/{name}-{uuid.uuid4().hex}"


#: Writers inside small_batches and the setting before the first of them: several queries may share a session.
_batches = {"lock": threading.Lock(), "users": 0, "before": None}


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it holds, Arrow batches of queries have at most so many rows: rows of texts are long. The setting goes back
    when the last of concurrent users leaves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _batches["lock"]:
        if not _batches["users"]:
            _batches["before"] = spark.conf.get(name)
        _batches["users"] += 1
        before = int(_batches["before"])
        spark.conf.set(name, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        with _batches["lock"]:
            _batches["users"] -= 1
            if not _batches["users"]:
                spark.conf.set(name, _batches["before"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def hash_unit(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) from SHA-256 of the parts joined by ':' (52 bits, so exact in a double)."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.sha2(F.concat_ws(":", *cols), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def sized(df: DataFrame, name: str, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """df written to the shared folder, and marked for broadcast only if it turned out to have at most most_rows rows and
    most_bytes bytes (of its columns' values); beyond that Spark joins it by shuffling."""
    kept = materialize(df, name)
    return F.broadcast(kept) if fits(kept, most_rows, most_bytes) else kept


def fits(kept: DataFrame, most_rows: int, most_bytes: int) -> bool:
    """Numbers count 8 bytes, strings and arrays their length; one pass over what was written."""
    width = F.lit(0)
    for field in kept.schema.fields:
        c, kind = F.col(field.name), field.dataType.typeName()
        own = F.octet_length(c) if kind in ("string", "binary") else 8 * F.size(c) if kind in ("array", "map") else F.lit(8)
        width = width + F.coalesce(own, F.lit(0))
    rows, size = kept.agg(F.count("*"), F.sum(width.cast("bigint"))).first()
    return rows <= most_rows and (size or 0) <= most_bytes


def dealt_join(rows: DataFrame, side: DataFrame, keys: list[str], salt: Column, most: int = 1024) -> DataFrame:
    """rows joined with side(keys, many, ...), which has a few rows for each key, and `many`, the number of the key's rows. Keys with
    more than `most` rows are dealt over several tasks by `salt`; their side rows are repeated once for each."""
    parts = F.ceil(F.col("many") / F.lit(most)).cast("int")
    hot = sized(side.where(F.col("many") > most).select(*keys, parts.alias("_parts")).distinct(), "hot-keys")
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(salt, F.lit(3)), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return salted.join(side.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("many"), [*keys, "_salt"]).drop("_salt")


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables; for callers that are done with them."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
