"""Sinks: Parquet artifacts with a manifest, canonical JSON, Markdown tables, and a ledger that is upserted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_line(*columns: str) -> Column:
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_table(df: DataFrame, most_rows: int = 1000) -> str:
    """A small result as a Markdown table; more than most_rows rows are an error, as reports hold summaries."""
    rows = df.limit(most_rows + 1).select(markdown_line(*df.columns)).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}", *(r[0] for r in rows)])


def write_artifacts(tables: Mapping[str, DataFrame], folder: str, partition_by: Mapping[str, list[str]] | None = None, spend: Mapping[str, str] | None = None) -> DataFrame:
    """Write every table as zstd Parquet below folder and a manifest (table, rows, schema, content hash, exact sum of its column
    of spend) beside them. An artifact that exists is an error: a frozen campaign is never overwritten."""
    spark, rows = None, []
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.mode("errorifexists").partitionBy(*(partition_by or {}).get(name, [])).option("compression", "zstd").parquet(f"{folder}/{name}")
        rows.append(manifest_row(spark, folder, name, (spend or {}).get(name)))
    manifest = spark.createDataFrame(rows, "name string, rows long, schema string, content long, spend_column string, spend string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/_manifest")
    return manifest


def manifest_row(spark: SparkSession, folder: str, name: str, spend: str | None = None) -> tuple:
    """Rows, schema, an order-independent content hash and the decimal sum of the spend of a written table."""
    df = spark.read.parquet(f"{folder}/{name}")
    total = F.sum(F.col(spend).cast("decimal(28,10)")).cast("string") if spend else F.lit(None).cast("string")
    n, digest, paid = df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)), total).first()
    return name, n, df.schema.simpleString(), digest, spend, paid


def verify_artifacts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the artifacts whose rows, schema, content or spend no longer agree with the manifest."""
    fields = "name string, rows long, schema string, content long, spend_column string, spend string"
    manifest = spark.read.schema(fields).json(f"{folder}/_manifest").collect()  # a row for each artifact
    return [r["name"] for r in manifest if manifest_row(spark, folder, r["name"], r["spend_column"]) != tuple(r)]


def canonical_json(**fields: Column) -> Column:
    """A JSON object of named columns, by name; nulls are written. NaN and infinities are no JSON: null them first."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def finite_or_null(column: Column) -> Column:
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


#: Parts of an upserted ledger, by a hash of its keys: what a change does not touch is not written again.
BUCKETS = 64


def upsert_parquet(changes: DataFrame, folder: str, keys: tuple[str, ...], order: str, buckets: int = BUCKETS) -> None:
    """Merge changes into the ledger below `folder`: the newest row of each key stays. Only the buckets that changes fall into
    are written anew, as folder/v<version>/_bucket=<b>; then folder/map<version> says which version each bucket is at.
    The map's commit is the version's, so a failed or repeated call changes nothing. What the version before last was
    the last to need is deleted: readers may still be at the last."""
    from pathfold.operators.ledger import latest

    spark = changes.sparkSession
    old = current_version(spark, folder)
    new, at = 0 if old is None else old + 1, _bucket_versions(spark, folder, old)
    part = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in changes.select(part.alias("b")).distinct().collect())  # `buckets` numbers at most
    held = [f"{folder}/v{at[b]:09d}/_bucket={b}" for b in touched if b in at]
    rows = spark.read.schema(changes.schema).parquet(*held).unionByName(changes) if held else changes
    latest(rows, keys, order).select(*changes.columns, part.alias("_bucket")).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/v{new:09d}")
    spark.createDataFrame([(b, new if b in touched else v) for b, v in {**at, **dict.fromkeys(touched, new)}.items()], "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{folder}/map{new:09d}")
    if old:
        for b, v in _bucket_versions(spark, folder, old - 1).items():
            if at[b] != v:
                _delete(spark, f"{folder}/v{v:09d}/_bucket={b}")
        _delete(spark, f"{folder}/map{old - 1:09d}")


def read_upserted(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The ledger as its last committed version has it."""
    at = _bucket_versions(spark, folder, current_version(spark, folder))
    paths = [f"{folder}/v{v:09d}/_bucket={b}" for b, v in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket_versions(spark: SparkSession, folder: str, version: int | None) -> dict[int, int]:
    if version is None:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").json(f"{folder}/map{version:09d}").collect()}


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def current_version(spark: SparkSession, folder: str) -> int | None:
    """The newest version whose map Spark committed."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    done = [s.getPath().getName() for s in store.listStatus(path) if store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(n[3:]) for n in done if n.startswith("map")), default=None)
