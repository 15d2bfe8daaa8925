"""Token-ID output as Parquet list columns, and selective reads of it.

Layout of the files: rows in ascending id order; each file is one range of ids. Columns
    shard int          number of the file's range, ascending with the ids
    pos long           ids of the same shard before this row (delta-friendly: it only grows)
    doc_id long, n_tokens int
    ids list<int>      dictionary pages first, then delta encoding where a dictionary would not pay
Row groups and pages have set sizes and Parquet's column and offset indexes are written, so a reader that asks for
`doc_id, n_tokens` or for a range of doc_id touches only those columns' pages.

Defined results: a null text is the empty text (one end id); a null id sorts first; rows with equal ids keep a
defined order (by text) and each has its own row; other columns of the input, whatever their names, are ignored;
an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathfold.llm.common import shared_path, sized, small_batches
from pathfold.llm.workers import tidied

SCHEMA = "shard int, pos long, doc_id long, n_tokens int, ids array<int>"
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA in ascending id order over partitions that are ranges of the id."""

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from pathfold.llm.byte_bpe import encoder

        shard, pos, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            step = 1000  # rows whose ids are held at once
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids = [np.append(x, np.int32(end_id)) for x in enc.encode(part.column(1).to_pylist())]
                size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                ends = np.cumsum(size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard, dtype=np.int32)), pa.array(pos + ends - size), part.column(0), pa.array(size.astype(np.int32)), lists],
                    names=["shard", "pos", "doc_id", "n_tokens", "ids"],
                )
                pos += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tidied(encode), SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files. Spark's commit makes them whole even if tasks are retried."""
    writer = (
        encode_sorted(docs, tokenizer, end_id, id_col, text_col)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
    )
    with small_batches(docs.sparkSession):
        writer.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files with `start`, the ids of all documents before the row: shard totals come from two columns only."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("shard").agg(F.max(F.col("pos") + F.col("n_tokens")).alias("total"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    # A row for each file, its number checked, so that the lists of ids are not shuffled to meet it.
    offsets = sized(totals.select("shard", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("offset")), "offsets")
    return rows.join(offsets, "shard").withColumn("start", F.col("offset") + F.col("pos")).drop("offset")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens without touching the pages of ids."""
    return read(spark, path).select("doc_id", "start", "n_tokens")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
    return rows.mapInArrow(tidied(crc), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents, read the files back and digest them."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(docs, path, tokenizer, end_id)
    return digest(read(spark, path))
