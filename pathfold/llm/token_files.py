"""Token counts of flat token files: a separator scan without any index.

A flat file holds little-endian ids one after the other; a document ends with the end-of-document id. The scan
cuts a file into blocks, finds the separators of each block with one vectorised comparison, and stitches documents
that cross blocks with a prefix scan over the blocks' summaries (separators, ids after the last one). The same
scan over the files' summaries, within ranges of files and then over the ranges, stitches documents that cross files,
in path order; no task sees all files.

Defined results: a document without ids (two separators in a row, a null or empty text) counts 0; ids after the last
separator of all files make one last document with `ended` false; an empty file changes nothing; no files give no
rows; repeated rows and null ids each keep their row; a text of any length is one document; other columns, whatever
their names, are ignored. File names in results do not depend on task attempts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathfold.llm.common import materialize, shared_path
from pathfold.llm.workers import release, tidied

BLOCK_IDS = 1 << 20
#: A file that has reached so many bytes ends with its document; a scan holds a few files at a time.
FILE_BYTES = 8 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority that Spark's own readers would use for it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def most_id(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat files for each partition of docs below `path` (a URL or folder that executors share), without a
    shuffle. Gives the rows (file, ordinal, doc_id) of what was written; the files themselves hold no index. Each
    attempt of a task has a file of its own that gets its name when it is whole; the rows of the attempt that Spark
    commits name the file that counts. A vocabulary or an end id that dtype cannot hold is an error."""
    import numpy as np

    most = np.iinfo(np.dtype(dtype)).max
    if max(most_id(tokenizer), end_id) > most or end_id < 0:
        raise ValueError(f"ids up to {max(most_id(tokenizer), end_id)} do not fit {dtype}")

    def put(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from pathfold.llm.byte_bpe import encoder

        task, enc, end = TaskContext.get(), encoder(tokenizer, special_as_text=True), np.array([end_id], dtype=dtype).tobytes()
        store, root = (fs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/")) if where.startswith("file:") else fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        out, name, size, ordinal, number = None, "", 0, 0, 0

        def close() -> None:
            if out:
                out.close()
                store.move(f"{root}/_{name}.part", f"{root}/{name}")

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                names, ordinals = [], []
                for ids in enc.encode(part.column(1).to_pylist()):
                    if out is None or size >= FILE_BYTES:
                        close()
                        name, size, ordinal, number = f"{task.partitionId():08d}-{task.taskAttemptId()}-{number:06d}.bin", 0, 0, number + 1
                        out = store.open_output_stream(f"{root}/_{name}.part")
                    data = ids.astype(dtype).tobytes() + end
                    out.write(data)
                    size += len(data)
                    names.append(name)
                    ordinals.append(ordinal)
                    ordinal += 1
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), part.column(0)], names=["file", "ordinal", "doc_id"])
        close()

    where = qualified(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(put), "file string, ordinal long, doc_id long")


def scan_blocks(data, end_id: int, dtype: str, block_ids: int = BLOCK_IDS):
    """Lengths of the documents that end in the file, and the ids after its last separator. The first length counts
    from the start of the file."""
    import numpy as np

    ids = np.frombuffer(data, dtype=dtype)
    found, tails, sizes = [], [], []
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids]
        here = np.flatnonzero(block == end_id)
        found.append(here)
        sizes.append(len(block))
        tails.append(len(block) - 1 - here[-1] if len(here) else len(block))
    if not found:
        return np.empty(0, dtype=np.int64), 0
    size, tail = np.array(sizes), np.array(tails)
    closes = np.array([len(x) > 0 for x in found])
    # Prefix scan: ids carried into a block are the tails since the last block that has a separator.
    total = np.concatenate(([0], np.cumsum(tail)))
    last = np.maximum.accumulate(np.where(closes, np.arange(len(found)), -1))
    carry_out = total[1:] - np.where(last >= 0, total[np.maximum(last, 0)], 0)
    carry_in = np.concatenate(([0], carry_out[:-1]))
    lengths = []
    for here, carry in zip(found, carry_in, strict=True):
        if len(here):
            own = np.diff(here, prepend=-1) - 1
            own[0] += carry
            lengths.append(own)
    assert int(size.sum()) == len(ids)
    return (np.concatenate(lengths) if lengths else np.empty(0, dtype=np.int64)), int(carry_out[-1])


def count_tokens(spark: SparkSession, path: str, end_id: int, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, ordinal (of the document's end in its file), n_tokens (without the end id), ended."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                lengths, tail = scan_blocks(content.as_buffer(), end_id, dtype, block_ids)
                release()
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * (n + 1)), pa.array(np.arange(n + 1)), pa.array(np.append(lengths, tail).astype(np.int64)), pa.array(np.arange(n + 1) < n)],
                    names=["file", "ordinal", "n_tokens", "ended"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInArrow(tidied(scan), "file string, ordinal long, n_tokens long, ended boolean")
    # One row for each file: whether it ends a document, and the ids after its last separator.
    ends = rows.where(~F.col("ended")).select("file", F.col("n_tokens").alias("tail"), (F.col("ordinal") > 0).cast("int").alias("closes"))
    carry = _carried(materialize(ends.repartitionByRange("file").withColumn("range", F.spark_partition_id()), "file-ends"))
    out = rows.join(carry, "file")
    first = (F.col("ordinal") == 0) & F.col("ended")
    tokens = F.when(first, F.col("n_tokens") + F.col("carry")).when(F.col("ended"), F.col("n_tokens")).otherwise(F.col("held"))
    keep = F.col("ended") | (F.col("final") & (F.col("held") > 0))
    return out.where(keep).select("file", "ordinal", tokens.alias("n_tokens"), "ended")


def _scan(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """rows(order, tail, closes) in their order within keys, with `open` (nothing closed up to and with the row), `held` (ids
    since the last row that closed, its tail included) and both for the row before: `open_before`, `before`."""
    line = Window.partitionBy(*keys).orderBy(order)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("run", F.sum("closes").over(upto))
    held = run.withColumn("held", F.sum("tail").over(Window.partitionBy(*keys, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return held.withColumns({"open": F.col("run") == 0, "open_before": F.col("run") - F.col("closes") == 0, "before": F.coalesce(F.lag("held").over(line), F.lit(0))}).drop("run")


def _carried(ends: DataFrame) -> DataFrame:
    """ends(file, tail, closes, range), ranges being in file order -> (file, held, carry, final): ids since the last separator
    at the end and at the beginning of each file, over all files before."""
    within = _scan(ends, "file", "range")
    ranges = within.groupBy("range").agg(F.max_by("held", "file").alias("tail"), F.max("closes").alias("closes"), F.max("file").alias("last"))
    over = _scan(ranges, "range").select("range", F.col("before").alias("into"), F.max("last").over(Window.partitionBy()).alias("last"))  # a row for each range
    into = lambda still_open: F.when(F.col(still_open), F.col("into")).otherwise(F.lit(0))
    return within.join(over, "range").select("file", (F.col("held") + into("open")).alias("held"), (F.col("before") + into("open_before")).alias("carry"), (F.col("file") == F.col("last")).alias("final"))


def write_and_count(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents' flat files, scan them without an index, and name each counted document by the order in
    which its file was written: doc_id, file, ordinal, n_tokens."""
    spark = docs.sparkSession
    path = shared_path(spark, "flat")
    written = materialize(write_files(docs, path, tokenizer, end_id), "flat-order")
    if not written.limit(1).count():  # no rows, no files
        return written.select("doc_id", "file", "ordinal", F.lit(0).cast("bigint").alias("n_tokens"))
    # The name without the attempt that wrote it.
    stable = F.regexp_replace("file", r"^([0-9]+)-[0-9]+-", "$1-").alias("file")
    return written.join(count_tokens(spark, path, end_id), ["file", "ordinal"], "left").select("doc_id", stable, "ordinal", "n_tokens")
