"""Freezing files: copied byte for byte by the executors, hashed on the way, under a marker that one freeze alone can create.

    <folder>/_claim        made with the file system's create-if-absent: of two freezes one gets it, the other is refused
    <folder>/data/...      the copies, in pieces of CHUNK bytes, each written beside its name and then moved there
    <folder>/_provenance   a JSON line for each file (name, bytes, SHA-256, source) and one for the freeze, written last

A folder without _provenance is no frozen one: its freeze has not ended. `differences` hashes the copies again, where they are
read, and names every changed, missing or surplus file. Nothing of a file is held but a piece.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold.sources.archives import _store

CHUNK = 1 << 20
FILES = "file string, bytes long, sha256 string, source string"


class Refused(ValueError):
    """The folder is claimed by another freeze."""


def claim(spark: SparkSession, folder: str) -> None:
    """Create the marker, or raise Refused where there is one."""
    path = f"{folder.rstrip('/')}/_claim"
    if path.startswith(("/", "file:")):
        local = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError as error:
            raise Refused(f"{folder} is claimed already") from error
        return
    from py4j.protocol import Py4JJavaError

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False).close()
    except Py4JJavaError as error:
        if "exist" not in str(error.java_exception):
            raise
        raise Refused(f"{folder} is claimed already") from error


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(source, file, length) of the files below path, empty ones too, or of the file that it is; nothing of them is read. Names with a
    leading dot (checksums) do not count. Like any scan's, the list of names is the driver's."""
    from pyarrow import fs

    (store, root), base = _store(path), path.rstrip("/")
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    rows = [(base + f.path.removeprefix(root.rstrip("/")), f.base_name, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(".")]
    return spark.createDataFrame(rows, "source string, file string, length long")


def _hashed(copy_to: str | None):
    """For files(source, file): their bytes and SHA-256, and a copy below copy_to if there is one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        for batch in batches:
            out = []
            for source, file in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                digest, size, (store, path) = hashlib.sha256(), 0, _store(source)
                target = part = None
                if copy_to is not None:
                    there, root = _store(copy_to)
                    part = f"{root}/{os.path.dirname(file)}/_{os.path.basename(file)}.{TaskContext.get().taskAttemptId()}.part".replace("//", "/")
                    there.create_dir(os.path.dirname(part), recursive=True)
                    target = there.open_output_stream(part)
                with store.open_input_stream(path, compression=None) as stream:
                    while piece := stream.read(CHUNK):
                        digest.update(piece)
                        size += len(piece)
                        if target:
                            target.write(piece)
                if target:
                    target.close()
                    there.move(part, f"{root}/{file}")
                out.append((file, size, digest.hexdigest(), source))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["file", "bytes", "sha256", "source"])

    return run


def freeze_files(spark: SparkSession, sources: Mapping[str, str], folder: str, provenance: Mapping[str, str]) -> DataFrame:
    """Copy the files below each of sources (name: path) to folder/data/<name>, and give (file, bytes, sha256, source). The folder may not
    be claimed; two files of one name below a source are an error."""
    claim(spark, folder)
    rows = None
    for name, path in sources.items():
        own = _listed(spark, path).withColumn("file", F.concat(F.lit(f"{name}/"), "file"))
        rows = own if rows is None else rows.unionByName(own)
    if rows.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("two files have one name")
    count = rows.count()
    dealt = rows.select("source", "file").repartition(max(1, min(count, 10_000)), "file")
    copied = dealt.mapInArrow(_hashed(f"{folder.rstrip('/')}/data"), FILES)
    lines = copied.select(F.to_json(F.struct("*")).alias("value"))
    whole = spark.createDataFrame([(json.dumps({"provenance": dict(provenance), "files": count}, sort_keys=True),)], "value string")
    lines.unionByName(whole).write.mode("errorifexists").text(f"{folder}/_provenance")
    return recorded(spark, folder)


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256, source) as the freeze recorded them."""
    return spark.read.schema(FILES).json(f"{folder}/_provenance").where("file IS NOT NULL")


def provenance(spark: SparkSession, folder: str) -> dict:
    """What the freeze was given, and how many files it copied."""
    rows = spark.read.text(f"{folder}/_provenance").where(F.startswith("value", F.lit('{"files"'))).collect()  # one line
    return json.loads(rows[0].value)


def differences(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem) of the copies that are changed, missing or surplus."""
    root = f"{folder.rstrip('/')}/data"
    names = _listed(spark, root).select("source", F.concat_ws("/", F.slice(F.split("source", "/"), -2, 2)).alias("file"))
    found = names.repartition("file").mapInArrow(_hashed(None), FILES).select("file", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found"))
    both = recorded(spark, folder).join(found, "file", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "surplus").when((F.col("found") != F.col("sha256")) | (F.col("found_bytes") != F.col("bytes")), "changed")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")
