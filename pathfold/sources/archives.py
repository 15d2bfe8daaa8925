"""Archives of result files as a data source: spark.read.format('result_archive').load(path), after `register`.

A partition is one tar.gz archive, which cannot be split. It is read as a stream: bytes are unpacked as they come, members are
yielded one by one, and what a task holds is one member, whatever the archive's size. Archives are not trusted: an absolute or
climbing path, a link, a device or a repeated member is an error. `inventory` has a row for each file, and tells where
the path and the file's own header disagree; such files must be pinned by name.
"""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pathfold.sources.readers import RESULT_FILE

SCHEMA = "archive string, member string, bytes long, sha256 string, body string"


def _store(path: str):
    """pyarrow's file system for a path or URL, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def safe_name(member: tarfile.TarInfo, seen: set[str]) -> bool:
    name = member.name
    return member.isreg() and not name.startswith("/") and ".." not in name.split("/") and name not in seen


def members_of(stream) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the regular files of a tar.gz stream, read forwards."""
    seen: set[str] = set()  # names only
    with tarfile.open(fileobj=stream, mode="r|gz") as tar:
        for member in tar:
            if member.isdir():
                continue
            if not safe_name(member, seen):
                raise ValueError(f"bad archive member: {member.name}")
            seen.add(member.name)
            yield member.name, tar.extractfile(member).read()
            tar.members.clear()  # else the headers of all members stay


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [Archive(self.path)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".tar.gz", ".tgz")))
        base = self.path.rstrip("/")
        return [Archive(base + name.removeprefix(root.rstrip("/"))) for name in names]

    def read(self, partition: Archive) -> Iterator[tuple]:
        store, path = _store(partition.path)
        with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
            for name, body in members_of(stream):
                yield partition.path, name, len(body), hashlib.sha256(body).hexdigest(), body.decode()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "result_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def write(members: DataFrame, folder: str) -> DataFrame:
    """members(archive, member, body) as folder/<archive>.tar.gz, each written by one task as a stream, in the order of its members' names:
    (archive, member, bytes, sha256). An archive gets its name when it is whole."""

    def run(batches: Iterator) -> Iterator:
        import io

        import pyarrow as pa

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, raw, tar = None, None, None

        def close() -> None:
            if tar is not None:
                tar.close()
                raw.close()
                store.move(f"{root}/_{name}.part", f"{root}/{name}.tar.gz")

        for batch in batches:
            out = []
            for archive, member, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive != name:
                    close()
                    name = archive
                    raw = store.open_output_stream(f"{root}/_{name}.part")
                    tar = tarfile.open(fileobj=raw, mode="w|gz")
                data = body.encode()
                entry = tarfile.TarInfo(member)
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))
                tar.members.clear()
                out.append((archive, member, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["archive", "member", "bytes", "sha256"])
        close()

    rows = members.select("archive", "member", "body").repartition("archive").sortWithinPartitions("archive", "member")
    return rows.mapInArrow(run, "archive string, member string, bytes long, sha256 string")


def inventory(members: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """A row for each file: archive, member, dataset, source_split, model_id (of its header), bytes, sha256, records, reported_counts,
    header_cost, record_cost_sum, path_agrees, and pinned: whether pinned(member, dataset, source_split, model_id) names just this header."""
    parsed = members.select("archive", "member", "bytes", "sha256", F.from_json("body", RESULT_FILE, {"mode": "FAILFAST"}).alias("f"), F.slice(F.reverse(F.split("member", "/")), 2, 3).alias("p"))
    header = {"dataset": "f.dataset_name", "source_split": "f.split", "model_id": "f.model_name"}
    agrees = F.col("p") == F.array("f.model_name", "f.split", "f.dataset_name")
    costs = F.aggregate(F.transform("f.records", lambda r: F.coalesce(r["cost"], F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    rows = parsed.select(
        "archive", "member", *[F.col(c).alias(n) for n, c in header.items()], "bytes", "sha256", F.size("f.records").cast("bigint").alias("records"), F.col("f.counts").alias("reported_counts"),
        F.col("f.cost").alias("header_cost"), costs.alias("record_cost_sum"), F.coalesce(agrees, F.lit(False)).alias("path_agrees"),
    )
    if pinned is None:
        return rows.withColumn("pinned", F.lit(False))
    marks = pinned.select("member", *header, F.lit(True).alias("pinned")).distinct()
    return rows.join(marks, ["member", *header], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))


def problems(files: DataFrame) -> DataFrame:
    """(member, problem) of an inventory: a header that neither agrees with its path nor is pinned, counts that are not those of the
    records, and runs (dataset, split, model) of which more than one archive has the same file."""
    own = F.when(~F.col("path_agrees") & ~F.col("pinned"), "identity").when(F.col("records") != F.col("reported_counts"), "counts")
    wrong = files.select("member", own.alias("problem")).where("problem IS NOT NULL")
    repeated = files.groupBy("member").agg(F.count("*").alias("n")).where("n > 1").select("member", F.lit("repeated").alias("problem"))
    return wrong.unionByName(repeated)
