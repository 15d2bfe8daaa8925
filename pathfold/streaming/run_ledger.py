"""A ledger as sorted runs: every micro-batch appends one, reads merge them by key, and compaction rewrites them by size.

    <folder>/runs/<id>          Parquet, the newest row of each key of a batch (or of the runs merged into it), in ranges of the keys
    <folder>/versions/<n>.json  the runs that version n consists of, with their levels, and the last batch in it

A version is committed by giving a file its name, which the file system lets one writer do; a writer that comes second starts over
from the version that won. So a killed append or compaction leaves a run that no version names, and loses nothing, and a
batch that is run again is known by its number. FAN runs of one level become one of the next: a row is written
once for each level, that is log(batches) times, whatever keys the batches have.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from pathfold.operators.ledger import latest
from pathfold.sources.archives import _store

#: Runs of a level that are merged into one of the next.
FAN = 4


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Give path this text, unless it is there; of several writers one succeeds, and nobody sees half a text."""
    store, name = _store(path)
    draft = f"{os.path.dirname(name)}/_{uuid.uuid4().hex}.draft"
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(draft) as out:
        out.write(text.encode())
    try:
        if store.type_name == "local":
            try:
                os.link(draft, name)
                return True
            except FileExistsError:
                return False
        # Elsewhere a rename onto a file that exists is refused.
        jvm, base = spark._jvm, path.rsplit("/", 1)[0]
        source, target = jvm.org.apache.hadoop.fs.Path(f"{base}/{os.path.basename(draft)}"), jvm.org.apache.hadoop.fs.Path(path)
        return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target))
    finally:
        if store.type_name == "local":
            store.delete_file(draft)


class RunLedger:
    """The ledger below `folder`: the row with the largest `order` of each key is its state."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], order: str, schema, fan: int = FAN):
        self.spark, self.folder, self.keys, self.order, self.schema, self.fan = spark, folder.rstrip("/"), keys, order, schema, fan
        self.written = 0  # rows that this object has written

    # -- versions -----------------------------------------------------------------------------------------------------

    def _names(self, part: str) -> list[str]:
        from pyarrow import fs

        store, root = _store(f"{self.folder}/{part}")
        return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))

    def version(self) -> dict:
        """The newest version: its number, its runs as [id, level], and the last batch."""
        names = [n for n in self._names("versions") if n.endswith(".json")]
        if not names:
            return {"version": -1, "runs": [], "batch": -1}
        store, path = _store(f"{self.folder}/versions/{names[-1]}")
        with store.open_input_stream(path) as text:
            return json.loads(text.read())

    def _commit(self, base: dict, runs: Iterable, batch: int) -> bool:
        content = {"version": base["version"] + 1, "runs": list(runs), "batch": batch}
        return put_if_absent(self.spark, f"{self.folder}/versions/{content['version']:012d}.json", json.dumps(content, sort_keys=True))

    # -- runs ---------------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        path = f"{self.folder}/runs/{name}"
        newest = latest(rows, self.keys, self.order).select(*self.schema.fieldNames())
        newest.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.option("compression", "zstd").parquet(path)
        self.written += self.spark.read.schema(self.schema).parquet(path).count()
        return name

    def _rows(self, runs: list) -> DataFrame:
        paths = [f"{self.folder}/runs/{name}" for name, _ in runs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, changes: DataFrame, batch: int | None = None) -> bool:
        """Add a batch as a run; one whose number is not above the last one's is known already, and nothing happens."""
        base = self.version()
        if batch is not None and batch <= base["batch"]:
            return False
        name = self._write(changes)
        while not self._commit(base, [*base["runs"], [name, 0]], base["batch"] if batch is None else batch):
            base = self.version()
            if batch is not None and batch <= base["batch"]:
                return False
        return True

    def compact(self) -> int:
        """Merge the runs of every full level, lowest first; the number of merges. Versions that were committed meanwhile stay in."""
        merges = 0
        while True:
            base = self.version()
            levels = sorted({level for _, level in base["runs"]})
            full = next((x for x in levels if sum(level == x for _, level in base["runs"]) >= self.fan), None)
            if full is None:
                return merges
            old = [r for r in base["runs"] if r[1] == full][: self.fan]
            name = self._write(self._rows(old))
            while not self._commit(base, [r for r in base["runs"] if r not in old] + [[name, full + 1]], base["batch"]):
                base = self.version()
                if not all(r in base["runs"] for r in old):
                    break  # another compaction has taken them
            merges += 1

    def read(self) -> DataFrame:
        """The state: the newest row of each key over all runs."""
        return latest(self._rows(self.version()["runs"]), self.keys, self.order).select(*self.schema.fieldNames())

    def sweep(self, keep: int = 2) -> list[str]:
        """Delete the runs that none of the last `keep` versions names, and the versions before them; no other writer may be at work."""
        versions = [n for n in self._names("versions") if n.endswith(".json")]
        named: set[str] = set()
        for n in versions[-keep:]:
            store, path = _store(f"{self.folder}/versions/{n}")
            with store.open_input_stream(path) as text:
                named |= {name for name, _ in json.loads(text.read())["runs"]}
        gone = [n for n in self._names("runs") if n not in named]
        for n in gone:
            store, path = _store(f"{self.folder}/runs/{n}")
            store.delete_dir(path)
        for n in versions[:-keep]:
            store, path = _store(f"{self.folder}/versions/{n}")
            store.delete_file(path)
        return gone
