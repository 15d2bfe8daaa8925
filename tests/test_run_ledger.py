"""The ledger of runs: equal to a plain one after any batches, cheap for random keys, and whole after a killed step."""

import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from pathfold.streaming import ledger_stream, run_ledger

SCHEMA = "k int, v string, seq long"


def batches(n, size, keys, seed=0):
    r, seq = random.Random(seed), iter(range(10**6))
    return [[(r.randrange(keys), f"b{i}", next(seq)) for _ in range(size)] for i in range(n)]


def plain(given):
    out = {}
    for row in (x for b in given for x in b):
        if row[0] not in out or row[2] > out[row[0]][2]:
            out[row[0]] = row
    return sorted(out.values())


def ledger(spark, folder, fan=2):
    schema = spark.createDataFrame([], SCHEMA).schema
    return run_ledger.RunLedger(spark, str(folder), ("k",), "seq", schema, fan)


def state(it):
    return sorted(map(tuple, it.read().collect()))


def test_batches_and_rows_written(spark, tmp_path):
    n, size = 8, 40
    given = batches(n, size, 10_000)
    it = ledger(spark, tmp_path)
    for i, rows in enumerate(given):
        assert it.append(spark.createDataFrame(rows, SCHEMA), i)
        it.compact()
    assert state(it) == plain(given)
    assert it.written <= n * size * (math.log2(n) + 1)  # and not n / 2 ledgers
    assert [level for _, level in it.version()["runs"]] == [3]
    assert not it.append(spark.createDataFrame(given[-1], SCHEMA), n - 1) and state(it) == plain(given)
    it.sweep()
    assert len(it._names("runs")) <= 3 and len(it._names("versions")) == 2 and state(it) == plain(given)


def test_a_killed_step_loses_nothing(spark, tmp_path, monkeypatch):
    given = batches(4, 30, 25)
    it = ledger(spark, tmp_path)
    for i, rows in enumerate(given):
        it.append(spark.createDataFrame(rows, SCHEMA), i)
    commit = run_ledger.RunLedger._commit
    monkeypatch.setattr(run_ledger.RunLedger, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        it.compact()
    with pytest.raises(KeyboardInterrupt):
        it.append(spark.createDataFrame([(1, "lost", 10**9)], SCHEMA), 4)
    monkeypatch.setattr(run_ledger.RunLedger, "_commit", commit)
    assert state(ledger(spark, tmp_path)) == plain(given)
    assert it.compact() == 3 and state(it) == plain(given)
    assert len(it.sweep(1)) >= 2 and state(it) == plain(given)


def test_two_writers(spark, tmp_path):
    given = batches(6, 10, 15, 3)
    with ThreadPoolExecutor(6) as pool:
        assert all(pool.map(lambda rows: ledger(spark, tmp_path).append(spark.createDataFrame(rows, SCHEMA)), given))
    assert state(ledger(spark, tmp_path)) == plain(given) and ledger(spark, tmp_path).version()["version"] == 5
    assert state(ledger(spark, tmp_path / "none")) == []


def test_a_name_is_given_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: run_ledger.put_if_absent(spark, str(tmp_path / "x/y.json"), str(i)), range(8)))
    assert sum(won) == 1 and (tmp_path / "x/y.json").read_text() == str(won.index(True))
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["y.json"]


def test_stream(spark, tmp_path):
    given = batches(5, 20, 30, 7)
    for i, rows in enumerate(given):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger_stream.upsert_stream(rows, str(tmp_path / "out"), ("k",), "seq", str(tmp_path / "offsets")).awaitTermination()
    assert state(ledger(spark, tmp_path / "out")) == plain(given)
