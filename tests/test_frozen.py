"""Frozen copies: one of two freezes wins, copies are exact, and every difference is named."""

import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from pathfold.sources import frozen


def sources(tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/b").mkdir()
    for name, n in (("a/x.bin", 3), ("a/y.bin", 2_500_000), ("b/x.bin", 0)):
        (tmp_path / "in" / name).write_bytes(os.urandom(n))
    return {"a": str(tmp_path / "in/a"), "b": str(tmp_path / "in/b")}


def test_copies(spark, tmp_path):
    given = sources(tmp_path)
    folder = str(tmp_path / "frozen")
    rows = {r.file: (r.bytes, r.sha256) for r in frozen.freeze_files(spark, given, folder, {"run": "7"}).collect()}
    want = {n: (tmp_path / "in" / n).read_bytes() for n in ("a/x.bin", "a/y.bin", "b/x.bin")}
    assert rows == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in want.items()}
    assert {n: (tmp_path / "frozen/data" / n).read_bytes() for n in want} == want
    assert frozen.provenance(spark, folder) == {"files": 3, "provenance": {"run": "7"}} and frozen.differences(spark, folder).collect() == []
    with pytest.raises(frozen.Refused):
        frozen.freeze_files(spark, given, folder, {})
    data = bytearray(want["a/y.bin"])
    data[1_200_000] ^= 1
    (tmp_path / "frozen/data/a/y.bin").write_bytes(bytes(data))
    os.remove(tmp_path / "frozen/data/b/x.bin")
    (tmp_path / "frozen/data/b/new.bin").write_bytes(b"1")
    for name in ("a/.y.bin.crc", "b/.x.bin.crc"):
        if os.path.exists(tmp_path / "frozen/data" / name):
            os.remove(tmp_path / "frozen/data" / name)
    assert sorted(map(tuple, frozen.differences(spark, folder).collect())) == [("a/y.bin", "changed"), ("b/new.bin", "surplus"), ("b/x.bin", "missing")]


def test_one_of_two_wins(spark, tmp_path):
    given, folder = sources(tmp_path), str(tmp_path / "frozen")

    def attempt(i):
        try:
            return frozen.freeze_files(spark, given, folder, {"run": str(i)}).count()
        except frozen.Refused:
            return "refused"

    with ThreadPoolExecutor(4) as pool:
        assert sorted(map(str, pool.map(attempt, range(4)))) == ["3", "refused", "refused", "refused"]
    assert frozen.differences(spark, folder).collect() == []


def test_names_must_differ(spark, tmp_path):
    for d in ("p", "q"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "x.bin").write_bytes(b"1")
    with pytest.raises(ValueError, match="one name"):
        frozen.freeze_files(spark, {"a": str(tmp_path / "in")}, str(tmp_path / "f"), {})
