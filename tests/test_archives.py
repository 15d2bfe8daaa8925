"""Archives: streamed, untrusted, with an inventory; lines with their numbers; settings."""

import io
import json
import os
import tarfile
import tracemalloc

import pytest
from pyspark.sql import functions as F

from pathfold.sources import archives, readers


def result(dataset, split, model, n=3, counts=None):
    record = lambda i: dict(index=i, prompt=f"{dataset} {i}", origin_query="o", raw_output="x", prediction="p", ground_truth="g", score=1.0, cost=0.25 * i if i else None, prompt_tokens=5, completion_tokens=7)
    return json.dumps(dict(dataset_name=dataset, split=split, model_name=model, counts=n if counts is None else counts, performance=0.5, cost=1.0, demo=False, records=[record(i) for i in range(n)])).encode()


def pack(path, *members):
    with tarfile.open(path, "w:gz") as tar:
        for name, body in members:
            entry = tarfile.TarInfo(name)
            if isinstance(body, bytes):
                entry.size = len(body)
                tar.addfile(entry, io.BytesIO(body))
            else:
                entry.type, entry.linkname = body[0], "elsewhere"
                tar.addfile(entry)


@pytest.mark.parametrize("members", [[("/abs.json", b"{}")], [("a/../../b.json", b"{}")], [("a.json", (tarfile.SYMTYPE,))], [("a.json", (tarfile.LNKTYPE,))], [("a.json", (tarfile.FIFOTYPE,))], [("a.json", b"{}"), ("a.json", b"{}")]])
def test_bad_members(spark, tmp_path, members):
    pack(tmp_path / "r.tar.gz", *members)
    with pytest.raises(Exception, match="bad archive member"):
        readers.read_archive(spark, str(tmp_path / "r.tar.gz")).collect()


def test_a_reader_holds_one_member(tmp_path):
    """64 members of a megabyte each: what is held at once is a few of them, and no headers pile up."""
    body = os.urandom(1 << 19).hex().encode()
    pack(tmp_path / "r.tar.gz", *[(f"d/{i}.json", body) for i in range(64)])
    reader = archives.ArchiveReader(str(tmp_path / "r.tar.gz"))
    (part,) = reader.partitions()
    tracemalloc.start()
    sizes = [row[2] for row in reader.read(part)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [1 << 20] * 64 and peak < 10 << 20


def test_inventory(spark, tmp_path):
    pack(tmp_path / "a.tar.gz", ("release/math/test/m0/r.json", result("math", "test", "m0")), ("release/math/test/m1/r.json", result("math", "test", "m1-old", 5)), ("release/code/test/m2/r.json", result("code", "test", "other")))
    pack(tmp_path / "b.tar.gz", ("release/math/test/m0/r.json", result("math", "test", "m0", 2, counts=3)))
    members = readers.read_archive(spark, str(tmp_path))
    assert members.rdd.getNumPartitions() == 2 and members.count() == 4
    pinned = spark.createDataFrame([("release/math/test/m1/r.json", "math", "test", "m1-old"), ("release/code/test/m2/r.json", "code", "test", "yet another")], "member string, dataset string, source_split string, model_id string")
    files = archives.inventory(members, pinned)
    got = {(os.path.basename(r.archive), r.member.split("/", 1)[1]): (r.records, r.reported_counts, r.record_cost_sum, r.path_agrees, r.pinned) for r in files.collect()}
    assert got == {("a.tar.gz", "math/test/m0/r.json"): (3, 3, 0.75, True, False), ("a.tar.gz", "math/test/m1/r.json"): (5, 5, 2.5, False, True), ("a.tar.gz", "code/test/m2/r.json"): (3, 3, 0.75, False, False), ("b.tar.gz", "math/test/m0/r.json"): (2, 3, 0.25, True, False)}
    assert sorted((r.member, r.problem) for r in archives.problems(files).collect()) == [("release/code/test/m2/r.json", "identity"), ("release/math/test/m0/r.json", "counts"), ("release/math/test/m0/r.json", "repeated")]
    assert archives.inventory(members).where("pinned").count() == 0


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    rows = ['{"k": %d}' % i for i in range(500)]
    for bad, text in ((7, "{"), (123, "[1]"), (300, "plain"), (499, '{"k": "x"}')):
        rows[bad] = text
    rows[50] = "  "
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n")
    (tmp_path / "b.jsonl").write_text('{"k": 1}\nbroken\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = readers.jsonl_problems(spark, str(tmp_path), "k int").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((os.path.basename(r.file), r.line, r.value) for r in found) == [("a.jsonl", 8, "{"), ("a.jsonl", 124, "[1]"), ("a.jsonl", 301, "plain"), ("a.jsonl", 500, '{"k": "x"}'), ("b.jsonl", 2, "broken")]


def test_settings(spark, tmp_path):
    good = dict(name="good", standard_fractions=[0.7, 0.15, 0.15], ood_validation_fraction=0.15, models=list("abcde"), ood_held_out_datasets=["x"])
    bad = dict(name="bad", standard_fractions=[0.7, 0.5, -0.2], ood_validation_fraction=1.0, models=list("abcda"))
    (tmp_path / "c.json").write_text(json.dumps(good) + "\n" + json.dumps(bad))
    assert sorted(tuple(r) for r in readers.config_problems(readers.read_configs(spark, str(tmp_path / "c.json"))).collect()) == [("bad", p) for p in ("fractions", "holdout", "models", "validation")]


def test_written_archives(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i % 3}", f"m/{i:03d}", "é" * i) for i in range(40)], "archive string, member string, body string")
    written = {(r.archive, r.member): (r.bytes, r.sha256) for r in archives.write(rows, str(tmp_path / "out")).collect()}
    got = {(os.path.basename(r.archive)[:2], r.member): (r.bytes, r.sha256) for r in readers.read_archive(spark, str(tmp_path / "out")).where(F.col("member") >= "").collect()}
    assert got == written and len(got) == 40 and not [f for f in os.listdir(tmp_path / "out") if f.endswith(".part")]
