"""The conversation trie against a plain version: shared heads, missing and short bases, ties, nulls, repeats, long and hot conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pathfold.llm import queries, turn_trie

SCHEMA = "conv_id long, turn long, role string, text string"
HEADS = turn_trie.Heads(lambda c: c - c % 20, lambda c: F.crc32(c.cast("string")) % 4, 3)


def plain(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 if heads else 0 for c in own}
    whole = {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += gain
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if tuple(whole[c]) == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def check(spark, rows, heads=True):
    got = turn_trie.trie(spark.createDataFrame(rows, SCHEMA), HEADS if heads else turn_trie.ORIGINAL)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect())) == plain(rows, heads)


def test_shared_heads(spark):
    r = random.Random(1)
    rows = []
    for c in [*range(45), 63, 64, 65, 81, 82, 83, 84, 85, 86]:  # 60 and 80 are absent
        for t in range(r.choice([1, 1, 2, 3, 5, 7]) if c not in (20,) else 1):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "d e f"])))
    rows += [(0, 0, "user", "c")] * 2 + [(3, None, None, None), (3, None, "", "x"), (4, 1, "user", ""), (None, 1, "user", "lost"), (7, 1, "user", "é日 \U0001f600")]
    r.shuffle(rows)
    check(spark, rows)


def test_original_conversations(spark):
    r = random.Random(2)
    rows = [(c, t, "u", f"w{r.randrange(2)} x") for c in range(120) for t in range(r.randrange(1, 9))]
    rows += [(c, 0, "u", "only") for c in range(200, 260)]  # a group of copies
    rows += [(c, t, "u", f"only {c}" if t else "only") for c in range(300, 340) for t in range(3)]  # many children of one node
    check(spark, rows, heads=False)


def test_paths_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "CHUNK", 4)
    monkeypatch.setattr(turn_trie, "IDS", 3)
    rows = [(c, t, "u", f"t{t}" if t < 30 - c else f"own {c} {t}") for c in range(12) for t in range(31 + c)] + [(c, 0, "u", "same") for c in range(20, 31)]
    check(spark, rows)
    check(spark, rows, heads=False)


def test_rounds_are_logarithmic(spark):
    """A caterpillar: every node of a long path has a light child, which hangs from the one path."""
    rows = [(c, t, "u", f"t{t}" if t < c else f"own {c}") for c in range(64) for t in range(c + 1)]
    places, ends = turn_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    nodes = turn_trie.with_parents(turn_trie.node_table(places, ends))
    found = turn_trie.paths(places, ends, nodes)
    assert found.agg(F.max("level")).first()[0] <= 6 and found.count() == nodes.count() == found.select("a", "b").distinct().count()
    check(spark, rows, heads=False)


def test_empty_and_extra_columns(spark):
    assert turn_trie.trie(spark.createDataFrame([], SCHEMA), HEADS).collect() == []
    rows = [(c, t, "u", "x y") for c in range(3) for t in range(2)]
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("r", "key", "words", "a", "b", "many", "row", "part", "tie", "d")})
    assert sorted(map(tuple, turn_trie.trie(extra, HEADS).collect())) == plain(rows)
    assert sorted(map(tuple, turn_trie.trie(spark.createDataFrame([(21, 0, "u", "x")], SCHEMA), HEADS).collect())) == plain([(21, 0, "u", "x")])


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_turn_trie"](spark, sf).collect())) == plain(rows)
