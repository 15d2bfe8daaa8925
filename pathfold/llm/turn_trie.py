"""The prefix trie of conversations, with subtree sums by heavy-path decomposition.

1.  Turns are numbered within their conversation, and every prefix is named by 128 bits: the xor of a hash for each (place,
    role, text). So prefixes are running totals (operators.scan), texts never move, and a conversation may have any
    number of turns.
2.  A conversation may take its first turns from another one (`Heads`): its prefixes are the other's up to there, and its own
    running totals from there on, with the xor of both heads added. Own turns may move to earlier places by as many as
    are missing there, so a running total is kept for every shift.
3.  Prefixes are grouped into nodes, with partial sums before the shuffle. A node's largest child (most members; of several
    the one with the smallest member) is heavy, the others are light. A light child has at most half of its parent's
    members, so a leaf has at most log2(conversations) light nodes above it.
4.  Each leaf is the end of one heavy path, which begins at the leaf's deepest light ancestor. The leaf's own rows below that
    are the path: nodes learn their path without any chasing of pointers.
5.  Rounds from the paths with the most light nodes above them to the root's: a path is an array of its nodes' values in blocks
    of CHUNK places, summed from its end; what the top of a path holds is added to the node that it hangs from, one
    round later. Every node is summed once, and there are log2(conversations) + 1 rounds at most.

Defined results: turns go by number, null first; equal numbers by the SHA-256 of role and text; null roles and texts are
empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation; without conversations there is
no node, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfold.llm.common import WORD, dealt_join, discard, materialize
from pathfold.operators import scan

#: Places of a path array.
CHUNK = 512
#: Ids that are joined to one text before they go to the hash.
IDS = 4096
_ROOT = {"a": 0, "b": 0}


@dataclass(frozen=True)
class Heads:
    """Conversation c begins with the first `turns(c)` (at most `most`) original turns of conversation `of(c)`, which replace its
    own first `turns(c)`."""

    of: object
    turns: object
    most: int


#: Every conversation as it is.
ORIGINAL = Heads(lambda c: c, lambda c: F.lit(0), 0)


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _keyed(place: Column, key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), place, key) for seed in (0x51, 0xA7)]


def numbered(turns: DataFrame, shifts: int = 0) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, r (place from 1), words, key, and xa0, xb0, ..: the name of the prefix up to here
    if its turns stood s places earlier."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.unhex(F.substring(key, 1, 32)).alias("key"), _word_count(text).alias("words"))
    ranked = materialize(scan.running(rows, ["conv_id"], [F.col("turn"), F.col("key")], {"r": ("sum", F.lit(1))}), "turns-numbered")
    totals = {}
    for s in range(shifts + 1):
        a, b = _keyed(F.col("r") - s, F.col("key"))
        totals |= {f"xa{s}": ("xor", F.when(F.col("r") > s, a).otherwise(F.lit(0))), f"xb{s}": ("xor", F.when(F.col("r") > s, b).otherwise(F.lit(0)))}
    out = materialize(scan.running(ranked, ["conv_id"], [F.col("r")], totals), "turns-named")
    discard(ranked)
    return out


def rebuilt(turns: DataFrame, heads: Heads = ORIGINAL) -> tuple[DataFrame, DataFrame]:
    """(places, ends): places(conv_id, d, a, b, pa, pb, words) names each prefix of each rebuilt conversation and the prefix before it;
    ends(conv_id, a, b, d) the whole of it, for every conversation."""
    rows = numbered(turns, heads.most)
    sizes = rows.groupBy("conv_id").agg(F.max("r").alias("size"))
    first = rows.where(F.col("r") <= max(heads.most, 1)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("r", *[c for c in rows.columns if c.startswith("x")], "words"))).alias("first"))
    known = materialize(sizes.join(first, "conv_id"), "conversations")
    base = known.select(F.col("conv_id").alias("of"), F.col("first").alias("base"))
    convs = known.withColumn("h", heads.turns(F.col("conv_id")).cast("int")).withColumn("of", heads.of(F.col("conv_id")).cast("long"))
    convs = convs.join(base, "of", "left").withColumn("base", F.when(F.col("h") > 0, F.expr("slice(coalesce(base, array()), 1, h)")).otherwise(F.expr("slice(first, 1, 0)")))
    at = lambda arr, i, c: F.coalesce(F.get(arr, i - 1)[c], F.lit(0))  # noqa: E731  nothing before the first turn
    nb = F.size("base")
    shift = F.col("h") - nb
    # What turns the name of an own prefix into that of the rebuilt one: its own head out, the other's in.
    own_head = lambda side: F.coalesce(*[F.when(shift == s, at(F.col("first"), F.least(F.col("h"), F.col("size")), f"x{side}{s}")) for s in range(heads.most + 1)])
    masks = [own_head(side).bitwiseXOR(at(F.col("base"), nb, f"x{side}0")).alias(f"m{side}") for side in "ab"]
    convs = materialize(convs.select("conv_id", "size", "h", nb.alias("nb"), shift.alias("shift"), *masks, "base"), "conversations-rebuilt")
    before = lambda side: F.expr(f"coalesce(get(base, i - 1).x{side}0, 0L)")
    head = convs.select("conv_id", "base", F.posexplode("base").alias("i", "it")).select("conv_id", (F.col("i") + 1).cast("long").alias("d"), F.col("it.xa0").alias("a"), F.col("it.xb0").alias("b"), before("a").alias("pa"), before("b").alias("pb"), F.col("it.words").alias("words"))
    side = convs.where(F.col("size") > F.col("h")).select("conv_id", F.col("size").alias("many"), "h", "shift", "ma", "mb")
    own = dealt_join(rows, side, ["conv_id"], F.col("r")).where(F.col("r") > F.col("h"))
    name = [F.coalesce(*[F.when(F.col("shift") == s, F.col(f"x{c}{s}")) for s in range(heads.most + 1)]).bitwiseXOR(F.col(f"m{c}")) for c in "ab"]
    d = F.col("r") - F.col("shift")
    step = _keyed(d, F.col("key"))
    own = own.select("conv_id", d.cast("long").alias("d"), name[0].alias("a"), name[1].alias("b"), name[0].bitwiseXOR(step[0]).alias("pa"), name[1].bitwiseXOR(step[1]).alias("pb"), "words")
    places = materialize(head.unionByName(own), "places")
    ended = convs.select("conv_id", (F.col("nb") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).cast("long").alias("d"))
    whole = places.join(ended.where("d > 0"), ["conv_id", "d"]).select("conv_id", "d", "a", "b")
    ends = whole.unionByName(ended.where("d = 0").select("conv_id", "d", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    ends = materialize(ends, "ends")
    discard(rows, known, convs)
    return places, ends


def node_table(places: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each node: its name (a, b), its parent's, depth, conv_id (smallest member), n_convs and words of its last text."""
    nodes = places.groupBy("a", "b").agg(F.first("d").alias("depth"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("depth"), none.alias("pa"), none.alias("pb"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    return nodes.unionByName(root)


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, parent_conv_id and `light`: not the largest child of its parent (false for the root)."""
    children = nodes.where(F.col("pa").isNotNull()).groupBy("pa", "pb").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("minus"), "a", "b")).alias("heavy"))
    both = materialize(nodes.join(children.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children", "heavy"), ["a", "b"], "left"), "nodes-children")
    # A node may have any number of children, so they are dealt over tasks.
    side = both.where(F.col("n_children") > 0).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("n_children").alias("many"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy.a").alias("ha"), F.col("heavy.b").alias("hb"))
    joined = dealt_join(both.where(F.col("pa").isNotNull()).drop("heavy"), side, ["pa", "pb"], F.col("a"))
    light = (F.col("a") != F.col("ha")) | (F.col("b") != F.col("hb"))
    found = joined.withColumn("light", light).drop("ha", "hb")
    root = both.where(F.col("pa").isNull()).drop("heavy").withColumns({"parent_conv_id": F.lit(None).cast("long"), "light": F.lit(False)})
    return materialize(found.unionByName(root).fillna(0, ["n_children"]), "nodes")


def paths(places: DataFrame, ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each node: (path, d, top, level, a, b, pa, pb): the heavy path's leaf by its smallest member, the depth of the
    path's top and the number of light nodes from the root down to it."""
    leaves = nodes.where("n_children = 0").select("a", "b", "conv_id", "depth")
    reps = ends.join(leaves.select("a", "b", "conv_id"), ["a", "b", "conv_id"], "left_semi").select("conv_id", F.col("d").alias("size"))
    # Rows of the leaves' own conversations, a leaf each; a light node may have many of them below it.
    own = materialize(dealt_join(places, reps.withColumn("many", F.col("size")), ["conv_id"], F.col("d")).drop("size"), "leaf-places")
    light = nodes.where("light").select("a", "b", F.col("n_convs").alias("many"))
    above = dealt_join(own.select("conv_id", "d", "a", "b"), light, ["a", "b"], F.col("conv_id"))
    tops = above.groupBy("conv_id").agg(F.max("d").alias("top"), F.count("*").alias("level"))
    tops = materialize(reps.join(tops, "conv_id", "left").fillna(0, ["top", "level"]), "path-tops")
    side = tops.withColumn("many", F.col("size")).drop("size")
    found = dealt_join(own, side, ["conv_id"], F.col("d")).where(F.col("d") >= F.col("top"))
    found = found.select(F.col("conv_id").alias("path"), "d", "top", "level", "a", "b", "pa", "pb")
    none = F.lit(None).cast("long")
    root = tops.where("level = 0").select(F.col("conv_id").alias("path"), F.lit(0).cast("long").alias("d"), "top", "level", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.alias("pa"), none.alias("pb"))
    out = materialize(found.unionByName(root), "paths")
    discard(own, tops)
    return out


def _suffix_sums(arrays: DataFrame, values: list[str]) -> DataFrame:
    """arrays(path, chunk, and lists `d`, values...) with each list of values summed from its end, and total_<value>."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for v in values:
                lists = columns[v]
                offsets = lists.offsets.to_numpy()
                flat = np.concatenate(([0], np.cumsum(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])))
                offsets = offsets - offsets[0]
                sums = np.repeat(flat[offsets[1:]], np.diff(offsets)) - flat[:-1]
                columns[v] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums, pa.int64()))
                columns[f"total_{v}"] = pa.array(flat[offsets[1:]] - flat[offsets[:-1]], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    rest = [f for f in arrays.schema.fields if f.name not in values]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rest])
    ordered = arrays.select(*[f.name for f in rest], *values)
    return ordered.mapInArrow(run, schema + "".join(f", {v} array<long>" for v in values) + "".join(f", total_{v} long" for v in values))


def subtree_sums(members: DataFrame, values: list[str]) -> DataFrame:
    """members(path, d, top, level, a, b, pa, pb, values...: long) -> (a, b, values...), summed over each node's subtree."""
    from pyspark.sql import Window

    levels = members.agg(F.max("level")).first()[0]
    done, hanging = [], None
    if levels is None:
        return members.select("a", "b", *values)
    for level in range(levels, -1, -1):
        rows = members.where(F.col("level") == level)
        if hanging is not None:
            rows = rows.join(hanging, ["a", "b"], "left").withColumns({v: F.col(v) + F.coalesce(F.col(f"more_{v}"), F.lit(0)) for v in values}).drop(*[f"more_{v}" for v in values])
        held = rows.groupBy("path", "top", F.floor(F.col("d") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("d", "a", "b", "pa", "pb", *values))).alias("it"))
        sums = _suffix_sums(held.select("path", "top", "chunk", *[F.col(f"it.{c}").alias(c) for c in ("d", "a", "b", "pa", "pb", *values)]), values)
        sums = materialize(sums, "path-arrays")
        below = Window.partitionBy("path").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
        later = sums.select("path", "chunk", *[F.coalesce(F.sum(f"total_{v}").over(below), F.lit(0)).alias(f"later_{v}") for v in values])  # a row for each block
        entry = F.explode(F.arrays_zip("d", "a", "b", "pa", "pb", *values)).alias("it")
        each = sums.join(later, ["path", "chunk"]).select("top", *[f"later_{v}" for v in values], entry)
        each = each.select("top", "it.d", "it.a", "it.b", "it.pa", "it.pb", *[(F.col(f"it.{v}") + F.col(f"later_{v}")).alias(v) for v in values])
        each = materialize(each, f"path-sums-{level}")
        discard(sums)
        done.append(each.select("a", "b", *values))
        hanging = each.where(F.col("d") == F.col("top")).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def end_hashes(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the conversations that end at a node. Ids are numbered within their node and joined in pieces of
    IDS; the pieces of a node pass through one hash in order, one at a time, as a hash has to."""
    ranked = scan.running(ends.select("a", "b", "conv_id"), ["a", "b"], [F.col("conv_id")], {"k": ("sum", F.lit(1))})
    pieces = ranked.groupBy("a", "b", F.floor((F.col("k") - 1) / IDS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, b) != name:
                    if name is not None:
                        out.append((*name, digest.hexdigest()))
                    name, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["a", "b", "ends_sha256"])

    ordered = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece").select("a", "b", "ids")
    return ordered.mapInArrow(run, "a long, b long, ends_sha256 string")


def trie(turns: DataFrame, heads: Heads = ORIGINAL) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Nodes at the
    same depth have different smallest members, so (conv_id, depth) is a key."""
    places, ends = rebuilt(turns, heads)
    nodes = with_parents(materialize(node_table(places, ends), "trie-nodes"))
    members = paths(places, ends, nodes)
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    valued = members.join(nodes.select("a", "b", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved), ["a", "b"])
    sums = subtree_sums(materialize(valued, "path-members"), ["n_leaves", "saved_tokens"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(sums, ["a", "b"]).join(end_hashes(ends), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
