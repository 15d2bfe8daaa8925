"""Policy candidates as columns of one action matrix, and simultaneous bootstrap bounds over all of them by blocked matrix products.

A prompt is a row of small arrays (probabilities by family and model, training costs, outcomes), and its actions under every
candidate are one array of bytes: a candidate is never a row of its own. Candidates that act alike everywhere are found by two
64-bit xors of hashed (prompt, action) for each of them, and only different ones go on.

Groups of a stratum are numbered and cut into blocks of GROUPS. A block's outcomes, summed by group, are a tile (groups x
candidates); the draws of REPLICATES replicates that fall into the block are another (replicates x groups), made from the
same digests as `uncertainty.multiplicities` but packed, never rows. Their product is added up in the task over
all blocks of a stratum that it holds, so what is shuffled after it has the size of replicates x candidates for each stratum and
task, however many groups there are; before it each draw moves once, as about a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold.operators import routing, scan
from pathfold.operators.uncertainty import numbered
from pathfold.sources.storage import freeze

#: Groups of a tile, replicates of a tile (their product is below 2 ** 16), draws of a replicate that one row asks for.
GROUPS, REPLICATES, DRAWS = 1024, 50, 1 << 16
#: Groups whose sums a task holds before it passes them on.
HELD = 512
#: Rows of an Arrow batch where a row has a byte (or a number) for each candidate, and where it has REPLICATES numbers for each.
WIDE, WIDEST = 512, 32


@dataclass(frozen=True)
class Candidate:
    candidate_id: str
    family: int
    kind: str
    value: float
    gate: float
    anchor: int  # position of the model that answers where a gate is shut or no other is better


def candidate_list(anchors: int) -> list[Candidate]:
    """For each anchor all rules of all families behind all gates, then the anchor itself."""
    out = []
    for anchor in range(anchors):
        for name, family, kind, value, gate in routing.candidate_grid():
            out.append(Candidate(name, routing.FAMILIES.index(family), kind, value, gate, anchor))
        out.append(Candidate("best_single", -1, "static", 0.0, 0.0, anchor))
    return out


def actions(p: np.ndarray, costs: np.ndarray, similarity: np.ndarray, cuts: dict[float, float], listed: list[Candidate]) -> np.ndarray:
    """(prompts x candidates) positions of the chosen models; p is prompts x families x models, in the order of the models' ids."""
    n, _, models = p.shape
    ids, c = np.broadcast_to(np.arange(models), (n, models)), np.broadcast_to(costs, (n, models))
    first = lambda *keys: np.lexsort(keys[::-1], axis=1)[:, 0]  # noqa: E731  least by the first key, then the next
    rules: dict[tuple, np.ndarray] = {}

    def rule(x: Candidate) -> np.ndarray:
        own = (x.family, x.kind, x.value, x.anchor if x.kind == "advantage" else None)
        if own not in rules:
            q = p[:, x.family]
            if x.kind == "threshold":
                good = q >= x.value
                rules[own] = np.where(good.any(axis=1), first(~good, c, -q, ids), first(-q, c, ids))
            elif x.kind == "utility":
                rules[own] = first(-(q - x.value * c / costs.max()), c, ids)
            else:
                good = (costs < costs[x.anchor])[None, :] & (q >= q[:, x.anchor, None] + x.value)
                rules[own] = np.where(good.any(axis=1), first(~good, c, -q, ids), x.anchor)
        return rules[own]

    out = np.empty((n, len(listed)), dtype=np.int8)
    for k, x in enumerate(listed):
        chosen = np.int64(x.anchor) if x.kind == "static" else rule(x)
        out[:, k] = np.where(similarity < cuts[x.gate], x.anchor, chosen) if x.gate else chosen
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside: rows are wide here, and a batch is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = int(before)
    spark.conf.set(name, str(min(rows, most) if most > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _flat(batch, column: str, kind) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(kind)


def decided(prompts: DataFrame, costs: list[float], cuts: dict[float, float], listed: list[Candidate]) -> DataFrame:
    """prompts(prompt_id, stratum, text_group, similarity, p: families * models, y, micro: models) with `act`, a byte for each candidate."""
    models = len(costs)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            p = _flat(batch, "p", float).reshape(batch.num_rows, -1, models)
            made = actions(p, np.array(costs), batch.column("similarity").to_numpy(zero_copy_only=False).astype(float), cuts, listed)
            keep = ["prompt_id", "stratum", "text_group", "similarity", "y", "micro"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([r.tobytes() for r in made], pa.binary())], names=[*keep, "act"])

    schema = "prompt_id string, stratum string, text_group string, similarity double, y array<double>, micro array<bigint>, act binary"
    return prompts.select("prompt_id", "stratum", "text_group", "similarity", "p", "y", "micro").mapInArrow(run, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def distinct_candidates(rows: DataFrame, count: int) -> np.ndarray:
    """For each candidate the first one that acts alike on every prompt. One pair of numbers for each candidate and task is
    shuffled, and one for each candidate is collected: their number is the grid's, not the data's."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = np.zeros((2, count), dtype=np.uint64)
        for batch in batches:
            act = np.stack([np.frombuffer(x, dtype=np.uint8) for x in batch.column(1).to_pylist()]) if batch.num_rows else np.empty((0, count), dtype=np.uint8)
            for i, h in enumerate(batch.columns[2:]):
                own = _mixed(h.to_numpy().view(np.uint64)[:, None] ^ (act.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                seen[i] ^= np.bitwise_xor.reduce(own, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count), pa.int32()), *[pa.array(s.view(np.int64).copy()) for s in seen]], names=["k", "x", "y"])

    hashed = rows.select("prompt_id", "act", F.xxhash64("prompt_id").alias("h0"), F.xxhash64("prompt_id", F.lit(1)).alias("h1"))
    with batches_of(rows.sparkSession, WIDE):
        sums = hashed.mapInArrow(run, "k int, x long, y long").groupBy("k").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).orderBy("k").collect()
    first: dict[tuple, int] = {}
    return np.array([first.setdefault((r.x, r.y), r.k) for r in sums], dtype=np.int64)


def group_tiles(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(stratum, text_group, sums): for each group its prompts, their successes and their costs under each chosen candidate, as packed
    64-bit numbers. Rows of a group are added where they are read."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys, sums = list(held), [x.tobytes() for x in held.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(sums, pa.binary())], names=["stratum", "text_group", "sums"])

        for batch in batches:
            for stratum, group, y, micro, act in zip(*[batch.column(c).to_pylist() for c in ("stratum", "text_group", "y", "micro", "act")], strict=True):
                at = np.frombuffer(act, dtype=np.int8)[chosen]
                row = np.concatenate(([1], np.array(y, dtype=np.int64)[at], np.array(micro, dtype=np.int64)[at]))
                if (stratum, group) in held:
                    held[stratum, group] += row
                else:
                    if len(held) >= HELD:
                        yield out()
                    held[stratum, group] = row
        if held:
            yield out()

    return rows.mapInArrow(run, "stratum string, text_group string, sums binary")


def _draws(strata: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(stratum, block, part, keys): for REPLICATES replicates the groups of a block that they draw, as sorted numbers replicate *
    GROUPS + group. Draw k of a replicate takes group sha256(seed:replicate:stratum:k) mod groups."""
    parts = -(-replicates // REPLICATES)
    asks = strata.select("stratum", "groups", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asks = asks.select("stratum", "groups", "part", F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / DRAWS).cast("int"))).alias("range"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for stratum, groups, part, number in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ks = range(number * DRAWS, min((number + 1) * DRAWS, groups))
                found = []
                for i, replicate in enumerate(range(part * REPLICATES, min((part + 1) * REPLICATES, replicates))):
                    begin = hashlib.sha256(f"{seed}:{replicate}:{stratum}:".encode())
                    digests = bytearray()
                    for k in ks:
                        h = begin.copy()
                        h.update(str(k).encode())
                        digests += h.digest()[:4]
                    g = np.frombuffer(bytes(digests), dtype=">u4").astype(np.int64) % groups
                    found.append((g // GROUPS << 16) | (i * GROUPS + g % GROUPS))
                keys = np.sort(np.concatenate(found))
                cut = np.flatnonzero(np.diff(keys >> 16, prepend=-1))
                stop = np.append(cut[1:], len(keys))
                blocks = (keys[cut] >> 16).astype(np.int64)
                packed = [(keys[a:b] & 0xFFFF).astype("<u2").tobytes() for a, b in zip(cut.tolist(), stop.tolist(), strict=True)]
                n = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([stratum] * n, pa.string()), pa.array(blocks), pa.array([part] * n, pa.int32()), pa.array(packed, pa.binary())], names=["stratum", "block", "part", "keys"])

    return asks.repartition("stratum", "part", "range").mapInArrow(run, "stratum string, block long, part int, keys binary")


def _products(tiles: DataFrame, draws: DataFrame, width: int) -> DataFrame:
    """(part, stratum, sums): replicates x (1 + candidates) sums of prompts and successes; part -1 has one row, that of every group once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stratum, block, tile, sums = None, None, np.zeros((GROUPS, width)), {}

        def out() -> pa.RecordBatch:
            parts, packed = list(sums), [x.tobytes() for x in sums.values()]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([stratum] * len(parts), pa.string()), pa.array(packed, pa.binary())], names=["part", "stratum", "sums"])

        for batch in batches:
            for own, own_block, part, g, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != stratum:
                    if sums:
                        yield out()
                    stratum, block, sums = own, None, {}
                if own_block != block:
                    block = own_block
                    tile[:] = 0
                if part < 0:  # the groups of a block come before its draws
                    row = np.frombuffer(data, dtype=np.int64)[:width]
                    tile[g % GROUPS] += row
                    sums[-1] = sums.get(-1, 0) + row.astype(float)[None, :]
                    continue
                many = np.bincount(np.frombuffer(data, dtype="<u2"), minlength=REPLICATES * GROUPS).reshape(REPLICATES, GROUPS)
                sums[part] = sums.get(part, 0) + many.astype(float) @ tile
        if sums:
            yield out()

    none = F.lit(None)
    left = tiles.select("stratum", F.floor(F.col("g") / GROUPS).cast("long").alias("block"), F.lit(-1).alias("part"), F.col("g").cast("long").alias("g"), F.col("sums").alias("data"))
    both = left.unionByName(draws.select("stratum", "block", "part", none.cast("long").alias("g"), F.col("keys").alias("data")))
    return both.repartition("stratum", "block").sortWithinPartitions("stratum", "block", "part").mapInArrow(run, "part int, stratum string, sums binary")


def _means(products: DataFrame, width: int) -> DataFrame:
    """(part, means): [micro, macro] x replicates x candidates, from the strata's sums, one stratum at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, part_sums, micro, macro, strata = (None, None), None, None, None, 0

        def close_stratum():
            nonlocal part_sums, micro, macro, strata
            if part_sums is not None:
                means = np.divide(part_sums[:, 1:], part_sums[:, :1], out=np.zeros_like(part_sums[:, 1:]), where=part_sums[:, :1] > 0)
                micro, macro, strata = (part_sums, means, 1) if micro is None else (micro + part_sums, macro + means, strata + 1)
            part_sums = None

        def out() -> pa.RecordBatch:
            whole = np.divide(micro[:, 1:], micro[:, :1], out=np.zeros_like(micro[:, 1:]), where=micro[:, :1] > 0)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([np.stack([whole, macro / strata]).tobytes()], pa.binary())], names=["part", "means"])

        for batch in batches:
            for part, stratum, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (part, stratum) != key:
                    close_stratum()
                    if part != key[0] and key[0] is not None:
                        yield out()
                        micro = macro = None
                    key = (part, stratum)
                add = np.frombuffer(data, dtype=float).reshape(-1, width)
                part_sums = add if part_sums is None else part_sums + add
        close_stratum()
        if micro is not None:
            yield out()

    return products.repartition("part").sortWithinPartitions("part", "stratum").mapInArrow(run, "part int, means binary")


def simultaneous(rows: DataFrame, chosen: np.ndarray, statics: np.ndarray, replicates: int, seed: int, least_error: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Bounds of every chosen candidate against every one of `statics` (places in chosen), and the sums of groups. The first has (k, other,
    metric, delta, standard_error, lower): k and other are places in chosen, metric is '__micro__' or '__macro__', and lower
    lies the 95 % quantile of the largest deviation over all of them below delta."""
    spark, width = rows.sparkSession, 1 + len(chosen)
    with batches_of(spark, WIDE):
        sums = freeze(group_tiles(rows, chosen), "group-tiles")
    tiles = freeze(numbered(sums), "tiles")
    strata = tiles.groupBy("stratum").agg((F.max("g") + 1).alias("groups"))
    with batches_of(spark, WIDE):
        products = freeze(_products(tiles, _draws(strata, replicates, seed), width), "products")
    with batches_of(spark, WIDEST):
        means = freeze(_means(products, width), "replicate-means")
    seen = means.where("part = -1").first()
    if seen is None:
        none = "k int, other int, metric string, delta double, standard_error double, lower double"
        return spark.createDataFrame([], none), tiles
    observed = np.frombuffer(seen.means, dtype=float).reshape(2, len(chosen))  # a number for each candidate
    delta = observed[:, :, None] - observed[:, None, statics]
    metrics = ("__micro__", "__macro__")

    def replicated(part: int, data: bytes) -> np.ndarray:
        own = np.frombuffer(data, dtype=float).reshape(2, -1, len(chosen))
        return own[:, : min(REPLICATES, replicates - part * REPLICATES)]

    def deviations(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = replicated(part, data)
                for m, metric in enumerate(metrics):
                    for j, s in enumerate(statics.tolist()):
                        d = own[m] - own[m][:, s, None] - delta[m, :, j]
                        n = len(chosen)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, s), pa.int32()), pa.array([metric] * n), pa.array(d.sum(axis=0)), pa.array((d * d).sum(axis=0)), pa.array(delta[m, :, j].copy())], names=["k", "other", "metric", "s", "ss", "delta"])

    drawn = means.where("part >= 0").repartition("part")
    parts = drawn.mapInArrow(deviations, "k int, other int, metric string, s double, ss double, delta double")
    variance = (F.sum("ss") - F.sum("s") * F.sum("s") / replicates) / (replicates - 1)
    errors = freeze(parts.groupBy("k", "other", "metric").agg(F.first("delta").alias("delta"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("standard_error")), "errors")
    table = errors.toArrow()  # candidates * statics * 2 rows
    scale = np.zeros((2, len(chosen), len(statics)))
    place = {s: j for j, s in enumerate(statics.tolist())}
    at = [np.array([metrics.index(m) for m in table.column("metric").to_pylist()]), table.column("k").to_numpy(), np.array([place[s] for s in table.column("other").to_pylist()])]
    scale[tuple(at)] = table.column("standard_error").to_numpy()

    def largest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = replicated(part, data)
                top = np.zeros(own.shape[1])
                for m in range(2):
                    for j, s in enumerate(statics.tolist()):
                        ok = scale[m, :, j] > least_error
                        if ok.any():
                            t = (own[m][:, ok] - own[m][:, s, None] - delta[m, ok, j]) / scale[m, ok, j]
                            top = np.maximum(top, t.max(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(top)], names=["t"])

    critical = scan.quantiles(drawn.mapInArrow(largest, "t double"), [], "t", (0.95,)).select(F.col("q")[0].alias("critical"))
    bounds = errors.crossJoin(F.broadcast(critical))  # one row
    return bounds.withColumn("lower", F.col("delta") - F.col("critical") * F.col("standard_error")).drop("critical"), tiles


def totals(tiles: DataFrame, width: int) -> DataFrame:
    """(stratum, k, n, y, micro): each chosen candidate's prompts, successes and costs in each stratum."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for stratum, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sums[stratum] = sums.get(stratum, 0) + np.frombuffer(data, dtype=np.int64)
        for stratum, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([stratum] * width, pa.string()), pa.array(np.arange(width), pa.int32()), pa.array(np.full(width, x[0])), pa.array(x[1 : 1 + width].copy()), pa.array(x[1 + width :].copy())], names=["stratum", "k", "n", "y", "micro"])

    parts = tiles.select("stratum", "sums").mapInArrow(run, "stratum string, k int, n long, y long, micro long")
    return parts.groupBy("stratum", "k").agg(*[F.sum(c).alias(c) for c in ("n", "y", "micro")])
