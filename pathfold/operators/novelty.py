"""The novelty gate: largest cosine of unit vectors to a reference set, through an exact metric index.

A bounded number of references are pivots, and every reference belongs to the cell of its nearest pivot, whose radius is the
largest angle to a member. By the triangle inequality of angles no member of a cell can be nearer to an asker than
its angle to the pivot less the radius. Askers are compared first with the cell whose bound is best. Cells near each other form zones of at
most `block` vectors, and an asker goes once to each zone with a cell whose bound exceeds what it has found; there it meets the cells one by one,
each only while its bound exceeds the best so far. So the answer is that of all pairs, and an asker moves at most as often as there are
zones, not cells. A zone's askers are cut into blocks as well. Tasks look at a few rows at once: no matrix has more than SLICE numbers,
whatever the number of pivots and the size of batches.

Defined results: equal vectors of one label are one reference; a vector without length has the similarity 0 to all;
without any reference (of another label, with other_groups) the similarity is null; a null label is nobody's own; a similarity above
1.0001 means vectors that are not of unit length and is an error; without askers there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.operators import scan
from pathfold.sources.storage import freeze

#: Bytes of the vectors of a zone, and of the askers that it meets at once; numbers of a matrix at most.
ZONE_BYTES, SLICE = 16 << 20, 1 << 20
#: References that a cell should have, and pivots at most.
CELL, MOST_PIVOTS = 256, 2048
#: Bounds are right to about 1e-8, as angles near 0 are.
SLACK = 1e-7
_ASK = "vec_id long, embedding array<double>, label long"


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sims = x @ pivots.T
    if sims.size and sims.max() > 1.0001:
        raise ValueError("vectors are not of unit length")
    return np.arccos(np.clip(sims, -1, 1))


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows whose matrices of `width` columns have SLICE numbers at most."""
    step = max(1, SLICE // max(1, width))
    return (slice(i, i + step) for i in range(0, rows, step))


def _bounds(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x cells): the largest cosine that a member of a cell can have, cos(angle - radius) or 1 within, and the cosine to the pivot."""
    sims = x @ pivots.T
    if sims.size and sims.max() > 1.0001:
        raise ValueError("vectors are not of unit length")
    near = np.clip(sims, -1, 1)
    far = near * np.cos(radius) + np.sqrt(1 - near * near) * np.sin(radius)
    return np.where((near >= np.cos(radius)) | (radius >= np.pi), 1.0, far), near


def _zones(pivots: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The zone of each cell: cells are halved across the direction in which their pivots spread most until none has more than `most`
    members, or it is one cell."""
    zone, stack, n = np.zeros(len(sizes), dtype=np.int64), [np.arange(len(sizes))], 0
    while stack:
        own = stack.pop()
        if len(own) == 1 or sizes[own].sum() <= most:
            zone[own], n = n, n + 1
            continue
        centred = pivots[own] - pivots[own].mean(axis=0)
        own = own[np.argsort(centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1], kind="stable")]
        half = np.clip(np.searchsorted(np.cumsum(sizes[own]), sizes[own].sum() / 2, "right"), 1, len(own) - 1)
        stack += [own[:half], own[half:]]
    return zone


class Index:
    """Cells of a reference set refs(vec_id, embedding, label); `visited` counts the pairs that were compared."""

    def __init__(self, refs: DataFrame, block: int | None = None, cell: int = CELL):
        self.visited = 0
        vectors = refs.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
        same = [F.xxhash64("embedding").alias("h0"), F.xxhash64("embedding", F.lit(1)).alias("h1"), "label"]
        once = freeze(vectors.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.first("embedding").alias("embedding")).select("vec_id", "embedding", "label"), "references")
        self.count = once.count()
        one = once.select(F.size("embedding").alias("n")).first()
        self.block = block or max(256, ZONE_BYTES // (8 * max(1, one.n if one else 1)))
        n = min(MOST_PIVOTS, max(1, self.count // cell))
        if n == 1:  # one cell, whose bound leaves nothing out
            self.pivots, self.cells = np.empty((0, 0)), once.select(F.lit(0).alias("cell"), "vec_id", "embedding", "label")
            self.names, self.radius, self.sizes = np.array([0][: self.count]), np.array([np.pi][: self.count]), np.array([self.count][: self.count])
            return
        long = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x) > 0.25  # vectors without length are no directions
        chosen = [r.embedding for r in once.where(long).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("embedding").collect()]
        pivots = np.array(chosen, dtype=float)

        def assign(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                x = _matrix(batch.column(1))
                place, angle = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.pi)
                if len(pivots):
                    for own in _slices(len(x), len(pivots)):
                        angles = _angles(x[own], pivots)
                        place[own], angle[own] = angles.argmin(axis=1), angles.min(axis=1)
                    angle[(x * x).sum(axis=1) <= 0.25] = np.pi  # such a member is in reach of everyone
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(angle), *batch.columns], names=["cell", "angle", "vec_id", "embedding", "label"])

        self.cells = freeze(once.mapInArrow(assign, f"cell int, angle double, {_ASK}"), "cells")
        found = self.cells.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).orderBy("cell").collect()  # a row for each pivot
        self.names, self.radius, self.sizes = (np.array([r[i] for r in found]) for i in range(3))
        self.pivots = pivots[self.names] if len(pivots) else np.zeros((len(self.names), one.n))

    def _first(self, asks: DataFrame) -> DataFrame:
        """asks(vec_id, embedding, label) with `first`, the cell whose bound is best, of those the nearest."""
        pivots, names, radius = self.pivots, self.names, self.radius

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                x = _matrix(batch.column(1))
                place = np.zeros(len(x), dtype=np.int64)
                for own in _slices(len(x), len(names)):
                    bound, near = _bounds(x[own], pivots, radius)
                    place[own] = np.where(bound == bound.max(axis=1, keepdims=True), near, -2).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[place], pa.int32())], names=[*batch.schema.names, "first"])

        return asks.select("vec_id", "embedding", "label").mapInArrow(run, f"{_ASK}, first int")

    def _visits(self, state: DataFrame, zone: np.ndarray, counts: bool) -> DataFrame:
        """state(vec_id, embedding, label, best, first) with each zone that has another cell than the first whose bound exceeds the best;
        or only how many rows that are for each zone."""
        order = np.argsort(zone, kind="stable")
        pivots, names, radius, cut = self.pivots[order], self.names[order], self.radius[order], np.flatnonzero(np.diff(zone[order], prepend=-1))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(len(cut), dtype=np.int64)
            for batch in batches:
                x, best, first = _matrix(batch.column(1)), batch.column(3).to_numpy(zero_copy_only=False).astype(float), batch.column(4).to_numpy()
                for own in _slices(len(x), len(names)):
                    open_ = _bounds(x[own], pivots, radius)[0] + SLACK > np.where(np.isnan(best[own]), -2, best[own])[:, None]
                    row, place = np.nonzero(np.logical_or.reduceat(open_ & (first[own][:, None] != names), cut, axis=1))
                    if counts:
                        total += np.bincount(place, minlength=len(cut))
                        continue
                    for some in _slices(len(row), x.shape[1]):
                        taken = batch.take(pa.array(own.start + row[some]))
                        yield pa.RecordBatch.from_arrays([pa.array(place[some], pa.int32()), *taken.columns], names=["part", *batch.schema.names])
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut)), pa.int32()), pa.array(total)], names=["part", "n"])

        return state.select("vec_id", "embedding", "label", "best", "first").mapInArrow(run, "part int, n long" if counts else f"part int, {_ASK}, best double, first int")

    def _compared(self, visits: DataFrame, asked: dict[int, int], cells: DataFrame, sizes: dict[int, int], other_groups: bool) -> DataFrame:
        """(vec_id, similarity): the best of each visit's part, or what the visit had; null if it has none that counts. visits(part, vec_id,
        embedding, label, best, first: a cell that is left out) meet cells(part, cell, vec_id, embedding, label) by blocks of both."""
        spark, block, names, radius = visits.sparkSession, self.block, self.names, self.radius
        pivots = self.pivots if len(self.pivots) else None
        cuts = F.broadcast(spark.createDataFrame([(p, -(-n // block), -(-sizes[p] // block)) for p, n in asked.items()], "part int, lefts int, rights int"))  # parts are bounded
        cut = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = visits.join(cuts, "part").select("part", cut("lefts").alias("i"), every("rights").alias("j"), "vec_id", "embedding", "label", "best", "first")
        right = cells.join(cuts, "part").select("part", every("lefts").alias("i"), cut("rights").alias("j"), "cell", "embedding", "label")

        def product(key, a, b):
            import pyarrow as pa

            if not a.num_rows:
                return pa.table({"vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64()), "pairs": pa.array([], pa.int64())})
            x, first, own = _matrix(a.column("embedding").combine_chunks()), a.column("first").to_numpy(), a.column("label").to_numpy()
            best = a.column("best").to_numpy().astype(float)
            best[np.isnan(best)] = -np.inf
            pairs = np.zeros(len(x), dtype=np.int64)
            if b.num_rows:
                y, theirs, cell = _matrix(b.column("embedding").combine_chunks()), b.column("label").to_numpy(), b.column("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                y, theirs, cell = y[order], theirs[order], cell[order]
                begins = np.flatnonzero(np.diff(cell, prepend=-1))
                ends, cells_here = np.append(begins[1:], len(cell)), cell[begins]
                place = np.searchsorted(names, cells_here)
                for some in _slices(len(x), max(len(cells_here), 1024)):
                    bound = _bounds(x[some], pivots[place], radius[place])[0] if pivots is not None else np.ones((len(x[some]), 1))
                    for k in np.argsort(-bound.mean(axis=0), kind="stable"):
                        rows = some.start + np.flatnonzero((bound[:, k] + SLACK > best[some]) & (first[some] != cells_here[k]))
                        if not len(rows):
                            continue
                        asking, top = x[rows], np.full(len(rows), -np.inf)
                        for at in _slices(ends[k] - begins[k], len(rows)):
                            at = slice(begins[k] + at.start, min(begins[k] + at.stop, ends[k]))
                            sims = asking @ y[at].T
                            if sims.max() > 1.0001:
                                raise ValueError("vectors are not of unit length")
                            if other_groups:
                                sims[own[rows][:, None] == theirs[at][None, :]] = -np.inf
                            top = np.maximum(top, sims.max(axis=1))
                        best[rows] = np.maximum(best[rows], top)
                        pairs[rows] += ends[k] - begins[k]
            return pa.table({"vec_id": a.column("vec_id"), "similarity": pa.array(np.where(np.isneginf(best), np.nan, best)), "pairs": pa.array(pairs)})

        tiles = left.groupBy("part", "i", "j").cogroup(right.groupBy("part", "i", "j")).applyInArrow(product, "vec_id long, similarity double, pairs long")
        found = freeze(tiles.groupBy("vec_id").agg(F.max(F.when(~F.isnan("similarity"), F.col("similarity"))).alias("similarity"), F.sum("pairs").alias("pairs")), "found")
        self.visited += found.agg(F.sum("pairs")).first()[0] or 0
        return found.drop("pairs")

    def nearest(self, asks: DataFrame, other_groups: bool = False) -> DataFrame:
        """asks(vec_id, embedding, label) -> (vec_id, similarity); with other_groups references of the asker's own label do not count."""
        label = F.col("label").cast("long") if other_groups else F.lit(None).cast("long")
        rows = asks.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), label.alias("label"))
        none, nobody = F.lit(None).cast("double").alias("best"), F.lit(-1).alias("first")
        if not len(self.names):
            return rows.select("vec_id", none.alias("similarity"))
        rows = freeze(self._first(rows) if len(self.names) > 1 else rows.withColumn("first", F.lit(0)), "askers")
        asked = {r.first: r.n for r in rows.groupBy("first").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
        sizes = dict(zip(self.names.tolist(), self.sizes.tolist(), strict=True))
        visits = rows.select(F.col("first").alias("part"), "vec_id", "embedding", "label", none, nobody)
        found = self._compared(visits, asked, self.cells.withColumn("part", F.col("cell")), sizes, other_groups)
        if len(self.names) == 1:
            return found
        state = freeze(rows.join(found, "vec_id").withColumnRenamed("similarity", "best"), "found")
        zone = _zones(self.pivots, self.sizes, self.block)
        asked = {r.part: r.n for r in self._visits(state, zone, True).groupBy("part").agg(F.sum("n").alias("n")).where("n > 0").collect()}  # a row for each zone
        if not asked:
            return state.select("vec_id", F.col("best").alias("similarity"))
        spark = rows.sparkSession
        zoned = F.broadcast(spark.createDataFrame(list(zip(self.names.tolist(), zone.tolist(), strict=True)), "cell int, part int"))  # a row for each pivot
        found = self._compared(self._visits(state, zone, False), asked, self.cells.join(zoned, "cell"), np.bincount(zone, self.sizes).astype(int).tolist(), other_groups)
        joined = state.select("vec_id", "best").join(found, "vec_id", "left")
        return joined.select("vec_id", F.greatest("best", "similarity").alias("similarity"))


def max_similarity(asks: DataFrame, refs: DataFrame, other_groups: bool = False, block: int | None = None, cell: int = CELL) -> DataFrame:
    """asks and refs (vec_id, embedding, label) -> (vec_id, similarity); with other_groups, references of the asker's own
    label do not count. Without any reference the similarity is null."""
    return Index(refs, block, cell).nearest(asks, other_groups)


def cutoffs(similarity: DataFrame) -> DataFrame:
    """Quantiles .01, .05 and .1 with linear interpolation."""
    return scan.quantiles(similarity, [], "similarity", (0.01, 0.05, 0.1)).select(*[F.col("q")[i].alias(n) for i, n in enumerate(("c01", "c05", "c10"))])
