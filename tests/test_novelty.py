"""The metric index against all pairs: random and clustered vectors, own groups, copies, vectors without length."""

import numpy as np
import pytest

from pathfold.operators import novelty


def frame(spark, x, labels, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), None if l is None else int(l)) for i, (v, l) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label long")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(a, la, b, lb, other):
    s = a @ b.T
    if other:
        s[np.array(la)[:, None] == np.array(lb)[None, :]] = -np.inf
    return s.max(axis=1)


@pytest.mark.parametrize("clusters, other", [(0, False), (0, True), (25, False), (25, True)])
def test_equal_to_all_pairs(spark, clusters, other):
    r = np.random.default_rng(clusters + other)
    centre = r.normal(size=(max(clusters, 1), 8))
    make = lambda n: unit((centre[r.integers(0, clusters, n)] if clusters else 0) + r.normal(size=(n, 8)) * (0.05 if clusters else 1))
    refs, asks = make(600), make(150)
    refs[100:300] = refs[100]  # a third are copies
    refs[5], asks[7] = 0, 0
    la, lb = r.integers(0, 6, 150), r.integers(0, 6, 600)
    index = novelty.Index(frame(spark, refs, lb), block=64, cell=10)
    assert index.count < 600 and 10 < len(index.names) <= 60
    got = {x.vec_id: x.similarity for x in index.nearest(frame(spark, asks, la), other).collect()}
    assert [got[i] for i in range(150)] == pytest.approx(brute(asks, la, refs, lb, other).tolist(), abs=1e-9)
    assert index.visited < 150 * index.count * (0.35 if clusters else 1.0)


def test_own_group_of_all_and_empty_sides(spark):
    x = unit(np.random.default_rng(0).normal(size=(12, 4)))
    same = frame(spark, x, [1] * 12)
    assert {r.similarity for r in novelty.max_similarity(same, same, other_groups=True, cell=3).collect()} == {None}
    assert {r.similarity for r in novelty.max_similarity(same, same.where("false"), cell=3).collect()} == {None}
    assert novelty.max_similarity(same.where("false"), same).collect() == []
    nobody = frame(spark, x, [None] * 12)
    assert all(abs(r.similarity - 1) < 1e-9 for r in novelty.max_similarity(nobody, nobody, other_groups=True, cell=3).collect())
    zero = frame(spark, np.zeros((3, 4)), [1, 2, 3])
    assert {r.similarity for r in novelty.max_similarity(same, zero, cell=1).collect()} == {0.0}


def test_lengths_are_checked(spark):
    x = frame(spark, np.array([[2.0, 0.0]]), [1])
    with pytest.raises(Exception, match="unit length"):
        novelty.max_similarity(x, x).collect()


def test_an_asker_moves_once_for_a_zone(spark):
    """Rows that move and matrices do not grow with the number of pivots."""
    r = np.random.default_rng(7)
    refs, asks = unit(r.normal(size=(600, 16))), unit(r.normal(size=(100, 16)))  # bounds leave out nothing
    index = novelty.Index(frame(spark, refs, [0] * 600), block=200, cell=10)
    zone = novelty._zones(index.pivots, index.sizes, index.block)
    assert len(index.names) > 40 and zone.max() + 1 <= 8 and np.bincount(zone, index.sizes).max() <= 200
    state = index._first(frame(spark, asks, [0] * 100)).selectExpr("vec_id", "embedding", "label", "cast(null as double) as best", "first")
    counted = index._visits(state, zone, True).groupBy("part").sum("n").collect()
    moved = index._visits(state, zone, False).count()
    assert moved == sum(x[1] for x in counted) <= 100 * (zone.max() + 1)
    assert all((s.stop - s.start) * w <= novelty.SLICE for n, w in ((10_000, 2048), (4096, 65_536)) for s in novelty._slices(n, w))
    got = {x.vec_id: x.similarity for x in index.nearest(frame(spark, asks, [0] * 100)).collect()}
    assert [got[i] for i in range(100)] == pytest.approx((asks @ refs.T).max(axis=1).tolist(), abs=1e-9)
