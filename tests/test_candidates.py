"""Candidates and their simultaneous bounds against a plain version in numpy, with anchors, hot groups and strata of one group."""

import hashlib

import numpy as np
import pytest

from pathfold.operators import candidates, routing

MODELS = 8
LISTED = candidates.candidate_list(MODELS)


def made(n=60, seed=0):
    r = np.random.default_rng(seed)
    p = np.round(r.random((n, 4, MODELS)), 2)  # ties
    y, micro = (r.random((n, MODELS)) < 0.6).astype(float), r.integers(1, 900, (n, MODELS))
    strata = np.array([f"s{k}" for k in r.integers(0, 3, n)])
    groups = [hashlib.sha256(f"{s}{'hot' if r.random() < 0.3 else i}".encode()).hexdigest() for i, s in enumerate(strata)]
    strata[0], groups[0] = "alone", hashlib.sha256(b"x").hexdigest()
    return p, y, micro, strata.tolist(), groups, r.random(n)


def frame(spark, p, y, micro, strata, groups, similarity):
    rows = [(f"p{i}", s, g, float(x), p[i].ravel().tolist(), y[i].tolist(), [int(m) for m in micro[i]]) for i, (s, g, x) in enumerate(zip(strata, groups, similarity))]
    return spark.createDataFrame(rows, "prompt_id string, stratum string, text_group string, similarity double, p array<double>, y array<double>, micro array<bigint>")


COSTS, CUTS = [1.0, 1.0, 2.0, 3.0, 3.0, 5.0, 9.0, 20.0], {0.01: 0.1, 0.05: 0.3, 0.1: 0.5}


def plain_action(x, p, similarity):
    """One candidate on one prompt, by sorting."""
    if x.kind == "static" or (x.gate and similarity < CUTS[x.gate]):
        return x.anchor
    q, c = p[x.family], COSTS
    if x.kind == "threshold":
        good = [i for i in range(MODELS) if q[i] >= x.value]
        return min(good, key=lambda i: (c[i], -q[i], i)) if good else min(range(MODELS), key=lambda i: (-q[i], c[i], i))
    if x.kind == "utility":
        return min(range(MODELS), key=lambda i: (-(q[i] - x.value * c[i] / max(c)), c[i], i))
    good = [i for i in range(MODELS) if c[i] < c[x.anchor] and q[i] >= q[x.anchor] + x.value]
    return min(good, key=lambda i: (c[i], -q[i], i)) if good else x.anchor


def test_actions_are_the_rules():
    assert len(LISTED) == MODELS * 545 and len({(x.candidate_id, x.anchor) for x in LISTED}) == len(LISTED)
    p, _, _, _, _, similarity = made(25, 3)
    got = candidates.actions(p, np.array(COSTS), similarity, CUTS, LISTED)
    assert got.tolist() == [[plain_action(x, p[i], similarity[i]) for x in LISTED] for i in range(25)]
    assert {x.kind for x in LISTED} == {"threshold", "utility", "advantage", "static"} and {x.gate for x in LISTED} == set(routing.GATE_QUANTILES)


def plain_bounds(act, y, strata, groups, chosen, statics, replicates, seed):
    n = len(strata)
    selected = y[np.arange(n)[:, None], act[:, chosen]]
    names = sorted(set(strata))
    members = {s: sorted({g for t, g in zip(strata, groups) if t == s}) for s in names}
    rows = {s: {g: [i for i in range(n) if strata[i] == s and groups[i] == g] for g in members[s]} for s in names}

    def level(weights):
        per = [(sum(weights[i] * selected[i] for i in range(n) if strata[i] == s), sum(weights[i] for i in range(n) if strata[i] == s)) for s in names]
        return np.stack([sum(a for a, _ in per) / sum(b for _, b in per), np.mean([a / b for a, b in per], axis=0)])

    observed, drawn = level(np.ones(n)), []
    for r in range(replicates):
        w = np.zeros(n)
        for s in names:
            for k in range(len(members[s])):
                g = int(hashlib.sha256(f"{seed}:{r}:{s}:{k}".encode()).hexdigest()[:8], 16) % len(members[s])
                w[rows[s][members[s][g]]] += 1
        drawn.append(level(w))
    drawn = np.array(drawn)
    d = drawn[:, :, :, None] - drawn[:, :, None, statics]
    delta = observed[:, :, None] - observed[:, None, statics]
    error = d.std(axis=0, ddof=1)
    t = np.where(error > 1e-9, (d - delta) / np.where(error > 1e-9, error, 1), 0)
    critical = np.quantile(np.maximum(t.reshape(replicates, -1).max(axis=1), 0), 0.95)
    return delta, error, delta - critical * error


@pytest.mark.parametrize("seed, groups_of_a_tile", [(1, 1024), (2, 4)])
def test_bounds(spark, monkeypatch, seed, groups_of_a_tile):
    monkeypatch.setattr(candidates, "DRAWS", 7)
    p, y, micro, strata, groups, similarity = made(60, seed)
    rows = candidates.decided(frame(spark, p, y, micro, strata, groups, similarity).repartition(3), COSTS, CUTS, LISTED)
    act = candidates.actions(p, np.array(COSTS), similarity, CUTS, LISTED)
    first = candidates.distinct_candidates(rows, len(LISTED))
    known = {}
    assert first.tolist() == [known.setdefault(act[:, k].tobytes(), k) for k in range(len(LISTED))]
    chosen = np.unique(first)[::9]
    statics = [int(first[545 * (a + 1) - 1]) for a in range(MODELS)]
    chosen = np.unique(np.concatenate((chosen, statics)))
    places = np.unique(np.searchsorted(chosen, statics))
    bounds, tiles = candidates.simultaneous(rows, chosen, places, 70, 5)
    delta, error, lower = plain_bounds(act, y, strata, groups, chosen, places, 70, 5)
    got = bounds.collect()
    assert len(got) == 2 * len(chosen) * len(places)
    at = {s: j for j, s in enumerate(places.tolist())}
    for x in got:
        m, k, j = ("__micro__", "__macro__").index(x.metric), x.k, at[x.other]
        assert (x.delta, x.standard_error, x.lower) == pytest.approx((delta[m, k, j], error[m, k, j], lower[m, k, j]), abs=1e-7)
    sums = {(x.stratum, x.k): (x.n, x.y, x.micro) for x in candidates.totals(tiles, len(chosen)).collect()}
    for s in set(strata):
        own = [i for i in range(60) if strata[i] == s]
        assert sums[s, 0] == (len(own), sum(y[i, act[i, chosen[0]]] for i in own), sum(micro[i, act[i, chosen[0]]] for i in own))


def test_no_prompts(spark):
    rows = candidates.decided(frame(spark, *made(5)).where("false"), COSTS, CUTS, LISTED)
    first = candidates.distinct_candidates(rows, len(LISTED))
    assert set(first.tolist()) <= {0}
    bounds, _ = candidates.simultaneous(rows, np.array([0]), np.array([0]), 10, 1)
    assert bounds.collect() == []


def test_wide_rows_come_in_small_batches(spark, monkeypatch):
    """10,000 rows of 4,360 actions would be 349 MB as one matrix of 64-bit numbers, and there are several."""
    assert candidates.WIDE * 4360 * 8 < 20e6
    before, asked = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    with candidates.batches_of(spark, 7):
        assert max(r.n for r in spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long").collect()) == 7
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    monkeypatch.setattr(candidates, "batches_of", lambda s, n, f=candidates.batches_of: (asked.append(n), f(s, n))[1])
    rows = candidates.decided(frame(spark, *made(5)), COSTS, CUTS, LISTED)
    candidates.distinct_candidates(rows, len(LISTED))
    assert asked == [candidates.WIDE]
