"""Heads on all rows against the solver in memory, terms against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfold.operators import heads, learning

HEADS = ("a", "b", "all", "none")


def data(spark, n=300, width=25, seed=0):
    r = np.random.default_rng(seed)
    true = r.normal(size=width)
    rows, labels = [], []
    for i in range(n):
        columns = np.sort(r.choice(width, r.integers(0, 8), replace=False))
        values = np.round(r.normal(size=len(columns)), 3)
        z = float(true[columns] @ values)
        y = {"a": float(r.random() < 1 / (1 + np.exp(-z))), "b": float(r.random() < 1 / (1 + np.exp(z - 1))), "all": 1.0}
        if i % 5 == 0:
            del y["b"]  # unknown
        rows.append((f"p{i}", columns.tolist(), values.tolist()))
        labels.append((f"p{i}", y))
    return spark.createDataFrame(rows, "id string, columns array<int>, values array<double>").repartition(5), spark.createDataFrame(labels, "id string, labels map<string, double>")


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_equal_to_the_solver_in_memory(spark, monkeypatch, c):
    features, labels = data(spark, seed=int(c))
    whole = heads.sampled(features.join(labels, "id"), HEADS)
    want = [heads.fit_one(whole, i, c, 25) for i in range(4)]
    monkeypatch.setattr(heads, "sampled", lambda rows, names, f=heads.sampled: f(rows, names, most_rows=40))
    found, rows = heads.fitted_on_all(features, labels, HEADS, 25, c)
    got = {r.model_id: r for r in found.collect()}
    assert rows.passes > 4  # the sample's solution is not that of all rows
    for (weights, prevalence), h in zip(want, HEADS, strict=True):
        assert got[h].prevalence == pytest.approx(prevalence)
        assert (weights is None) == (got[h].weights is None)
        if weights is not None:
            assert np.abs(np.array(got[h].weights) - weights).max() < 1e-4


def test_a_solution_stays(spark):
    features, labels = data(spark)
    found, rows = heads.fitted_on_all(features, labels, HEADS, 25)
    alone = {r.model_id: r.weights for r in heads.fitted_heads(spark, heads.sampled(features.join(labels, "id"), HEADS), HEADS, 25).collect()}
    assert rows.passes == 2 and {r.model_id: r.weights for r in found.collect()} == alone


def test_sums_go_up_a_tree(spark, monkeypatch):
    features, labels = data(spark, 60, 1200, 3)
    blocks = heads.packed(features.repartition(9), labels, HEADS)
    w = np.random.default_rng(1).normal(size=(1201, 4)) / 10
    flat = heads.AllRows(blocks, 1200, 4).gradient(w)
    monkeypatch.setattr(heads.AllRows, "TREE", 2)
    assert np.allclose(heads.AllRows(blocks, 1200, 4).gradient(w), flat)


@pytest.mark.parametrize("bigrams", [True, False])
def test_terms(spark, monkeypatch, bigrams):
    monkeypatch.setattr(learning, "TERM_CHARS", 60)
    r = random.Random(1)
    texts = [None, "", "a b c", "One one ONE", "naïve Straße éé", "x" * 200, *[" ".join(r.choices(["ab", "cd", "ef-gh", "i", "中文", "_x1"], k=r.randrange(30))) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = {}
    for k, t in enumerate(texts):
        words = re.findall(r"\w{2,}", (t or "").lower())
        count = Counter(words)
        if bigrams:
            count.update(" ".join(p) for p in zip(words, words[1:]))
        if count:
            want[k] = count
    got = {x.id: dict(zip(x.terms, x.tf, strict=True)) for x in learning.term_counts(df, "k", "t", bigrams).collect()}
    assert got == want
    assert learning.term_counts(df.where("false"), "k", "t", bigrams).agg(F.count("*")).first()[0] == 0


def test_products_are_of_the_heads_that_go_on(spark):
    features, labels = data(spark, 60)
    rows = heads.AllRows(heads.packed(features, labels, HEADS), 25, 4)
    r = np.random.default_rng(4)
    w, d, every = r.normal(size=(26, 4)), r.normal(size=(26, 4)), np.ones(4, dtype=bool)
    whole, some = rows.curved(w, d, every), rows.curved(w, d, np.array([True, False, True, False]))
    assert np.allclose(some[:, [0, 2]], whole[:, [0, 2]]) and not some[:, [1, 3]].any() and whole[:, :3].any(axis=0).all()  # nobody knows a label of the last


def test_weights_apart_are_the_same_rows_in_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(heads, "BLOCK", 2_000)
    r = random.Random(5)
    texts = [(f"p{i}", " ".join(r.choices([f"w{j}" for j in range(150)], k=r.randrange(1, 120)))) for i in range(150)]
    labels = spark.createDataFrame([(i, {"a": float(r.random() < 0.5), "b": float(r.random() < 0.3)}) for i, _ in texts], "id string, labels map<string, double>")
    counted = learning.term_counts(spark.createDataFrame(texts, "id string, t string"), "id", "t")
    fitted = learning.Tfidf.fit(counted, len(texts))
    width, features = len(fitted.words), fitted.apart(counted)
    plain, apart = (heads.packed(x, labels, ("a", "b")) for x in (features.select("id", "columns", "values"), features))
    assert apart.count() > 2 and all(len(x.columns) + len(x.values) == 3 * np.frombuffer(x.starts, np.int64)[-1] for x in apart.collect())
    w = np.random.default_rng(2).normal(size=(width + 1, 2))
    want, got = heads.AllRows(plain, width, 2).sloped(w), heads.AllRows(apart, width, 2, fitted.idf).sloped(w)
    assert np.allclose(want[0], got[0]) and np.allclose(want[1], got[1])
    losses, ahead, curve = heads.AllRows(apart, width, 2, fitted.idf).stepped(w * 0, w, np.array([0.0, 1.0]))
    assert np.allclose(ahead, got[0]) and np.allclose(curve, got[1]) and np.allclose(losses[0], len(texts) * np.log(2))


@pytest.mark.parametrize("long", [0, 10**9])
def test_rows_one_by_one_and_all_at_once(long, monkeypatch):
    monkeypatch.setattr(heads._Block, "LONG", long)
    r = np.random.default_rng(3)
    x = r.normal(size=(7, 9)) * (r.random((7, 9)) < 0.5)
    x[2] = 0.0  # a row without entries
    rows, columns = np.nonzero(x)
    packs = [np.concatenate(([0], np.cumsum((x != 0).sum(axis=1)))), columns.astype(np.uint16), x[rows, columns], np.zeros(0), np.arange(7) + 1.0, np.ones(14)]
    block = heads._Block([[p.tobytes() for p in packs]] * 2, 9, 2, [0, 1])
    whole = np.hstack((np.vstack([x * (np.arange(7) + 1.0)[:, None]] * 2), np.ones((14, 1))))
    w, u = r.normal(size=(10, 3)), r.normal(size=(14, 2))
    assert np.allclose(block.forward(w), whole @ w) and np.allclose(block.back(u), whole.T @ u)


def test_directions_of_one_head_serve_the_others():
    """Eight heads with the same curvature: what one head has tried solves the others' systems."""
    r = np.random.default_rng(6)
    x = r.normal(size=(40, 12)) * np.geomspace(30, 1, 12)
    a, space = x.T @ x, heads.Subspace(12)
    for s in np.eye(12):
        space.add(s, a @ s)
    space.close()
    b = r.normal(size=(12, 3))
    z = space.apply(b, np.array([0.1, 1.0, 5.0]))
    for h, c in enumerate((0.1, 1.0, 5.0)):
        want = np.linalg.solve(np.eye(12) + c * a, b[:, h])
        assert np.allclose(z[:, h] / np.linalg.norm(z[:, h]), want / np.linalg.norm(want))
