"""A saved router scores as the one that was trained, without its data, and a changed artifact is refused."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfold.operators import heads, learning, prep, router

MODELS = ("m0", "m1", "m2")
COSTS = {"m0": 1.0, "m1": 2.0, "m2": 5.0}


def training(spark, n=60):
    r = np.random.default_rng(2)
    rows = [(f"p{i}", " ".join(r.choice(["alpha", "beta, gamma", "12 + 3", "Why?", "(c)", "delta"], 1 + i % 7)), i % 50) for i in range(n)]
    prompts = spark.createDataFrame(rows, "id string, prompt string, label long")
    labels = spark.createDataFrame([(a, {m: float((len(t) % 11 > 2 + 3 * k) or r.random() < 0.2) for k, m in enumerate(MODELS[:2])} | {"m2": 1.0}) for a, t, _ in rows], "id string, labels map<string, double>")
    return prompts, labels


def requests(spark):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["alpha", "Why? (c) delta", "", "12 + 3 beta, gamma " * 4, "zzz qqq xxx"])], "prompt_id string, prompt string").withColumn("p", F.lit("x"))


def rows(df):
    return {r.prompt_id: (r.model_id, r.estimated_cost, r.probabilities, r.policy_id, r.novelty_fallback) for r in df.collect()}


@pytest.mark.parametrize("family, kind, value, gate", [("handcrafted", "threshold", 0.6, 0.0), ("embedding", "utility", 0.3, 0.1), ("embedding_handcrafted", "advantage", 0.0, 0.05), ("tfidf", "threshold", 0.5, 0.1)])
def test_equal_to_the_one_that_was_trained(spark, tmp_path, family, kind, value, gate):
    prompts, labels = training(spark)
    policy = router.Policy("x", family, kind, value, gate, "m1")
    tables = router.train(prompts, labels, COSTS, policy, MODELS)
    router.save(tables, policy, str(tmp_path / "a"))
    loaded = router.Router(spark.newSession(), str(tmp_path / "a"))
    got = rows(loaded.route(requests(spark)))
    assert set(got) == {f"q{i}" for i in range(5)}
    # In this session, from the tables that were never written.
    known = {r.model_id: r for r in tables["heads"].collect()}
    asked = requests(spark).select(F.col("prompt_id").alias("id"), "prompt")
    if family == "tfidf":
        terms = tables["vocabulary"].orderBy("place").collect()
        features = learning.Tfidf([t.term for t in terms], np.array([t.idf for t in terms])).transform(learning.term_counts(asked, "id", "prompt"))
    else:
        features = router.scaled(asked.select("id", router.dense(F.col("prompt"), family).alias("x")), tables["scaling"].collect())
    own = {r.id: r.p for r in heads.probabilities(features, [known[m] for m in MODELS]).collect()}
    for q, (model, cost, p, name, shut) in got.items():
        p = [p[m] for m in MODELS]
        if q in own:
            assert p == pytest.approx(own[q], abs=1e-12)
        assert p[2] == 1.0  # one class only
        if kind == "threshold":
            best = min([m for m, x in zip(MODELS, p) if x >= value], key=COSTS.get)
        elif kind == "utility":
            best = max(zip(MODELS, p), key=lambda x: x[1] - value * COSTS[x[0]] / 5)[0]
        else:
            best = "m0" if p[0] >= p[1] + value else "m1"
        assert model == ("m1" if shut else best) and cost == COSTS[model] and name == "x" and (gate > 0 or not shut)
    if gate:
        assert got["q2"][4] and got["q4"][4]  # no letters, and letters that no prompt has


def damage(folder, how):
    part = sorted(glob.glob(f"{folder}/heads/*.parquet"))[0]
    if how == "byte":
        data = bytearray(open(part, "rb").read())
        data[len(data) // 2] ^= 1
        open(part, "wb").write(data)
    elif how == "missing":
        os.remove(part)
    elif how == "surplus":
        open(f"{folder}/costs/part-x.parquet", "wb").write(open(part, "rb").read())
    else:
        (name,) = glob.glob(f"{folder}/manifest/part-*")
        content = json.load(open(name))
        content["policy"]["value"] = 0.1
        open(name, "w").write(json.dumps(content))
    for crc in glob.glob(f"{folder}/*/.*.crc"):  # else the file system itself would tell
        os.remove(crc)


@pytest.mark.parametrize("how", ["byte", "missing", "surplus", "manifest"])
def test_a_changed_artifact_is_refused(spark, tmp_path, how):
    prompts, labels = training(spark, 20)
    policy = router.Policy("x", "handcrafted", "threshold", 0.6, 0.0, "m1")
    router.save(router.train(prompts, labels, COSTS, policy, MODELS, "centroid"), policy, str(tmp_path / "a"))
    assert router.Router(spark, str(tmp_path / "a")).policy == policy
    damage(str(tmp_path / "a"), how)
    with pytest.raises(ValueError, match="manifest" if how == "manifest" else "heads/part" if how != "surplus" else "costs/part-x"):
        router.Router(spark, str(tmp_path / "a"))


def test_requests_are_checked(spark, tmp_path):
    prompts, labels = training(spark, 20)
    policy = router.Policy("s", "static", "static", 0.0, 0.0, "m2")
    router.save(router.train(prompts, labels, COSTS, policy, MODELS), policy, str(tmp_path / "a"))
    loaded = router.Router(spark, str(tmp_path / "a"))
    assert set(rows(loaded.route(requests(spark))).values()) == {("m2", 5.0, None, "s", False)}
    assert loaded.route(requests(spark).where("false")).collect() == []
    for bad in ([("a", "x"), ("a", "y")], [(" ", "x")], [(None, "x")], [("a", None)]):
        with pytest.raises(ValueError):
            loaded.route(spark.createDataFrame(bad, "prompt_id string, prompt string"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        router.save(router.train(prompts, labels, COSTS, policy, MODELS), policy, str(tmp_path / "a"))


def test_exact_forms(spark):
    forms = [("ﬁne Ｔext", "fine text"), ("Straße  ①", "strasse 1"), ("Ångström\tÅ", "ångström å"), ("é É", "é é"), (" \n", ""), ("Σς", "σσ"), ("Ⅳ ½", "iv 1⁄2"), ("PLAIN  text", "plain text"), ("a\x1cb\x1f", "a b")]
    got = spark.createDataFrame(forms, "a string, b string").select("b", prep.exact_text(F.col("a")).alias("c")).collect()
    assert [r.c for r in got] == [r.b for r in got]


def test_letters_are_counted_once_for_a_row(spark):
    """The unit vector names its input once in the plan: texts are not scanned again for each of its numbers."""
    from pathfold.functions.text import letter_counts, unit

    df = spark.createDataFrame([("p", "abca"), ("q", "")], "id string, prompt string")
    made = df.select("id", unit(letter_counts(F.col("prompt"))).alias("v"))
    # Each naming of the input is one replace(prompt, ...) in the plan.
    assert made._jdf.queryExecution().analyzed().toString().lower().count("replace(prompt") == 1
    got = {r.id: r.v for r in made.collect()}
    assert got["p"][:4] == pytest.approx([2 / 6**0.5, 1 / 6**0.5, 1 / 6**0.5, 0.0]) and got["q"] == [0.0] * 26
