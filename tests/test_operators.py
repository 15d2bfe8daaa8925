"""Operators on tiny frames: masks, coverage, splits, tie-breaks, metrics, bounds, ledger, graders, sources and sinks."""

import json
import math
import tarfile

import pytest
from pyspark.sql import functions as F

from pathfold.functions import grading
from pathfold.functions.text import prompt_features
from pathfold.operators import ledger, learning, novelty, prep, routing, uncertainty
from pathfold.sources import readers, sinks

OUT = "prompt_id string, model_id string, raw_score double, raw_cost_usd double, input_tokens double, output_tokens double, has_output boolean, generation_failure boolean"


def outcomes(spark, *changes):
    base = [["p1", "a"], ["p1", "b"], ["p2", "a"], ["p2", "b"]]
    rows = [dict(prompt_id=p, model_id=m, raw_score=1.0, raw_cost_usd=0.001, input_tokens=10.0, output_tokens=20.0, has_output=True, generation_failure=False) for p, m in base]
    for i, change in enumerate(changes):
        rows[i].update(change)
    return spark.createDataFrame([tuple(r.values()) for r in rows], OUT)


def test_masks(spark):
    df = outcomes(spark, dict(raw_score=None), dict(raw_score=0.0, raw_cost_usd=0.0, output_tokens=0.0, generation_failure=True), dict(has_output=False, raw_score=0.0), dict(raw_cost_usd=math.nan, output_tokens=1.5))
    rows = {(r.prompt_id, r.model_id): r for r in prep.normalize_outcomes(df).collect()}
    assert rows["p1", "a"].success is None and not rows["p1", "a"].eligible
    assert rows["p1", "b"].success is None and rows["p1", "b"].cost_usd is None and rows["p1", "b"].raw_score == 0
    assert rows["p2", "a"].success == 0 and rows["p2", "a"].eligible  # a paid answer without text
    assert rows["p2", "b"].success == 1 and rows["p2", "b"].unavailable_reason == "missing_or_invalid_cost;missing_or_invalid_tokens"


@pytest.mark.parametrize("cost", [-1.0, math.inf, -math.inf, math.nan, 0.0, None])
def test_bad_costs(spark, cost):
    row = prep.normalize_outcomes(outcomes(spark, dict(raw_cost_usd=cost))).where("prompt_id = 'p1' AND model_id = 'a'").first()
    assert row.success == 1 and row.cost_usd is None and not row.eligible


@pytest.mark.parametrize("tokens", [-1.0, 1.5, math.nan, math.inf, 0.0, None])
def test_bad_tokens(spark, tokens):
    assert not prep.normalize_outcomes(outcomes(spark, dict(output_tokens=tokens))).where("prompt_id = 'p1' AND model_id = 'a'").first().eligible


def test_complete_and_coverage(spark):
    df = prep.normalize_outcomes(outcomes(spark)).where("NOT (prompt_id = 'p2' AND model_id = 'b')")
    prompts, models = spark.createDataFrame([("p1",), ("p2",)], "prompt_id string"), spark.createDataFrame([("a",), ("b",)], "model_id string")
    found = {r.prompt_id: (r.missing_models, r.complete) for r in prep.complete_case(prompts, df, 2).collect()}
    assert found == {"p1": (0, True), "p2": (1, False)}
    table = {r.model_id: (r.coverage, r.missing_pairs) for r in prep.coverage_table(prep.coverage_grid(prompts, models, df), "model_id").collect()}
    assert table == {"a": (1.0, 0), "b": (0.5, 1)}
    assert prep.duplicate_pairs(df.unionByName(df.limit(1)), "prompt_id", "model_id").count() == 1


def example_prompts(spark, n=40, **origin):
    rows = [(f"p{i}", f"Question {i}", origin.get(f"p{i}", f"Question {i}"), "math" if i < n // 2 else "code") for i in range(n)]
    return spark.createDataFrame(rows, "prompt_id string, prompt string, origin_query string, dataset string")


def split(spark, prompts):
    grouped = prompts.join(prep.leakage_groups(prompts, "prompt", "origin_query"), "prompt_id")
    both = prep.ood_split(prep.standard_split(grouped, 3407), 3407, ("code",))
    return {r.prompt_id: r for r in both.collect()}


def test_splits(spark):
    rows = split(spark, example_prompts(spark))
    counts = [sum(r.standard_split == s for r in rows.values()) for s in ("train", "validation", "test")]
    assert counts == [28, 6, 6]
    again = split(spark, example_prompts(spark).orderBy(F.desc("prompt_id")))
    assert {k: r.standard_split for k, r in rows.items()} == {k: r.standard_split for k, r in again.items()}
    assert all((r.ood_split == "test") == (r.dataset == "code") for r in rows.values())


def test_shared_origin_groups(spark):
    rows = split(spark, example_prompts(spark, p1="  QUESTION   0 ", p20="Question 0"))
    assert rows["p0"].leakage_group == rows["p1"].leakage_group == rows["p20"].leakage_group
    assert rows["p0"].ood_split == rows["p1"].ood_split == "excluded_overlap" and rows["p20"].ood_split == "test"
    import hashlib

    assert rows["p1"].leakage_group == hashlib.sha256(b"p0").hexdigest()


def test_long_chain_is_one_group(spark):
    rows = [(f"p{i:03d}", f"k{i}", f"k{i + 1}", "d") for i in range(60)]
    df = spark.createDataFrame(rows, "prompt_id string, a string, b string, dataset string")
    shifted = df.select("prompt_id", F.col("a").alias("x")).unionByName(df.select("prompt_id", F.col("b").alias("x")))
    wide = shifted.groupBy("prompt_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = [(f"p{i:03d}", f"same{i // 2}", f"pair{(i + 1) // 2}") for i in range(60)]
    chain = spark.createDataFrame(rows, "prompt_id string, a string, b string")
    assert wide.count() == 60
    assert prep.leakage_groups(chain, "a", "b").select("leakage_group").distinct().count() == 1


def test_features(spark):
    text = "A. 2 + 2?\nB. 5\n```python\nx=4\n```"
    row = spark.createDataFrame([(text,), ("",)], "t string").select(*[c.alias(n) for n, c in prompt_features(F.col("t")).items()]).collect()
    assert (row[0].answer_choice_count, row[0].code_fence_count, row[0].digit_count, row[0].contains_math) == (2, 2, 4, 1)
    assert row[1].line_count == 0 and row[1].character_length == 0


POOL = "pool array<struct<model_id:string,idx:int,c:double,p:double,y:double,cost:double>>"


def pools(spark, ids, costs, *probabilities):
    return spark.createDataFrame([([(m, i, float(c), p, 1.0, float(c)) for i, (m, c, p) in enumerate(zip(ids, costs, ps, strict=True))],) for ps in probabilities], POOL)


def picks(df, rule):
    return [r[0] for r in df.select(rule["idx"]).collect()]


def test_threshold_ties(spark):
    it = routing.threshold(F.col("pool"), F.lit(0.5))
    assert picks(pools(spark, "zab", (1, 1, 2), (0.8, 0.9, 0.95), (0.9, 0.9, 1.0), (0.4, 0.4, 0.7)), it) == [1, 1, 2]
    it = routing.threshold(F.col("pool"), F.lit(1.0))
    assert picks(pools(spark, "zab", (2, 2, 3), (0.3, 0.4, 0.2), (0.4, 0.4, 0.4), (0.1, 0.1, 0.2)), it) == [1, 1, 2]
    assert picks(pools(spark, "za", (1, 2), (0.2, 0.2)), it) == [0]


def test_utility_ties(spark):
    df = pools(spark, "ab", (1, 10), (0.6, 0.9))
    assert picks(df, routing.utility(F.col("pool"), F.lit(0.0))) == [1] and picks(df, routing.utility(F.col("pool"), F.lit(1.0))) == [0]
    assert picks(pools(spark, "za", (1, 2), (0.5, 1.0)), routing.utility(F.col("pool"), F.lit(1.0))) == [0]
    assert picks(pools(spark, "za", (1, 1), (0.5, 0.5)), routing.utility(F.col("pool"), F.lit(0.0))) == [1]


def test_advantage(spark):
    ids, costs = [f"m{i}" for i in range(8)], range(1, 9)
    row = lambda **p: tuple(p.get(m, 0.7 if m == "m6" else 0.1) for m in ids)
    it = routing.advantage(F.col("pool"), F.lit(0.1), "m6")
    assert picks(pools(spark, ids, costs, row(m0=0.81), row(m0=0.75), row(m7=0.99)), it) == [0, 6, 6]


def test_oracle_falls_back(spark):
    df = spark.createDataFrame([([("a", 0, 2.0, 0.1, 0.0, 1.0), ("b", 1, 1.0, 0.1, 0.0, 5.0)],), ([("a", 0, 2.0, 0.1, 1.0, 4.0), ("b", 1, 1.0, 0.1, 1.0, 3.0)],)], POOL)
    assert picks(df, routing.oracle(F.col("pool"))) == [1, 1]


def test_grid_sizes():
    assert len(routing.THRESHOLDS) + len(routing.UTILITIES) == 29
    assert len(routing.candidate_grid()) == len({r[0] for r in routing.candidate_grid()}) == 544


def test_bootstrap_of_equal_policies(spark):
    rows = spark.createDataFrame([("d", f"g{i // 2}", float(i % 2), float(i % 2), 1.0, 2.0) for i in range(20)], "dataset string, text_group string, ry double, by_ double, rc double, bc double")
    means = uncertainty.replicate_means(uncertainty.group_sums(rows, ["ry", "by_", "rc", "bc"]), ["ry", "by_", "rc", "bc"], 25, 1).where("metric = '__micro__'").collect()
    assert len(means) == 25 and all(r.ry == r.by_ and 1 - r.rc / r.bc == 0.5 for r in means)


def test_max_t_skips_constant_metrics(spark):
    rows = spark.createDataFrame([("x", "d", f"g{i}", 0.0) for i in range(6)], "policy_id string, dataset string, text_group string, delta double")
    sums = uncertainty.group_sums(rows, ["delta"], "policy_id")
    errors, most = uncertainty.max_t(uncertainty.replicate_means(sums, ["delta"], 10, 1, "policy_id"), uncertainty.observed_means(sums, ["delta"], "policy_id"), "delta", ["policy_id"], [])
    assert {r.standard_error for r in errors.collect()} == {0.0} and {r.max_t for r in most.collect()} == {0.0}


def test_novelty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    refs = spark.createDataFrame([(0, [1.0, 0.0], 1), (2, [0.0, 1.0], 2)], schema)
    asks = spark.createDataFrame([(1, [0.6, 0.8], 1)], schema)
    assert novelty.max_similarity(asks, refs).first().similarity == pytest.approx(0.8, abs=1e-6)
    assert novelty.max_similarity(refs, refs, other_groups=True, block=1).agg(F.max("similarity")).first()[0] == pytest.approx(0.0, abs=1e-6)


def test_ledger_latest_and_attempts(spark):
    schema = "prompt_id string, model string, seq long, status string, error_type string, retry_count int, provider_attempts int, cost double, response_cost double"
    rows = spark.createDataFrame([("p", "m", 1, "success", None, 0, None, 1.0, None), ("p", "m", 2, "provider_error", "spend_limit_error", 2, None, 1.0, None), ("q", "m", 3, "success", None, 1, None, 1.0, None), ("r", "m", 4, "skipped_model", None, 0, None, 0.0, None)], schema)
    new = ledger.latest(rows, ("prompt_id", "model"), "seq")
    got = {r.prompt_id: (r.a, r.c) for r in new.select("prompt_id", ledger.attempts().alias("a"), ledger.response_cost().alias("c")).collect()}
    assert got == {"p": (2, None), "q": (2, None), "r": (0, 0.0)}


def test_running_spend(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, False), (2, 1.0, 2.0, True), (3, 1.0, 2.0, False), (4, 0.1, 0.1, False)], "seq long, cost double, bound double, failed boolean")
    got = [(r.after, r.stopped) for r in ledger.running_spend(rows, 4.5, "seq").orderBy("seq").collect()]
    assert got == [(1.0, False), (3.0, False), (4.0, True), (4.1, True)]


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("\\frac{1}{2}", "0.5", True), ("$\\frac{3}{4}$", "3/4", True), ("2\\pi", "pi*2", True), ("(1, 2)", "(1,2)", True), ("x = 5", "5", True), ("\\boxed{7}", "7.0", True), ("1/3", "0.333", False), ("\\sqrt{2}", "\\sqrt{2}", True),
        ("\\sqrt{2}", "1.414", False), ("-(1/2)", "-0.5", True), ("1/0", "1/0", True), ("pi*pi", "pi*pi", True), ("\\left(1,2\\right)", "(1,2)", True), ("1,000", "1000", False), ("", "1", None), (None, "1", None),
    ],
)
def test_math_grades(a, b, same):
    assert grading.same_math(a, b) is same


@pytest.mark.parametrize("text, answer", [("so \\boxed{\\frac{1}{2}} end", "\\frac{1}{2}"), ("Work.\nFinal answer: 12", "12"), ("42", "42"), ("because 42", None), ("a\nb", None), ("", None), (None, None)])
def test_math_answers(text, answer):
    assert grading.final_math_answer(text) == answer


def test_choices_and_code(spark):
    texts = ["(b)", "**C**", "Answer: D", "Option A\nOption B", "\\boxed{ a }", "no idea", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(grading.parse_choice(F.col("t"), "ABCD").alias("x"))
    assert [r.x for r in df.collect()] == ["B", "C", "D", None, "A", None, None, None]
    df = spark.createDataFrame([("x\n```python\nprint(1)\n```\n",), ("def f():\n  pass",), ("prose",)], "t string").select(grading.extract_code(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["print(1)", "def f():\n  pass", None]


def test_chunks_and_pooling(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "t array<int>").select(learning.token_chunks(F.col("t"), 2).alias("c"))
    assert [r.c for r in df.collect()] == [[[1, 2], [3]], [[]]]
    rows = spark.createDataFrame([(0, [1.0, 0.0], 3.0), (1, [0.0, 1.0], 2.0), (0, [0.0, -1.0], 4.0)], "o int, v array<double>, w double")
    got = {r.o: r.v for r in learning.pooled(rows, "o", "v", "w").collect()}
    assert got[0] == pytest.approx([0.6, -0.8]) and got[1] == pytest.approx([0, 1])


def test_head_matches_newton(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.7 + rng.normal(size=200) > 0).astype(float)
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label double")
    weights, intercept = learning.fit_head(rows, 1.0)
    z, w = np.column_stack((np.ones(200), x)), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(4), z.T @ (p - y) + w)
    assert np.allclose([intercept, *weights], w, atol=1e-4)
    assert learning.fit_head(rows.withColumn("label", F.lit(1.0)), 1.0) == (None, 1.0)


def test_folds_keep_groups(spark):
    rows = spark.createDataFrame([(f"g{i}", "a" if i % 2 else "b") for i in range(40) for _ in range(2)], "g string, s string")
    folds = {r.g: r.fold for r in learning.profile_folds(rows, "g", "s", 5, 3407).collect()}
    assert len(folds) == 40 and all(sum(f == k for f in folds.values()) == 8 for k in range(5))


def test_ranks_over_slices(spark):
    rows = spark.createDataFrame([("k", f"{i * 7919 % 4096:03x}{i}", i) for i in range(300)] + [("l", "ffff", 0)], "k string, o string, i long")
    got = [(r.k, r.o) for r in prep.ranked(rows, ["k"], "o", "i").orderBy("k", "rank").collect()]
    assert got == sorted(got) and prep.ranked(rows, ["k"], "o", "i").agg(F.max("rank")).first()[0] == 300


def sparse(rng, n, width, heads_):
    import numpy as np

    from pathfold.operators import heads

    x = (rng.random((n, width)) < 0.3) * rng.integers(1, 4, (n, width))
    own, columns = np.nonzero(x)
    y = (rng.random((n, heads_)) < 0.5).astype(float)
    y[:, 0] = x[:, 0] > x[:, 1]
    return x, heads.Rows(np.arange(n), np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n)))), columns, x[own, columns].astype(float), y, {})


def test_heads_match_newton(spark):
    """Weights of sparse heads, by exact Newton steps; a head with one class is constant; unknown labels are left out."""
    import numpy as np

    from pathfold.operators import heads

    x, rows = sparse(np.random.default_rng(1), 150, 12, 3)
    rows.labels[:, 2] = 1.0
    rows.labels[::3, 1] = np.nan
    for head, c in ((0, 0.1), (0, 10.0), (1, 1.0)):
        known = ~np.isnan(rows.labels[:, head])
        z, y, w = np.column_stack((x, np.ones(150)))[known], rows.labels[known, head], np.zeros(13)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + np.eye(13), c * z.T @ (p - y) + w)
        assert np.allclose(heads.fit_one(rows, head, c, 12)[0], w, atol=2e-4)
    assert heads.fit_one(rows, 2, 1.0, 12) == (None, 1.0)
    fitted = {r.model_id: r for r in heads.fitted_heads(spark, rows, ("a", "b", "c"), 12, 0.1).collect()}
    assert fitted["c"].weights is None and np.allclose(fitted["a"].weights, heads.fit_one(rows, 0, 0.1, 12)[0])


def test_weights_of_a_fold_are_tfidf():
    import numpy as np

    from pathfold.operators import heads

    x, rows = sparse(np.random.default_rng(2), 40, 15, 1)
    out = heads.weighed(rows, rows, min_df=2, max_features=10)(rows)
    df, total = (x > 0).sum(axis=0), x.sum(axis=0)
    kept = sorted([i for i in range(15) if df[i] >= 2], key=lambda i: (-total[i], i))[:10]
    for i in range(40):
        w = {j: (1 + np.log(x[i, j])) * (np.log(41 / (1 + df[j])) + 1) for j in kept if x[i, j]}
        norm = np.sqrt(sum(v * v for v in w.values()))
        at = slice(out.starts[i], out.starts[i + 1])
        assert np.allclose(out.values[at], [w[j] / norm for j in sorted(w)]) and out.columns[at].tolist() == sorted(w)


def test_samples_are_bounded(spark):
    from pathfold.operators import heads

    rows = spark.range(50).select(F.col("id"), F.sequence(F.lit(0), (F.col("id") % 5).cast("int")).alias("columns"), F.lit(1.0).alias("v"))
    rows = rows.select("id", "columns", F.transform("columns", lambda x: x * 2.0).alias("values"), F.create_map(F.lit("a"), F.lit(1.0)).alias("labels"))
    every = heads.sampled(rows, ("a", "b"))
    assert len(every.ids) == 50 and every.starts[-1] == 150 and every.values.tolist() == (every.columns * 2.0).tolist()
    assert len(heads.sampled(rows, ("a",), most_rows=7).ids) == 7 and heads.sampled(rows, ("a",), most_entries=20).starts[-1] <= 20
    assert len(heads.sampled(rows.limit(0), ("a",)).ids) == 0


def test_archive(spark, tmp_path):
    want = 0
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as tar:
        for d in ("math", "code"):
            for m in range(3):
                records = [dict(index=i, prompt=f"{d} {i}", origin_query="o", raw_output="x", prediction="p", ground_truth="g", score=float((i + m) % 3 != 0), cost=(m + 1) / 1000, prompt_tokens=5, completion_tokens=7) for i in range(4)]
                body = json.dumps(dict(dataset_name=d, split="test", model_name=f"m{m}", counts=4, performance=0.5, cost=1.0, demo=False, records=records))
                (tmp_path / "f.json").write_text(body)
                tar.add(tmp_path / "f.json", f"release/{d}/test/m{m}/20250101_000000.json")
                want += 4
    rows = readers.explode_results(readers.read_archive(spark, str(tmp_path / "r.tar.gz")))
    assert rows.count() == want and rows.where("header_agrees").count() == want and rows.select("prompt_id").distinct().count() == 8


def test_archive_refuses_climbing_paths(spark, tmp_path):
    (tmp_path / "f.json").write_text("{}")
    with tarfile.open(tmp_path / "bad.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "f.json", "../f.json")
    with pytest.raises(Exception, match="bad archive member"):
        readers.read_archive(spark, str(tmp_path / "bad.tar.gz")).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "prompt": "x"}\n\n{"id": "a", "prompt": null}\n{"id": " ", "prompt": "y"}\n')
    rows = readers.read_requests(spark, str(tmp_path / "r.jsonl"))
    assert rows.count() == 3
    assert sorted(r.problem for r in readers.request_problems(rows).collect()) == ["blank_id", "no_prompt", "repeated_id"]
    (tmp_path / "l.csv").write_text('k,v,t\n1,2.5,"a\nb"\n2,,""\n')
    assert [tuple(r) for r in readers.read_ledger(spark, str(tmp_path / "l.csv"), "k int, v double, t string").collect()] == [(1, 2.5, "a\nb"), (2, None, None)]
    (tmp_path / "m.json").write_text('[{"name": "a", "loader": "choice", "task_type": "multiple_choice", "path": "x"},\n {"name": "b", "loader": "math", "task_type": "code", "path": "y"}]')
    assert [r.fits for r in readers.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [True, False]


def test_artifacts_and_upserts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b|c")], "k int, v string")
    sinks.write_artifacts({"t": df}, str(tmp_path / "art"))
    assert sinks.verify_artifacts(spark, str(tmp_path / "art")) == []
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_artifacts({"t": df}, str(tmp_path / "art"))
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "art/t"))
    assert sinks.verify_artifacts(spark, str(tmp_path / "art")) == ["t"]
    assert sinks.markdown_table(df).splitlines()[-1] == "| 2 | b\\|c |"
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, seq long")
    folder = str(tmp_path / "ledger")
    for change in (rows((1, "a", 1), (2, "b", 2)), rows((1, "c", 3)), rows((1, "c", 3)), rows((5, "e", 4))):
        sinks.upsert_parquet(change, folder, ("k",), "seq")
    assert sorted(tuple(r) for r in sinks.read_upserted(spark, folder, change.schema).collect()) == [(1, "c", 3), (2, "b", 2), (5, "e", 4)]
    # Key 2 was never written again; superseded parts of key 1 and old maps are gone.
    kept = sorted(str(x.relative_to(folder)).split("/_bucket")[0] for x in (tmp_path / "ledger").rglob("_bucket=*"))
    assert kept == ["v000000000", "v000000001", "v000000002", "v000000003"] or kept == ["v000000000", "v000000002", "v000000003"]
    assert sinks.current_version(spark, folder) == 3 and not (tmp_path / "ledger/map000000001").exists()


def test_rest_works_without_llm():
    import ast
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "pathfold"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            names = [n for node in ast.walk(ast.parse(path.read_text())) if isinstance(node, (ast.Import, ast.ImportFrom)) for n in ([node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names])]
            assert not any(n.startswith("pathfold.llm") for n in names), path


def test_report(spark, sf):
    from pathfold.plans import report

    text = report.render(spark, sf, "Pilot", report.PILOT)
    assert text.count("## ") == len(report.PILOT) and "| expected_pairs |" in text.replace("| accuracy", "| accuracy")


def test_exact_normalisation():
    from pathfold.functions.unicode_text import folded

    assert folded(" Ｆoo\tSTRASSE ﬁ ") == "foo strasse fi" and folded(None) is None


def test_files_and_config(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.bin").write_bytes(b"abc")
    (tmp_path / "d/b.bin").write_bytes(b"abd")
    digest = hashlib.sha256(b"abc").hexdigest()
    expected = spark.createDataFrame([("a.bin", 3, digest), ("b.bin", 3, digest), ("c.bin", 1, "x")], "file string, bytes long, sha256 string")
    assert {tuple(r) for r in readers.verify_files(spark, str(tmp_path / "d"), expected).collect()} == {("b.bin", "sha256"), ("c.bin", "missing")}
    good = dict(standard_fractions=[0.7, 0.15, 0.15], ood_validation_fraction=0.15, models=list("abcde"), ood_held_out_datasets=["x"])
    (tmp_path / "c.json").write_text(json.dumps(good | dict(name="good")) + "\n" + json.dumps(good | dict(name="bad", models=list("aabcd"), standard_fractions=[1, 1, 1])))
    assert sorted(tuple(r) for r in readers.config_problems(readers.read_configs(spark, str(tmp_path / "c.json"))).collect()) == [("bad", "fractions"), ("bad", "models")]
