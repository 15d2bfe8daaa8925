"""Queries of the remaining scalar functions, set operations, learning loops and inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.operators import heads, learning, prep, routing
from pathfold.plans.bridge import BASE_SQL, MODEL_IDS, REFERENCE, SEED, pool, prompts, table
from pathfold.plans.prep_queries import crossfit_roles, outcomes, parts
from pathfold.plans.registry import query
from pathfold.plans.routing_queries import CAND_SQL, GRID_SQL, POLICIES, pools, training_costs_of
from pathfold.sources.storage import freeze

# -- scalars --------------------------------------------------------------------------------------------------------


@query("normalize_text", r"SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\xA0]+', ' ', 'g'))), 'ß', 'ss')) AS normal FROM documents")
def normalize_text(spark, sf_dir):
    """The exact form of every document. The tables' texts hold nothing that NFKC changes, so SQL can follow; tests have other texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(prep.exact_text(F.col("text")), 256).alias("normal"))


@query("normalize_documents", r"SELECT count(DISTINCT lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')))) AS texts FROM documents")
def normalize_documents(spark, sf_dir):
    """Different documents by their exact form; on these tables the form that SQL has tells the same ones apart."""
    digest = F.sha2(prep.exact_text(F.col("text")), 256)
    return table(spark, sf_dir, "documents").agg(F.countDistinct(digest).alias("texts"))


@query("text_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("configuration_fingerprint", "SELECT s_suppkey AS key, sha256('[\"' || s_name || '\", ' || s_nationkey || ']') AS fingerprint FROM supplier")
def configuration_fingerprint(spark, sf_dir):
    text = F.concat(F.lit('["'), "s_name", F.lit('", '), F.col("s_nationkey").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.sha2(text, 256).alias("fingerprint"))


@query("sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 20) / 10)), 9) AS p FROM events")
def sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(1 / (1 + F.exp(-(F.col("value") - 20) / 10)), 9).alias("p"))


@query("cost_estimate", BASE_SQL + "SELECT m.model_id, count(*) AS calls, CAST(sum(((length(prompt) + 3) // 4) * in_price + 512 * out_price) AS BIGINT) / 1e6 AS usd FROM prompts CROSS JOIN pool m GROUP BY 1")
def cost_estimate(spark, sf_dir):
    """Tokens times price; summed in whole micro-dollars."""
    tokens = prompts(spark, sf_dir).agg(F.count("*").alias("calls"), F.sum(F.floor((F.length("prompt") + 3) / F.lit(4))).alias("tokens"))
    priced = pool(spark).crossJoin(F.broadcast(tokens))
    micro = F.col("tokens") * F.col("in_price") + F.col("calls") * 512 * F.col("out_price")
    return priced.select("model_id", "calls", (micro.cast("double") / 1e6).alias("usd"))


@query("experiment_plan", BASE_SQL + "SELECT p.dataset, m.model_id, count(*) AS calls, CAST(sum((octet_length(encode(p.prompt)) * in_price + 2048 * out_price) * 3) AS BIGINT) / 1e6 AS bound_usd FROM prompts p CROSS JOIN pool m GROUP BY ALL")
def experiment_plan(spark, sf_dir):
    sizes = prompts(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("calls"), F.sum(F.octet_length("prompt")).alias("bytes"))
    bound = (F.col("bytes") * F.col("in_price") + F.col("calls") * 2048 * F.col("out_price")) * 3
    return sizes.crossJoin(F.broadcast(pool(spark))).select("dataset", "model_id", "calls", (bound.cast("double") / 1e6).alias("bound_usd"))


@query("canonical_json", """SELECT event_type, '{"event_type":"' || event_type || '","mean":' || CAST(round(avg(value), 2) AS VARCHAR) || ',"n":' || count(*) || ',"none":null}' AS json FROM events GROUP BY event_type""")
def canonical_json(spark, sf_dir):
    """Metrics as JSON text, fields by name; what is not finite is null and is written."""
    from pathfold.sources.sinks import canonical_json as to_json
    from pathfold.sources.sinks import finite_or_null

    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("mean"), F.count("*").alias("n"))
    nothing = finite_or_null(F.lit(float("nan")))
    return rows.select("event_type", to_json(n=F.col("n"), none=nothing, mean=finite_or_null(F.col("mean")), event_type=F.col("event_type")).alias("json"))


# -- sets -----------------------------------------------------------------------------------------------------------

_PLAN_SQL = BASE_SQL + ", want AS (SELECT prompt_id FROM prompts WHERE doc_id % 3 <> 0), have AS (SELECT prompt_id FROM complete)\n"


def _sets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    want = prompts(spark, sf_dir).where("doc_id % 3 <> 0").select("prompt_id")
    have = prep.complete_case(prompts(spark, sf_dir).select("prompt_id"), outcomes(spark, sf_dir), len(MODEL_IDS)).where("complete").select("prompt_id")
    return want, have


@query("set_differences", _PLAN_SQL + "SELECT 'missing' AS side, prompt_id FROM (SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL SELECT 'surplus', prompt_id FROM (SELECT * FROM have EXCEPT SELECT * FROM want)")
def set_differences(spark, sf_dir):
    """Two sets are equal when both differences are empty."""
    want, have = _sets(spark, sf_dir)
    return want.subtract(have).select(F.lit("missing").alias("side"), "prompt_id").unionByName(have.subtract(want).select(F.lit("surplus").alias("side"), "prompt_id"))


@query("set_intersection", _PLAN_SQL + "SELECT * FROM want INTERSECT SELECT * FROM have")
def set_intersection(spark, sf_dir):
    want, have = _sets(spark, sf_dir)
    return want.intersect(have)


@query("distinct_prompts", "SELECT lang, count(*) AS rows, count(DISTINCT text) AS texts FROM documents GROUP BY 1")
def distinct_prompts(spark, sf_dir):
    # The digest stands for the text, so that whole texts are not shuffled.
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("rows"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


# -- baselines and inference ----------------------------------------------------------------------------------------


@query(
    "baseline_choices",
    CAND_SQL
    + """, best AS (SELECT model_id FROM (SELECT model_id, avg(y) AS q, any_value(c) AS c FROM val GROUP BY 1) ORDER BY q DESC, c, model_id LIMIT 1), cheap AS (SELECT model_id FROM costs ORDER BY c, model_id LIMIT 1)
SELECT policy, count(*) AS n, round(avg(y), 9) AS success, round(avg(cost), 9) AS cost FROM (SELECT 'best_single' AS policy, y, cost FROM cand WHERE split = 'test' AND model_id = (SELECT model_id FROM best)
  UNION ALL SELECT 'always_cheapest', y, cost FROM cand WHERE split = 'test' AND model_id = (SELECT model_id FROM cheap)) GROUP BY 1""",
)
def baseline_choices(spark, sf_dir):
    from pathfold.plans.routing_queries import best_single_of

    rows = parts(spark, sf_dir)
    named = best_single_of(rows).select(F.lit("best_single").alias("policy"), "model_id").unionByName(training_costs_of(rows).agg(F.min(F.struct("c", "model_id"))["model_id"].alias("model_id")).select(F.lit("always_cheapest").alias("policy"), "model_id"))
    chosen = rows.where("split = 'test'").join(F.broadcast(named), "model_id")  # two rows
    return chosen.groupBy("policy").agg(F.count("*").alias("n"), F.round(F.avg("success"), 9).alias("success"), F.round(F.avg("cost_usd"), 9).alias("cost"))


@query("oracle_targets", CAND_SQL + "SELECT prompt_id, max(y) = 1 AS any_success, arg_min(model_id, (cost, model_id)) FILTER (y = 1) AS cheapest_success, arg_min(model_id, (c, model_id)) AS fallback, round(coalesce(min(cost) FILTER (y = 1), arg_min(cost, (c, model_id))), 9) AS cost FROM val GROUP BY 1")
def oracle_targets(spark, sf_dir):
    pool_ = F.col("pool")
    solved = F.filter(pool_, lambda x: x["y"] == 1)
    first = F.array_min(F.transform(solved, lambda x: F.struct(x["cost"].alias("cost"), x["model_id"].alias("model_id"))))
    back = F.array_min(F.transform(pool_, lambda x: F.struct(x["c"].alias("c"), x["model_id"].alias("model_id"), x["cost"].alias("cost"))))
    return pools(spark, sf_dir).select("prompt_id", (F.size(solved) > 0).alias("any_success"), first["model_id"].alias("cheapest_success"), back["model_id"].alias("fallback"), F.round(F.coalesce(first["cost"], back["cost"]), 9).alias("cost"))


# -- heads ----------------------------------------------------------------------------------------------------------

def _outcomes(spark, sf_dir, split: str = "train") -> DataFrame:
    """(id, dataset, text_group, labels): a prompt's success by candidate."""
    rows = parts(spark, sf_dir).where(F.col("split") == split)
    entry = F.struct("model_id", F.col("success").cast("double"))
    return rows.groupBy(F.col("prompt_id").alias("id"), "dataset", "text_group").agg(F.map_from_entries(F.collect_list(entry)).alias("labels"))


def _texts(spark, sf_dir) -> DataFrame:
    return prompts(spark, sf_dir).select(F.col("prompt_id").alias("id"), "prompt")


@query("text_head")
def text_head(spark, sf_dir):
    """Eight heads on TF-IDF of the training prompts (50,000 terms), with C = 1, fitted on all of them: accuracy and log loss on the
    test prompts."""
    entry = F.struct("model_id", F.col("success").cast("double"))
    rows = parts(spark, sf_dir).where("split <> 'validation'").groupBy(F.col("prompt_id").alias("id"), "split").agg(F.map_from_entries(F.collect_list(entry)).alias("labels"))
    rows = freeze(rows, "outcomes")
    train, test = (rows.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    counted = freeze(learning.term_counts(_texts(spark, sf_dir).join(rows.select("id"), "id", "left_semi"), "id", "prompt"), "term-counts")
    fitted = learning.Tfidf.fit(counted.join(train.select("id"), "id", "left_semi"), train.count())
    features = freeze(fitted.apart(counted), "tfidf")
    models, _ = heads.fitted_on_all(features, train, MODEL_IDS, len(fitted.words), scale=fitted.idf)
    models = sorted(models.collect(), key=lambda r: MODEL_IDS.index(r.model_id))  # one row for each head
    scored = heads.probabilities(features.select("id", "columns", "values").join(test.select("id"), "id", "left_semi"), models).join(test, "id")
    each = F.array(*[F.struct(F.lit(m).alias("model_id"), F.get("p", i).alias("p"), F.element_at("labels", F.lit(m)).alias("y")) for i, m in enumerate(MODEL_IDS)])
    p, y = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)), F.col("y")
    rows = scored.select(F.inline(each)).groupBy("model_id")
    return rows.agg(F.count("*").alias("n"), F.avg("y").alias("prevalence"), F.avg(((F.col("p") >= 0.5) == (y == 1)).cast("int")).alias("accuracy"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def _counts(spark, sf_dir, rows: DataFrame, *marks: str) -> heads.Rows:
    """The bounded sample of rows(id, labels, marks) with the counts of all terms that two of their prompts hold."""
    counted = learning.term_counts(_texts(spark, sf_dir).join(rows.select("id"), "id", "left_semi"), "id", "prompt")
    counted = freeze(counted, "term-counts")
    ids = [r[0] for r in rows.select("id").orderBy(F.xxhash64("id"), "id").limit(heads.MOST_ROWS).collect()]
    own = counted.where(F.col("id").isin(ids)) if len(ids) < 1000 else counted.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "id string")), "id", "left_semi")
    words = sorted(r[0] for r in learning.vocabulary(own, 2, heads.MOST_TERMS).select("term").collect())
    return heads.sampled(learning.numbered(own, words).join(rows, "id"), MODEL_IDS, marks)


def _cv_rows(spark, sf_dir) -> DataFrame:
    """Loss of every head on every fold for every penalty; vocabulary and frequencies are those of the fold's other prompts."""
    folds = crossfit_roles(spark, sf_dir).select(F.col("prompt_id").alias("id"), "own").distinct()
    rows = _counts(spark, sf_dir, freeze(_outcomes(spark, sf_dir).join(folds, "id").withColumn("own", F.col("own").cast("int")), "cv-rows"), "own")
    tasks = spark.createDataFrame([(fold, i, m) for fold in range(5) for i, m in enumerate(MODEL_IDS)], "fold int, i int, model_id string")

    def work(rows: heads.Rows, task: dict) -> list[tuple]:
        out = np.equal(rows.marks["own"], task["fold"])
        raw, scored = rows.take(~out), rows.take(out)
        weigh, width = heads.weighed(rows, raw), int(rows.columns.max(initial=-1)) + 1
        fit, score = weigh(raw), weigh(scored)
        y, weights, result = score.labels[:, task["i"]], None, []
        for c in learning.PENALTIES:  # each begins where the one before ended
            weights, prevalence = heads.fit_one(fit, task["i"], c, width, weights)
            loss = heads.log_loss(y, heads.predicted(score, weights, prevalence, width))
            result.append((task["fold"], c, task["model_id"], len(y), loss, weights is None))
        return result

    return heads.each(spark, tasks, rows, work, "fold int, c double, model_id string, n_score long, log_loss double, constant_fallback boolean")


@query("cv_losses")
def cv_losses(spark, sf_dir):
    """Five folds inside training, three penalties, eight heads: the table that selects C."""
    return _cv_rows(spark, sf_dir)


@query("select_c")
def select_c(spark, sf_dir):
    """Least mean loss over all folds and heads; ties to the smaller C."""
    losses = _cv_rows(spark, sf_dir).groupBy("c").agg(F.avg("log_loss").alias("log_loss"))
    return losses.agg(F.min(F.struct("log_loss", "c")).alias("it")).select("it.c", "it.log_loss")


@query("holdout_fits")
def holdout_fits(spark, sf_dir):
    """Leave each dataset out in turn: every head fitted on the others (C = 1), scored on it."""
    train = freeze(_outcomes(spark, sf_dir), "holdout-rows")
    rows = _counts(spark, sf_dir, train, "dataset")
    numbers = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("model_id")) for i, m in enumerate(MODEL_IDS)])).alias("head")
    tasks = train.select("dataset").distinct().select(F.col("dataset").alias("held_out"), numbers).select("held_out", "head.*")

    def work(rows: heads.Rows, task: dict) -> list[tuple]:
        out = np.equal(rows.marks["dataset"], task["held_out"])
        raw, scored = rows.take(~out), rows.take(out)
        weigh, width = heads.weighed(rows, raw), int(rows.columns.max(initial=-1)) + 1
        weights, prevalence = heads.fit_one(weigh(raw), task["i"], 1.0, width)
        score = weigh(scored)
        y = score.labels[:, task["i"]]
        return [(task["held_out"], task["model_id"], len(y), heads.log_loss(y, heads.predicted(score, weights, prevalence, width)))]

    return heads.each(spark, tasks, rows, work, "held_out string, model_id string, n_score long, log_loss double")


@query("replay_check", GRID_SQL + "SELECT run, (SELECT count(*) FROM vacts) AS n, true AS same FROM (VALUES (1), (2)) r(run)")
def replay_check(spark, sf_dir):
    """The same plan twice has the same rows: an order-independent digest of each run of the whole grid, and whether both agree."""
    cells = lambda: routing.grid_actions(pools(spark, sf_dir), POLICIES, REFERENCE).select("prompt_id", "policy_id", "it.model_id")
    runs = [cells().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("prompt_id", "policy_id", "model_id")).alias("digest")).select(F.lit(i).alias("run"), "n", "digest") for i in (1, 2)]
    both = runs[0].unionByName(runs[1])
    return both.withColumn("same", F.min("digest").over(Window.partitionBy()) == F.max("digest").over(Window.partitionBy())).select("run", "n", "same")  # two rows


_PROFILE_SQL = f""", profiles AS (SELECT text_group, sha256(string_agg(dataset || ':' || n, '|' ORDER BY dataset || ':' || n)) AS profile, sha256('{SEED}:profile:' || text_group) AS o
  FROM (SELECT text_group, dataset, count(*) AS n FROM keyed GROUP BY ALL) GROUP BY 1),
dealt AS (SELECT text_group, (CAST('0x' || substr(profile, 1, 8) AS BIGINT) + row_number() OVER (PARTITION BY profile ORDER BY o, text_group) - 1) % 5 AS fold FROM profiles)
"""


@query("profile_folds", BASE_SQL + _PROFILE_SQL + "SELECT CAST(fold AS INT) AS fold, dataset, count(*) AS prompts, count(DISTINCT text_group) AS groups FROM dealt JOIN keyed USING (text_group) GROUP BY ALL")
def profile_folds(spark, sf_dir):
    """Five stratified folds of whole text groups, by one method at every size."""
    from pathfold.plans.prep_queries import text_groups

    rows = text_groups(spark, sf_dir)
    folds = learning.profile_folds(rows, "text_group", "dataset", 5, SEED)
    return rows.join(folds, "text_group").groupBy("fold", "dataset").agg(F.count("*").alias("prompts"), F.countDistinct("text_group").alias("groups"))
