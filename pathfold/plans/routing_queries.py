"""Queries of the routing rules, policy selection and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.operators import routing, scan
from pathfold.plans.bridge import BASE_SQL, MODEL_IDS, REFERENCE, pool
from pathfold.plans.prep_queries import matrix, parts
from pathfold.plans.registry import query
from pathfold.sources.storage import freeze

POLICIES = routing.grid(MODEL_IDS)


def training_costs_of(rows: DataFrame) -> DataFrame:
    return rows.where("split = 'train'").groupBy("model_id", "idx").agg(F.avg("cost_usd").alias("c"))


def pools(spark, sf_dir, split: str | None = "validation") -> DataFrame:
    rows = parts(spark, sf_dir)
    chosen = rows.where(F.col("split") == split) if split else rows
    return routing.candidates(chosen, training_costs_of(rows), "dataset", "split", "text_group")


CAND_SQL = BASE_SQL + ", cand AS (SELECT p.prompt_id, p.dataset, p.split, p.text_group, p.model_id, p.idx, p.p, CAST(p.success AS DOUBLE) AS y, p.cost_usd AS cost, c.c FROM parts p JOIN costs c USING (model_id)), val AS (SELECT * FROM cand WHERE split = 'validation')\n"


def _pick(order: str, where: str = "true", source: str = "val", extra: str = "") -> str:
    return f"SELECT prompt_id, model_id{extra} FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY {order}) = 1"


def _chosen(df: DataFrame, it) -> DataFrame:
    return df.select("prompt_id", it["model_id"].alias("model_id"))


# -- costs and single rules -----------------------------------------------------------------------------------------


@query("training_costs", BASE_SQL + "SELECT model_id, round(c, 9) AS c, round(c / max(c) OVER (), 9) AS relative FROM costs")
def training_costs(spark, sf_dir):
    c = training_costs_of(parts(spark, sf_dir))
    return c.select("model_id", F.round("c", 9).alias("c"), F.round(F.col("c") / F.max("c").over(Window.partitionBy()), 9).alias("relative"))


@query("route_static", CAND_SQL + "SELECT prompt_id, 'm4' AS model_id FROM val GROUP BY 1")
def route_static(spark, sf_dir):
    return _chosen(pools(spark, sf_dir), routing.static(F.col("pool"), F.lit("m4")))


for _tau in (0.5, 0.75):

    @query(f"route_threshold_{int(_tau * 100)}", CAND_SQL + _pick(f"p >= {_tau}::DOUBLE DESC, CASE WHEN p >= {_tau}::DOUBLE THEN c ELSE -p END, CASE WHEN p >= {_tau}::DOUBLE THEN -p ELSE c END, model_id"))
    def route_threshold(spark, sf_dir, tau=_tau):
        return _chosen(pools(spark, sf_dir), routing.threshold(F.col("pool"), F.lit(tau)))


@query("route_utility", CAND_SQL + _pick("-(p - 0.3::DOUBLE * c / top), c, model_id", source="(SELECT *, max(c) OVER (PARTITION BY prompt_id) AS top FROM val)"))
def route_utility(spark, sf_dir):
    return _chosen(pools(spark, sf_dir), routing.utility(F.col("pool"), F.lit(0.3)))


_REF_SQL = f"(SELECT v.*, r.c AS rc, r.p AS rp FROM val v JOIN val r ON r.prompt_id = v.prompt_id AND r.model_id = '{REFERENCE}')"


@query("route_advantage", CAND_SQL + _pick(f"model_id = '{REFERENCE}', c, -p, model_id", f"model_id = '{REFERENCE}' OR (c < rc AND p >= rp + 0.05::DOUBLE)", _REF_SQL))
def route_advantage(spark, sf_dir):
    return _chosen(pools(spark, sf_dir), routing.advantage(F.col("pool"), F.lit(0.05), REFERENCE))


@query("oracle_choice", CAND_SQL + _pick("y DESC, CASE WHEN y = 1 THEN cost ELSE c END, model_id", extra=", y = 1 AS solved"))
def oracle_choice(spark, sf_dir):
    it = routing.oracle(F.col("pool"))
    return pools(spark, sf_dir).select("prompt_id", it["model_id"].alias("model_id"), (it["y"] == 1).alias("solved"))


@query("hindsight_cheapest", CAND_SQL + _pick("cost, model_id"))
def hindsight_cheapest(spark, sf_dir):
    return _chosen(pools(spark, sf_dir), routing.hindsight_cheapest(F.col("pool")))


@query("best_single", CAND_SQL + "SELECT model_id, round(q, 9) AS quality FROM (SELECT model_id, avg(y) AS q, any_value(c) AS c FROM val GROUP BY 1) ORDER BY q DESC, c, model_id LIMIT 1")
def best_single(spark, sf_dir):
    return best_single_of(parts(spark, sf_dir)).select("model_id", F.round("q", 9).alias("quality"))


def best_single_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Highest validation success; ties by training cost, then id."""
    quality = rows.where("split = 'validation'").groupBy("model_id", *keys).agg(F.avg("success").alias("q")).join(F.broadcast(training_costs_of(rows)), "model_id")
    return quality.groupBy(*keys).agg(F.min(F.struct((-F.col("q")).alias("a"), "c", "model_id", "q")).alias("it")).select(*keys, "it.model_id", "it.q")


@query("always_cheapest", BASE_SQL + "SELECT model_id FROM costs ORDER BY c, model_id LIMIT 1")
def always_cheapest(spark, sf_dir):
    return training_costs_of(parts(spark, sf_dir)).agg(F.min(F.struct("c", "model_id"))["model_id"].alias("model_id"))


@query(
    "domain_static",
    CAND_SQL
    + """, best AS (SELECT dataset, model_id FROM (SELECT dataset, model_id, avg(y) AS q, any_value(c) AS c FROM val WHERE dataset <> 'es' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY q DESC, c, model_id) = 1),
overall AS (SELECT model_id FROM (SELECT model_id, avg(y) AS q, any_value(c) AS c FROM val GROUP BY 1) ORDER BY q DESC, c, model_id LIMIT 1)
SELECT d.dataset, coalesce(b.model_id, o.model_id) AS model_id FROM (SELECT DISTINCT dataset FROM prompts) d LEFT JOIN best b USING (dataset) CROSS JOIN overall o""",
)
def domain_static(spark, sf_dir):
    """The best of each dataset; one that validation has not seen falls back to the overall best."""
    rows = parts(spark, sf_dir)
    each = best_single_of(rows.where((F.col("split") != "validation") | (F.col("dataset") != "es")), "dataset").select("dataset", F.col("model_id").alias("own"))
    every = best_single_of(rows).select(F.col("model_id").alias("all"))
    return parts(spark, sf_dir).select("dataset").distinct().join(each, "dataset", "left").crossJoin(F.broadcast(every)).select("dataset", F.coalesce("own", "all").alias("model_id"))


# -- the grid on every prompt ---------------------------------------------------------------------------------------

_VALUES = ", ".join(f"('{a}', '{k}', {'NULL' if v is None else repr(v)}::DOUBLE, {'NULL' if m is None else repr(m)})" for a, k, v, m in POLICIES)
GRID_SQL = (
    CAND_SQL
    + f""", policies(policy_id, kind, value, model) AS (VALUES {_VALUES}),
wide AS (SELECT v.*, r.c AS rc, r.p AS rp, max(v.c) OVER (PARTITION BY v.prompt_id) AS top FROM cand v JOIN cand r ON r.prompt_id = v.prompt_id AND r.model_id = '{REFERENCE}' WHERE v.split IN ('validation', 'test')),
acts AS (
  SELECT w.*, g.policy_id FROM wide w CROSS JOIN policies g
  WHERE g.kind <> 'static' OR w.model_id = g.model
  QUALIFY row_number() OVER (PARTITION BY w.prompt_id, g.policy_id ORDER BY
    CASE WHEN g.kind = 'threshold' AND p < g.value THEN 1 WHEN g.kind = 'advantage' AND NOT (c < rc AND p >= rp + g.value) THEN CASE WHEN w.model_id = '{REFERENCE}' THEN 1 ELSE 2 END ELSE 0 END,
    CASE WHEN g.kind = 'utility' THEN -(p - g.value * c / top) WHEN g.kind = 'threshold' AND p < g.value THEN -p ELSE c END,
    CASE WHEN g.kind = 'utility' OR (g.kind = 'threshold' AND p < g.value) THEN c ELSE -p END, w.model_id) = 1),
vacts AS (SELECT * FROM acts WHERE split = 'validation'),
summary AS (SELECT policy_id, round(avg(y), 12) AS quality, round(avg(cost), 12) AS cost FROM vacts GROUP BY 1)
"""
)


def actions(spark, sf_dir, split: str = "validation") -> DataFrame:
    return routing.grid_actions(pools(spark, sf_dir, split), POLICIES, REFERENCE).select("prompt_id", "dataset", "text_group", "policy_id", "it.*")


def summary(spark, sf_dir) -> DataFrame:
    return actions(spark, sf_dir).groupBy("policy_id").agg(F.round(F.avg("y"), 12).alias("quality"), F.round(F.avg("cost"), 12).alias("cost"))


@query("grid_actions", GRID_SQL + "SELECT policy_id, model_id, count(*) AS n FROM vacts GROUP BY ALL")
def grid_actions(spark, sf_dir):
    return actions(spark, sf_dir).groupBy("policy_id", "model_id").agg(F.count("*").alias("n"))


@query("realized_outcomes", GRID_SQL + "SELECT prompt_id, model_id, y, round(cost, 9) AS cost FROM vacts WHERE policy_id = 'threshold_0.70'")
def realized_outcomes(spark, sf_dir):
    return actions(spark, sf_dir).where("policy_id = 'threshold_0.70'").select("prompt_id", "model_id", "y", F.round("cost", 9).alias("cost"))


@query(
    "policy_summary",
    GRID_SQL
    + """, by_set AS (SELECT policy_id, dataset, count(*) AS n, avg(y) AS quality, avg(cost) AS mean_cost, quantile_cont(cost, 0.5) AS median_cost FROM vacts GROUP BY ALL)
SELECT policy_id, dataset, n, round(quality, 9) AS quality, round(mean_cost, 9) AS mean_cost, round(median_cost, 9) AS median_cost FROM (
  SELECT * FROM by_set UNION ALL SELECT policy_id, '__micro__', count(*), avg(y), avg(cost), quantile_cont(cost, 0.5) FROM vacts GROUP BY 1
  UNION ALL SELECT policy_id, '__macro__', CAST(sum(n) AS BIGINT), avg(quality), avg(mean_cost), NULL FROM by_set GROUP BY 1)""",
)
def policy_summary(spark, sf_dir):
    """Each dataset, all prompts, and the mean of the datasets' means (whose n is all rows and whose median is null)."""
    sets = actions(spark, sf_dir).rollup("policy_id", "dataset").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("y").alias("quality"), F.avg("cost").alias("mean_cost"), F.percentile("cost", F.lit(0.5)).alias("median_cost")
    ).where("g < 3")
    macro = sets.where("g = 0").groupBy("policy_id").agg(F.sum("n").alias("n"), F.avg("quality").alias("quality"), F.avg("mean_cost").alias("mean_cost")).withColumns({"dataset": F.lit("__macro__"), "median_cost": F.lit(None).cast("double")})
    out = sets.drop("g").fillna("__micro__", ["dataset"]).unionByName(macro)
    return out.withColumns({c: F.round(c, 9) for c in ("quality", "mean_cost", "median_cost")})


def _first(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order).limit(1)


@query("select_validation", GRID_SQL + "SELECT policy_id, round(quality, 9) AS quality, round(cost, 9) AS cost FROM summary WHERE quality >= (SELECT max(quality) FROM summary) - 0.005::DOUBLE ORDER BY cost, quality DESC, policy_id LIMIT 1")
def select_validation(spark, sf_dir):
    """Cheapest policy whose quality is within the slack of the best one's."""
    s = summary(spark, sf_dir).withColumn("best", F.max("quality").over(Window.partitionBy()))
    kept = s.where(F.col("quality") >= F.col("best") - routing.SLACK)
    return _first(kept, "cost", F.desc("quality"), "policy_id").select("policy_id", F.round("quality", 9).alias("quality"), F.round("cost", 9).alias("cost"))


@query(
    "select_budget",
    GRID_SQL
    + """SELECT b.budget, s.policy_id FROM (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) b(budget) LEFT JOIN LATERAL (
  SELECT policy_id FROM summary WHERE cost <= b.budget * (SELECT cost FROM summary WHERE policy_id = 'static_m7') ORDER BY quality DESC, cost, policy_id LIMIT 1) s ON true""",
)
def select_budget(spark, sf_dir):
    """Best quality within each share of the dearest static policy's cost; null if none is."""
    s = summary(spark, sf_dir).withColumn("whole", F.max(F.when(F.col("policy_id") == "static_m7", F.col("cost"))).over(Window.partitionBy()))
    each = s.select("*", F.explode(F.array(*[F.lit(b) for b in routing.BUDGETS])).alias("budget"))
    key = F.when(F.col("cost") <= F.col("budget") * F.col("whole"), F.struct((-F.col("quality")).alias("q"), "cost", "policy_id"))
    return each.groupBy("budget").agg(F.min(key)["policy_id"].alias("policy_id"))


@query(
    "pareto_frontier",
    GRID_SQL + "SELECT policy_id, NOT EXISTS (SELECT 1 FROM summary b WHERE b.cost <= a.cost AND b.quality >= a.quality AND (b.cost < a.cost OR b.quality > a.quality)) AS efficient FROM summary a",
)
def pareto_frontier(spark, sf_dir):
    """A policy is efficient if no other is as cheap and as good and better in one of the two. The policies are sorted once:
    better ones can only come before, and a running maximum of quality tells whether one does."""
    s = summary(spark, sf_dir)
    ranked = s.withColumn("place", F.dense_rank().over(Window.orderBy("cost")))
    earlier = Window.orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    seen = ranked.withColumn("same", F.max("quality").over(Window.partitionBy("place"))).withColumn("before", F.max("quality").over(earlier))
    return seen.select("policy_id", ((F.col("quality") == F.col("same")) & (F.col("before").isNull() | (F.col("before") < F.col("quality")))).alias("efficient"))


@query(
    "envelopes",
    GRID_SQL
    + """, best AS (SELECT max(quality) AS q, arg_max(cost, (quality, -cost)) AS c FROM summary WHERE starts_with(policy_id, 'static_'))
SELECT e.slack, (SELECT policy_id FROM summary, best WHERE quality >= best.q - e.slack ORDER BY cost, quality DESC, policy_id LIMIT 1) AS policy_id,
  round((SELECT 1 - min(cost) / any_value(best.c) FROM summary, best WHERE quality >= best.q - e.slack), 9) AS savings FROM (VALUES (0.0::DOUBLE), (0.005::DOUBLE)) e(slack)""",
)
def envelopes(spark, sf_dir):
    """Largest saving at the best static quality, without and with slack."""
    s = summary(spark, sf_dir)
    best = s.where(F.startswith("policy_id", F.lit("static_"))).agg(F.max(F.struct("quality", (-F.col("cost")).alias("minus"))).alias("b")).select(F.col("b.quality").alias("q"), (-F.col("b.minus")).alias("bc"))
    each = s.crossJoin(F.broadcast(best)).select("*", F.explode(F.array(F.lit(0.0), F.lit(0.005))).alias("slack")).where(F.col("quality") >= F.col("q") - F.col("slack"))
    picked = each.groupBy("slack", "bc").agg(F.min(F.struct("cost", (-F.col("quality")).alias("m"), "policy_id")).alias("it"))
    return picked.select("slack", "it.policy_id", F.round(1 - F.col("it.cost") / F.col("bc"), 9).alias("savings"))


@query("evaluate_policies", GRID_SQL + "SELECT policy_id, count(*) AS n, round(avg(y), 9) AS quality, round(avg(cost), 9) AS cost FROM acts WHERE split = 'test' GROUP BY 1 UNION ALL SELECT '__oracle__', count(*), round(avg(y), 9), round(avg(cost), 9) FROM (SELECT y, cost FROM cand WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY y DESC, CASE WHEN y = 1 THEN cost ELSE c END, model_id) = 1)")
def evaluate_policies(spark, sf_dir):
    rows = pools(spark, sf_dir, "test")
    every = routing.grid_actions(rows, POLICIES, REFERENCE).select("policy_id", "it")
    every = every.unionByName(rows.select(F.lit("__oracle__").alias("policy_id"), routing.oracle(F.col("pool")).alias("it")))
    return every.groupBy("policy_id").agg(F.count("*").alias("n"), F.round(F.avg("it.y"), 9).alias("quality"), F.round(F.avg("it.cost"), 9).alias("cost"))


_PAIR_SQL = GRID_SQL + ", pair AS (SELECT a.prompt_id, a.dataset, a.text_group, a.y AS ry, b.y AS by_, a.cost AS rc, b.cost AS bc FROM vacts a JOIN vacts b USING (prompt_id) WHERE a.policy_id = 'threshold_0.70' AND b.policy_id = 'static_m6')\n"


def pairs(spark, sf_dir) -> DataFrame:
    """A router beside its baseline on the same prompts: both come from one array, so there is no join."""
    pool_ = F.col("pool")
    rows = pools(spark, sf_dir).select("prompt_id", "dataset", "text_group", routing.threshold(pool_, F.lit(0.7)).alias("r"), routing.static(pool_, F.lit("m6")).alias("b"))
    return rows.select("prompt_id", "dataset", "text_group", F.col("r.y").alias("ry"), F.col("b.y").alias("by_"), F.col("r.cost").alias("rc"), F.col("b.cost").alias("bc"))


@query("paired_delta", _PAIR_SQL + "SELECT dataset, count(*) AS n, round(avg(ry - by_), 9) AS quality_delta, round(1 - avg(rc) / avg(bc), 9) AS savings FROM pair GROUP BY dataset")
def paired_delta(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ry") - F.col("by_")), 9).alias("quality_delta"), F.round(1 - F.avg("rc") / F.avg("bc"), 9).alias("savings"))


@query(
    "acceptance",
    _PAIR_SQL
    + """, d AS (SELECT dataset, avg(ry - by_) AS q, avg(rc) AS rc, avg(bc) AS bc FROM pair GROUP BY 1)
SELECT (SELECT 1 - avg(rc) / avg(bc) >= 0.1 FROM pair) AS saves, (SELECT avg(ry - by_) >= -0.005 FROM pair) AS micro, (SELECT avg(q) >= -0.005 FROM d) AS macro, (SELECT min(q) >= -0.005 FROM d) AS every_dataset""",
)
def acceptance(spark, sf_dir):
    p = pairs(spark, sf_dir)
    sets = p.groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.col("ry") - F.col("by_")).alias("q"), F.sum("rc").alias("rc"), F.sum("bc").alias("bc"))
    mean = F.col("q") / F.col("n")
    return sets.agg(
        (1 - F.sum("rc") / F.sum("bc") >= 0.1).alias("saves"), (F.sum("q") / F.sum("n") >= -routing.SLACK).alias("micro"), (F.avg(mean) >= -routing.SLACK).alias("macro"), (F.min(mean) >= -routing.SLACK).alias("every_dataset")
    )


@query(
    "oracle_gap",
    _PAIR_SQL
    + """, o AS (SELECT dataset, avg(y) AS oy FROM (SELECT dataset, y FROM val QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY y DESC, cost, model_id) = 1) GROUP BY 1)
SELECT dataset, CASE WHEN oy - b > 0 THEN round((r - b) / (oy - b), 9) END AS recovered FROM (SELECT dataset, avg(ry) AS r, avg(by_) AS b FROM pair GROUP BY 1) JOIN o USING (dataset)""",
)
def oracle_gap(spark, sf_dir):
    pool_ = F.col("pool")
    rows = pools(spark, sf_dir).select("dataset", routing.threshold(pool_, F.lit(0.7))["y"].alias("r"), routing.static(pool_, F.lit("m6"))["y"].alias("b"), routing.oracle(pool_)["y"].alias("o"))
    means = rows.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in "rbo"])
    return means.select("dataset", F.when(F.col("o") - F.col("b") > 0, F.round((F.col("r") - F.col("b")) / (F.col("o") - F.col("b")), 9)).alias("recovered"))


@query("dataset_model_counts", GRID_SQL + "SELECT dataset, " + ", ".join(f"count(*) FILTER (model_id = '{m}') AS {m}" for m in MODEL_IDS) + " FROM vacts WHERE policy_id = 'threshold_0.70' GROUP BY dataset")
def dataset_model_counts(spark, sf_dir):
    chosen = pools(spark, sf_dir).select("dataset", routing.threshold(F.col("pool"), F.lit(0.7))["model_id"].alias("model_id"))
    return chosen.groupBy("dataset").pivot("model_id", list(MODEL_IDS)).count().fillna(0)


@query(
    "selection_distribution",
    GRID_SQL
    + """, s AS (SELECT * FROM vacts WHERE policy_id = 'threshold_0.70')
SELECT m.model_id, count(s.prompt_id) AS n, round(count(s.prompt_id) / (SELECT count(*) FROM s), 9) AS share, round(avg(s.p), 9) AS mean_p, round(avg(s.y), 9) AS quality, round(avg(s.cost), 9) AS cost FROM pool m LEFT JOIN s USING (model_id) GROUP BY m.model_id""",
)
def selection_distribution(spark, sf_dir):
    chosen = pools(spark, sf_dir).select(routing.threshold(F.col("pool"), F.lit(0.7)).alias("it")).select("it.*")
    stats = chosen.groupBy("model_id").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("quality"), F.avg("cost").alias("cost"))
    stats = stats.withColumn("total", F.sum("n").over(Window.partitionBy()))
    joined = pool(spark).select("model_id").join(stats, "model_id", "left").withColumn("total", F.max("total").over(Window.partitionBy()))
    n = F.coalesce("n", F.lit(0))
    return joined.select("model_id", n.alias("n"), F.round(n / F.col("total"), 9).alias("share"), *[F.round(c, 9).alias(c) for c in ("mean_p", "quality", "cost")])


@query("frozen_actions", CAND_SQL + "SELECT policy, model_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT 'static_{m}' AS policy, '{m}' AS model_id FROM val WHERE model_id = '{m}'" for m in MODEL_IDS) + " UNION ALL SELECT 'oracle', model_id FROM (" + _pick("y DESC, CASE WHEN y = 1 THEN cost ELSE c END, model_id") + ") UNION ALL SELECT 'hindsight', model_id FROM (" + _pick("cost, model_id") + ")) GROUP BY ALL")
def frozen_actions(spark, sf_dir):
    pool_ = F.col("pool")
    named = [(f"static_{m}", routing.static(pool_, F.lit(m))) for m in MODEL_IDS] + [("oracle", routing.oracle(pool_)), ("hindsight", routing.hindsight_cheapest(pool_))]
    rows = pools(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), it["model_id"].alias("model_id")) for n, it in named])).alias("x")).select("x.*")
    return rows.groupBy("policy", "model_id").agg(F.count("*").alias("n"))


@query("dedupe_actions", GRID_SQL + "SELECT actions, count(*) AS policies, min(policy_id) AS first_policy FROM (SELECT policy_id, sha256(string_agg(prompt_id || '=' || model_id, ',' ORDER BY prompt_id)) AS actions FROM vacts GROUP BY 1) GROUP BY 1")
def dedupe_actions(spark, sf_dir):
    """Policies that act alike on all prompts."""
    cells = actions(spark, sf_dir).groupBy("policy_id").agg(F.sort_array(F.collect_list(F.struct("prompt_id", "model_id"))).alias("cells"))
    text = F.array_join(F.transform("cells", lambda x: F.concat(x["prompt_id"], F.lit("="), x["model_id"])), ",")
    return cells.select("policy_id", F.sha2(text, 256).alias("actions")).groupBy("actions").agg(F.count("*").alias("policies"), F.min("policy_id").alias("first_policy"))


# -- model summaries and classifier metrics -------------------------------------------------------------------------


@query("model_summary", BASE_SQL + "SELECT model_id, count(*) AS n, round(avg(success), 9) AS success, round(avg(raw_score), 9) AS raw_score, round(CAST(sum(CAST(round(cost_usd * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6, 9) AS mean_cost, round(quantile_cont(cost_usd, 0.5), 9) AS median_cost, round(count(*) / (SELECT count(*) FROM prompts), 9) AS coverage FROM outcomes WHERE eligible GROUP BY 1")
def model_summary(spark, sf_dir):
    from pathfold.plans.bridge import prompts
    from pathfold.plans.prep_queries import outcomes

    total = prompts(spark, sf_dir).agg(F.count("*").alias("total"))
    rows = outcomes(spark, sf_dir).where("eligible").select("model_id", "success", "raw_score", "cost_usd")
    stats = with_median(rows.groupBy("model_id").agg(F.count("*").alias("n"), *_means()), rows, "model_id")
    return stats.crossJoin(F.broadcast(total)).withColumn("coverage", F.round(F.col("n") / F.col("total"), 9)).drop("total")


def _means() -> list:
    """Costs are whole micro-dollars, so their sum is exact and the mean does not hang on the order of rows."""
    micro = F.sum(F.round(F.col("cost_usd") * 1e6).cast("bigint")).cast("double")
    return [F.round(F.avg("success"), 9).alias("success"), F.round(F.avg("raw_score"), 9).alias("raw_score"), F.round(micro / F.count("*") / 1e6, 9).alias("mean_cost")]


def with_median(stats: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """stats with the exact median cost of each key, however many rows a key has."""
    medians = scan.quantiles(rows, list(keys), "cost_usd", (0.5,))
    return stats.join(medians, list(keys), "left").select(*stats.columns, F.round(F.col("q")[0], 9).alias("median_cost"))


@query("static_model_summary", BASE_SQL + "SELECT split, coalesce(dataset, '__all__') AS dataset, model_id, count(*) AS n, round(avg(success), 9) AS success, round(avg(raw_score), 9) AS raw_score, round(CAST(sum(CAST(round(cost_usd * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6, 9) AS mean_cost, round(quantile_cont(cost_usd, 0.5), 9) AS median_cost FROM parts GROUP BY GROUPING SETS ((split, model_id), (split, dataset, model_id))")
def static_model_summary(spark, sf_dir):
    rows = parts(spark, sf_dir).select("split", "model_id", "success", "raw_score", "cost_usd", F.explode(F.array("dataset", F.lit("__all__"))).alias("dataset"))
    rows = freeze(rows, "summary-rows")  # read for the means and for the medians
    return with_median(rows.groupBy("split", "dataset", "model_id").agg(F.count("*").alias("n"), *_means()), rows, "split", "dataset", "model_id")


@query("calibration_bins", BASE_SQL + "SELECT model_id, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(success), 9) AS observed FROM parts WHERE split <> 'train' GROUP BY ALL")
def calibration_bins(spark, sf_dir):
    rows = parts(spark, sf_dir).where("split <> 'train'")
    return rows.groupBy("model_id", F.least(F.floor(F.col("p") * 10), F.lit(9).cast("bigint")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.avg("success"), 9).alias("observed"))


@query("calibration_scores", BASE_SQL + ", b AS (SELECT model_id, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(success) AS o, sum((p - success) * (p - success)) AS s FROM parts WHERE split <> 'train' GROUP BY ALL) SELECT model_id, round(sum(s) / sum(n), 9) AS brier, round(sum(n * abs(mp - o)) / sum(n), 9) AS ece FROM b GROUP BY 1")
def calibration_scores(spark, sf_dir):
    rows = parts(spark, sf_dir).where("split <> 'train'")
    gap = F.col("p") - F.col("success")
    bins = rows.groupBy("model_id", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("success").alias("o"), F.sum(gap * gap).alias("s"))
    return bins.groupBy("model_id").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("o"))) / F.sum("n"), 9).alias("ece"))


_CLIP = "least(greatest(p, 1e-6), 1 - 1e-6)"


@query("log_loss", BASE_SQL + f"SELECT model_id, round(avg(-(success * ln({_CLIP}) + (1 - success) * ln(1 - {_CLIP}))), 9) AS log_loss FROM parts WHERE split <> 'train' GROUP BY 1")
def log_loss(spark, sf_dir):
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(F.col("success") * F.log(p) + (1 - F.col("success")) * F.log(1 - p))
    return parts(spark, sf_dir).where("split <> 'train'").groupBy("model_id").agg(F.round(F.avg(loss), 9).alias("log_loss"))


_CURVE_SQL = """, tied AS (SELECT model_id, p, CAST(sum(success) AS BIGINT) AS pos, count(*) - CAST(sum(success) AS BIGINT) AS neg FROM parts WHERE split <> 'train' GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model_id) AS np, sum(neg) OVER (PARTITION BY model_id) AS nn FROM tied WINDOW w AS (PARTITION BY model_id ORDER BY p DESC))
"""


def score_curve(rows: DataFrame) -> DataFrame:
    """Equal scores are one step of the curve: they are summed before the running totals, which are made by ranges of scores, so one
    model may hold all rows."""
    tied = rows.groupBy("model_id", "p").agg(F.sum("success").alias("pos"), (F.count("*") - F.sum("success")).alias("neg"))
    tied = freeze(tied, "tied")
    curve = scan.running(tied, ["model_id"], [-F.col("p")], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))})
    whole = tied.groupBy("model_id").agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return curve.join(F.broadcast(whole), "model_id")  # a row for each model of the pool


@query("roc_auc", BASE_SQL + _CURVE_SQL + "SELECT model_id, round(CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / (2 * CAST(any_value(np) * any_value(nn) AS DOUBLE)), 9) AS auc FROM curve GROUP BY 1")
def roc_auc(spark, sf_dir):
    c = score_curve(parts(spark, sf_dir).where("split <> 'train'"))
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))).cast("double")
    return c.groupBy("model_id").agg(F.round(area / (2 * (F.first("np") * F.first("nn")).cast("double")), 9).alias("auc"))


@query("average_precision", BASE_SQL + _CURVE_SQL + "SELECT model_id, round(sum(CAST(pos AS DOUBLE) / np * tp / (tp + fp)), 9) AS ap FROM curve GROUP BY 1")
def average_precision(spark, sf_dir):
    c = score_curve(parts(spark, sf_dir).where("split <> 'train'"))
    return c.groupBy("model_id").agg(F.round(F.sum(F.col("pos").cast("double") / F.col("np") * F.col("tp") / (F.col("tp") + F.col("fp"))), 9).alias("ap"))


_METRICS_SQL = BASE_SQL + _CURVE_SQL + """, m AS (SELECT model_id, avg(success) AS prevalence, avg(CAST((p >= 0.5) = (success = 1) AS INT)) AS accuracy FROM parts WHERE split <> 'train' GROUP BY 1),
a AS (SELECT model_id, CASE WHEN any_value(np) > 0 AND any_value(nn) > 0 THEN CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / (2 * CAST(any_value(np) * any_value(nn) AS DOUBLE)) END AS auc FROM curve GROUP BY 1)
"""


def _metrics(spark, sf_dir) -> DataFrame:
    rows = parts(spark, sf_dir).where("split <> 'train'")
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))).cast("double") / (2 * (F.first("np") * F.first("nn")).cast("double"))
    auc = score_curve(rows).groupBy("model_id").agg(F.when((F.first("np") > 0) & (F.first("nn") > 0), area).alias("auc"))
    base = rows.groupBy("model_id").agg(F.avg("success").alias("prevalence"), F.avg(((F.col("p") >= 0.5) == (F.col("success") == 1)).cast("int")).alias("accuracy"))
    return base.join(auc, "model_id")


@query("binary_metrics", _METRICS_SQL + "SELECT model_id, round(prevalence, 9) AS prevalence, round(accuracy, 9) AS accuracy, round(auc, 9) AS auc FROM m JOIN a USING (model_id)")
def binary_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("model_id", *[F.round(c, 9).alias(c) for c in ("prevalence", "accuracy", "auc")])


@query("classifier_diagnostics", _METRICS_SQL + "SELECT model_id, round(prevalence, 9) AS prevalence, round(accuracy, 9) AS accuracy, round(auc, 9) AS auc FROM m JOIN a USING (model_id) UNION ALL SELECT '__macro__', round(avg(prevalence), 9), round(avg(accuracy), 9), round(avg(auc), 9) FROM m JOIN a USING (model_id)")
def classifier_diagnostics(spark, sf_dir):
    rows = _metrics(spark, sf_dir).rollup("model_id").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("prevalence", "accuracy", "auc")])
    return rows.fillna("__macro__", ["model_id"])


@query("composition_check", GRID_SQL + "SELECT d.dataset AS without, round(avg(v.y) FILTER (v.dataset <> d.dataset), 9) AS quality, round(avg(v.cost) FILTER (v.dataset <> d.dataset), 9) AS cost FROM vacts v CROSS JOIN (SELECT DISTINCT dataset FROM prompts) d WHERE policy_id = 'threshold_0.70' GROUP BY 1")
def composition_check(spark, sf_dir):
    """Leave each dataset out: totals minus its own sums, one pass over the prompts."""
    chosen = pools(spark, sf_dir).select("dataset", routing.threshold(F.col("pool"), F.lit(0.7)).alias("it"))
    sets = chosen.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("it.y").alias("y"), F.sum("it.cost").alias("c"))
    every = Window.partitionBy()
    rest = lambda x: F.sum(x).over(every) - F.col(x)
    return sets.select(F.col("dataset").alias("without"), F.round(rest("y") / rest("n"), 9).alias("quality"), F.round(rest("c") / rest("n"), 9).alias("cost"))


@query("regime_comparison", CAND_SQL + "SELECT a.model_id, count(*) AS n, round(avg(b.y - a.y), 9) AS delta FROM cand a JOIN (SELECT prompt_id, y FROM cand WHERE model_id = 'm6') b USING (prompt_id) WHERE a.dataset = 'de' AND a.split = 'test' GROUP BY 1")
def regime_comparison(spark, sf_dir):
    rows = matrix(spark, sf_dir).where("dataset = 'de'").join(parts(spark, sf_dir).where("split = 'test'").select("prompt_id").distinct(), "prompt_id", "left_semi")
    ref = F.max(F.when(F.col("model_id") == "m6", F.col("success").cast("double"))).over(Window.partitionBy("prompt_id"))
    return rows.withColumn("ref", ref).groupBy("model_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ref") - F.col("success")), 9).alias("delta"))


@query(
    "holdout_behavior",
    GRID_SQL + "SELECT dataset, round(avg(CAST(model_id = 'm6' AS INT)), 9) AS to_reference, round(1 - avg(cost) / avg(bc), 9) AS savings FROM (SELECT v.dataset, v.model_id, v.cost, b.cost AS bc FROM vacts v JOIN vacts b USING (prompt_id) WHERE v.policy_id = 'advantage_0.05' AND b.policy_id = 'static_m6') GROUP BY 1",
)
def holdout_behavior(spark, sf_dir):
    pool_ = F.col("pool")
    rows = pools(spark, sf_dir).select("dataset", routing.advantage(pool_, F.lit(0.05), REFERENCE).alias("a"), routing.static(pool_, F.lit(REFERENCE)).alias("b"))
    return rows.groupBy("dataset").agg(F.round(F.avg((F.col("a.model_id") == REFERENCE).cast("int")), 9).alias("to_reference"), F.round(1 - F.avg("a.cost") / F.avg("b.cost"), 9).alias("savings"))


@query(
    "fold_stability",
    _PAIR_SQL + ", f AS (SELECT *, CAST('0x' || substr(sha256('fold:' || text_group), 1, 8) AS BIGINT) % 5 AS fold FROM pair) SELECT fold, count(*) AS n, round(avg(ry - by_), 9) AS delta, round(1 - avg(rc) / avg(bc), 9) AS savings, avg(ry - by_) >= -0.005 AS passes FROM f GROUP BY 1",
)
def fold_stability(spark, sf_dir):
    fold = F.conv(F.substring(F.sha2(F.concat(F.lit("fold:"), "text_group"), 256), 1, 8), 16, 10).cast("bigint") % 5
    d = F.avg(F.col("ry") - F.col("by_"))
    return pairs(spark, sf_dir).groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), F.round(d, 9).alias("delta"), F.round(1 - F.avg("rc") / F.avg("bc"), 9).alias("savings"), (d >= -routing.SLACK).alias("passes"))
