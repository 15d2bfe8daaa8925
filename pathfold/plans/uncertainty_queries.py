"""Queries of the uncertainty operators and of the novelty gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.operators import novelty, routing, scan
from pathfold.operators import uncertainty as unc
from pathfold.plans.bridge import MODEL_IDS, REFERENCE, SEED, table
from pathfold.plans.registry import query
from pathfold.plans.routing_queries import _PAIR_SQL, GRID_SQL, pairs, pools
from pathfold.sources.storage import freeze

REPLICATES = 2000
ADVANTAGES = tuple(f"advantage_{v:.2f}" for v in routing.MARGINS)


@query("bootstrap_strata", _PAIR_SQL + "SELECT dataset AS stratum, count(DISTINCT text_group) AS groups, count(*) AS prompts, (SELECT count(*) FROM (SELECT text_group FROM pair GROUP BY 1 HAVING count(DISTINCT dataset) > 1)) AS crossing FROM pair GROUP BY 1")
def bootstrap_strata(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    crossing = rows.groupBy("text_group").agg(F.countDistinct("dataset").alias("d")).agg(F.count_if(F.col("d") > 1).alias("crossing"))
    return rows.groupBy(F.col("dataset").alias("stratum")).agg(F.countDistinct("text_group").alias("groups"), F.count("*").alias("prompts")).crossJoin(F.broadcast(crossing))


def _draw_sql(groups: str) -> str:
    """multiplicities of a CTE groups(stratum, g)."""
    return f""", strata_n AS (SELECT stratum, count(DISTINCT g) AS groups FROM {groups} GROUP BY 1),
mults AS (SELECT replicate, stratum, CAST('0x' || substr(sha256('{SEED}:' || replicate || ':' || stratum || ':' || k), 1, 8) AS BIGINT) % groups AS g, count(*) AS mult
  FROM (SELECT stratum, groups, replicate, unnest(range(groups)) AS k FROM strata_n CROSS JOIN (SELECT unnest(range({REPLICATES})) AS replicate)) GROUP BY ALL)
"""


_BOOT_SQL = (
    _PAIR_SQL
    + ", gs AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY text_group) - 1 AS g FROM (SELECT dataset AS stratum, text_group, count(*) AS n, sum(ry) AS ry, sum(by_) AS by_, sum(rc) AS rc, sum(bc) AS bc FROM pair GROUP BY ALL))"
    + _draw_sql("gs")
    + """, sets AS (SELECT replicate, stratum, sum(mult * n) AS n, sum(mult * ry) AS ry, sum(mult * by_) AS by_, sum(mult * rc) AS rc, sum(mult * bc) AS bc FROM mults JOIN gs USING (stratum, g) GROUP BY ALL),
reps AS (SELECT replicate, sum(ry) / sum(n) - sum(by_) / sum(n) AS quality_delta, 1 - (sum(rc) / sum(n)) / (sum(bc) / sum(n)) AS cost_savings,
  avg(ry / n) - avg(by_ / n) AS macro_quality_delta, 1 - avg(rc / n) / avg(bc / n) AS macro_cost_savings FROM sets GROUP BY 1)
"""
)


def bootstrap_replicates(rows: DataFrame) -> DataFrame:
    values = ["ry", "by_", "rc", "bc"]
    means = unc.replicate_means(freeze(unc.group_sums(rows, values), "group-sums"), values, REPLICATES, SEED)
    pick = lambda metric, v: F.max(F.when(F.col("metric") == metric, F.col(v)))
    return means.groupBy("replicate").agg(
        (pick("__micro__", "ry") - pick("__micro__", "by_")).alias("quality_delta"), (1 - pick("__micro__", "rc") / pick("__micro__", "bc")).alias("cost_savings"),
        (pick("__macro__", "ry") - pick("__macro__", "by_")).alias("macro_quality_delta"), (1 - pick("__macro__", "rc") / pick("__macro__", "bc")).alias("macro_cost_savings"),
    )


_NAMES = ("quality_delta", "cost_savings", "macro_quality_delta", "macro_cost_savings")


@query("paired_bootstrap", _BOOT_SQL + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(quantile_cont({n}, 0.025), 9) AS low, round(quantile_cont({n}, 0.975), 9) AS high, {'quantile_cont(quality_delta, 0.025) >= -0.005' if n == 'quality_delta' else 'NULL'} AS noninferior FROM reps" for n in _NAMES))
def paired_bootstrap(spark, sf_dir):
    reps = bootstrap_replicates(pairs(spark, sf_dir))
    long = reps.select(F.explode(F.create_map(*[x for n in _NAMES for x in (F.lit(n), F.col(n))])).alias("metric", "v"))
    ends = long.groupBy("metric").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return ends.select("metric", F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"), F.when(F.col("metric") == "quality_delta", F.col("q")[0] >= -0.005).alias("noninferior"))


# -- simultaneous bounds --------------------------------------------------------------------------------------------


def evidence_rows(spark, sf_dir) -> DataFrame:
    """Advantage policies beside the reference on validation (ordinary) and test (source_holdout) prompts."""
    pool_ = F.col("pool")
    ref = routing.static(pool_, F.lit(REFERENCE))
    policies = F.array(*[F.struct(F.lit(f"advantage_{v:.2f}").alias("policy_id"), routing.advantage(pool_, F.lit(v), REFERENCE).alias("it")) for v in routing.MARGINS])
    rows = pools(spark, sf_dir, None).where("split <> 'train'").select("prompt_id", "dataset", "text_group", F.when(F.col("split") == "validation", "ordinary").otherwise("source_holdout").alias("block"), ref.alias("ref"), F.inline(policies))
    return rows.select("block", "policy_id", "prompt_id", "dataset", "text_group", F.col("it.y").alias("success"), (F.col("it.y") - F.col("ref.y")).alias("delta"), F.col("it.cost").alias("cost"))


_EVIDENCE_SQL = (
    GRID_SQL
    + f""", ev AS (SELECT CASE WHEN a.split = 'validation' THEN 'ordinary' ELSE 'source_holdout' END AS block, a.policy_id, a.prompt_id, a.dataset, a.text_group, a.y AS success, a.y - b.y AS delta, a.cost
  FROM acts a JOIN acts b USING (prompt_id) WHERE starts_with(a.policy_id, 'advantage_') AND b.policy_id = 'static_{REFERENCE}')
"""
)


@query("evidence", _EVIDENCE_SQL + "SELECT block, policy_id, dataset, count(*) AS n, round(avg(success), 9) AS success, round(avg(delta), 9) AS delta, round(avg(cost), 9) AS cost FROM ev GROUP BY ALL")
def evidence(spark, sf_dir):
    return evidence_rows(spark, sf_dir).groupBy("block", "policy_id", "dataset").agg(F.count("*").alias("n"), F.round(F.avg("success"), 9).alias("success"), F.round(F.avg("delta"), 9).alias("delta"), F.round(F.avg("cost"), 9).alias("cost"))


def _bounds_sql(source: str, keys: str) -> str:
    """CTEs from source(keys, dataset, text_group, delta): errors(keys, metric, delta, se) and centred replicates."""
    k = keys + ", "
    return f""", gs AS (SELECT {k}dataset AS stratum, text_group, count(*) AS n, sum(delta) AS delta FROM {source} GROUP BY ALL),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY block_, stratum ORDER BY text_group) - 1 AS g FROM (SELECT *, {'block' if 'block' in keys else "'all'"} AS block_ FROM gs)),
strata_n AS (SELECT block_, stratum, count(DISTINCT g) AS groups FROM numbered GROUP BY ALL),
mults AS (SELECT block_, replicate, stratum, CAST('0x' || substr(sha256('{SEED}:' || replicate || ':' || stratum || ':' || k), 1, 8) AS BIGINT) % groups AS g, count(*) AS mult
  FROM (SELECT block_, stratum, groups, replicate, unnest(range(groups)) AS k FROM strata_n CROSS JOIN (SELECT unnest(range({REPLICATES})) AS replicate)) GROUP BY ALL),
sets AS (SELECT {k}replicate, stratum, sum(mult * n) AS n, sum(mult * delta) AS s FROM mults JOIN numbered USING (block_, stratum, g) GROUP BY ALL),
means AS (SELECT {k}replicate, stratum AS metric, s / n AS v FROM sets UNION ALL SELECT {k}replicate, '__micro__', sum(s) / sum(n) FROM sets GROUP BY ALL UNION ALL SELECT {k}replicate, '__macro__', avg(s / n) FROM sets GROUP BY ALL),
seen AS (SELECT {k}stratum, sum(n) AS n, sum(delta) AS s FROM gs GROUP BY ALL),
obs AS (SELECT {k}stratum AS metric, s / n AS delta FROM seen UNION ALL SELECT {k}'__micro__', sum(s) / sum(n) FROM seen GROUP BY ALL UNION ALL SELECT {k}'__macro__', avg(s / n) FROM seen GROUP BY ALL),
errors AS (SELECT {k}metric, o.delta, m.se FROM (SELECT {k}metric, stddev_samp(v) AS se FROM means GROUP BY ALL) m JOIN obs o USING ({k}metric)),
centred AS (SELECT {k}metric, replicate, CASE WHEN se > 1e-12 THEN (v - delta) / se ELSE 0 END AS t FROM means JOIN errors USING ({k}metric))
"""


def joint_bounds_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, policy_id, metric, delta, standard_error, joint_lower, ordinary_only_lower)."""
    sums = freeze(rows.groupBy("block", "policy_id", F.col("dataset").alias("stratum"), "text_group").agg(F.count("*").alias("n"), F.sum("delta").alias("delta")), "group-sums")
    parts_ = []
    for block in ("ordinary", "source_holdout"):
        own = unc.numbered(sums.where(F.col("block") == block))
        means = unc.replicate_means(own, ["delta"], REPLICATES, SEED, "block", "policy_id")
        parts_.append((means, unc.observed_means(own, ["delta"], "block", "policy_id")))
    means, observed = freeze(parts_[0][0].unionByName(parts_[1][0]), "replicates"), parts_[0][1].unionByName(parts_[1][1])
    errors, most = unc.max_t(means, observed, "delta", ["block", "policy_id"], ["block"])
    joint = most.groupBy("replicate").agg(F.max("max_t").alias("joint"), F.max(F.when(F.col("block") == "ordinary", F.col("max_t"))).alias("ordinary"))
    critical = joint.agg(F.percentile("joint", F.lit(0.95)).alias("critical"), F.percentile("ordinary", F.lit(0.95)).alias("ordinary_critical"))
    table_ = errors.crossJoin(F.broadcast(critical))  # one row
    lower = F.col("delta") - F.col("critical") * F.col("standard_error")
    only = F.when(F.col("block") == "ordinary", F.col("delta") - F.col("ordinary_critical") * F.col("standard_error"))
    return table_.withColumns({"joint_lower": lower, "ordinary_only_lower": only}), critical


_JOINT_SQL = (
    _EVIDENCE_SQL
    + _bounds_sql("ev", "block, policy_id")
    + """, tops AS (SELECT block, replicate, greatest(max(t), 0) AS t FROM centred GROUP BY ALL),
crit AS (SELECT quantile_cont(j, 0.95) AS critical, quantile_cont(o, 0.95) AS ordinary_critical FROM (SELECT replicate, max(t) AS j, max(t) FILTER (block = 'ordinary') AS o FROM tops GROUP BY 1)),
bounds AS (SELECT block, policy_id, metric, delta, se, delta - critical * se AS joint_lower, CASE WHEN block = 'ordinary' THEN delta - ordinary_critical * se END AS ordinary_only_lower FROM errors CROSS JOIN crit)
"""
)


@query("joint_bounds", _JOINT_SQL + "SELECT block, policy_id, metric, round(delta, 8) AS quality_delta, round(se, 8) AS standard_error, round(joint_lower, 8) AS joint_lower, round(ordinary_only_lower, 8) AS ordinary_only_lower FROM bounds")
def joint_bounds(spark, sf_dir):
    rows, _ = joint_bounds_of(evidence_rows(spark, sf_dir))
    return rows.select("block", "policy_id", "metric", F.round("delta", 8).alias("quality_delta"), *[F.round(c, 8).alias(c) for c in ("standard_error", "joint_lower", "ordinary_only_lower")])


@query("limiting_bound", _JOINT_SQL + "SELECT policy_id, block, metric, round(joint_lower, 8) AS joint_lower FROM bounds QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY round(joint_lower, 8), block, metric) = 1")
def limiting_bound(spark, sf_dir):
    rows, _ = joint_bounds_of(evidence_rows(spark, sf_dir))
    least = rows.groupBy("policy_id").agg(F.min(F.struct(F.round("joint_lower", 8).alias("joint_lower"), "block", "metric")).alias("it"))
    return least.select("policy_id", "it.block", "it.metric", "it.joint_lower")


_SELECT_SQL = _JOINT_SQL + """, cands AS (SELECT policy_id, avg(success) AS q, avg(cost) AS c FROM ev WHERE block = 'ordinary' GROUP BY 1),
feas AS (SELECT c.*, w.worst >= -0.005 AS feasible, w.own >= -0.005 AS ordinary_feasible FROM cands c JOIN (SELECT policy_id, min(joint_lower) AS worst, min(ordinary_only_lower) AS own FROM bounds GROUP BY 1) w USING (policy_id)
  UNION ALL SELECT 'fixed', avg(success - delta), (SELECT avg(cost) FROM vacts WHERE policy_id = 'static_m6'), true, true FROM ev WHERE block = 'ordinary' AND policy_id = 'advantage_0.00')
"""


@query("select_joint", _SELECT_SQL + "SELECT (SELECT policy_id FROM feas WHERE feasible ORDER BY round(c, 12), q DESC, policy_id LIMIT 1) AS selected, (SELECT policy_id FROM feas WHERE ordinary_feasible ORDER BY round(c, 12), q DESC, policy_id LIMIT 1) AS control, (SELECT count(*) FROM feas WHERE feasible) AS feasible_count")
def select_joint(spark, sf_dir):
    """Cheapest policy all of whose joint lower bounds clear the margin, and the control that looks at ordinary validation
    only; the fixed reference always qualifies."""
    rows = freeze(evidence_rows(spark, sf_dir), "evidence")
    bounds, _ = joint_bounds_of(rows)
    worst = bounds.groupBy("policy_id").agg((F.min("joint_lower") >= -routing.SLACK).alias("feasible"), (F.min("ordinary_only_lower") >= -routing.SLACK).alias("ordinary_feasible"))
    ordinary = rows.where("block = 'ordinary'")
    means = ordinary.groupBy("policy_id").agg(F.avg("success").alias("q"), F.round(F.avg("cost"), 12).alias("c")).join(worst, "policy_id")
    ref = routing.static(F.col("pool"), F.lit(REFERENCE))
    fixed = pools(spark, sf_dir).select(ref.alias("it")).agg(F.avg("it.y").alias("q"), F.round(F.avg("it.cost"), 12).alias("c")).withColumns({"policy_id": F.lit("fixed"), "feasible": F.lit(True), "ordinary_feasible": F.lit(True)})
    every = means.unionByName(fixed)
    key = F.struct("c", (-F.col("q")).alias("m"), "policy_id")
    return every.agg(F.min(F.when(F.col("feasible"), key))["policy_id"].alias("selected"), F.min(F.when(F.col("ordinary_feasible"), key))["policy_id"].alias("control"), F.count_if("feasible").alias("feasible_count"))


@query("quantiles", "SELECT event_type, round(quantile_cont(value, 0.01), 9) AS q01, round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.95), 9) AS q95 FROM events GROUP BY 1")
def quantiles(spark, sf_dir):
    found = scan.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", (0.01, 0.5, 0.95))
    return found.select("event_type", *[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(("q01", "q50", "q95"))])


# -- novelty --------------------------------------------------------------------------------------------------------

_SIM = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"
_NOVEL_SQL = f"""WITH refs AS (SELECT * FROM embeddings WHERE vec_id % 2 = 0), asks AS (SELECT * FROM embeddings WHERE vec_id % 2 = 1),
fitted AS (SELECT a.vec_id, max({_SIM}) AS sim FROM refs a JOIN refs b ON a.label <> b.label GROUP BY 1),
asked AS (SELECT a.vec_id, max({_SIM}) AS sim FROM asks a CROSS JOIN refs b GROUP BY 1),
cuts AS (SELECT quantile_cont(sim, 0.01) AS c01, quantile_cont(sim, 0.05) AS c05, quantile_cont(sim, 0.1) AS c10 FROM fitted)
"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")


@query("novelty_similarity", _NOVEL_SQL + "SELECT vec_id, round(sim, 6) AS similarity FROM asked")
def novelty_similarity(spark, sf_dir):
    refs, asks = _sides(spark, sf_dir)
    return novelty.max_similarity(asks, refs).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("novelty_cutoffs", _NOVEL_SQL + "SELECT round(c01, 6) AS c01, round(c05, 6) AS c05, round(c10, 6) AS c10 FROM cuts")
def novelty_cutoffs(spark, sf_dir):
    refs, _ = _sides(spark, sf_dir)
    return novelty.cutoffs(novelty.max_similarity(refs, refs, other_groups=True)).select(*[F.round(c, 6).alias(c) for c in ("c01", "c05", "c10")])


def _gated(spark, sf_dir) -> DataFrame:
    refs, asks = _sides(spark, sf_dir)
    cut = novelty.cutoffs(novelty.max_similarity(refs, refs, other_groups=True))
    return novelty.max_similarity(asks, refs).crossJoin(F.broadcast(cut))  # one row


@query("novelty_gate", _NOVEL_SQL + "SELECT vec_id, CASE WHEN sim < c10 THEN 'm6' ELSE 'm0' END AS model_id FROM asked CROSS JOIN cuts")
def novelty_gate(spark, sf_dir):
    """Below the cutoff the reference answers; equality passes."""
    return _gated(spark, sf_dir).select("vec_id", F.when(F.col("similarity") < F.col("c10"), REFERENCE).otherwise("m0").alias("model_id"))


@query("gate_rejection", _NOVEL_SQL + "SELECT round(avg(CAST(sim < c01 AS INT)), 9) AS r01, round(avg(CAST(sim < c05 AS INT)), 9) AS r05, round(avg(CAST(sim < c10 AS INT)), 9) AS r10 FROM asked CROSS JOIN cuts")
def gate_rejection(spark, sf_dir):
    return _gated(spark, sf_dir).agg(*[F.round(F.avg((F.col("similarity") < F.col(f"c{q}")).cast("int")), 9).alias(f"r{q}") for q in ("01", "05", "10")])
