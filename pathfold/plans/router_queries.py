"""Queries of the saved router: trained on the prompts' outcomes, written, loaded again and used on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.functions.text import LETTERS, NAMES
from pathfold.operators import router
from pathfold.plans.bridge import MODEL_IDS, REFERENCE, table
from pathfold.plans.more_queries import _outcomes, _texts
from pathfold.plans.prep_queries import _FEATURES_SQL, parts
from pathfold.plans.registry import query
from pathfold.plans.routing_queries import CAND_SQL, training_costs_of
from pathfold.sources.storage import freeze, shared_path

GATE = 0.1


def saved(spark, sf_dir, policy: router.Policy, fit: str = "logistic") -> router.Router:
    """The router of a policy, through its artifact."""
    labels = freeze(_outcomes(spark, sf_dir), "labels")
    prompts = freeze(_texts(spark, sf_dir).join(labels.select("id", F.xxhash64("text_group").alias("label")), "id"), "training-prompts")
    costs = {r.model_id: r.c for r in training_costs_of(parts(spark, sf_dir)).collect()}  # a row for each model
    path = shared_path(spark, "router")
    router.save(router.train(prompts, labels.select("id", "labels"), {m: costs.get(m, 0.0) for m in MODEL_IDS}, policy, MODEL_IDS, fit), policy, path)
    return router.Router(spark, path)


def requests(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), F.col("text").alias("prompt"))


@query("route_requests")
def route_requests(spark, sf_dir):
    """Label-free inference: the user's turns are scored by eight logistic heads on the sixteen scaled features, then routed at a
    threshold of 0.7."""
    found = saved(spark, sf_dir, router.Policy("threshold_0.70", "handcrafted", "threshold", 0.7, 0.0, REFERENCE)).route(requests(spark, sf_dir))
    return found.select("prompt_id", "model_id", F.element_at("probabilities", F.col("model_id")).alias("p"))


@query("route_by_terms")
def route_by_terms(spark, sf_dir):
    """The same with TF-IDF heads: the vocabulary comes from the artifact."""
    found = saved(spark, sf_dir, router.Policy("threshold_0.70", "tfidf", "threshold", 0.7, 0.0, REFERENCE)).route(requests(spark, sf_dir))
    return found.select("prompt_id", "model_id", F.element_at("probabilities", F.col("model_id")).alias("p"))


_LIST = ", ".join(f"CAST({n} AS DOUBLE)" for n in NAMES)
_LETTER_SQL = "[" + ", ".join(f"'{x}'" for x in LETTERS) + "]"
_UNIT = f"list_transform({{0}}, lambda x: x / greatest(sqrt(list_sum(list_transform({{0}}, lambda y: y * y))), 1e-12))"
_COUNTS = f"list_transform({_LETTER_SQL}, lambda x: CAST(length(t) - length(replace(t, x, '')) AS DOUBLE))"

_ROUTER_SQL = (
    CAND_SQL
    + f""", trained AS (SELECT DISTINCT prompt_id, text_group FROM cand WHERE split = 'train'),
texts AS (SELECT 'train' AS side, prompt_id, text_group, prompt AS t FROM prompts JOIN trained USING (prompt_id)
  UNION ALL SELECT 'ask', conv_id || ':' || turn, NULL, text FROM conversations WHERE role = 'user'),
measured AS (SELECT side, prompt_id, text_group, {_COUNTS} AS v, [{_LIST}] AS x FROM (SELECT side, prompt_id, text_group, t, {_FEATURES_SQL} FROM texts)),
long AS (SELECT side, prompt_id, unnest(range(1, {len(NAMES)} + 1)) AS place, unnest(x) AS v FROM measured),
scales AS (SELECT place, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM long WHERE side = 'train' GROUP BY 1),
scaled AS (SELECT side, prompt_id, place, (v - m) / s AS v FROM long JOIN scales USING (place)),
weights AS (SELECT model_id, place, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS w FROM scaled JOIN cand USING (prompt_id) WHERE side = 'train' GROUP BY ALL),
odds AS (SELECT model_id, any_value(c) AS c, ln(avg(y) / (1 - avg(y))) AS b FROM cand WHERE split = 'train' GROUP BY 1),
scored AS (SELECT prompt_id, model_id, 1 / (1 + exp(-(sum(v * w) + any_value(b)))) AS p, any_value(c) AS c FROM scaled JOIN weights USING (place) JOIN odds USING (model_id) WHERE side = 'ask' GROUP BY ALL),
vecs AS (SELECT side, prompt_id, text_group, {_UNIT.format("v")} AS vec FROM measured),
dots AS (SELECT a.side, a.prompt_id, a.text_group = b.text_group AS own, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])) AS sim FROM vecs a JOIN vecs b ON b.side = 'train'),
sims AS (SELECT side, prompt_id, round(max(sim) FILTER (side = 'ask' OR NOT own), 6) AS sim FROM dots GROUP BY ALL),
cut AS (SELECT round(quantile_cont(sim, {GATE}), 9) AS cut FROM sims WHERE side = 'train'),
top AS (SELECT s.prompt_id, s.model_id, s.p, s.c FROM scored s JOIN (SELECT prompt_id, p AS rp, c AS rc FROM scored WHERE model_id = '{REFERENCE}') USING (prompt_id)
  QUALIFY row_number() OVER (PARTITION BY s.prompt_id ORDER BY CASE WHEN c < rc AND p >= rp + 0.05::DOUBLE THEN 0 WHEN model_id = '{REFERENCE}' THEN 1 ELSE 2 END, c, -p, model_id) = 1)
"""
)


@query(
    "route_saved",
    _ROUTER_SQL
    + f"""SELECT t.prompt_id, CASE WHEN sim < cut THEN '{REFERENCE}' ELSE t.model_id END AS model_id, round(r.p, 6) AS reference_p, sim < cut AS novelty_fallback, round(o.c, 9) AS estimated_cost
FROM top t JOIN sims s ON s.side = 'ask' AND s.prompt_id = t.prompt_id CROSS JOIN cut JOIN scored r ON r.prompt_id = t.prompt_id AND r.model_id = '{REFERENCE}' JOIN odds o ON o.model_id = CASE WHEN sim < cut THEN '{REFERENCE}' ELSE t.model_id END""",
)
def route_saved(spark, sf_dir):
    """A saved router with heads in closed form, which SQL can follow: an advantage of 0.05 over the reference behind a gate at the
    training prompts' tenth."""
    policy = router.Policy("advantage_0.05__gate_0.10", "handcrafted", "advantage", 0.05, GATE, REFERENCE)
    found = saved(spark, sf_dir, policy, "centroid").route(requests(spark, sf_dir))
    return found.select("prompt_id", "model_id", F.round(F.element_at("probabilities", F.lit(REFERENCE)), 6).alias("reference_p"), "novelty_fallback", F.round("estimated_cost", 9).alias("estimated_cost"))
