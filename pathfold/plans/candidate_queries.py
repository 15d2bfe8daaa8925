"""Queries over all policy candidates: four families of probabilities, 34 rules, four novelty gates, every anchor.

A family's probabilities are training success rates of each model in cells of what the family sees (one more success and failure
for each cell), so that SQL can follow; `heads` holds the fitted ones. A prompt's vector is the frequency of the 26
letters, and the novelty gate compares its largest cosine to training prompts with quantiles of the training prompts'
own, those of the same text left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.functions.text import LETTERS, letter_counts, unit
from pathfold.operators import candidates, novelty, routing, scan
from pathfold.plans.bridge import MODEL_IDS, SEED, prompts
from pathfold.plans.prep_queries import parts
from pathfold.plans.registry import query
from pathfold.plans.routing_queries import GRID_SQL, actions, best_single_of, training_costs_of
from pathfold.plans.uncertainty_queries import REPLICATES, _bounds_sql
from pathfold.sources.storage import freeze

LISTED = candidates.candidate_list(len(MODEL_IDS))
OWN = len(LISTED) // len(MODEL_IDS)

# -- families and similarity ----------------------------------------------------------------------------------------

_LETTER_SQL = "[" + ", ".join(f"'{x}'" for x in LETTERS) + "]"
_GATES = ", ".join(f"({q}::DOUBLE)" for q in routing.GATE_QUANTILES)

_FAMILY_SQL = (
    GRID_SQL
    + f""", letters AS (SELECT prompt_id, dataset, source_split, prompt, list_transform({_LETTER_SQL}, lambda x: CAST(length(prompt) - length(replace(prompt, x, '')) AS DOUBLE)) AS v FROM prompts),
looks AS (SELECT prompt_id, dataset || ':' || coalesce(source_split, '') AS lexical, CAST(least(length(prompt) // 500, 11) AS VARCHAR) || CASE WHEN regexp_matches(prompt, '[0-9]') THEN 'd' ELSE '' END AS shape,
  CAST(list_position(v, list_max(v)) AS VARCHAR) AS topic, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS vec FROM letters),
cells AS (SELECT prompt_id, unnest(['handcrafted', 'tfidf', 'embedding', 'embedding_handcrafted']) AS family, unnest([shape, lexical, topic, topic || ':' || shape]) AS cell FROM looks),
rates AS (SELECT family, cell, model_id, CAST(sum(CAST(y AS BIGINT)) + 1 AS DOUBLE) / (count(*) + 2) AS p FROM cand JOIN cells USING (prompt_id) WHERE split = 'train' GROUP BY ALL),
fp AS (SELECT v.* REPLACE (coalesce(r.p, 0.5) AS p), k.family FROM val v JOIN cells k USING (prompt_id) LEFT JOIN rates r ON r.family = k.family AND r.cell = k.cell AND r.model_id = v.model_id),
vecs AS (SELECT DISTINCT c.prompt_id, c.split, c.text_group, s.vec FROM cand c JOIN looks s USING (prompt_id) WHERE c.split IN ('train', 'validation')),
dots AS (SELECT a.prompt_id, a.split, a.text_group = b.text_group AS own, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])) AS sim FROM vecs a JOIN vecs b ON b.split = 'train'),
sims AS (SELECT prompt_id, split, round(max(sim) FILTER (split = 'validation' OR NOT own), 6) AS sim FROM dots GROUP BY ALL),
gates(gate) AS (VALUES {_GATES}),
cuts AS (SELECT gate, CASE WHEN gate > 0 THEN round((SELECT quantile_cont(sim, [{", ".join(map(str, routing.GATE_QUANTILES))}]) FROM sims WHERE split = 'train')[CAST(list_position([{", ".join(map(str, routing.GATE_QUANTILES))}]::DOUBLE[], gate) AS INT)], 9) END AS cut FROM gates),
anchors AS (SELECT model_id AS anchor, c AS ac FROM costs),
fwide AS (SELECT v.*, max(v.c) OVER (PARTITION BY v.prompt_id, v.family) AS top FROM fp v),
free AS (
  SELECT w.*, g.policy_id FROM fwide w CROSS JOIN policies g WHERE g.kind IN ('threshold', 'utility')
  QUALIFY row_number() OVER (PARTITION BY w.prompt_id, w.family, g.policy_id ORDER BY
    CASE WHEN g.kind = 'threshold' AND p < g.value THEN 1 ELSE 0 END,
    CASE WHEN g.kind = 'utility' THEN -(p - g.value * c / top) WHEN p < g.value THEN -p ELSE c END, CASE WHEN g.kind = 'utility' OR p < g.value THEN c ELSE -p END, w.model_id) = 1),
bound AS (
  SELECT w.*, g.policy_id, n.anchor FROM fwide w JOIN fp a USING (prompt_id, family) JOIN anchors n ON n.anchor = a.model_id CROSS JOIN policies g WHERE g.kind = 'advantage'
  QUALIFY row_number() OVER (PARTITION BY w.prompt_id, w.family, g.policy_id, n.anchor ORDER BY
    CASE WHEN w.c < n.ac AND w.p >= a.p + g.value THEN 0 WHEN w.model_id = n.anchor THEN 1 ELSE 2 END, w.c, -w.p, w.model_id) = 1),
ruled AS (SELECT prompt_id, family, policy_id, anchor, model_id FROM free CROSS JOIN anchors UNION ALL SELECT prompt_id, family, policy_id, anchor, model_id FROM bound),
acted AS (
  SELECT anchor, family || '__' || policy_id || '__gate_' || printf('%.2f', gate) AS candidate_id, prompt_id, coalesce(gate > 0 AND sim < cut, false) AS shut, CASE WHEN gate > 0 AND sim < cut THEN anchor ELSE model_id END AS model_id
  FROM ruled JOIN sims USING (prompt_id) CROSS JOIN cuts
  UNION ALL SELECT anchor, 'best_single', prompt_id, false, anchor FROM (SELECT DISTINCT prompt_id FROM val) CROSS JOIN anchors),
best AS (SELECT model_id AS anchor FROM (SELECT model_id, avg(y) AS q, any_value(c) AS c FROM val GROUP BY 1) ORDER BY q DESC, c, model_id LIMIT 1),
alike AS (SELECT anchor, candidate_id, sha256(string_agg(prompt_id || model_id, ',' ORDER BY prompt_id)) AS vec FROM acted GROUP BY ALL)
"""
)


def prompt_cells(spark, sf_dir) -> DataFrame:
    """(prompt_id, cells: a name for each family, vec)."""
    text, v = F.col("prompt"), letter_counts(F.col("prompt"))
    rows = prompts(spark, sf_dir).select("prompt_id", F.concat_ws(":", "dataset", F.coalesce("source_split", F.lit(""))).alias("lexical"), F.concat(F.least(F.floor(F.length(text) / 500), F.lit(11)).cast("string"), F.when(text.rlike("[0-9]"), "d").otherwise("")).alias("shape"), v.alias("v"))
    rows = freeze(rows, "letters")  # 26 scans of a text, once
    topic = F.array_position("v", F.array_max("v")).cast("string")
    return rows.select("prompt_id", F.array("shape", "lexical", topic, F.concat_ws(":", topic, "shape")).alias("cells"), unit(F.col("v")).alias("vec"))


def similarities(rows: DataFrame) -> tuple[DataFrame, dict[float, float]]:
    """rows(prompt_id, split, text_group, vec) -> (prompt_id, similarity) of validation, and the cut of each gate."""
    held = rows.select(F.xxhash64("prompt_id").alias("vec_id"), F.col("vec").alias("embedding"), F.xxhash64("text_group").alias("label"), "split", "prompt_id")
    held = freeze(held, "prompt-vectors")
    refs, asks = held.where("split = 'train'"), held.where("split = 'validation'")
    fitted = novelty.max_similarity(refs, refs, other_groups=True).select(F.round("similarity", 6).alias("similarity"))
    points = tuple(q for q in routing.GATE_QUANTILES if q)
    found = scan.quantiles(fitted, [], "similarity", points).select(F.transform("q", lambda x: F.round(x, 9)).alias("q")).first()
    cuts = dict(zip(points, found.q, strict=True)) if found else dict.fromkeys(points, 0.0)
    return novelty.max_similarity(asks, refs).join(asks.select("vec_id", "prompt_id"), "vec_id").select("prompt_id", F.round("similarity", 6).alias("similarity")), cuts


def decisions(spark, sf_dir) -> tuple[DataFrame, int]:
    """Every validation prompt's actions under all candidates of all anchors, which gates are shut for it, and the position of the
    best single model."""
    rows = freeze(parts(spark, sf_dir).select("prompt_id", "split", "dataset", "text_group", "model_id", "idx", "success", "cost_usd"), "candidate-parts")
    cells = freeze(prompt_cells(spark, sf_dir), "prompt-cells")
    entry = F.struct("idx", F.col("success").cast("double").alias("y"), F.round(F.col("cost_usd") * 1e6).cast("bigint").alias("micro"))
    held = rows.where("split <> 'test'").groupBy("prompt_id", "split", "dataset", "text_group").agg(F.sort_array(F.collect_list(entry)).alias("it"))
    held = freeze(held.join(cells, "prompt_id"), "candidate-prompts")
    similar, cuts = similarities(held)
    each = held.select("prompt_id", "split", "it", F.posexplode("cells").alias("family", "cell"))
    # Rates of all models of a cell are one array, summed where the prompts are.
    n = len(MODEL_IDS)
    trained = each.where("split = 'train'").groupBy("family", "cell").agg(F.count("*").alias("n"), *[F.sum(F.col("it")[i]["y"]).alias(f"s{i}") for i in range(n)])
    rates = trained.select("family", "cell", F.array(*[(F.col(f"s{i}") + 1) / (F.col("n") + 2) for i in range(n)]).alias("p"))
    known = each.where("split = 'validation'").join(rates, ["family", "cell"], "left")
    half = F.array(*[F.lit(0.5)] * n)
    probabilities = known.groupBy("prompt_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("family", F.coalesce("p", half).alias("p")))), lambda x: x["p"])).alias("p"))
    asked = held.where("split = 'validation'").join(probabilities, "prompt_id").join(similar, "prompt_id")
    asked = asked.select("prompt_id", F.col("dataset").alias("stratum"), "text_group", "similarity", "p", F.transform("it", lambda x: x["y"]).alias("y"), F.transform("it", lambda x: x["micro"]).alias("micro"))
    costs = {r.model_id: r.c for r in training_costs_of(rows).collect()}  # a row for each model of the pool
    best = best_single_of(rows).first()
    acted = candidates.decided(asked, [costs.get(m, 0.0) for m in MODEL_IDS], cuts, LISTED)
    shut = F.array(*[F.coalesce(F.col("similarity") < cuts[q], F.lit(False)) if q else F.lit(False) for q in routing.GATE_QUANTILES])
    with candidates.batches_of(spark, candidates.WIDE):
        acted = freeze(acted.withColumn("shut", shut), "actions")
    return acted, MODEL_IDS.index(best.model_id) if best else 0


def _kinds(spark, first: np.ndarray, chosen: np.ndarray, anchor: int) -> DataFrame:
    """(candidate_id, family, kind, k) of the anchor's candidates: k is the place of what acts like it in chosen. Rows of the grid."""
    place = {int(k): i for i, k in enumerate(chosen.tolist())}
    own = LISTED[anchor * OWN : (anchor + 1) * OWN]
    return spark.createDataFrame([(x.candidate_id, routing.FAMILIES[x.family] if x.family >= 0 else "static", x.kind, place[int(first[anchor * OWN + i])]) for i, x in enumerate(own)], "candidate_id string, family string, kind string, k int")


def judged(spark, sf_dir, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, int, np.ndarray, np.ndarray]:
    """Bounds of the best single model's candidates and all statics that act differently, or of `every` anchor's."""
    rows, best = decisions(spark, sf_dir)
    first = candidates.distinct_candidates(rows, len(LISTED))
    single = [(a + 1) * OWN - 1 for a in range(len(MODEL_IDS))]
    chosen = np.unique(first) if every else np.unique(np.append(first[best * OWN : (best + 1) * OWN], first[single]))
    statics = np.searchsorted(chosen, first[single])
    bounds, tiles = candidates.simultaneous(rows, chosen, np.unique(statics), REPLICATES, SEED)
    return bounds, tiles, _kinds(spark, first, chosen, best), best, chosen, statics


# -- queries --------------------------------------------------------------------------------------------------------


@query("policy_grid", GRID_SQL + "SELECT kind, count(DISTINCT policy_id) AS n, count(*) AS decisions FROM vacts JOIN policies USING (policy_id) GROUP BY kind")
def policy_grid(spark, sf_dir):
    """The kinds of the grid's policies, and how many decisions each made on the validation prompts."""
    kind = reduce(lambda col, k: col.when(F.startswith("policy_id", F.lit(f"{k}_")), k), ("threshold", "utility", "advantage"), F.when(F.startswith("policy_id", F.lit("static_")), "static"))
    return actions(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.countDistinct("policy_id").alias("n"), F.count("*").alias("decisions"))


@query("candidate_grid", _FAMILY_SQL + "SELECT split_part(candidate_id, '__', 1) AS family, split_part(split_part(candidate_id, '__', 2), '_', 1) AS kind, count(*) AS n, count(DISTINCT vec) AS different FROM alike JOIN best USING (anchor) WHERE candidate_id <> 'best_single' GROUP BY ALL")
def candidate_grid(spark, sf_dir):
    """The candidates of the best single model by family and kind, and how many of them act differently on validation."""
    rows, best = decisions(spark, sf_dir)
    first = candidates.distinct_candidates(rows, len(LISTED))
    kinds = _kinds(spark, first, np.unique(first), best)
    return kinds.where("kind <> 'static'").groupBy("family", "kind").agg(F.count("*").alias("n"), F.countDistinct("k").alias("different"))


@query(
    "candidate_outcomes",
    _FAMILY_SQL
    + """SELECT candidate_id, count(*) AS n, count(*) FILTER (shut) AS gated, count(*) FILTER (a.model_id = a.anchor) AS baseline, round(avg(v.y), 9) AS quality,
  round(CAST(sum(CAST(round(v.cost * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6, 12) AS cost
FROM acted a JOIN best USING (anchor) JOIN val v ON v.prompt_id = a.prompt_id AND v.model_id = a.model_id GROUP BY candidate_id""",
)
def candidate_outcomes(spark, sf_dir):
    """Every candidate of the best single model on every validation prompt: how often its gate was shut, the anchor answered,
    its quality and its cost."""
    rows, best = decisions(spark, sf_dir)
    own = LISTED[best * OWN : (best + 1) * OWN]
    width, offset, gates = len(own), best * OWN, [x.gate for x in own]

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((5, width), dtype=np.int64)
        for batch in batches:
            for y, micro, act, shut in zip(*[batch.column(c).to_pylist() for c in ("y", "micro", "act", "shut")], strict=True):
                at = np.frombuffer(act, dtype=np.int8)[offset : offset + width]
                closed = np.array([shut[routing.GATE_QUANTILES.index(g)] for g in gates])
                sums += np.stack([np.ones(width, dtype=np.int64), closed.astype(np.int64), (at == best).astype(np.int64), np.array(y, dtype=np.int64)[at], np.array(micro, dtype=np.int64)[at]])
        yield pa.RecordBatch.from_arrays([pa.array([x.candidate_id for x in own]), *[pa.array(s.copy()) for s in sums]], names=["candidate_id", "n", "gated", "baseline", "y", "micro"])

    found = rows.select("y", "micro", "act", "shut").mapInArrow(run, "candidate_id string, n long, gated long, baseline long, y long, micro long")
    sums = found.groupBy("candidate_id").agg(*[F.sum(c).alias(c) for c in ("n", "gated", "baseline", "y", "micro")]).where("n > 0")
    return sums.select("candidate_id", "n", "gated", "baseline", F.round(F.col("y") / F.col("n"), 9).alias("quality"), F.round(F.col("micro") / F.col("n") / 1e6, 12).alias("cost"))


_BOUNDS_SQL = (
    _FAMILY_SQL
    + ", vs AS (SELECT vec, v.dataset, v.text_group, v.y AS delta FROM (SELECT vec, min(anchor || candidate_id) AS one FROM alike WHERE candidate_id = 'best_single' OR anchor = (SELECT anchor FROM best) GROUP BY 1) JOIN acted a ON a.anchor || a.candidate_id = one JOIN val v ON v.prompt_id = a.prompt_id AND v.model_id = a.model_id)"
    + _bounds_sql("vs", "vec").replace("stratum AS metric, s / n AS v FROM sets UNION ALL SELECT vec, replicate, '__micro__', sum(s) / sum(n) FROM", "'__micro__' AS metric, sum(s) / sum(n) AS v FROM")
    + """, statics AS (SELECT anchor AS other, vec FROM alike WHERE candidate_id = 'best_single'),
levels AS (SELECT m.vec, metric, replicate, m.v, s.other FROM means m LEFT JOIN statics s USING (vec)),
diffs AS (SELECT a.vec, b.other, metric, replicate, a.v - b.v AS v FROM means a JOIN levels b USING (metric, replicate) WHERE b.other IS NOT NULL),
deltas AS (SELECT a.vec, s.other, metric, a.delta - b.delta AS delta FROM obs a JOIN obs b USING (metric) JOIN statics s ON s.vec = b.vec WHERE starts_with(metric, '__')),
ses AS (SELECT d.*, s.se FROM deltas d JOIN (SELECT vec, other, metric, stddev_samp(v) AS se FROM diffs GROUP BY ALL) s USING (vec, other, metric)),
tops AS (SELECT replicate, greatest(max(CASE WHEN se > 1e-9 THEN (v - delta) / se ELSE 0 END), 0) AS t FROM diffs JOIN ses USING (vec, other, metric) GROUP BY 1),
crit AS MATERIALIZED (SELECT quantile_cont(t, 0.95) AS critical FROM tops),
limits AS (SELECT vec, other, metric, delta, CASE WHEN se > 1e-9 THEN se ELSE 0 END AS se, delta - critical * CASE WHEN se > 1e-9 THEN se ELSE 0 END AS lower FROM ses CROSS JOIN crit)
"""
)


@query("simultaneous_bounds", _BOUNDS_SQL + "SELECT candidate_id, other, metric, round(delta, 8) AS delta, round(se, 8) AS standard_error, round(lower, 8) AS lower FROM alike JOIN best USING (anchor) JOIN limits USING (vec)")
def simultaneous_bounds(spark, sf_dir):
    """All candidates of the best single model against every static one, micro and macro, one critical value for all."""
    bounds, _, kinds, _, _, statics = judged(spark, sf_dir)
    return _named(bounds, kinds, statics).select("candidate_id", "other", "metric", *[F.round(c, 8).alias(c) for c in ("delta", "standard_error", "lower")])


@query("anchored_bounds")
def anchored_bounds(spark, sf_dir):
    """The same over the candidates of all anchors that act differently somewhere, as an unknown best model would ask for: the rows
    of the best one's candidates, whose lower bounds are lower for the larger family."""
    bounds, _, kinds, _, _, statics = judged(spark, sf_dir, every=True)
    return _named(bounds, kinds, statics).select("candidate_id", "other", "metric", *[F.round(c, 8).alias(c) for c in ("delta", "standard_error", "lower")])


def _named(bounds: DataFrame, kinds: DataFrame, statics: np.ndarray) -> DataFrame:
    """bounds with candidate_id, and the static model's id as other. Deviations of nothing but rounding have no error. Two statics
    that act alike would be one place, so places are turned into all their names."""
    names = bounds.sparkSession.createDataFrame([(int(s), m) for s, m in zip(statics.tolist(), MODEL_IDS, strict=True)], "other int, name string")
    error = F.when(F.col("standard_error") > 1e-9, F.col("standard_error")).otherwise(F.lit(0.0))
    lower = F.when(F.col("standard_error") > 1e-9, F.col("lower")).otherwise(F.col("delta"))
    joined = bounds.withColumns({"lower": lower}).withColumn("standard_error", error).join(F.broadcast(names), "other").join(F.broadcast(kinds), "k")  # rows of the grid
    return joined.drop("other").withColumnRenamed("name", "other")


@query(
    "select_conservative",
    _BOUNDS_SQL
    + """, own AS (SELECT a.candidate_id, v.prompt_id, v.dataset, v.y, v.cost, b.y AS by_ FROM acted a JOIN best USING (anchor) JOIN val v ON v.prompt_id = a.prompt_id AND v.model_id = a.model_id JOIN val b ON b.prompt_id = a.prompt_id AND b.model_id = a.anchor),
tallies AS (SELECT candidate_id, avg(y) AS quality, CAST(sum(CAST(round(cost * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS cost FROM own GROUP BY 1),
worst_set AS (SELECT candidate_id, min(m) AS m FROM (SELECT candidate_id, dataset, avg(y) - avg(by_) AS m FROM own GROUP BY ALL) GROUP BY 1),
lowest AS (SELECT candidate_id, min(lower) AS lower FROM alike JOIN best USING (anchor) JOIN limits USING (vec) WHERE other = anchor GROUP BY 1),
judged AS (SELECT *, candidate_id = 'best_single' OR (round(lower, 9) >= -0.005 AND round(m, 9) >= -0.005) AS feasible FROM tallies JOIN worst_set USING (candidate_id) JOIN lowest USING (candidate_id))
SELECT candidate_id, round(quality, 9) AS quality, round(cost, 12) AS cost, round(lower, 8) AS worst_lower, round(m, 9) AS worst_dataset, feasible,
  feasible AND row_number() OVER (ORDER BY NOT feasible, round(cost, 12), round(quality, 9) DESC, candidate_id) = 1 AS selected FROM judged""",
)
def select_conservative(spark, sf_dir):
    """Every candidate against the best single model of validation: feasible if its lower bounds, micro and macro, and its
    worst dataset's difference clear the margin; the single model itself always is. The cheapest feasible one is selected."""
    bounds, tiles, kinds, best, chosen, statics = judged(spark, sf_dir)
    lowest = _named(bounds, kinds, statics).where(F.col("other") == MODEL_IDS[best]).groupBy("candidate_id", "k").agg(F.min("lower").alias("lower"))
    sums = freeze(candidates.totals(tiles, len(chosen)), "totals")
    single = sums.where(F.col("k") == int(statics[best])).select("stratum", (F.col("y") / F.col("n")).alias("q"))
    whole = sums.join(F.broadcast(single), "stratum").groupBy("k").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("micro").alias("micro"), F.min(F.col("y") / F.col("n") - F.col("q")).alias("m"))  # strata * grid rows
    rows = lowest.join(F.broadcast(whole), "k").select("candidate_id", F.round(F.col("y") / F.col("n"), 9).alias("quality"), F.round(F.col("micro") / F.col("n") / 1e6, 12).alias("cost"), "lower", "m")
    clear = lambda c: F.round(c, 9) >= -routing.SLACK
    rows = freeze(rows.withColumn("feasible", (F.col("candidate_id") == "best_single") | (clear("lower") & clear("m"))), "judged")
    winner = rows.where("feasible").agg(F.min(F.struct("cost", (-F.col("quality")).alias("minus"), "candidate_id"))["candidate_id"].alias("winner"))
    joined = rows.crossJoin(F.broadcast(winner))  # one row
    return joined.select("candidate_id", "quality", "cost", F.round("lower", 8).alias("worst_lower"), F.round("m", 9).alias("worst_dataset"), "feasible", (F.col("candidate_id") == F.col("winner")).alias("selected"))
