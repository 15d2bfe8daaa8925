"""Routing decisions. A prompt's candidates are one array of structs (model_id, idx, c, p, y, cost), c being the training
mean cost; every rule is a minimum over that array by an explicit total order, so no rule shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Policy grids.
THRESHOLDS = tuple(i / 20 for i in range(21))
UTILITIES = (0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
MARGINS = (0.0, 0.02, 0.05, 0.1, 0.2)
FAMILIES = ("handcrafted", "tfidf", "embedding", "embedding_handcrafted")
GATE_QUANTILES = (0.0, 0.01, 0.05, 0.1)
BUDGETS = (0.25, 0.5, 0.75, 1.0)
SLACK = 0.005


def candidates(rows: DataFrame, costs: DataFrame, *keys: str) -> DataFrame:
    """rows(prompt_id, model_id, idx, p, success, cost_usd, keys) with costs(model_id, c) -> a row for each prompt."""
    joined = rows.join(F.broadcast(costs.select("model_id", "c")), "model_id")  # a row for each pool model
    entry = F.struct("model_id", "idx", "c", "p", F.col("success").cast("double").alias("y"), F.col("cost_usd").alias("cost"))
    return joined.groupBy("prompt_id", *keys).agg(F.collect_list(entry).alias("pool"))


def _least(pool: Column, *order) -> Column:
    """The candidate that is least by the given keys; its own struct comes last in the key."""
    return F.array_min(F.transform(pool, lambda x: F.struct(*[k(x).alias(f"k{i}") for i, k in enumerate(order)], x.alias("it"))))["it"]


_cost, _minus_p, _id = (lambda x: x["c"]), (lambda x: -x["p"]), (lambda x: x["model_id"])


def static(pool: Column, model: Column) -> Column:
    return F.filter(pool, lambda x: x["model_id"] == model)[0]


def threshold(pool: Column, tau: Column) -> Column:
    """Cheapest of those at least tau; if none, the likeliest."""
    good = F.filter(pool, lambda x: x["p"] >= tau)
    return F.when(F.size(good) > 0, _least(good, _cost, _minus_p, _id)).otherwise(_least(pool, _minus_p, _cost, _id))


def utility(pool: Column, weight: Column) -> Column:
    """Largest p - weight * c / max(c); ties by cost, then id."""
    top = F.array_max(F.transform(pool, _cost))
    return _least(pool, lambda x: -(x["p"] - weight * x["c"] / top), _cost, _id)


def advantage(pool: Column, margin: Column, reference: str) -> Column:
    """Cheapest of those strictly cheaper than the reference and likelier by the margin; else the reference."""
    ref = static(pool, F.lit(reference))
    better = F.filter(pool, lambda x: (x["c"] < ref["c"]) & (x["p"] >= ref["p"] + margin))
    return F.when(F.size(better) > 0, _least(better, _cost, _minus_p, _id)).otherwise(ref)


def oracle(pool: Column) -> Column:
    """Cheapest successful by realised cost; if none, the cheapest by training cost."""
    solved = F.filter(pool, lambda x: x["y"] == 1)
    return F.when(F.size(solved) > 0, _least(solved, lambda x: x["cost"], _id)).otherwise(_least(pool, _cost, _id))


def hindsight_cheapest(pool: Column) -> Column:
    return _least(pool, lambda x: x["cost"], _id)


def decide(pool: Column, kind: Column, value: Column, model: Column, reference: str) -> Column:
    return (
        F.when(kind == "static", static(pool, model))
        .when(kind == "threshold", threshold(pool, value))
        .when(kind == "utility", utility(pool, value))
        .when(kind == "advantage", advantage(pool, value, reference))
    )


def grid(model_ids: tuple[str, ...]) -> list[tuple[str, str, float | None, str | None]]:
    """Rows (policy_id, kind, value, model): every static, threshold, utility and advantage policy."""
    rows = [(f"static_{m}", "static", None, m) for m in model_ids]
    rows += [(f"threshold_{v:.2f}", "threshold", v, None) for v in THRESHOLDS]
    rows += [(f"utility_{v:g}", "utility", v, None) for v in UTILITIES]
    return rows + [(f"advantage_{v:.2f}", "advantage", v, None) for v in MARGINS]


def candidate_grid() -> list[tuple[str, str, str, float, float]]:
    """Rows (candidate_id, family, kind, value, gate): every threshold, utility and advantage rule of every feature family behind
    every novelty gate."""
    rules = [(a, k, v) for a, k, v, _ in grid(()) if k != "static"]
    return [(f"{f}__{a}__gate_{q:.2f}", f, k, v, q) for f in FAMILIES for a, k, v in rules for q in GATE_QUANTILES]


def grid_actions(pools: DataFrame, policies: list, reference: str) -> DataFrame:
    """Every policy on every prompt: the policies are a literal array, exploded beside the pool; no join."""
    table = F.array(*[F.struct(F.lit(a).alias("policy_id"), F.lit(k).alias("kind"), F.lit(v).cast("double").alias("value"), F.lit(m).cast("string").alias("model")) for a, k, v, m in policies])
    rows = pools.select("*", F.explode(table).alias("policy"))
    chosen = decide(F.col("pool"), F.col("policy.kind"), F.col("policy.value"), F.col("policy.model"), reference)
    return rows.select(*[c for c in pools.columns if c != "pool"], F.col("policy.policy_id").alias("policy_id"), chosen.alias("it"))
