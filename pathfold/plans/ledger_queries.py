"""Queries of the ledger, pilot comparison, spend and support operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.operators import ledger as L
from pathfold.plans.bridge import table
from pathfold.plans.registry import query

LEDGER_SQL = """WITH RECURSIVE led AS (
  SELECT event_id AS seq, 'p' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS prompt_id, 'm' || (event_id % 4) AS model, ['choice', 'math', 'code'][1 + user_id % 3] AS benchmark,
    CASE WHEN event_id % 10 < 7 THEN 'success' WHEN event_type = 'view' THEN 'parsing_failure' WHEN event_type = 'signup' THEN 'grading_failure' WHEN event_type = 'error' THEN 'provider_error'
         WHEN event_type = 'purchase' THEN 'skipped_model' ELSE 'success' END AS status,
    CAST(value AS DECIMAL(18, 6)) AS cost, value * 10 AS latency_ms, event_id, user_id, value, props, event_type FROM events),
ledger AS (
  SELECT *, CASE WHEN status = 'success' THEN (event_id // 7) % 3 <> user_id % 3 END AS correct,
    CASE WHEN status = 'provider_error' THEN CASE WHEN event_id % 7 = 0 THEN 'spend_limit_error' ELSE ['network_error', 'invalid_model_error', 'output_limit_exhausted'][1 + event_id % 3] END END AS error_type,
    CASE WHEN status = 'provider_error' THEN event_id % 4 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS retry_count,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(value / 2 AS DECIMAL(18, 6)) END AS response_cost, CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS provider_attempts FROM led),
latest AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY prompt_id, model ORDER BY seq DESC) = 1),
tried AS (SELECT *, CAST(status IN ('success', 'parsing_failure', 'grading_failure') AS INT) AS responded,
  coalesce(provider_attempts, CASE WHEN status = 'skipped_model' THEN 0 WHEN error_type = 'spend_limit_error' THEN retry_count ELSE 1 + retry_count END) AS attempts,
  coalesce(response_cost, CASE WHEN retry_count = 0 THEN cost END) AS rcost FROM latest),
graded AS (SELECT * FROM tried WHERE status = 'success'),
common AS (SELECT prompt_id FROM graded GROUP BY 1 HAVING count(*) = 4),
cg AS (SELECT g.* FROM graded g SEMI JOIN common c ON g.prompt_id = c.prompt_id)
"""


def ledger(spark, sf_dir) -> DataFrame:
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    status = F.when(e % 10 < 7, "success").when(kind == "view", "parsing_failure").when(kind == "signup", "grading_failure").when(kind == "error", "provider_error").when(kind == "purchase", "skipped_model").otherwise("success")
    rows = table(spark, sf_dir, "events").select(
        e.alias("seq"), F.concat(F.lit("p"), F.lpad(u.cast("string"), 4, "0")).alias("prompt_id"), F.concat(F.lit("m"), (e % 4).cast("string")).alias("model"),
        F.element_at(F.array(F.lit("choice"), F.lit("math"), F.lit("code")), (u % 3 + 1).cast("int")).alias("benchmark"), status.alias("status"),
        F.col("value").cast("decimal(18,6)").alias("cost"), (F.col("value") * 10).alias("latency_ms"), "event_id", "user_id", "value", "props", "event_type",
    )
    s = F.col("status")
    failed = s == "provider_error"
    return rows.withColumns(
        {
            "correct": F.when(s == "success", F.floor(e / F.lit(7)) % 3 != u % 3), "error_type": F.when(failed, F.when(e % 7 == 0, "spend_limit_error").otherwise(F.element_at(F.array(F.lit("network_error"), F.lit("invalid_model_error"), F.lit("output_limit_exhausted")), (e % 3 + 1).cast("int")))),
            "retry_count": F.when(failed, e % 4).when(e % 11 == 0, 1).otherwise(0), "response_cost": F.when(e % 13 != 0, (F.col("value") / 2).cast("decimal(18,6)")), "provider_attempts": F.when(e % 5 == 0, e % 3),
        }
    )


def latest(spark, sf_dir) -> DataFrame:
    return L.latest(ledger(spark, sf_dir), ("prompt_id", "model"), "seq")


def common_graded(spark, sf_dir) -> DataFrame:
    """Graded rows of the prompts that all four models have graded."""
    rows = latest(spark, sf_dir).where("status = 'success'").withColumn("rcost", L.response_cost())
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("prompt_id"))).where("_n = 4").drop("_n")


@query("upsert_latest", LEDGER_SQL + "SELECT prompt_id, model, seq, status FROM latest")
def upsert_latest(spark, sf_dir):
    return latest(spark, sf_dir).select("prompt_id", "model", "seq", "status")


@query("ledger_cast", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(event_type AS DOUBLE) AS not_a_number, CAST(round(value * 100) AS BIGINT) AS cents FROM events")
def ledger_cast(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.col("event_type").try_cast("double").alias("not_a_number"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


_METRIC_SQL = """count(*) AS recorded_pairs, count(*) FILTER (status = 'success') AS graded, CAST(sum(attempts) AS BIGINT) AS attempted_calls, CAST(sum(responded) AS BIGINT) AS responses, CAST(sum(attempts - responded) AS BIGINT) AS failed_attempts,
  count(*) FILTER (status = 'success' AND correct) AS correct_responses, round(count(*) FILTER (status = 'success' AND correct) / nullif(count(*) FILTER (status = 'success'), 0), 9) AS accuracy,
  count(*) FILTER (status = 'provider_error' AND error_type <> 'spend_limit_error') AS provider_failures, count(*) FILTER (status = 'parsing_failure') AS parsing_failures, count(*) FILTER (status = 'grading_failure') AS grading_failures,
  count(*) FILTER (status = 'skipped_model') AS skipped_pairs, count(*) FILTER (error_type = 'spend_limit_error') AS spend_limit_stops, CAST(sum(cost) AS DOUBLE) AS cost, round(avg(latency_ms) FILTER (responded = 1), 6) AS latency_ms FROM tried"""


@query("ledger_metrics", LEDGER_SQL + f"SELECT 600 AS expected_pairs, 600 - count(*) AS unrecorded_pairs, {_METRIC_SQL}")
def ledger_metrics(spark, sf_dir):
    return latest(spark, sf_dir).agg(*L.metrics()).select(F.lit(600).alias("expected_pairs"), (600 - F.col("recorded_pairs")).alias("unrecorded_pairs"), "*")


@query("ledger_metrics_by", LEDGER_SQL + f"SELECT coalesce(benchmark, '__all__') AS benchmark, model, {_METRIC_SQL} GROUP BY GROUPING SETS ((model), (benchmark, model))")
def ledger_metrics_by(spark, sf_dir):
    return latest(spark, sf_dir).groupingSets([["model"], ["benchmark", "model"]], "benchmark", "model").agg(*L.metrics()).fillna("__all__", ["benchmark"])


@query(
    "classify_rows",
    LEDGER_SQL
    + "SELECT class, count(*) AS n FROM (SELECT CASE WHEN error_type = 'spend_limit_error' THEN 'spend-limit stop' WHEN status = 'skipped_model' THEN 'skipped historical row' WHEN status = 'parsing_failure' THEN 'parsing failure' WHEN status = 'grading_failure' THEN 'grading failure' WHEN error_type IN ('invalid_model_error', 'configuration_error', 'authentication_error') THEN 'permanent provider/model failure' WHEN error_type = 'network_error' THEN 'transient provider failure' ELSE 'other' END AS class FROM latest) GROUP BY 1",
)
def classify_rows(spark, sf_dir):
    return latest(spark, sf_dir).groupBy(L.classification().alias("class")).agg(F.count("*").alias("n"))


@query(
    "ledger_violations",
    LEDGER_SQL
    + """SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN value > 300 THEN 'cost_range' END, CASE WHEN status = 'success' AND correct IS NULL THEN 'success_without_grade' END, CASE WHEN status <> 'success' AND correct IS NOT NULL THEN 'failure_with_grade' END,
  CASE WHEN status = 'provider_error' AND error_type IS NULL THEN 'error_without_type' END, CASE WHEN response_cost > 150 THEN 'response_cost_range' END, CASE WHEN provider_attempts < 1 THEN 'attempts_range' END]) AS rule FROM ledger) WHERE rule IS NOT NULL GROUP BY 1""",
)
def ledger_violations(spark, sf_dir):
    """One condition for each rule; a row reports every rule it breaks."""
    s = F.col("status")
    rules = {
        "cost_range": F.col("value") > 300, "success_without_grade": (s == "success") & F.col("correct").isNull(), "failure_with_grade": (s != "success") & F.col("correct").isNotNull(),
        "error_without_type": (s == "provider_error") & F.col("error_type").isNull(), "response_cost_range": F.col("response_cost") > 150, "attempts_range": F.col("provider_attempts") < 1,
    }
    broken = F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])))
    return ledger(spark, sf_dir).select(broken.alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("ledger_set_violations", LEDGER_SQL + "SELECT 'repeated_key' AS rule, count(*) AS n FROM (SELECT 1 FROM ledger GROUP BY prompt_id, model HAVING count(*) > 1) UNION ALL SELECT 'unmapped_benchmark', count(*) FROM ledger WHERE benchmark NOT IN ('choice', 'math')")
def ledger_set_violations(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    repeated = rows.groupBy("prompt_id", "model").count().where("count > 1").agg(F.lit("repeated_key").alias("rule"), F.count("*").alias("n"))
    known = spark.createDataFrame([(k, v) for k, v in L.TASK_OF.items() if k != "code"], "benchmark string, task_type string")
    unmapped = rows.join(F.broadcast(known), "benchmark", "left_anti").agg(F.lit("unmapped_benchmark").alias("rule"), F.count("*").alias("n"))
    return repeated.unionByName(unmapped)


@query("select_exhausted", LEDGER_SQL + "SELECT prompt_id, model, retry_count FROM latest WHERE status = 'provider_error' AND error_type = 'output_limit_exhausted' AND benchmark <> 'code' AND NOT contains(lower(model), 'm3')")
def select_exhausted(spark, sf_dir):
    kept = (F.col("status") == "provider_error") & (F.col("error_type") == "output_limit_exhausted") & (F.col("benchmark") != "code") & ~F.contains(F.lower("model"), F.lit("m3"))
    return latest(spark, sf_dir).where(kept).select("prompt_id", "model", "retry_count").orderBy("prompt_id", "model")


@query("grading_issues", "SELECT item_id, CASE WHEN length(text) < 200 THEN 'short' WHEN NOT contains(text, '.') THEN 'no_sentence' WHEN regexp_matches(text, '[0-9]') THEN 'digits' END AS issue FROM benchmark WHERE length(text) < 200 OR NOT contains(text, '.') OR regexp_matches(text, '[0-9]')")
def grading_issues(spark, sf_dir):
    t = F.col("text")
    issue = F.when(F.length(t) < 200, "short").when(~F.contains(t, F.lit(".")), "no_sentence").when(t.rlike("[0-9]"), "digits")
    return table(spark, sf_dir, "benchmark").select("item_id", issue.alias("issue")).where("issue IS NOT NULL")


_DIAG_SQL = ", hist AS (SELECT user_id, list({'seq': event_id, 'k': CAST(json_extract_string(props, '$.k') AS BIGINT), 'kind': event_type} ORDER BY event_id) AS h FROM events GROUP BY 1)"


def diagnostics(spark, sf_dir) -> DataFrame:
    """Each user's history as one JSON text, as the ledger keeps it in a cell."""
    item = F.struct(F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("kind"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("history"))


_HISTORY = "array<struct<seq:bigint,k:bigint,kind:string>>"


@query("cost_bound_issues", LEDGER_SQL + _DIAG_SQL + "SELECT user_id, x.seq AS seq, x.k AS k FROM (SELECT user_id, unnest(h) AS x FROM hist) WHERE x.k > 95")
def cost_bound_issues(spark, sf_dir):
    return diagnostics(spark, sf_dir).select("user_id", F.inline(F.from_json("history", _HISTORY))).where("k > 95").select("user_id", "seq", "k")


@query("last_diagnostic", LEDGER_SQL + _DIAG_SQL + "SELECT user_id, list_filter(h, lambda x: x.kind = 'error')[-1].seq AS seq FROM hist")
def last_diagnostic(spark, sf_dir):
    errors = F.filter(F.from_json("history", _HISTORY), lambda x: x["kind"] == "error")
    return diagnostics(spark, sf_dir).select("user_id", F.try_element_at(errors, F.lit(-1))["seq"].alias("seq"))


@query("request_violations", "SELECT count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (text IS NULL) AS missing, count(*) - count(DISTINCT conv_id) AS repeated_ids, count(*) FILTER (role NOT IN ('user')) AS not_requests FROM conversations")
def request_violations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").agg(F.count_if(F.trim("text") == "").alias("blank"), F.count_if(F.col("text").isNull()).alias("missing"), (F.count("*") - F.countDistinct("conv_id")).alias("repeated_ids"), F.count_if(F.col("role") != "user").alias("not_requests"))


@query("saved_blocks", LEDGER_SQL + "SELECT model, count(*) AS blocked, min(prompt_id) AS first_prompt FROM latest WHERE status = 'provider_error' AND retry_count > 0 GROUP BY 1")
def saved_blocks(spark, sf_dir):
    return latest(spark, sf_dir).where("status = 'provider_error' AND retry_count > 0").groupBy("model").agg(F.count("*").alias("blocked"), F.min("prompt_id").alias("first_prompt"))


# -- pilot comparison -----------------------------------------------------------------------------------------------


@query(
    "cost_inversions",
    LEDGER_SQL + ", av AS (SELECT model, avg(rcost) AS a FROM cg GROUP BY 1) SELECT w.prompt_id, w.model AS cheaper_correct, l.model AS dearer_wrong FROM cg w JOIN cg l USING (prompt_id) JOIN av x ON x.model = w.model JOIN av y ON y.model = l.model WHERE w.correct AND NOT l.correct AND x.a < y.a",
)
def cost_inversions(spark, sf_dir):
    """Cheaper models that solve what dearer ones miss. A prompt has a row for each model, so the pairs are made within its own
    array; nothing is joined to itself."""
    rows = common_graded(spark, sf_dir)
    mean = rows.groupBy("model").agg(F.avg("rcost").alias("a"))
    cells = rows.join(F.broadcast(mean), "model").groupBy("prompt_id").agg(F.collect_list(F.struct("model", "a", "correct")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda w: F.transform(F.filter("x", lambda b: w["correct"] & ~b["correct"] & (w["a"] < b["a"])), lambda b: F.struct(w["model"].alias("cheaper_correct"), b["model"].alias("dearer_wrong")))))
    return cells.select("prompt_id", F.inline(pairs))


@query("pairwise_disagreement", LEDGER_SQL + "SELECT a.model AS a, b.model AS b, count(*) AS overlap, count(*) FILTER (a.correct <> b.correct) AS disagree, count(*) FILTER (a.correct AND NOT b.correct) AS only_a FROM graded a JOIN graded b ON a.prompt_id = b.prompt_id AND a.model < b.model GROUP BY ALL")
def pairwise_disagreement(spark, sf_dir):
    cells = latest(spark, sf_dir).where("status = 'success'").groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("model", "correct"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: a["model"] < b["model"]), lambda b: F.struct(a["model"].alias("a"), b["model"].alias("b"), a["correct"].alias("ca"), b["correct"].alias("cb")))))
    return cells.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("overlap"), F.count_if(F.col("ca") != F.col("cb")).alias("disagree"), F.count_if(F.col("ca") & ~F.col("cb")).alias("only_a"))


@query("exhaustion_counts", LEDGER_SQL + "SELECT coalesce(model, '__all__') AS model, coalesce(benchmark, '__all__') AS benchmark, count(*) AS n FROM latest WHERE status = 'provider_error' GROUP BY CUBE (model, benchmark)")
def exhaustion_counts(spark, sf_dir):
    return latest(spark, sf_dir).where("status = 'provider_error'").cube("model", "benchmark").agg(F.count("*").alias("n")).fillna("__all__", ["model", "benchmark"])


@query("static_metrics", LEDGER_SQL + "SELECT model, count(*) AS n, count(*) FILTER (correct) AS solved, round(count(*) FILTER (correct) / count(*), 9) AS accuracy, round(CAST(sum(rcost) AS DOUBLE), 6) AS cost, round(count(*) FILTER (correct) / nullif(CAST(sum(rcost) AS DOUBLE), 0), 9) AS solved_for_a_dollar FROM cg GROUP BY 1")
def static_metrics(spark, sf_dir):
    cost, solved = F.sum("rcost").cast("double"), F.count_if("correct")
    return common_graded(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), solved.alias("solved"), F.round(solved / F.count("*"), 9).alias("accuracy"), F.round(cost, 6).alias("cost"), F.round(F.try_divide(solved, cost), 9).alias("solved_for_a_dollar"))


@query("correctness_vectors", LEDGER_SQL + "SELECT prompt_id, max(CAST(correct AS INT)) FILTER (model = 'm0') AS m0, max(CAST(correct AS INT)) FILTER (model = 'm1') AS m1, max(CAST(correct AS INT)) FILTER (model = 'm2') AS m2, max(CAST(correct AS INT)) FILTER (model = 'm3') AS m3 FROM cg GROUP BY 1")
def correctness_vectors(spark, sf_dir):
    return common_graded(spark, sf_dir).groupBy("prompt_id").pivot("model", ["m0", "m1", "m2", "m3"]).agg(F.max(F.col("correct").cast("int")))


@query("agreement_counts", LEDGER_SQL + "SELECT count(*) FILTER (a) AS all_right, count(*) FILTER (NOT o) AS all_wrong, count(*) FILTER (o AND NOT a) AS split FROM (SELECT bool_and(correct) AS a, bool_or(correct) AS o FROM cg GROUP BY prompt_id)")
def agreement_counts(spark, sf_dir):
    each = common_graded(spark, sf_dir).groupBy("prompt_id").agg(F.bool_and("correct").alias("a"), F.bool_or("correct").alias("o"))
    return each.agg(F.count_if("a").alias("all_right"), F.count_if(~F.col("o")).alias("all_wrong"), F.count_if(F.col("o") & ~F.col("a")).alias("split"))


@query(
    "oracle_with_fallback",
    LEDGER_SQL
    + """, av AS (SELECT model, sum(rcost) AS s FROM cg GROUP BY 1), cheap AS (SELECT model FROM av ORDER BY s, model LIMIT 1),
o AS (SELECT prompt_id, bool_or(correct) AS solved, coalesce(min(rcost) FILTER (correct), min(rcost) FILTER (model = (SELECT model FROM cheap))) AS c FROM cg GROUP BY 1)
SELECT count(*) AS prompts, count(*) FILTER (solved) AS solved, round(CAST(sum(c) AS DOUBLE), 6) AS cost, round(CAST(sum(c) AS DOUBLE) / (SELECT CAST(max(s) AS DOUBLE) FROM av), 9) AS relative_cost FROM o""",
)
def oracle_with_fallback(spark, sf_dir):
    rows = common_graded(spark, sf_dir)
    sums = rows.groupBy("model").agg(F.sum("rcost").alias("s")).agg(F.min(F.struct("s", "model"))["model"].alias("cheap"), F.max("s").alias("most"))
    each = rows.crossJoin(F.broadcast(sums)).groupBy("prompt_id", "most").agg(
        F.bool_or("correct").alias("solved"), F.coalesce(F.min(F.when(F.col("correct"), F.col("rcost"))), F.min(F.when(F.col("model") == F.col("cheap"), F.col("rcost")))).alias("c")
    )
    cost = F.sum("c").cast("double")
    return each.agg(F.count("*").alias("prompts"), F.count_if("solved").alias("solved"), F.round(cost, 6).alias("cost"), F.round(cost / F.max("most").cast("double"), 9).alias("relative_cost"))


@query("pilot_completeness", LEDGER_SQL + "SELECT 600 AS expected_pairs, count(*) FILTER (status = 'success') AS graded_pairs, count(*) AS recorded_pairs, 600 - count(*) AS unrecorded_pairs, (SELECT count(*) FROM common) AS common_prompts, count(*) FILTER (status = 'success') = 600 AS complete FROM latest")
def pilot_completeness(spark, sf_dir):
    each = latest(spark, sf_dir).groupBy("prompt_id").agg(F.count("*").alias("r"), F.count_if(F.col("status") == "success").alias("g"))
    return each.agg(F.lit(600).alias("expected_pairs"), F.sum("g").alias("graded_pairs"), F.sum("r").alias("recorded_pairs"), (600 - F.sum("r")).alias("unrecorded_pairs"), F.count_if(F.col("g") == 4).alias("common_prompts"), (F.sum("g") == 600).alias("complete"))


@query("pilot_signal", LEDGER_SQL + ", a AS (SELECT model, avg(CAST(correct AS INT)) AS q FROM cg GROUP BY 1) SELECT round((SELECT avg(CAST(o AS INT)) FROM (SELECT bool_or(correct) AS o FROM cg GROUP BY prompt_id)), 9) AS oracle, round(max(q), 9) AS best, arg_max(model, (round(q, 12), model)) AS best_model FROM a")
def pilot_signal(spark, sf_dir):
    rows = common_graded(spark, sf_dir)
    oracle = rows.groupBy("prompt_id").agg(F.bool_or("correct").cast("int").alias("o")).agg(F.round(F.avg("o"), 9).alias("oracle"))
    best = rows.groupBy("model").agg(F.avg(F.col("correct").cast("int")).alias("q")).agg(F.round(F.max("q"), 9).alias("best"), F.max(F.struct(F.round("q", 12).alias("q"), "model"))["model"].alias("best_model"))
    return oracle.crossJoin(F.broadcast(best))


@query("response_costs", LEDGER_SQL + "SELECT prompt_id, model, CAST(rcost AS DOUBLE) AS response_cost, CAST(attempts AS BIGINT) AS attempts, responded FROM tried")
def response_costs(spark, sf_dir):
    return latest(spark, sf_dir).select("prompt_id", "model", L.response_cost().cast("double").alias("response_cost"), L.attempts().cast("bigint").alias("attempts"), L.responses().alias("responded"))


# -- spend, plans, resume -------------------------------------------------------------------------------------------


@query("max_spend", "SELECT CAST(ceil(sum((CAST(octet_length(encode(text)) + 64 AS DECIMAL(18, 0)) * 3 + 4096 * 15) * 3 / CAST(1000000 AS DECIMAL(18, 0))) * 1000000) / 1000000 AS DOUBLE) AS max_spend FROM conversations".replace("ceil(sum((CAST(octet_length(encode(text)) + 64 AS DECIMAL(18, 0)) * 3 + 4096 * 15) * 3 / CAST(1000000 AS DECIMAL(18, 0))) * 1000000) / 1000000", "sum((octet_length(encode(text)) + 64) * 3 + 4096 * 15) * 3 / 1000000"))
def max_spend(spark, sf_dir):
    """UTF-8 bytes bound the tokens; three attempts; exact in decimals, rounded up at the sixth place."""
    micro = F.sum(((F.octet_length("text") + 64) * 3 + 4096 * 15).cast("decimal(38,0)")) * 3
    return table(spark, sf_dir, "conversations").agg((F.ceil(micro).cast("decimal(38,6)") / 1000000).cast("double").alias("max_spend"))


@query(
    "spend_prefix",
    LEDGER_SQL
    + """, c AS (SELECT seq, user_id, CASE WHEN status = 'provider_error' THEN CAST(value * 1.5 AS DECIMAL(18, 6)) ELSE cost END AS charge, CAST(value * 1.5 AS DECIMAL(18, 6)) AS bound FROM (SELECT *, value FROM ledger)),
r AS (SELECT *, sum(charge) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS after FROM c)
SELECT user_id, seq, CAST(after AS DOUBLE) AS after, max(CAST(after - charge + bound > 800 AS INT)) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM r""".replace("SELECT *, value FROM ledger", "SELECT * FROM ledger").replace("value * 1.5", "value * 1.5e0"),
)
def spend_prefix(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("user_id", "seq", "cost", (F.col("value") * 1.5).cast("decimal(18,6)").alias("bound"), (F.col("status") == "provider_error").alias("failed"))
    return L.running_spend(rows, 800, "seq", key="user_id").select("user_id", "seq", F.col("after").cast("double").alias("after"), "stopped")


@query("planned_calls", LEDGER_SQL + "SELECT count(*) AS calls, count(DISTINCT prompt_id) AS prompts, count(DISTINCT model) AS models FROM (SELECT DISTINCT prompt_id FROM ledger) CROSS JOIN (SELECT DISTINCT model FROM ledger)")
def planned_calls(spark, sf_dir):
    return _plan(spark, sf_dir).agg(F.count("*").alias("calls"), F.countDistinct("prompt_id").alias("prompts"), F.countDistinct("model").alias("models"))


def _plan(spark, sf_dir) -> DataFrame:
    models = spark.createDataFrame([(f"m{i}",) for i in range(4)], "model string")
    return ledger(spark, sf_dir).select("prompt_id").distinct().crossJoin(F.broadcast(models))


@query("pending_pairs", LEDGER_SQL + "SELECT prompt_id, model FROM (SELECT DISTINCT prompt_id FROM ledger) CROSS JOIN (SELECT DISTINCT model FROM ledger) WHERE (prompt_id, model) NOT IN (SELECT (prompt_id, model) FROM latest WHERE status IN ('success', 'grading_failure')) AND model NOT IN (SELECT model FROM latest WHERE model = 'm3')")
def pending_pairs(spark, sf_dir):
    """The plan without what is complete and without excluded models."""
    done = latest(spark, sf_dir).where("status IN ('success', 'grading_failure')").select("prompt_id", "model")
    excluded = spark.createDataFrame([("m3",)], "model string")
    return _plan(spark, sf_dir).join(done, ["prompt_id", "model"], "left_anti").join(F.broadcast(excluded), "model", "left_anti").select("prompt_id", "model")


@query("reconcile", LEDGER_SQL + "SELECT prompt_id, model, CASE WHEN status <> 'success' AND model IN ('m1', 'm2') THEN 'new-' || model ELSE model END AS configured, CASE WHEN status <> 'success' AND model IN ('m1', 'm2') THEN 'superseded:' || model END AS fingerprint FROM latest")
def reconcile(spark, sf_dir):
    """Unpaid rows move to corrected ids and remember the old ones; paid rows keep theirs."""
    registry = spark.createDataFrame([("m1", "new-m1"), ("m2", "new-m2")], "model string, corrected string")
    rows = latest(spark, sf_dir).join(F.broadcast(registry), "model", "left")
    moved = (F.col("status") != "success") & F.col("corrected").isNotNull()
    return rows.select("prompt_id", "model", F.when(moved, F.col("corrected")).otherwise(F.col("model")).alias("configured"), F.when(moved, F.concat(F.lit("superseded:"), "model")).alias("fingerprint"))


@query("treatment_plan", LEDGER_SQL + "SELECT model, count(*) AS calls, CAST(sum(cost * 3) AS DOUBLE) AS bound, sum(cost * 3) > 500 AS over_cap, count(*) FILTER (retry_count >= 3) AS issues FROM latest WHERE status = 'provider_error' AND error_type = 'output_limit_exhausted' GROUP BY 1")
def treatment_plan(spark, sf_dir):
    rows = latest(spark, sf_dir).where("status = 'provider_error' AND error_type = 'output_limit_exhausted'")
    bound = F.sum(F.col("cost") * 3)
    return rows.groupBy("model").agg(F.count("*").alias("calls"), bound.cast("double").alias("bound"), (bound > 500).alias("over_cap"), F.count_if(F.col("retry_count") >= 3).alias("issues"))


@query("recoverable_prompts", LEDGER_SQL + "SELECT count(*) FILTER (now) AS complete_now, count(*) FILTER (later) AS complete_if_recovered FROM (SELECT count(*) FILTER (status = 'success') = 4 AS now, count(*) FILTER (status IN ('success', 'provider_error')) = 4 AS later FROM latest GROUP BY prompt_id)")
def recoverable_prompts(spark, sf_dir):
    s = F.col("status")
    each = latest(spark, sf_dir).groupBy("prompt_id").agg((F.count_if(s == "success") == 4).alias("now"), (F.count_if(s.isin("success", "provider_error")) == 4).alias("later"))
    return each.agg(F.count_if("now").alias("complete_now"), F.count_if("later").alias("complete_if_recovered"))


_HALVES_SQL = LEDGER_SQL + ", before AS (SELECT * FROM ledger WHERE seq < 6000 QUALIFY row_number() OVER (PARTITION BY prompt_id, model ORDER BY seq DESC) = 1)\n"


@query("ledger_diff", _HALVES_SQL + "SELECT count(*) FILTER (b.seq IS NULL) AS added, count(*) FILTER (a.seq IS NULL) AS removed, count(*) FILTER (a.status <> b.status) AS changed_status, count(*) FILTER (a.correct <> b.correct) AS changed_grade, CAST(coalesce(sum(a.cost), 0) - coalesce(sum(b.cost), 0) AS DOUBLE) AS spend_delta FROM latest a FULL JOIN before b USING (prompt_id, model)")
def ledger_diff(spark, sf_dir):
    before = L.latest(ledger(spark, sf_dir).where("seq < 6000"), ("prompt_id", "model"), "seq").alias("b")
    j = latest(spark, sf_dir).alias("a").join(before, ["prompt_id", "model"], "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.agg(
        F.count_if(F.col("b.seq").isNull()).alias("added"), F.count_if(F.col("a.seq").isNull()).alias("removed"), F.count_if(F.col("a.status") != F.col("b.status")).alias("changed_status"),
        F.count_if(F.col("a.correct") != F.col("b.correct")).alias("changed_grade"), (total("a.cost") - total("b.cost")).cast("double").alias("spend_delta"),
    )


@query("input_drift", _HALVES_SQL + "SELECT a.prompt_id, a.model FROM latest a JOIN before b USING (prompt_id, model) WHERE a.error_type IS DISTINCT FROM b.error_type")
def input_drift(spark, sf_dir):
    """Null-safe: a value that appears or goes is a change, two nulls are not."""
    before = L.latest(ledger(spark, sf_dir).where("seq < 6000"), ("prompt_id", "model"), "seq").select("prompt_id", "model", F.col("error_type").alias("old"))
    return latest(spark, sf_dir).join(before, ["prompt_id", "model"]).where(~F.col("error_type").eqNullSafe(F.col("old"))).select("prompt_id", "model")


# -- scalar functions -----------------------------------------------------------------------------------------------


@query("mock_latency", "SELECT doc_id, greatest(1, CAST(round_even(length(text) / 4, 0) AS BIGINT)) AS tokens, 50 + CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 200 AS latency_ms FROM documents")
def mock_latency(spark, sf_dir):
    jitter = F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("bigint") % 200
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1).cast("bigint"), F.bround(F.length("text") / 4).cast("bigint")).alias("tokens"), (jitter + 50).alias("latency_ms"))


@query("mock_label", "SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 2) AS INT) % 3 AS label FROM documents")
def mock_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.conv(F.substring(F.sha2("text", 256), 1, 2), 16, 10).cast("int") % 3).alias("label"))


_HTTP_SQL = "CASE WHEN s IN (401, 403) THEN 'authentication_error' WHEN s = 402 OR contains(msg, 'insufficient_quota') THEN 'quota_or_billing_error' WHEN s = 404 OR contains(msg, 'model_not_found') THEN 'invalid_model_error' WHEN s IN (400, 413, 422) THEN 'invalid_parameter_error' WHEN s IN (408, 409, 425, 429) OR s BETWEEN 500 AND 599 THEN 'transient_provider_error' ELSE 'provider_error' END"


@query("classify_http", f"SELECT class, count(*) AS n, count(*) FILTER (class = 'transient_provider_error') AS retryable FROM (SELECT {_HTTP_SQL} AS class FROM (SELECT [400, 401, 402, 403, 404, 408, 418, 429, 500, 503][1 + event_id % 10] AS s, CASE event_type WHEN 'purchase' THEN 'insufficient_quota' WHEN 'signup' THEN 'model_not_found' ELSE event_type END AS msg FROM events)) GROUP BY 1")
def classify_http(spark, sf_dir):
    from pathfold.functions.responses import classify_http as classify

    s = F.element_at(F.array(*[F.lit(x) for x in (400, 401, 402, 403, 404, 408, 418, 429, 500, 503)]), (F.col("event_id") % 10 + 1).cast("int"))
    kind = F.col("event_type")
    message = F.when(kind == "purchase", "Insufficient_Quota").when(kind == "signup", "model_not_found").otherwise(kind)
    rows = table(spark, sf_dir, "events").select(F.inline(F.array(classify(s, message))))
    return rows.groupBy(F.col("error_type").alias("class")).agg(F.count("*").alias("n"), F.count_if("retryable").alias("retryable"))


@query("reconstruct_records", "SELECT conv_id, any_value(text ORDER BY turn) AS prompt, count(*) AS rows, len(regexp_extract_all(any_value(text ORDER BY turn), '(?m)^[A-Z]')) AS labels FROM conversations GROUP BY 1".replace("any_value(text ORDER BY turn)", "arg_min(text, turn)"))
def reconstruct_records(spark, sf_dir):
    """The first saved row of each key holds the grading inputs."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"), F.count("*").alias("rows"))
    return first.withColumn("labels", F.size(F.regexp_extract_all("prompt", F.lit("(?m)^[A-Z]"), F.lit(0))).cast("bigint"))


@query("render_choices", "SELECT item_id, text || chr(10) || 'A. ' || substr(text, 1, 10) || chr(10) || 'B. ' || substr(text, 11, 10) || chr(10) || 'C. ' || substr(text, 21, 10) AS prompt FROM benchmark")
def render_choices(spark, sf_dir):
    choices = F.array(*[F.struct(F.lit(k).alias("k"), F.substring("text", at, 10).alias("v")) for k, at in (("A", 1), ("B", 11), ("C", 21))])
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws("\n", F.col("text"), F.transform(choices, lambda x: F.concat_ws(". ", x["k"], x["v"]))).alias("prompt"))


@query("markdown_rows", "SELECT n_nationkey AS key, '| ' || replace(n_name, '|', '\\|') || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS line FROM nation")
def markdown_rows(spark, sf_dir):
    from pathfold.sources.sinks import markdown_line

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), markdown_line("n_name", "n_regionkey").alias("line"))


@query("ticks_to_usd", "SELECT event_id, CAST(CAST(round(value * 100) AS BIGINT) * 37756 / 10000000000 AS DOUBLE) AS usd FROM events".replace("* 37756 / 10000000000", "* 37756 / 1e10"))
def ticks_to_usd(spark, sf_dir):
    ticks = (F.round(F.col("value") * 100).cast("bigint") * 37756).cast("decimal(28,0)")
    return table(spark, sf_dir, "events").select("event_id", (ticks / F.lit(10_000_000_000).cast("decimal(28,0)")).cast("double").alias("usd"))


@query(
    "normalize_responses",
    """WITH r AS (SELECT event_id, event_id % 3 AS shape, user_id AS a, event_id % 17 AS b, CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS t FROM events)
SELECT event_id, CASE WHEN t <> '' THEN t END AS text, a AS input_tokens, b AS output_tokens, CASE WHEN t <> '' THEN 'completed' WHEN shape = 0 THEN 'output_limit_exhausted' WHEN shape = 1 THEN 'empty_completion' ELSE 'incomplete_response' END AS outcome FROM r""",
)
def normalize_responses(spark, sf_dir):
    """Three response layouts become one: text, tokens, outcome."""
    from pathfold.functions.responses import normalize_response

    e, u = F.col("event_id"), F.col("user_id")
    t = F.when(e % 17 == 0, "").otherwise(F.col("event_type"))
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"), F.lit("length").alias("finish_reason"))).alias("choices"), F.struct(u.alias("prompt_tokens"), (e % 17).alias("completion_tokens")).alias("usage")))
    message = F.to_json(F.struct(F.lit("end_turn").alias("stop_reason"), F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"), F.struct(u.alias("input_tokens"), (e % 17).alias("output_tokens")).alias("usage")))
    output = F.to_json(F.struct(F.lit("incomplete").alias("status"), F.array(F.struct(F.array(F.struct(t.alias("text"))).alias("content"))).alias("output"), F.struct(u.alias("input_tokens"), (e % 17).alias("output_tokens")).alias("usage")))
    body = F.when(e % 3 == 0, chat).when(e % 3 == 1, message).otherwise(output)
    return table(spark, sf_dir, "events").select("event_id", F.inline(F.array(normalize_response(body))))
