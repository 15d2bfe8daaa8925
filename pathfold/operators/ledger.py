"""The result ledger: one row for each recorded outcome of a prompt and a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfold.operators import scan

#: Fixed values.
STATUSES = ("success", "parsing_failure", "grading_failure", "provider_error", "skipped_model")
RESPONDED = ("success", "parsing_failure", "grading_failure")
PERMANENT = ("invalid_model_error", "configuration_error", "authentication_error")
TASK_OF = {"choice": "multiple_choice", "math": "math", "code": "code"}


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key. An aggregate, so most rows are dropped before the shuffle; ties cannot be, as `order` is
    unique."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_it")).select(*keys, "_it.*")


def attempts() -> Column:
    """Provider calls behind a row; recorded numbers win over what status and retries imply."""
    retries = F.coalesce(F.col("retry_count"), F.lit(0))
    inferred = F.when(F.col("status") == "skipped_model", 0).when(F.col("error_type") == "spend_limit_error", retries).otherwise(1 + retries)
    return F.coalesce(F.col("provider_attempts"), inferred)


def responses() -> Column:
    return F.col("status").isin(*RESPONDED).cast("int")


def response_cost() -> Column:
    """Cost of the response alone; an older row with retries has none that is known."""
    return F.coalesce(F.col("response_cost"), F.when(F.coalesce(F.col("retry_count"), F.lit(0)) == 0, F.col("cost")))


def metrics() -> list[Column]:
    s = F.col("status")
    graded = F.count_if(s == "success")
    right = F.count_if((s == "success") & F.col("correct"))
    return [
        F.count("*").alias("recorded_pairs"), graded.alias("graded"), F.sum(attempts()).cast("bigint").alias("attempted_calls"), F.sum(responses()).cast("bigint").alias("responses"),
        F.sum(attempts() - responses()).cast("bigint").alias("failed_attempts"), right.alias("correct_responses"), F.round(F.try_divide(right, graded), 9).alias("accuracy"),
        F.count_if((s == "provider_error") & (F.col("error_type") != "spend_limit_error")).alias("provider_failures"), F.count_if(s == "parsing_failure").alias("parsing_failures"),
        F.count_if(s == "grading_failure").alias("grading_failures"), F.count_if(s == "skipped_model").alias("skipped_pairs"), F.count_if(F.col("error_type") == "spend_limit_error").alias("spend_limit_stops"),
        F.sum("cost").cast("double").alias("cost"), F.round(F.avg(F.when(s.isin(*RESPONDED), F.col("latency_ms"))), 6).alias("latency_ms"),
    ]


def classification() -> Column:
    """Why a row has no grade, or `other`."""
    s, e = F.col("status"), F.col("error_type")
    return (
        F.when(e == "spend_limit_error", "spend-limit stop").when(s == "skipped_model", "skipped historical row").when(s == "parsing_failure", "parsing failure").when(s == "grading_failure", "grading failure")
        .when(e.isin(*PERMANENT), "permanent provider/model failure").when(e == "network_error", "transient provider failure").otherwise("other")
    )


def running_spend(rows: DataFrame, cap, *order: str, key: str | None = None) -> DataFrame:
    """Spend before and after each call, and whether the call is made: calls stop before the first that could pass the cap.
    A failed attempt is charged its whole bound. Totals are made by ranges, so one account may hold all rows."""
    keys, by = [key] if key else [], [F.col(c) for c in order]
    charged = rows.withColumn("charge", F.when(F.col("failed"), F.col("bound")).otherwise(F.col("cost")))
    spent = scan.running(charged, keys, by, {"after": ("sum", F.col("charge"))})
    over = (F.col("after") - F.col("charge") + F.col("bound") > cap).cast("int")
    stopped = scan.running(spent, keys, by, {"stops": ("max", over)})
    return stopped.withColumn("stopped", F.col("stops") == 1).drop("stops")
