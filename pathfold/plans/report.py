"""Markdown reports composed of result tables. Tables are summaries; a larger one is an error of markdown_table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pathfold.plans import catalog
from pathfold.sources.sinks import markdown_table

#: Fixed value: sections of the evaluation report, each a title and a query.
EVALUATION = (
    ("Data", "audit_summary"), ("Coverage by model", "coverage_by_model"), ("Splits", "split_counts"), ("Training costs", "training_costs"), ("Policies on test prompts", "evaluate_policies"), ("Efficient policies", "pareto_frontier"),
    ("Selected policy", "select_validation"), ("Router and baseline", "paired_delta"), ("Bootstrap intervals", "paired_bootstrap"), ("Joint bounds", "joint_bounds"), ("Joint selection", "select_joint"), ("Calibration", "calibration_scores"),
)
PILOT = (("Completeness", "pilot_completeness"), ("Signal", "pilot_signal"), ("Ledger", "ledger_metrics"), ("By model", "ledger_metrics_by"), ("Models", "static_metrics"), ("Agreement", "agreement_counts"), ("Oracle", "oracle_with_fallback"))


def render(spark: SparkSession, sf_dir: str, title: str, sections: tuple[tuple[str, str], ...]) -> str:
    parts = [f"# {title}"]
    for name, key in sections:
        df = catalog.QUERIES[key](spark, sf_dir)
        parts += [f"## {name}", markdown_table(df.orderBy(*df.columns))]
    return "\n\n".join(parts) + "\n"
