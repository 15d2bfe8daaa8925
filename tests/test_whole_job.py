"""Queries do the whole job: no rows, draws, folds or forms are left out."""

from pathfold.plans import catalog


def test_every_event_is_normalised(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert catalog.QUERIES["normalize_responses"](spark, sf).count() == events
    assert catalog.QUERIES["normalize_sources"](spark, sf).count() >= events


def test_bootstraps_have_all_replicates(spark, sf):
    from pathfold.plans import uncertainty_queries as u

    assert u.bootstrap_replicates(u.pairs(spark, sf)).select("replicate").distinct().count() == 2000
