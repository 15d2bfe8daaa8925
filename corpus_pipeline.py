"""A training-corpus pipeline: quality, one of each near-copy group, pseudonyms, the mix, pieces.

Every stage takes a DataFrame with the columns of documents, in any state: null texts are empty, null ids and sources are
values of their own, repeated rows are rows (near_copies keeps one of each), texts of any length are taken whole, an empty
table gives an empty one, and further columns, whatever their names, go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold.llm import jaccard, mixing, piece_bpe, pii, quality
from pathfold.llm.common import discard, materialize
from pathfold.llm.queries import PII_KEY, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted of their own lines go; the others lose their host's boilerplate lines,
    and n_chars follows. Null and empty texts fail the base rules."""
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the document with the smallest id stays, and of that id's texts one.
    Documents without words are nobody's copies. Rows go by id and text, so no text is lost with another's id."""
    return jaccard.one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced within its format, equal values by equal ones; n_chars follows the text. No row is
    lost, null texts stay null."""
    out = pii.pseudonymize(docs, PII_KEY, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources reach their targets; copies are rows of their own. Sources without
    words have nothing to reach."""
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy's text, and whether they decode to it again; a null text has no ids."""
    return piece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality_rules), ("near_copies", near_copies), ("pii", pseudonyms), ("mix", source_mix), ("pieces", pieces)]

#: Components, pseudonyms and pieces are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote is deleted once the next one's rows are written."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
