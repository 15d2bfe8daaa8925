"""The exact form of text normalisation: NFKC, case folding, white space collapsed. Spark has no NFKC, so this is an
Arrow-batched pandas UDF; `operators.prep.normalized_text` is the built-in form for text without compatibility characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(text: str | None) -> str | None:
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def normalize_exact(text: pd.Series) -> pd.Series:
    return text.map(folded)
