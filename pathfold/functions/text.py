"""Text features of a prompt as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, brackets, and the patterns of code, mathematics and answer choices.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BRACKETS = "()[]{}"
WORD = r"[\p{L}\p{N}_]+"
CODE = r"```|\b(?:def |class |import |SELECT |function\s*\(|#include)"
MATH = r"\\(?:frac|sqrt|sum|int|boxed)|\$|[=^∑∫√]|\d\s*[+*/<>]\s*\d"
CHOICE = r"(?m)^\s*(?:[A-J][.)]|\([A-J]\))\s+"


def count_text(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("bigint")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def prompt_features(text: Column) -> dict[str, Column]:
    """The sixteen features, all whole numbers; nothing but the text is read."""
    n = F.length(text).cast("bigint")
    return {
        "character_length": n,
        "word_count": F.regexp_count(text, F.lit(WORD)).cast("bigint"),
        "token_estimate": F.ceil(n / F.lit(4)).cast("bigint"),
        "line_count": F.when(n == 0, F.lit(0)).otherwise(count_text(text, "\n") + 1).cast("bigint"),
        "code_fence_count": count_text(text, "```"),
        "contains_code": text.rlike(CODE).cast("bigint"),
        "contains_math": text.rlike(MATH).cast("bigint"),
        "answer_choice_count": F.regexp_count(text, F.lit(CHOICE)).cast("bigint"),
        "digit_count": F.regexp_count(text, F.lit("[0-9]")).cast("bigint"),
        "question_mark_count": count_text(text, "?"),
        "punctuation_count": count_chars(text, PUNCTUATION),
        "comma_count": count_text(text, ","),
        "period_count": count_text(text, "."),
        "colon_count": count_text(text, ":"),
        "semicolon_count": count_text(text, ";"),
        "bracket_count": count_chars(text, BRACKETS),
    }


#: The names of the features above, in order.
NAMES = (
    "character_length", "word_count", "token_estimate", "line_count", "code_fence_count", "contains_code", "contains_math", "answer_choice_count",
    "digit_count", "question_mark_count", "punctuation_count", "comma_count", "period_count", "colon_count", "semicolon_count", "bracket_count",
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text: Column) -> Column:
    """How often each lower-case ASCII letter occurs."""
    return F.transform(F.array(*[F.lit(x) for x in LETTERS]), lambda x: (F.length(text) - F.length(F.replace(text, x, F.lit("")))).cast("double"))


def unit(vector: Column) -> Column:
    """The vector at length 1; one without length stays zero. The vector and its length are variables of lambdas, so each is
    computed once for a row, not once for each number."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    size = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)), F.lit(1e-12))
    return once(vector, lambda v: once(size(v), lambda s: F.transform(v, lambda x: x / s)))
