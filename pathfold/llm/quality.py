"""Quality rules with cross-document line frequency, in built-in column functions only.

Base rules of a text: number of words, characters in words, symbols, repeated lines, words in repeated three-word
windows; a text fails with fewer than MIN_WORDS words or with more than half of its words in repeated windows.

Line frequency: lines are normalised (white space collapsed, trimmed, lower-cased) and hashed. For each host the
distinct documents that hold a line are counted - documents with the same text are one document, so that copies do not
condemn their own original. A line is boilerplate and is removed when at least LINE_DOCS documents and more than
LINE_PERCENT of the host's hold it, or more than LINE_MANY whatever their share; a document that loses more than half
of its characters in words is depleted and is rejected. Counting shuffles hashes of a line, its host and its text, never
the text. A host's boilerplate is a short array that is broadcast behind a check of its bytes and its longest array;
beyond it the hashes of a document's own boilerplate are joined to it by (host, text), which no hot host skews.

Defined results: a null text is the empty text (no words, base fails); a null host is a host of its own; equal rows
get equal verdicts and each has its row; a null id keeps its row; texts of any length are judged whole; other columns,
whatever their names, stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfold.llm.common import dealt_join, fits, materialize

GAP = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
MIN_WORDS, REPEAT_PERCENT = 50, 50
LINE_DOCS, LINE_PERCENT, LINE_MANY, DEPLETED_PERCENT = 5, 2, 200, 50
#: A host's boilerplate is looked up in an array of at most so many lines, all of at most so many bytes.
LONGEST, ARRAY_BYTES = 2048, 32 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def repeated_window_words(windows: Column) -> Column:
    """From the hashes of a text's three-word windows in order: words that lie in a window found twice or more. Sorting
    brings equal windows together; a word is counted once however many such windows hold it."""
    numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def twice(x: Column, i: Column, row: Column) -> Column:
        return F.coalesce(x["h"] == F.get(row, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(row, i + 1)["h"], F.lit(False))

    starts = F.element_at(F.transform(F.array(numbered), lambda row: F.sort_array(F.transform(F.filter(row, lambda x, i: twice(x, i, row)), lambda x: x["p"]))), 1)
    walk = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), walk).otherwise(F.lit(0))


def base_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; one pass, no shuffle."""
    kept = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    split = kept.withColumn("_words", words_of(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(SOLID)))
    n = F.size("_words")
    hashed = split.select(
        "_row",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    # The generator keeps later filters from being pushed below, where they would compute all of this again.
    numbers = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_window_words(F.col("_windows")).cast("bigint").alias("n_repeat_words"))
    counted = hashed.select("_row", F.inline(F.array(numbers)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, GAP, " ")))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def _keys(text: Column, host: Column) -> list[Column]:
    return [F.coalesce(F.xxhash64(host), F.lit(0)).alias("host_key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")]


def host_lines(docs: DataFrame, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    """(host_key, text_key) and (host_key, text_key, line) of the documents, with repeats."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(host_col), F.lit("\0")).alias("host"), text.alias("text"))
    solid = F.filter(F.split("text", "\n"), lambda x: x.rlike(SOLID))
    keys = _keys(F.col("text"), F.col("host"))
    return rows.select(*keys), rows.select(*keys, F.explode(F.array_distinct(F.transform(solid, _line_hash))).alias("line"))


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_percent: float = LINE_PERCENT, line_many: int = LINE_MANY) -> DataFrame:
    """(host_key, line, many): the lines of each host that are boilerplate, and the documents that hold them."""
    texts, lines = host_lines(docs, text_col, host_col)
    # A row for each line of each distinct document; copies and repeats meet here, partly before the shuffle.
    counted = lines.distinct().groupBy("host_key", "line").agg(F.count("*").alias("many")).where(F.col("many") >= min(line_docs, line_many + 1))
    hosts = texts.distinct().groupBy("host_key").agg(F.count("*").alias("host_docs"))
    share = (F.col("many") >= line_docs) & (100 * F.col("many") > line_percent * F.col("host_docs"))
    return counted.join(hosts, "host_key").where(share | (F.col("many") > line_many)).select("host_key", "line", "many")


def _with_boilerplate(metrics: DataFrame, docs: DataFrame, text_col: str, host_col: str, longest: int, most_bytes: int, **limits) -> DataFrame:
    """metrics(_row, ...) with the array `frequent`: hashes among which all boilerplate lines of the row are."""
    above = materialize(frequent_lines(docs, text_col, host_col, **limits), "frequent-lines")
    by_host = materialize(above.groupBy("host_key").agg(F.sort_array(F.collect_list("line")).alias("frequent")), "host-lines") if fits(above, most_bytes // 8, most_bytes) else None
    host, text = _keys(F.col(f"_row.{text_col}"), F.coalesce(F.col(f"_row.{host_col}"), F.lit("\0")))
    if by_host is not None and (by_host.agg(F.max(F.size("frequent"))).first()[0] or 0) <= longest:
        return metrics.withColumn("host_key", host).join(F.broadcast(by_host), "host_key", "left").drop("host_key")
    _, lines = host_lines(docs, text_col, host_col)
    hits = dealt_join(lines.distinct(), above, ["host_key", "line"], F.col("text_key"), 1 << 16)
    own = hits.groupBy("host_key", "text_key").agg(F.collect_set("line").alias("frequent"))
    return metrics.withColumns({"host_key": host, "text_key": text}).join(own, ["host_key", "text_key"], "left").drop("host_key", "text_key")


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", percent: int = DEPLETED_PERCENT, longest: int = LONGEST, most_bytes: int = ARRAY_BYTES, **limits) -> DataFrame:
    """_row (the input's row), the base metrics, base_failed, left_text (the text without its host's boilerplate), n_lost and
    lost (lines, and characters in words, that went) and kept (base passed and not depleted)."""
    joined = _with_boilerplate(base_metrics(docs, text_col), docs, text_col, host_col, longest, most_bytes, **limits)
    text = F.col(f"_row.{text_col}")
    solid = lambda x: F.when(x.rlike(SOLID), F.array_contains(F.col("frequent"), _line_hash(x))).otherwise(F.lit(False))
    marked = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(x.alias("l"), solid(x).alias("hit")))
    lines = joined.withColumn("_lines", F.when(F.col("frequent").isNotNull(), marked)).drop("frequent")
    gone = F.filter("_lines", lambda x: x["hit"])
    lost = F.aggregate(gone, F.lit(0), lambda acc, x: acc + F.length(F.regexp_replace(x["l"], GAP, "")))
    stays = F.array_join(F.transform(F.filter("_lines", lambda x: ~x["hit"]), lambda x: x["l"]), "\n")
    n_lost = F.coalesce(F.size(gone), F.lit(0)).cast("bigint")
    left = F.struct(F.when(n_lost > 0, stays).otherwise(text).alias("left_text"), n_lost.alias("n_lost"), F.coalesce(lost, F.lit(0)).cast("bigint").alias("lost"))
    names = [c for c in lines.columns if c != "_lines"]
    return lines.select(*names, F.inline(F.array(left))).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost") <= percent * F.col("word_chars")))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost, kept."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    return judge(slim).select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "kept")


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that are kept, without their frequent lines, with the columns of the input. A column n_chars, where
    there is one of numbers, follows the text."""
    kept = judge(docs, text_col, host_col).where("kept")
    counted = dict(docs.dtypes).get("n_chars") in ("int", "bigint")
    changed = {text_col: F.col("left_text")} | ({"n_chars": F.when(F.col("lost") > 0, F.length("left_text")).otherwise(F.col("_row.n_chars"))} if counted else {})
    return kept.select(*[changed.get(c, F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
