"""Queries of the learning operators and graders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathfold.functions import grading
from pathfold.functions.text import prompt_features
from pathfold.operators import learning
from pathfold.plans.bridge import table
from pathfold.plans.registry import query

_TERMS_SQL = r"""WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
terms AS (SELECT doc_id, unnest(w) AS term FROM toks UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM toks)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 50000),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1e0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)
"""


@query("tfidf", _TERMS_SQL + "SELECT doc_id, count(*) AS terms, round(sum(w), 6) AS weight, round(max(w), 6) AS heaviest FROM tfidf GROUP BY 1")
def tfidf(spark, sf_dir):
    _, rows = learning.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text")
    weight = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x)
    return rows.where(F.size("columns") > 0).select(F.col("id").alias("doc_id"), F.size("columns").cast("bigint").alias("terms"), F.round(weight, 6).alias("weight"), F.round(F.array_max("values"), 6).alias("heaviest"))


@query("tfidf_vocabulary", _TERMS_SQL + "SELECT term, df, CAST(total AS BIGINT) AS total FROM voc")
def tfidf_vocabulary(spark, sf_dir):
    """The whole vocabulary: 50,000 terms at most."""
    return learning.vocabulary(learning.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("standard_scale", "WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem WHERE l_linenumber < 4) SELECT l_returnflag, l_linestatus, round(sum((l_quantity - m) / d), 5) AS scaled, round(sum(((l_quantity - m) / d) ** 2), 5) AS squared FROM lineitem, s GROUP BY ALL")
def standard_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    scaled = learning.standard_scale(rows, rows.where("l_linenumber < 4"), "l_quantity")
    return scaled.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 5).alias("scaled"), F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")), 5).alias("squared"))


@query("token_chunks", r"SELECT doc_id, greatest(1, (len(w) + 127) // 128) AS chunks, CAST(len(w) - 128 * (greatest(1, (len(w) + 127) // 128) - 1) AS BIGINT) AS last_size FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)")
def token_chunks(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", learning.token_chunks(words, 128).alias("c"))
    return rows.select("doc_id", F.size("c").cast("bigint").alias("chunks"), F.size(F.element_at("c", -1)).cast("bigint").alias("last_size"))


@query(
    "pooled_vectors",
    "WITH e AS (SELECT label, vec_id % 5 + 1 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT label, i, sum(CAST(x AS DOUBLE) * w) / sum(w) AS x FROM e GROUP BY ALL) SELECT label, CAST(i AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM s",
)
def pooled_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 5 + 1)
    return learning.pooled(rows, "label", "embedding", "w").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("dense_families", "SELECT e.vec_id, len(e.embedding) + 2 AS width, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first, length(d.text) AS characters FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def dense_families(spark, sf_dir):
    """An embedding and a prompt's counts as one vector."""
    f = prompt_features(F.col("text"))
    counts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.array(f["character_length"].cast("double"), f["comma_count"].cast("double")).alias("counts"))
    rows = table(spark, sf_dir, "embeddings").join(counts, "vec_id").withColumn("x", F.concat(F.transform("embedding", lambda v: v.cast("double")), "counts"))
    return rows.select("vec_id", F.size("x").alias("width"), F.round(F.col("x")[0], 6).alias("first"), F.element_at("x", -2).cast("bigint").alias("characters"))


@query("feature_head")
def feature_head(spark, sf_dir):
    """A head with a penalised intercept on scaled features."""
    f = prompt_features(F.col("text"))
    names = ["word_count", "line_count", "digit_count", "punctuation_count"]
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), *[f[n].cast("double").alias(n) for n in names])
    scaled = learning.standard_scale(rows, rows.where("doc_id % 5 <> 0"), *names).select(F.col("doc_id").alias("id"), "label", F.array(*names).alias("features"))
    weights, intercept = learning.fit_head(scaled.where("id % 5 <> 0"), 1.0)
    return scaled.where("id % 5 = 0").select("id", "label", learning.head_probability(F.col("features"), weights, intercept).alias("p"))


# -- graders --------------------------------------------------------------------------------------------------------

_ANSWER_SQL = "CASE event_id % 6 WHEN 0 THEN '(' || chr(CAST(65 + user_id % 6 AS INT)) || ')' WHEN 1 THEN 'So.' || chr(10) || 'Final answer is ' || chr(CAST(97 + user_id % 6 AS INT)) || '.' WHEN 2 THEN 'Option B' || chr(10) || 'Option C' WHEN 3 THEN 'x \\boxed{' || chr(CAST(65 + user_id % 6 AS INT)) || '}' WHEN 4 THEN '**D**' ELSE event_type END"


def _answers(spark, sf_dir):
    e, u = F.col("event_id") % 6, F.col("user_id") % 6
    text = (
        F.when(e == 0, F.concat(F.lit("("), F.char(u + 65), F.lit(")"))).when(e == 1, F.concat(F.lit("So.\nFinal answer is "), F.char(u + 97), F.lit("."))).when(e == 2, "Option B\nOption C")
        .when(e == 3, F.concat(F.lit("x \\boxed{"), F.char(u + 65), F.lit("}"))).when(e == 4, "**D**").otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", text.alias("answer"))


_PARSED_SQL = (
    f"WITH a AS (SELECT event_id, user_id, trim({_ANSWER_SQL}) AS t FROM events), d AS (SELECT *, upper(coalesce(nullif(regexp_extract(t, '^\\s*[\\(\\[]?([A-Za-z])[\\)\\].]?\\s*$', 1), ''), nullif(regexp_extract(t, '^\\*\\*([A-Za-z])\\*\\*$', 1), ''))) AS direct, "
    "list_distinct(list_filter(list_transform(regexp_extract_all(t, '(?im)^\\s*(?:final\\s+)?answer\\s*(?:is|:)\\s*[\\(\\[]?([A-Za-z])[\\)\\]]?\\s*[.!]?\\s*$', 1) || regexp_extract_all(t, '(?im)^\\s*option\\s*[\\(\\[]?([A-Za-z])[\\)\\]]?\\s*[.!]?\\s*$', 1) || regexp_extract_all(t, '\\\\boxed\\{\\s*([A-Za-z])\\s*\\}', 1), lambda x: upper(x)), lambda x: x IN ('A', 'B', 'C', 'D'))) AS named FROM a), "
    "p AS (SELECT *, CASE WHEN direct IN ('A', 'B', 'C', 'D') THEN direct WHEN len(named) = 1 THEN named[1] END AS parsed FROM d) "
)


@query("parse_choice", _PARSED_SQL + "SELECT event_id, parsed FROM p")
def parse_choice(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", grading.parse_choice(F.col("answer"), "ABCD").alias("parsed"))


@query("grade_choice", _PARSED_SQL + "SELECT parsed, count(*) AS n, count(*) FILTER (parsed = chr(CAST(65 + user_id % 6 AS INT))) AS right_answers FROM p GROUP BY 1")
def grade_choice(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("parsed", grading.parse_choice(F.col("answer"), "ABCD"))
    return rows.groupBy("parsed").agg(F.count("*").alias("n"), F.count_if(grading.grade_choice(F.col("parsed"), F.char(F.col("user_id") % 6 + 65))).alias("right_answers"))


_CODE_SQL = r"regexp_replace(regexp_extract('Here:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.', '(?is)```(?:python|py)?[ \t]*\r?\n(.*?)```', 1), '^\s+|\s+$', '', 'g')"


@query("extract_code", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN nullif({_CODE_SQL}, '') END AS code FROM conversations")
def extract_code(spark, sf_dir):
    """Every second turn's text in a fence is code; the others have neither fences nor lines of code."""
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here:\n```python\n"), "text", F.lit("\n```\nDone.")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", grading.extract_code(fenced).alias("code"))


def _saved(spark, sf_dir):
    """Saved answers in four layouts, three of which say the reference's value."""
    n, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Thus \\boxed{\\frac{"), n, F.lit("}{2}}"))).when(k == 1, F.concat(F.lit("The final answer is: $"), n, F.lit("/2$")))
        .when(k == 2, F.concat(F.lit("x = "), n, F.lit("*0.5"))).otherwise(F.concat(n, F.lit("\\pi")))
    )
    return table(spark, sf_dir, "events").select("event_id", k.alias("layout"), text.alias("saved"), F.concat(n, F.lit("/2")).alias("reference"))


_REGRADE_SQL = "SELECT event_id % 4 AS layout, count(*) AS n, count(*) AS parsed, count(*) FILTER (event_id % 4 <> 3 OR user_id = 0) AS right_answers FROM events GROUP BY 1"


@query("regrade", _REGRADE_SQL)
def regrade(spark, sf_dir):
    """Saved texts are parsed and graded again: mathematics, exactly."""
    rows = _saved(spark, sf_dir)
    graded = rows.withColumn("parsed", grading.parse_math("saved")).withColumn("correct", grading.grade_math("parsed", "reference"))
    return graded.groupBy("layout").agg(F.count("*").alias("n"), F.count("parsed").alias("parsed"), F.count_if("correct").alias("right_answers"))


@query("grader_functions", _REGRADE_SQL)
def grader_functions(spark, sf_dir):
    """The graders as functions of SQL, which is where a user would plug in their own."""
    spark.udf.register("parse_math", grading.parse_math)
    spark.udf.register("grade_math", grading.grade_math)
    saved = _saved(spark, sf_dir)
    return spark.sql("SELECT layout, count(*) AS n, count(parsed) AS parsed, count_if(grade_math(parsed, reference)) AS right_answers FROM (SELECT *, parse_math(saved) AS parsed FROM {saved}) GROUP BY layout", saved=saved)
