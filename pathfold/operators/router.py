"""A saved router: trained once, written as a versioned artifact, and used on new prompts without the data that it came from.

The artifact is a folder of Parquet tables and a manifest that is written last:

    heads       a model's weights on the features (intercept last), or its prevalence alone
    scaling     mean and deviation of each dense feature
    vocabulary  term, place and inverse document frequency
    costs       mean training cost of each model
    references  vectors of the training prompts, for the novelty gate
    manifest    version, policy, models, the SHA-256 of every file, and a digest of all that

Loading compares every file with the manifest, where the files are read, and refuses an artifact with a changed, missing or
surplus file. Heads, scaling, vocabulary and costs have the size of the model; references may be many and stay a table.

Defined results: requests need distinct ids that are not blank, and texts; anything else is an error that tells how many.
No requests give no rows; further columns are ignored. Where the gate is shut the reference model answers.
"""

from __future__ import annotations

import hashlib
import json
from collections import namedtuple
from collections.abc import Mapping
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold.functions.text import NAMES, letter_counts, prompt_features, unit
from pathfold.operators import heads, learning, novelty, routing, scan
from pathfold.sources.storage import freeze

VERSION = 1
#: Rows of a file of an artifact at most, so that each can be read and hashed whole.
FILE_ROWS = 200_000

Head = namedtuple("Head", "model_id prevalence weights")


@dataclass(frozen=True)
class Policy:
    """A rule on one family's probabilities; gate is the quantile of the training prompts' similarities below which the
    reference answers, 0 for none. Family 'static' always takes the reference."""

    policy_id: str
    family: str
    kind: str
    value: float
    gate: float
    reference: str


def dense(text: Column, family: str) -> Column:
    """The dense features of a family as an array of doubles."""
    known = prompt_features(text)
    numbers, letters = F.array(*[known[n].cast("double") for n in NAMES]), unit(letter_counts(text))
    return {"handcrafted": numbers, "embedding": letters, "embedding_handcrafted": F.concat(letters, numbers)}[family]


def vectors(prompts: DataFrame, *others: str) -> DataFrame:
    """(vec_id, embedding, others) of prompts(id, prompt, others)."""
    return prompts.select(F.xxhash64("id").alias("vec_id"), unit(letter_counts(F.col("prompt"))).alias("embedding"), *others)


def scaling(raw: DataFrame) -> DataFrame:
    """(place, mean, deviation) of raw(id, x); a constant feature has the deviation 1."""
    each = raw.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    return each.withColumn("deviation", F.when(F.col("deviation") > 0, F.col("deviation")).otherwise(F.lit(1.0)))


def scaled(raw: DataFrame, rows: list) -> DataFrame:
    """raw(id, x) as heads take it: (id, columns, values)."""
    known = {r.place: r for r in rows}
    of = lambda name: F.array(*[F.lit(float(getattr(known[i], name))) for i in range(len(known))])
    centred = F.zip_with(F.col("x"), of("mean"), lambda x, m: x - m)
    return raw.select("id", *heads.dense(F.zip_with(centred, of("deviation"), lambda x, d: x / d)))


def centroid_heads(features: DataFrame, labels: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """(model_id, prevalence, weights) in closed form: a feature's mean where the model succeeded less its mean where it failed, and
    the log odds of success as intercept. One aggregate over all rows; null weights with one class."""
    joined = features.join(labels, "id").select("columns", "values", F.explode("labels").alias("model_id", "y")).where(F.col("y").isNotNull())
    each = joined.select("model_id", "y", F.inline(F.arrays_zip("columns", "values")))
    means = each.groupBy("model_id", "columns").agg((F.avg(F.when(F.col("y") == 1, F.col("values"))) - F.avg(F.when(F.col("y") == 0, F.col("values")))).alias("w"))
    listed = means.groupBy("model_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("columns", "w"))), lambda x: x["w"]).alias("w"))
    shares = joined.groupBy("model_id").agg(F.avg("y").alias("prevalence"))
    q = F.col("prevalence")
    weights = F.when((q > 0) & (q < 1), F.concat("w", F.array(F.log(q / (1 - q)))))
    return shares.where(F.col("model_id").isin(*models)).join(listed, "model_id", "left").select("model_id", "prevalence", weights.alias("weights"))


def train(prompts: DataFrame, labels: DataFrame, costs: Mapping[str, float], policy: Policy, models: tuple[str, ...], fit: str = "logistic", penalty: float = 1.0) -> dict[str, DataFrame]:
    """The artifact's tables from training prompts(id, prompt, label: whose similarities do not count) and labels(id, labels: map of
    successes). fit is 'logistic' or 'centroid', both on all rows."""
    spark = prompts.sparkSession
    tables = {"costs": spark.createDataFrame([(m, i, float(costs[m])) for i, m in enumerate(models)], "model_id string, place int, cost double")}
    if policy.family == "tfidf":
        counted = freeze(learning.term_counts(prompts, "id", "prompt"), "term-counts")
        fitted = learning.Tfidf.fit(counted, prompts.count())
        tables["vocabulary"] = spark.createDataFrame([(w, i, float(x)) for i, (w, x) in enumerate(zip(fitted.words, fitted.idf, strict=True))], "term string, place int, idf double")
        features, width, scale = fitted.apart(counted), len(fitted.words), fitted.idf
    elif policy.family != "static":
        raw = freeze(prompts.select("id", dense(F.col("prompt"), policy.family).alias("x")), "features")
        tables["scaling"] = freeze(scaling(raw), "scaling")
        rows = tables["scaling"].collect()  # a row for each feature
        features, width, scale = scaled(raw, rows), len(rows), None
    if policy.family != "static":
        tables["heads"] = centroid_heads(features, labels, models) if fit == "centroid" else heads.fitted_on_all(freeze(features, "scaled"), labels, models, width, penalty, scale)[0]
    if policy.gate:
        tables["references"] = vectors(prompts, F.col("label").cast("long").alias("label"))
    return tables


def _digests(spark: SparkSession, path: str, names: list[str]) -> dict[str, str]:
    """SHA-256 of every file of the tables, computed where they are read."""
    found: dict[str, str] = {}
    for name in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{name}")
        for row in files.select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha")).collect():  # a row for each file
            found[f"{name}/{row.file}"] = row.sha
    return found


def _sealed(content: dict) -> str:
    return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()


def save(tables: Mapping[str, DataFrame], policy: Policy, path: str) -> None:
    """Write the artifact below path, which must not exist; the manifest comes last, so half an artifact is none."""
    spark = tables["costs"].sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(f"{path}/{name}")
    cut = None
    if policy.gate:
        refs = spark.read.parquet(f"{path}/references")
        found = scan.quantiles(novelty.max_similarity(refs, refs, other_groups=True).select(F.round("similarity", 6).alias("similarity")), [], "similarity", (policy.gate,)).first()
        cut = round(found.q[0], 9) if found else None
    content = {"version": VERSION, "policy": asdict(policy), "cut": cut, "tables": sorted(tables), "files": _digests(spark, path, sorted(tables))}
    text = json.dumps(content | {"digest": _sealed(content)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


class Router:
    """A loaded artifact; `route` reads nothing else."""

    def __init__(self, spark: SparkSession, path: str):
        lines = spark.read.text(f"{path}/manifest").collect()  # one line
        try:
            content = json.loads(lines[0].value)
            seal = content.pop("digest")
        except (IndexError, ValueError, KeyError) as error:
            raise ValueError("the manifest cannot be read") from error
        if seal != _sealed(content) or content["version"] != VERSION:
            raise ValueError("the manifest is changed, or of another version")
        there = _digests(spark, path, content["tables"])
        wrong = sorted(f for f in content["files"].keys() | there.keys() if content["files"].get(f) != there.get(f))
        if wrong:
            raise ValueError(f"changed, missing or surplus files: {', '.join(wrong)}")
        self.spark, self.policy, self.cut = spark, Policy(**content["policy"]), content["cut"]
        read = lambda name: spark.read.parquet(f"{path}/{name}") if name in content["tables"] else None
        # What follows has the size of the model, whatever it was trained on.
        self.costs = [(r.model_id, r.cost) for r in read("costs").orderBy("place").collect()]
        known = {r.model_id: Head(r.model_id, r.prevalence, r.weights) for r in read("heads").collect()} if "heads" in content["tables"] else {}
        self.heads = [known.get(m, Head(m, 0.0, None)) for m, _ in self.costs]
        self.scaling = read("scaling").collect() if "scaling" in content["tables"] else []
        terms = read("vocabulary").orderBy("place").collect() if "vocabulary" in content["tables"] else []
        self.vocabulary = learning.Tfidf([r.term for r in terms], np.array([r.idf for r in terms])) if terms else None
        self.references = read("references")

    def checked(self, requests: DataFrame) -> DataFrame:
        """(id, prompt) of requests(prompt_id, prompt), or an error."""
        rows = requests.select(F.col("prompt_id").cast("string").alias("id"), F.col("prompt").cast("string").alias("prompt"))
        blank = F.count_if(F.col("id").isNull() | (F.trim("id") == "")).alias("blank")
        bad = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("prompt").isNull()).alias("textless"))
        seen = bad.agg(F.sum("n"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("textless").alias("textless"), blank).first()
        if any(seen[c] for c in ("repeated", "textless", "blank")):
            raise ValueError(f"{seen.blank} blank ids, {seen.repeated} repeated ids, {seen.textless} requests without text")
        return rows

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """(id, p): each head's probability of success, in the order of the costs."""
        if self.vocabulary is not None:
            found = self.vocabulary.transform(learning.term_counts(rows, "id", "prompt"))
            found = rows.select("id").join(found, "id", "left")  # a request without terms has none
            features = found.select("id", F.coalesce("columns", F.array().cast("array<int>")).alias("columns"), F.coalesce("values", F.array().cast("array<double>")).alias("values"))
        else:
            features = scaled(rows.select("id", dense(F.col("prompt"), self.policy.family).alias("x")), self.scaling)
        return heads.probabilities(features, self.heads).select("id", "p")

    def route(self, requests: DataFrame) -> DataFrame:
        """prompt_id, model_id, estimated_cost, probabilities (null for a static router), policy_id and novelty_fallback."""
        rows, rule = self.checked(requests), self.policy
        if rule.family == "static":
            scored = rows.select("id", F.lit(None).cast("array<double>").alias("p"))
        else:
            scored = self.probabilities(rows)
        shut = F.lit(False)
        if rule.gate:
            similar = novelty.max_similarity(vectors(rows, F.lit(None).cast("long").alias("label")), self.references)
            similar = vectors(rows, "id").select("vec_id", "id").join(similar, "vec_id").select("id", F.round("similarity", 6).alias("similarity"))
            scored, shut = scored.join(similar, "id", "left"), F.coalesce(F.col("similarity") < F.lit(self.cut), F.lit(False))
        entry = lambda i, m, c: F.struct(F.lit(m).alias("model_id"), F.lit(i).alias("idx"), F.lit(float(c)).alias("c"), F.coalesce(F.get("p", i), F.lit(0.0)).alias("p"), F.lit(0.0).alias("y"), F.lit(0.0).alias("cost"))
        held = scored.select("id", "p", shut.alias("shut"), F.array(*[entry(i, m, c) for i, (m, c) in enumerate(self.costs)]).alias("pool"))
        reference = routing.static(F.col("pool"), F.lit(rule.reference))
        chosen = reference if rule.family == "static" else F.when(F.col("shut"), reference).otherwise(routing.decide(F.col("pool"), F.lit(rule.kind), F.lit(float(rule.value)), F.lit(rule.reference), rule.reference))
        names = F.array(*[F.lit(m) for m, _ in self.costs])
        out = held.select("id", "shut", F.when(F.col("p").isNotNull(), F.map_from_arrays(names, F.col("p"))).alias("probabilities"), chosen.alias("it"))
        return out.select(F.col("id").alias("prompt_id"), F.col("it.model_id").alias("model_id"), F.col("it.c").alias("estimated_cost"), "probabilities", F.lit(rule.policy_id).alias("policy_id"), F.col("shut").alias("novelty_fallback"))
