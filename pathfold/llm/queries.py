"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold.llm import hamming_topk, jaccard, language_id, media, mixing, piece_bpe, pii, quality, secrets, token_align, token_files, token_parquet, turn_trie
from pathfold.llm.common import read_table

PII_KEY = "pathfold-demo-key"
TOP_K = 10


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vec_id divisible by 100, against all rows."""
    rows = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = hamming_topk.search_vectors(rows, "vec_id", "embedding", F.col("id") % 100 == 0, k=TOP_K)
    return found.select(F.col("query_id").alias("query_vec_id"), "rank", F.col("id").alias("vec_id"), "distance")


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    out = pii.pseudonymize(docs, PII_KEY)
    return out.select("doc_id", "text", "pii_count", *[F.col(f"pii_kinds.n_{k}").alias(f"n_{k}") for k in pii.KINDS])


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.write_and_count(docs, tokenizer_path("byte_bpe_50k.json"), 50256)


def op5_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return token_parquet.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), 0)


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return piece_bpe.digest(docs, tokenizer_path("piece_bpe_32k.model"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    bucket = F.crc32(F.col("doc_id").cast("string")) % 4
    fitted = language_id.fit(*language_id.training_sample(docs, bucket != 2))
    found = language_id.identify(docs, fitted)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op11_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the difference hash; the tile's digest stands for the tile."""
    found = media.round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    own = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    return found.select(*own, F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return token_align.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first crc32(c) % 4 turns of conversation c - c % 20."""
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return turn_trie.trie(turns, turn_trie.Heads(lambda c: c - c % 20, lambda c: F.crc32(c.cast("string")) % 4, 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_hamming_topk, op2_pii_pseudonyms, op3_jaccard_join, op4_token_counts, op5_token_parquet, op6_line_quality, op7_sentencepiece, op8_secret_scan, op9_source_mix, op10_language_id, op11_media_columns, op12_token_align, op13_turn_trie)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Unsigned CRC-32 of an ASCII text, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
  lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, byte)), 4294967295), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op1_hamming_topk": """
WITH bits AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE len(embedding) = 64),
pairs AS (
  SELECT q.vec_id AS query_vec_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.b[i] <> c.b[i] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM bits q, bits c WHERE q.vec_id % 100 = 0)
SELECT query_vec_id, rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10
""",
    "op3_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(r.c, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) r USING (doc_id)
""",
    "op6_line_quality": rf"""
WITH t AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
         length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
frequent AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM lines GROUP BY ALL)
  JOIN (SELECT host, count(DISTINCT text) AS docs FROM t GROUP BY host) USING (host) WHERE (n >= 5 AND 100 * n > 2 * docs) OR n > 200),
gone AS (SELECT doc_id, sum(chars) AS lost, count(*) AS n_lost FROM lines SEMI JOIN frequent USING (host, norm) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost, NOT base_failed AND 100 * lost <= 50 * word_chars AS kept FROM (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed, coalesce(g.lost, 0) AS lost, CAST(coalesce(g.n_lost, 0) AS BIGINT) AS n_lost
  FROM t LEFT JOIN repeated r USING (doc_id) LEFT JOIN dups d USING (doc_id) LEFT JOIN gone g USING (doc_id))
""",
    "op9_source_mix": rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM w),
h AS (SELECT *, CAST(total - 3 * before AS DOUBLE) / (weights - used) AS share FROM o),
f AS (SELECT arg_min(share, k) AS level, min(k) AS k FROM h WHERE share * weight <= 3 * source_size),
g AS (SELECT source, source_size, CASE WHEN f.k IS NULL OR h.k < f.k THEN CAST(3 * source_size AS DOUBLE) ELSE f.level * weight END AS target FROM h, f),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(sha256('mix:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
""",
    "op13_turn_trie": rf"""
WITH t AS (
  SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS k, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS r FROM t),
convs AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 20 AS base, {_CRC32.format("conv_id")} % 4 AS h FROM t),
joined AS (
  SELECT c, 0 AS side, r, k, words FROM convs JOIN numbered n ON n.conv_id = base AND r <= h UNION ALL
  SELECT c, 1, r, k, words FROM convs JOIN numbered n ON n.conv_id = c AND r > h),
places AS (
  SELECT c, row_number() OVER w AS d, words, string_agg(k, '') OVER w AS name FROM joined WINDOW w AS (PARTITION BY c ORDER BY side, r ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, 0, '' FROM convs),
ended AS (SELECT c, arg_max(name, d) AS name FROM places GROUP BY c),
nodes AS (SELECT name, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM places GROUP BY name, d),
kids AS (SELECT substr(name, 1, 64 * (depth - 1)) AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN kids USING (name) LEFT JOIN nodes p ON n.depth > 0 AND p.name = substr(n.name, 1, 64 * (n.depth - 1))),
above AS (SELECT substr(name, 1, 64 * k) AS name, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM own, LATERAL (SELECT unnest(range(CAST(length(name) // 64 + 1 AS BIGINT))) AS k)),
sums AS (SELECT name, CAST(count(*) FILTER (leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY 1),
hashes AS (SELECT name, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM ended GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sums USING (name) LEFT JOIN hashes USING (name)
""",
}
