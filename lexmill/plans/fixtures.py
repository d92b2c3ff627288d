"""Inputs of the registered queries, derived alike in Spark and in SQL from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH
from ..operators import index
from ..operators.corpus import corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files have fewer splits than there are cores, which only small inputs have."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spread(table(spark, sf_dir, "documents")))


_stored: dict[tuple, index.Index] = {}


def stored(spark: SparkSession, sf_dir: str, kind: str = "all", docs: DataFrame | None = None) -> index.Index:
    """The index of the documents (or of ``docs``, by its name), built once a session into the shared folder and read from there by every search."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _stored:
        _stored[key] = index.temporary(documents(spark, sf_dir) if docs is None else docs)
    return _stored[key]


def with_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their column ``lang``, which no join need bring."""
    return corpus(spread(table(spark, sf_dir, "documents")), "lang")


CORPUS = """corpus AS (
  SELECT doc_id AS doc_key, source || '-' || doc_id AS doc_id, source || '-' || doc_id AS title, source || '-' || doc_id || '.txt' AS source_file, source, lang, text
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""

STOP = "[" + ", ".join(f"'{w}'" for w in ENGLISH) + "]"


def sql_tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains({STOP}, x))"


POSTINGS = f"""tokens AS (
  SELECT doc_key, unnest({sql_tokens("title")}) AS w, 1 AS title FROM corpus
  UNION ALL SELECT doc_key, unnest({sql_tokens("text")}) AS w, 0 AS title FROM corpus),
parts AS (SELECT doc_key, unnest(string_split(w, '_')) AS token, title FROM tokens),
postings AS (SELECT doc_key, token, sum(title)::BIGINT AS tf_title, sum(1 - title)::BIGINT AS tf_body FROM parts WHERE token <> '' GROUP BY ALL),
lengths AS (SELECT c.doc_key, coalesce(sum(tf_title + tf_body), 0)::BIGINT AS dl FROM corpus c LEFT JOIN postings p ON p.doc_key = c.doc_key GROUP BY c.doc_key),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths),
frequency AS (SELECT token, count(*) AS df FROM postings GROUP BY token)"""

BM25 = f"""asked AS (SELECT query_id, token, count(*) AS times FROM (
  SELECT query_id, unnest(string_split(w, '_')) AS token FROM (SELECT query_id, unnest(({sql_tokens("text")})[1:64]) AS w FROM queries)) WHERE token <> '' GROUP BY ALL),
weights AS (SELECT query_id, a.token, times, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM asked a JOIN frequency f ON f.token = a.token, stats),
scores AS (
  SELECT query_id, doc_key, -sum(round(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) * 1e12)::BIGINT)::DOUBLE / 1e12 AS score
  FROM (SELECT w.query_id, p.doc_key, times, idf, (10 * tf_title + tf_body)::DOUBLE AS f, dl FROM weights w JOIN postings p ON p.token = w.token JOIN lengths l ON l.doc_key = p.doc_key), stats
  GROUP BY query_id, doc_key)"""

FIXED = "thing reation Licensed under the MIT License version ndre oration heed"
FIXED_TOKENS = ["thing", "reation", "licensed", "mit", "license", "version", "ndre", "oration", "heed"]


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUERIES = "queries AS (SELECT item_id AS query_id, text, 10 AS top_k FROM benchmark)"


def fixed_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(FIXED).alias("text"))


FIXED_QUERY = f"queries AS (SELECT 0::BIGINT AS query_id, '{FIXED}' AS text, 10 AS top_k)"


WIDE = "".join(chr(c) for c in range(48, 58)) + "".join(chr(c) for c in range(65, 91))


def wide(text: Column) -> Column:
    """ASCII digits and capitals as full-width characters, whose normal form they are."""
    return F.translate(text, WIDE, "".join(chr(ord(c) + 0xFEE0) for c in WIDE))


def marked_text(text: Column) -> Column:
    """A text with structure: every seventh line is a heading, a blank line follows every fifth."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.when((i + 1) % 7 == 0, F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" "))).otherwise(""), x, F.when((i + 1) % 5 == 0, "\n").otherwise(""))), "\n")


MARKED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 7 = 0 THEN repeat('#', ((i - 1) % 3 + 1)::INT) || ' ' ELSE '' END || x || CASE WHEN i % 5 = 0 THEN chr(10) ELSE '' END), chr(10))"


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", marked_text(F.col("text")))


STRUCTURED = f"{CORPUS}, structured AS (SELECT doc_key, doc_id, title, source_file, {MARKED} AS text FROM corpus)"
LINES = """slines AS (
  SELECT doc_key, unnest(parts) AS text, generate_subscripts(parts, 1)::BIGINT AS line FROM (
    SELECT doc_key, CASE WHEN last = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM (
      SELECT doc_key, string_split(text, chr(10)) AS parts, string_split(text, chr(10))[-1] AS last FROM structured)))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as document trees: a conversation is a document, its turns are nodes."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id").cast("string")
    return c.select(F.concat(F.lit("c"), key).alias("doc_id"), F.concat(key, F.lit(":"), F.col("turn").cast("string")).alias("node_id"), F.lit("item").alias("kind"), F.concat(F.lit("c"), key).alias("parent_id"), F.col("turn").cast("int").alias("ordinal"), F.col("role").alias("label"), F.col("text").alias("body_md"), F.lit("false").alias("is_leaf"), F.lit("current").alias("source_version"))


NODES = """nodes AS (
  SELECT 'c' || conv_id AS doc_id, conv_id || ':' || turn AS node_id, 'item' AS kind, 'c' || conv_id AS parent_id, turn::INT AS ordinal, role AS label,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) AS body_md, 'current' AS source_version FROM conversations)"""


def snapshot(docs: DataFrame, which: int) -> DataFrame:
    """Two states of the same documents. The first has no French ones, the second no German ones; in the second the source
    of every longer text differs, and of the longest ones the text too."""
    size, text = F.length("text"), F.col("text")
    if which == 1:
        kept, source, body = docs.filter("lang <> 'fr'"), text, text
    else:
        kept = docs.filter("lang <> 'de'")
        source = F.when(size > 1500, F.concat(text, F.lit(" "))).otherwise(text)
        body = F.when(size > 3000, F.concat(text, F.lit(" changed"))).otherwise(text)
    return kept.select("doc_id", F.concat(F.lit("/in/"), F.col("source_file")).alias("source_path"), F.sha2(source, 256).alias("source_fingerprint"), F.sha2(body, 256).alias("text_fingerprint"), F.lit(True).alias("is_active"))


SNAPSHOTS = f"""{CORPUS}, old AS (
  SELECT doc_id, '/in/' || source_file AS source_path, sha256(text) AS source_fingerprint, sha256(text) AS text_fingerprint, true AS is_active FROM corpus WHERE lang <> 'fr'),
fresh AS (
  SELECT doc_id, '/in/' || source_file AS source_path, sha256(CASE WHEN len(text) > 1500 THEN text || ' ' ELSE text END) AS source_fingerprint,
         sha256(CASE WHEN len(text) > 3000 THEN text || ' changed' ELSE text END) AS text_fingerprint, true AS is_active FROM corpus WHERE lang <> 'de'),
changes AS (
  SELECT coalesce(o.doc_id, f.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN f.doc_id IS NULL THEN 'removed' WHEN f.source_fingerprint = o.source_fingerprint THEN 'unchanged'
         WHEN f.text_fingerprint = o.text_fingerprint THEN 'metadata_only' ELSE 'rebuild' END AS change
  FROM fresh f FULL OUTER JOIN old o USING (source_path))"""
