"""Host-level quality rules with empirical-Bayes shrinkage.

Each document is tested by page rules; failures are added up by host (the column
``source``), and each host's failure rate of each rule is shrunk towards the corpus by a
beta prior whose mean and strength come from the hosts themselves (method of moments: the variance of the hosts' rates
less what the sizes of the hosts alone make of it).
A host fails a rule when its shrunk rate exceeds ``host_limit``; the host verdicts join
back to the documents.

Plan: built-in functions only. One scan of (doc_id, source, text) yields flags, which are written once, the text
goes no further; the per-host sums combine before the shuffle, so a hot host costs one
row per task, and the join back moves no text and lets AQE choose and split it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: A rule flags a document that fails it; the limits of its figure are in LIMITS. A text of a single word may be a good one, so only texts without any fail.
RULES = ("wordless", "long_words", "symbols", "few_letters", "repeated_lines", "shouting")
LIMITS = {"min_words": 1, "max_word_length": 14.0, "max_symbols": 0.06, "min_letters": 0.5, "max_repeated_lines": 0.3, "max_upper": 0.5}
HOST_LIMIT, MAX_FAILED = 0.5, 0


def _flags(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chars = F.length(text)
    # letters by what is left when they are taken out: no array of words is built
    words = F.length(F.regexp_replace(text, r"[^\s]+", "x")) - F.length(F.regexp_replace(F.regexp_replace(text, r"[^\s]+", "x"), "x", ""))
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    letters = chars - F.length(F.regexp_replace(text, r"\p{L}", ""))
    upper = chars - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    symbols = chars - F.length(F.regexp_replace(text, r"[#%&*$<>{}|\\^~=_+@]", ""))
    lines = F.split(text, "\n")
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("words"), solid.alias("solid"), letters.alias("letters"), upper.alias("upper"), symbols.alias("symbols"), F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("distinct_lines"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    tests = {
        "wordless": F.col("words") < LIMITS["min_words"],
        "long_words": ratio("solid", "words") > LIMITS["max_word_length"],
        "symbols": ratio("symbols", "solid") > LIMITS["max_symbols"],
        "few_letters": ratio("letters", "solid") < LIMITS["min_letters"],
        "repeated_lines": 1 - ratio("distinct_lines", "lines") > LIMITS["max_repeated_lines"],
        "shouting": ratio("upper", "letters") > LIMITS["max_upper"],
    }
    return base.select("doc_id", "source", *(F.when(t, 1).otherwise(0).alias(r) for r, t in tests.items()))


def host_rates(flags: DataFrame) -> DataFrame:
    """(source, docs, and per rule its shrunk rate): one row for each host, null among them."""
    hosts = flags.groupBy("source").agg(F.count("*").alias("docs"), *(F.sum(r).alias(f"n_{r}") for r in RULES))
    prior = hosts.agg(
        *(F.avg(F.col(f"n_{r}") / F.col("docs")).alias(f"m_{r}") for r in RULES),
        *(F.coalesce(F.var_samp(F.col(f"n_{r}") / F.col("docs")), F.lit(0.0)).alias(f"v_{r}") for r in RULES),
        F.avg(1 / F.col("docs")).alias("size"),
    )
    joined = hosts.crossJoin(F.broadcast(prior))  # the prior is one row
    rates = []
    for r in RULES:
        m = F.col(f"m_{r}")
        # rates of n documents vary by m(1 - m)/n though their hosts be alike
        v = F.round(F.col(f"v_{r}") - m * (1 - m) * F.col("size"), 12)
        # strength a + b = m(1 - m)/v - 1, kept within 1 .. 1e6; no spread between hosts: the strongest prior
        strength = F.when(v <= 0, F.lit(1e6)).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / F.when(v > 0, v) - 1)))
        rates.append(F.round((F.col(f"n_{r}") + strength * m) / (F.col("docs") + strength), 6).alias(f"rate_{r}"))
    return joined.select("source", "docs", *rates)


def host_verdicts(docs: DataFrame, host_limit: float = HOST_LIMIT, max_failed: int = MAX_FAILED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, failed, host_docs, host_failed, keep.

    ``failed`` is the number of rules that the document fails, ``host_failed`` the number that
    its host fails. A document is kept if it fails at most ``max_failed`` rules and its host none.

    * A null or empty text fails ``wordless`` and ``few_letters``. Documents without a source share a host.
    * Repeated rows count and are returned each. Other columns are ignored, whatever their names.
    * An empty table gives an empty result.
    """
    flags = cut(_flags(docs))
    hosts = host_rates(flags).select(F.col("source").alias("__host"), F.col("docs").alias("host_docs"), reduce(add, (F.when(F.col(f"rate_{r}") > host_limit, 1).otherwise(0) for r in RULES)).alias("host_failed"))
    failed = reduce(add, (F.col(r) for r in RULES)).alias("failed")
    joined = flags.select("doc_id", "source", failed).join(hosts, F.col("source").eqNullSafe(F.col("__host")))
    return joined.select("doc_id", "source", "failed", "host_docs", "host_failed", ((F.col("failed") <= max_failed) & (F.col("host_failed") == 0)).alias("keep"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_verdicts(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rate = lambda r: f"round((n_{r} + s_{r} * m_{r}) / (docs + s_{r}), 6)"
    return f"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
sizes AS (
  SELECT doc_id, source,
    len(regexp_extract_all(t, '[^\\t\\n\\v\\f\\r ]+')) AS words,
    len(regexp_replace(t, '[\\t\\n\\v\\f\\r ]', '', 'g')) AS solid,
    len(t) - len(regexp_replace(t, '\\p{{L}}', '', 'g')) AS letters,
    len(t) - len(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS upper,
    len(t) - len(regexp_replace(t, '[#%&*$<>{{}}|\\\\^~=_+@]', '', 'g')) AS symbols,
    len(string_split(t, chr(10))) AS lines, len(list_distinct(string_split(t, chr(10)))) AS distinct_lines
  FROM base),
flags AS (
  SELECT doc_id, source,
    (words < {LIMITS["min_words"]})::INT AS wordless,
    (coalesce(solid / nullif(words, 0), 0) > {LIMITS["max_word_length"]})::INT AS long_words,
    (coalesce(symbols / nullif(solid, 0), 0) > {LIMITS["max_symbols"]})::INT AS symbols,
    (coalesce(letters / nullif(solid, 0), 0) < {LIMITS["min_letters"]})::INT AS few_letters,
    (1 - distinct_lines / lines > {LIMITS["max_repeated_lines"]})::INT AS repeated_lines,
    (coalesce(upper / nullif(letters, 0), 0) > {LIMITS["max_upper"]})::INT AS shouting
  FROM sizes),
hosts AS (SELECT source, count(*) AS docs, {", ".join(f"sum({r}) AS n_{r}" for r in RULES)} FROM flags GROUP BY source),
moments AS (SELECT avg(1 / docs) AS size, {", ".join(f"avg(n_{r} / docs) AS m_{r}, coalesce(var_samp(n_{r} / docs), 0) AS w_{r}" for r in RULES)} FROM hosts),
prior AS (SELECT *, {", ".join(f"round(w_{r} - m_{r} * (1 - m_{r}) * size, 12) AS v_{r}" for r in RULES)} FROM moments),
strengths AS (SELECT *, {", ".join(f"CASE WHEN v_{r} <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, m_{r} * (1 - m_{r}) / nullif(v_{r}, 0) - 1)) END::DOUBLE AS s_{r}" for r in RULES)} FROM prior),
verdicts AS (SELECT source, docs, {" + ".join(f"({rate(r)} > {HOST_LIMIT})::INT" for r in RULES)} AS host_failed FROM hosts, strengths)
SELECT f.doc_id, f.source, {" + ".join(f"f.{r}" for r in RULES)} AS failed, v.docs AS host_docs, v.host_failed,
       {" + ".join(f"f.{r}" for r in RULES)} <= {MAX_FAILED} AND v.host_failed = 0 AS keep
FROM flags f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""


OP4_SQL = _sql()
