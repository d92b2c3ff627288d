"""Line evidence, the out-of-scope gate, status and the rendered answers of a query batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .index import Index
from .search import MAX_TOKENS, POOL, Batch, batch, candidates, read_candidates, reranked

MAX_LINES, SHOWN, LONG = 10, 5, 3


def line_hits(line: Column, tokens: Column) -> Column:
    """Tokens found in the line, repeats included."""
    return lowered_hits(F.lower(line), tokens)


def lowered_hits(low: Column, tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.contains(low, t))).cast("long")


def matching_lines(text: Column, tokens: Column, most: int = MAX_LINES) -> Column:
    """array<(line, text)>: the lines with the most hits, earlier lines first among equals."""
    # each line is lowered once, before the tokens are tried; only the best lines are cut to what is shown
    rows = F.transform(tx.lines(text), lambda x, i: F.struct(F.lower(x).alias("low"), (i + 1).cast("long").alias("line"), x.alias("text")))
    every = F.transform(rows, lambda r: F.struct((-lowered_hits(r["low"], tokens)).alias("order"), r["line"].alias("line"), r["text"].alias("text")))
    best = F.slice(F.array_sort(F.filter(every, lambda m: m["order"] < 0)), 1, most)
    return F.transform(best, lambda m: F.struct(m["line"].alias("line"), tx.rstrip(m["text"]).alias("text")))


def in_scope(tokens: Column, matches: Column) -> Column:
    """Whether a token of LONG or more characters stands in a matched line; true if there is no such token."""
    long = F.filter(tokens, lambda t: F.length(t) >= LONG)
    return (F.size(long) == 0) | F.exists(matches, lambda m: F.exists(long, lambda t: F.contains(F.lower(m["text"]), t)))


def results(index: Index, queries: DataFrame | Batch, rerank: bool = True) -> DataFrame:
    """(query_id, rank, doc_key, doc_id, title, source_file, score, matches): search results with their lines.

    The texts of the candidates are read once, for rerank and lines alike.
    """
    asked = batch(queries)
    rows = read_candidates(index, asked, candidates(index, asked, POOL if rerank else 1))
    found = matching_lines(tx.strip(F.col("text")), F.col("tokens")).alias("matches")
    if not rerank:
        return rows.select("query_id", "rank", "doc_key", "doc_id", "title", "source_file", F.round("score", 6).alias("score"), found)
    # the texts of a few candidates a query go through the ranking, so that lines are sought in what stays alone
    best = reranked(rows, *map(F.col, ("doc_id", "title", "source_file", "tokens", "text")))
    return best.select("query_id", "rank", "doc_key", "doc_id", "title", "source_file", "score", found)


def answers(index: Index, queries: DataFrame | Batch, rerank: bool = True) -> DataFrame:
    """One row for each query: status, next_action, match expression and results in order.

    An empty query, or one without results, has no_hits. If no long token stands in a retained
    line, the query is out of scope and its results are dropped.
    """
    asked_batch = batch(queries)
    asked = asked_batch.rows
    rows = results(index, asked_batch, rerank)
    gathered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "source_file", "score", "matches"))).alias("found"))
    joined = asked.join(gathered, "query_id", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<rank:bigint,doc_id:string,title:string,source_file:string,score:double,matches:array<struct<line:bigint,text:string>>>>)")))
    every = F.flatten(F.transform("found", lambda r: r["matches"]))
    scope = in_scope(F.col("tokens"), every)
    blank = (tx.strip(F.col("text")) == "") | (F.size("found") == 0)
    gated = ~blank & ~scope
    strong = F.exists(F.slice("found", 1, 2), lambda r: F.size(r["matches"]) >= 2)
    status = F.when(blank | gated, "no_hits").when(strong, "high_confidence").otherwise("needs_verification")
    action = F.when(gated, "out_of_scope").when(blank, "retry_broader_or_stop").otherwise("read_file_at_lines")
    clause = F.array_join(F.transform(F.slice("tokens", 1, MAX_TOKENS), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
    kept = F.when(gated, F.slice("found", 1, 0)).otherwise(F.col("found"))
    return joined.select("query_id", "text", status.alias("status"), action.alias("next_action"), F.when(blank, "").otherwise(clause).alias("match"), gated.alias("out_of_scope"), kept.alias("results"))


def compact(answered: DataFrame) -> DataFrame:
    """Answers with the first SHOWN results as JSON."""
    return answered.select("query_id", "status", "next_action", "match", F.to_json(F.slice("results", 1, SHOWN)).alias("results"))


def markdown(answered: DataFrame) -> DataFrame:
    """(query_id, markdown): every result with a table of its lines."""

    def row(m: Column) -> Column:
        return F.concat(F.lit("| "), m["line"].cast("string"), F.lit(" | "), tx.inline_markdown(m["text"]), F.lit(" |\n"))

    def block(r: Column) -> Column:
        table = F.when(F.size(r["matches"]) > 0, F.concat(F.lit("- matches: "), F.size(r["matches"]).cast("string"), F.lit(" line(s)\n\n| line | text |\n|---|---|\n"), F.array_join(F.transform(r["matches"], row), ""), F.lit("\n"))).otherwise("\n")
        return F.concat(F.lit("## "), tx.inline_markdown(r["title"]), F.lit(" (`"), tx.inline_markdown(r["source_file"]), F.lit("`)\n\n- bm25_score: "), F.format_string("%.4f", r["score"]), F.lit("\n"), table)

    head = F.concat(F.lit("# Query Results\n\n- query: `"), tx.inline_markdown(F.col("text")), F.lit("`\n- documents: "), F.size("results").cast("string"), F.lit("\n\n"))
    body = F.when(F.size("results") == 0, "*No matching documents found.*\n\n").otherwise(F.array_join(F.transform("results", block), ""))
    return answered.select("query_id", F.concat(head, body).alias("markdown"))


def summary_markdown(answered: DataFrame) -> DataFrame:
    """(query_id, markdown): the short form, with at most MAX_LINES lines for each document."""

    def row(m: Column) -> Column:
        return F.concat(F.lit("  - L"), m["line"].cast("string"), F.lit(": "), tx.inline_markdown(m["text"]), F.lit("\n"))

    def block(r: Column) -> Column:
        found = F.when(F.size(r["matches"]) > 0, F.concat(F.lit("- matching_lines: "), F.size(r["matches"]).cast("string"), F.lit("\n"), F.array_join(F.transform(F.slice(r["matches"], 1, MAX_LINES), row), ""))).otherwise("")
        return F.concat(F.lit("### "), tx.inline_markdown(r["title"]), F.lit("\n\n- score: "), F.format_string("%.4f", r["score"]), F.lit("\n- file: `"), tx.inline_markdown(r["source_file"]), F.lit("`\n"), found, F.lit("\n"))

    shown = F.when(F.size("results") > 0, "high_confidence").otherwise("no_hits")
    reason = F.when(F.col("out_of_scope"), "- reason: `out_of_scope`\n").otherwise("")
    clause = F.when(F.col("match") != "", F.concat(F.lit("- fts_match: `"), tx.inline_markdown(F.col("match")), F.lit("`\n"))).otherwise("")
    action = F.when(F.col("out_of_scope"), "out_of_scope").when(F.size("results") > 0, "read_file_at_lines").otherwise("retry_broader_or_stop")
    head = F.concat(F.lit("# Evidence Summary\n\n## Decision Summary\n\n- query: `"), tx.inline_markdown(F.col("text")), F.lit("`\n- status: `"), shown, F.lit("`\n"), reason, clause, F.lit("- next_action: `"), action, F.lit("`\n\n## Matching Documents\n\n"))
    body = F.when(F.size("results") == 0, "*No matching documents found.*\n\n").otherwise(F.array_join(F.transform("results", block), ""))
    return answered.select("query_id", F.concat(head, body).alias("markdown"))


def first_score(scored: DataFrame) -> DataFrame:
    """Scores of each query relative to the absolute score of its first row."""
    first = F.abs(F.first("score").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return scored.withColumn("score", F.round(F.when(first > 0, F.col("score") / first).otherwise(F.col("score")), 6))
