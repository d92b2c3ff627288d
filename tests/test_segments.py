"""The stored index: nothing is shuffled to lay postings out, and scores inside segments are those of the joined postings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import index, search

COLUMNS = "doc_key long, doc_id string, title string, source_file string, version string, is_active boolean, text string"
WORDS = [f"word{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def docs(spark, n, active="id % 11 <> 0"):
    words = F.array(*map(F.lit, WORDS))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get(words, F.pmod(F.xxhash64("id", i), F.lit(100)).cast("int"))), " ")
    rows = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_key"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), F.lit("same").alias("title"), F.lit("f").alias("source_file"), F.lit("current").alias("version"), F.expr(active).alias("is_active"), text.alias("text"))
    return spark.createDataFrame(rows.collect(), COLUMNS).coalesce(1)


def shuffled(spark):
    jvm, context = spark._jvm, spark.sparkContext
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def brute(stored, asked, top, keep=None):
    """The best of each query from all scores of the joined postings."""
    scores = search.bm25_scores(stored, asked)
    if keep is not None:
        scores = scores.filter(keep)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "doc_key"))
    return sorted((r.query_id, r.doc_key, r.score, r.rank) for r in scores.withColumn("rank", rank).filter(F.col("rank") <= top).collect())


def got(stored, asked):
    return sorted((r.query_id, r.doc_key, r.score, r["rank"]) for r in search.best(stored, asked, 1).collect())


def queries(spark):
    return spark.createDataFrame([(1, "wordak wordbl wordbl"), (2, "wordcm"), (3, "nothing"), (4, "same wordjt wordak")], "query_id int, text string")


def test_segments_score_as_joined_postings_do(spark):
    stored = index.temporary(docs(spark, 40_000))
    assert stored.segments.count() > 1
    asked = search.batch(queries(spark))
    assert got(stored, asked) == brute(stored, asked, 10) and len(got(stored, asked)) == 30


def test_sets_and_lists_restrict_alike(spark, monkeypatch):
    stored = index.temporary(docs(spark, 500))
    sets = stored.names.select(F.when(F.col("doc_key") % 3 == 0, "third").otherwise("rest").alias("doc_set"), "doc_id")
    chosen = queries(spark).withColumn("doc_set", F.when(F.col("query_id") == 1, "third").when(F.col("query_id") == 2, "none"))
    by_set = search.batch(chosen, sets)
    want = brute(stored, by_set, 10, "(query_id <> 1 or doc_key % 3 = 0) and query_id <> 2")
    assert got(stored, by_set) == want and want
    third = [r.doc_id for r in stored.names.filter("doc_key % 3 = 0").collect()]
    by_list = queries(spark).withColumn("doc_ids", F.when(F.col("query_id") == 1, F.array(*map(F.lit, third))).when(F.col("query_id") == 2, F.array(F.lit("absent"))))
    assert got(stored, search.batch(by_list)) == want
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    assert got(stored, search.batch(chosen, sets)) == want


def test_an_index_is_stored_and_searched_without_shuffling_postings(spark):
    before = shuffled(spark)
    stored = index.temporary(docs(spark, 20_000))
    search.bm25_top(stored, queries(spark)).collect()
    # 250,000 postings; document frequencies and the best documents are all that moves
    assert shuffled(spark) - before < 200_000


def test_texts_that_hold_a_query_are_found_without_a_nested_loop(spark):
    from lexmill.operators import evaluate

    texts = ["a long passage of words", "xx a long passage", "passage", "long passag", "", None, "é long passage of wordsé long passage of words", "ab", "a long passage"]
    items = ["long passage", "a long passage of words", "é long passage of words", "ab", "", None, "passage of words xx a long", "long passage"]
    rows = spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    asked = spark.createDataFrame(list(enumerate(items)), "query_id int, text string")
    found = evaluate.holders(rows, asked)
    assert sorted((r.doc_id, r.query_id) for r in found.collect()) == sorted((f"d{n}", q) for n, t in enumerate(texts) for q, i in enumerate(items) if t is not None and i is not None and i in t)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_ranks_by_plain_names_and_globs(spark):
    from lexmill.operators import evaluate

    rows = [(1, ["a.1", "b"], ["b"]), (2, ["axb"], ["a?b"]), (3, ["ab"], ["a.", "[x]"]), (4, ["x[", "x"], ["x", "x["]), (5, [], ["*"])]
    ranks = {r.n: r["rank"] for r in evaluate.first_ranks(spark.createDataFrame(rows, "n int, hits array<string>, patterns array<string>")).collect()}
    assert ranks == {1: 2, 2: 1, 3: 0, 4: 1, 5: 0}


def test_keywords_are_counted_inside_the_row(spark):
    from lexmill.operators import structure

    texts = ["Zebra zebra lion LION lions lions the the the x1 x1 q", "民法典 民法典 tea", "once", "", None, "Kelvin elvin Kelvin"]
    found = structure.keywords(spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string"))
    assert {r.doc_key: r.keywords for r in found.collect()} == {0: ["lions", "zebra", "x1"], 1: ["民法典"], 5: ["elvin"]}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_a_batch_go_on_before_it_is_done(spark):
    import pyarrow as pa

    from lexmill.functions import udf

    texts = ["word " * 300, "", None, "short", "line\n" * 1000] * 400
    cut = udf.Chunker(600, 60)
    want = sorted((n, *c) for n, t in enumerate(texts) for c in cut(t))
    made = udf.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string"), 600, 60)
    assert made.columns == ["doc_key", "ordinal", "start", "stop", "text"] and sorted(map(tuple, made.collect())) == want
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_key", "text"])
    parts = list(udf.chunk_batches(cut)(iter([batch])))
    assert len(parts) > 1 and sum(p.num_rows for p in parts) == len(want)
    assert all(sum(map(len, p.column("text").to_pylist())) < udf.CHUNK_BYTES + 2_000 for p in parts)
