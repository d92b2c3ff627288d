import sqlite3

from pyspark.sql import functions as F

from lexmill.operators import evidence, index, reader, search

DOCS = [
    (1, "d1", "zebra guide", "zebra lion tiger lion\nzebra grass"),
    (2, "d2", "lion notes", "lion zebra"),
    (3, "BS EN 1992-1-1:2004", "eurocode", "concrete zebra zebra zebra"),
    (4, "d4", "empty", ""),
    (5, "d5", "common", "zebra concrete lion tiger grass water"),
]


def corpus(spark):
    return index.temporary(table(spark))


def table(spark):
    rows = [(k, i, t, f"{i}.txt", "current", True, x) for k, i, t, x in DOCS]
    return spark.createDataFrame(rows, "doc_key long, doc_id string, title string, source_file string, version string, is_active boolean, text string")


def asked(spark, *texts, top_k=10):
    return spark.createDataFrame([(n, t, top_k) for n, t in enumerate(texts)], "query_id int, text string, top_k int")


def test_bm25_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, body)")
    for k, _, title, text in DOCS:
        con.execute("INSERT INTO t(rowid, title, body) VALUES (?, ?, ?)", (k, title, text))
    stored = corpus(spark)
    for query in ("lion", "zebra lion lion", "tiger concrete water", "guide zebra"):
        match = " OR ".join(f'"{w}"' for w in query.split())
        want = {k: round(s, 6) for k, s in con.execute("SELECT rowid, bm25(t, 10.0, 1.0) FROM t WHERE t MATCH ?", (match,))}
        got = {r.doc_key: r.score for r in search.bm25_scores(stored, asked(spark, query)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_identifiers_come_first_and_scores_are_relative(spark):
    rows = search.merged(corpus(spark), asked(spark, "en 1992-1-1 zebra", "bs en 1992-1-1:2004", "d2")).orderBy("query_id", "rank").collect()
    by = {q: [(r.doc_key, r.score) for r in rows if r.query_id == q] for q in range(3)}
    assert by[1][0] == (3, -1.0)
    assert by[2] == []  # fewer than four characters, and no document holds the token
    assert all(s == -1.0 for s in [by[0][0][1]])


def test_no_tokens_keeps_exact_matches_unscaled(spark):
    docs = table(spark).withColumn("doc_id", F.when(F.col("doc_key") == 4, "what is this").otherwise(F.col("doc_id")))
    rows = search.merged(index.temporary(docs), asked(spark, "what is this")).collect()
    assert [(r.doc_key, r.score) for r in rows] == [(4, -100.0)]


def test_density_reference(spark):
    text = "\n".join(f"line {i} " + ("alpha beta" if i == 27 else "gamma") for i in range(40))
    df = spark.createDataFrame([(text,), ("alpha betas",), ("",)], "x string")
    tokens = F.array(*map(F.lit, ["alpha", "beta", "line", "v2"]))
    assert [r.y for r in df.select(search.window_density(F.col("x"), tokens).alias("y")).collect()] == [3, 2, 0]


def test_gate_and_status(spark):
    a = {r.query_id: r for r in evidence.answers(corpus(spark), asked(spark, "zebra", "", "nowhere", "guide")).collect()}
    assert a[0].status == "high_confidence" and a[0].next_action == "read_file_at_lines"
    assert a[1].status == a[2].status == "no_hits" and a[1].match == ""
    assert a[3].next_action == "out_of_scope" and a[3].results == []


def test_empty_tables(spark):
    none = index.temporary(table(spark).limit(0))
    assert search.search(none, asked(spark, "zebra")).count() == 0
    assert evidence.answers(none, asked(spark, "zebra")).first().status == "no_hits"
    assert search.search(corpus(spark), asked(spark, "zebra").limit(0)).count() == 0


def test_reading_modes(spark):
    text = "\n\n# One\na\nb\n## Two\nneedle c\n1.2 Three\nd"
    docs = spark.createDataFrame([(1, "x", text)], "doc_key long, doc_id string, text string")
    assert [(r.line, r.end_line, r.heading) for r in reader.section_list(docs).orderBy("line").collect()] == [(3, 5, "# One"), (6, 7, "## Two"), (8, 9, "1.2 Three")]
    ask = lambda **k: spark.createDataFrame([(7, 1, *k.values())], "req_id int, doc_key long, " + ", ".join(f"{n} {'string' if isinstance(v, str) else 'int'}" for n, v in k.items()))
    got = lambda df: [r.line for r in df.orderBy("part", "line").collect()]
    assert got(reader.read_around(docs, ask(around=4, expand=0))) == [3, 4, 5]
    assert got(reader.read_around(docs, ask(around=4, expand=1))) == [3, 4, 5, 6, 7]
    assert got(reader.read_around(docs, ask(around=5, expand=0))) == list(range(1, 10))  # last line of a section
    assert got(reader.read_find(docs, ask(find="NEEDLE", after=0, context=1))) == [6, 7, 8]
    assert got(reader.read_find(docs, ask(find="needle", after=7, context=1))) == []
    assert got(reader.read_jump(docs, ask(jump="8-99, 3", count=2))) == [8, 9, 3, 4]
    assert got(reader.read_range(docs, ask(start=-1, count=4))) == [1, 2]
    assert reader.missing_documents(ask(start=1).withColumn("doc_key", F.lit(9)), docs).count() == 1


def test_boolean_match(spark):
    t = F.array(*map(F.lit, ["a1", "b1", "c1"]))
    check = lambda c: spark.range(1).select(c.alias("y")).first().y
    assert check(search.match_expression(t, [["a1", "zz"]], "or", []))
    assert not check(search.match_expression(t, [["a1"], ["zz"]], "and", []))
    assert check(search.match_expression(t, [["a1"], ["b1"]], "and", [["c1"]]))
    assert not check(search.match_expression(t, [], "or", []))


def test_equal_documents_tie_and_keep_their_order(spark):
    words = "zebra lion tiger grass water concrete"
    rows = [(k, f"n{k}", "same", f"{k}.txt", "current", True, " ".join(words.split()[k % 6 :] + words.split()[: k % 6])) for k in range(40)]
    stored = index.temporary(spark.createDataFrame(rows, table(spark).schema).repartition(5))
    top = search.bm25_top(stored, asked(spark, words, top_k=20)).orderBy("rank").collect()
    assert [r.doc_key for r in top] == list(range(20)) and len({r.score for r in top}) == 1


def test_a_large_batch_gives_what_a_small_one_gives(spark, monkeypatch):
    stored = corpus(spark)
    texts = ("zebra lion", "BS EN 1992", "d2", "ＢＳ ＥＮ 1992-1-1:2004", "tiger grass water zebra", "")
    queries = asked(spark, *texts).withColumn("doc_ids", F.when(F.col("query_id") == 0, F.array(F.lit(" d2 "), F.lit("d5"))))
    run = lambda: sorted(map(repr, evidence.answers(stored, queries).collect()))
    small = run()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    assert run() == small
    assert {r["doc_id"] for x in evidence.answers(stored, queries).collect() if x.query_id == 0 for r in x.results} == {"d2", "d5"}


def test_identifiers_of_any_width_are_found(spark):
    stored = corpus(spark)
    got = {(r.query_id, r.doc_key) for r in search.exact_matches(stored, asked(spark, "ＢＳ ＥＮ １９９２", "guide to en 1992-1-1 of bs en 1992-1-1:2004, d2", "eurocode", "zeb")).collect()}
    assert got == {(0, 3), (1, 2), (1, 3), (2, 3)}


def test_plans_read_no_more_than_they_need(spark):
    stored = corpus(spark)
    plan = search.bm25_top(stored, asked(spark, "zebra"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema" in plan and "text:string" not in plan
    rows = evidence.results(stored, asked(spark, "zebra lion"))._jdf.queryExecution().executedPlan().toString()
    assert rows.count("FileScan") <= 5
