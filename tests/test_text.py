import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import udf


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


GOLDEN = [
    ("监护关系终止的情形", 21, "监护", "止的情形"),
    ("农民集体所有的不动产和动产，哪些事项应当依照法定程序经本集体成员决定", 86, "农民", None),
]


@pytest.mark.parametrize("query,count,first,last", GOLDEN)
def test_golden_tokens(spark, query, count, first, last):
    got = one(spark, tx.search_tokens, query)
    assert len(got) == count and got[0] == first
    assert last is None or got[-1] == last
    if count > 64:
        assert got[63] == "经本集" and got.count("集体") == 2


def test_cjk_runs(spark):
    assert one(spark, tx.cjk_ngrams, "甲") == ["甲"]
    assert one(spark, tx.cjk_ngrams, "钢筋混凝土x")[:3] == ["钢筋混凝土", "钢筋", "筋混"]
    assert one(spark, tx.cjk_ngrams, "甲甲甲甲甲甲甲") == ["甲甲", "甲甲甲", "甲甲甲甲"]
    assert one(spark, tx.cjk_ngrams, "\U00020000\U00020001") == ["\U00020000\U00020001"]
    assert one(spark, tx.cjk_ngrams, "かな") == []


def test_ascii_tokens_cut_accents_and_keep_underscores(spark):
    assert one(spark, tx.search_tokens, "éoireeau the Foo_bar x Kelvin İstan") == ["oireeau", "foo_bar", "elvin", "stan"]
    assert one(spark, tx.index_tokens, "Foo_bar_ baz") == ["foo", "bar", "baz"]


def test_lines_are_universal(spark):
    for text in ("a\r\nb\rc\nd", "a\n\nb\n", "", "\n", "a\x0bb\x0cc\x1cd e\x85f"):
        assert one(spark, tx.lines, text) == text.splitlines()


def test_markdown_to_plain(spark):
    md = "# Head `x`\n\n  **bold** [t](u) __a__ *b*  \n\n"
    assert one(spark, tx.markdown_to_plain, md) == "Head x\n\nbold [t] a b\n"


def test_front_matter(spark):
    md = '---\na: 1\nb: "two"\na: 3\nnothing\n---\n\nbody'
    assert one(spark, tx.front_matter, md) == {"a": "3", "b": "two"}
    assert one(spark, tx.strip_front_matter, md) == "body"
    assert one(spark, tx.strip_front_matter, "--- a") == "--- a"
    assert one(spark, tx.front_matter, "plain") == {}


def test_titles_and_versions(spark):
    stem = F.lit("stem")
    title = lambda t: spark.createDataFrame([(t,)], "x string").select(tx.document_title(F.col("x"), stem).alias("y")).first().y
    assert title("\n\n ## 民 法  典 \nx") == "民法典"
    assert title("plain\n# later") == "stem" and title("#\nx") == "#" and title("") == "stem"
    version = lambda n, t: spark.range(1).select(tx.source_version(F.lit(n), F.lit(t)).alias("y")).first().y
    assert version("a V3", "b") == "v3" and version("a V3", "b v12") == "v12" and version("aV3", "b") == "current"


def test_keywords_of_titles(spark):
    assert one(spark, tx.title_keywords, "中华人民共和国民法典") == ["中华人民共", "国民法典"]


def test_aliases_and_canonical_text(spark):
    assert one(spark, udf.alias_form, "BS EN 1992-1-1：2004") == "bsen1992112004"
    assert one(spark, udf.canonical_text, "ﬁ\r\nＡ\rb") == "fi\nA\nb\n"


def test_window_around(spark):
    got = one(spark, lambda c: tx.window_around(c, F.array(F.lit("zz"), F.lit("needle")), 12), "0123456789needle0123456789")
    assert got == "… 6789needle01 …"
    assert one(spark, lambda c: tx.window_around(c, F.array(F.lit("zz")), 4), "abcdef") == "abcd"


def test_tolerant_pattern_and_globs(spark):
    assert re.search(tx.tolerant_pattern("a,b."), "x a，b。")
    glob = lambda p, s: spark.range(1).select(F.regexp(F.lit(s), tx.glob_pattern(F.lit(p))).alias("y")).first().y
    assert glob("a*[!0-9]?", "abcx1") and not glob("a*", "ba") and glob("a.b", "a.b") and not glob("a.b", "axb")


def test_span_id_quotes(spark):
    import hashlib
    import json

    got = spark.range(1).select(tx.span_id(F.lit('a"b'), F.lit(1), F.lit(20)).alias("y")).first().y
    assert got == hashlib.sha256(json.dumps(['a"b', 1, 20]).encode()).hexdigest()[:16]


def test_names():
    assert udf.slug("Ｍy Book2 v3 (V12x)") == "my-book-2-v3-v-12-x"
    assert udf.shard_file("") == "_EMPTY" and udf.shard_file("con").startswith("U0063") and udf.shard_file("a.b") == "U0061-002E-0062" and udf.shard_file("中") == "中"
    assert udf.decoded("é".encode("cp1252")) in ("é", "é") and udf.decoded("中".encode("gb18030")) == "中"


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.sampled_from("ab .\n|`。"), max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_chunks_are_ordered_and_cover_the_text(text, size, overlap):
    chunks = udf.Chunker(size, overlap)(text)
    assert [c[0] for c in chunks] == list(range(1, len(chunks) + 1))
    seen = set()
    for _, a, b, part in chunks:
        assert text[a:b] == part and part == part.strip() and part
        seen.update(range(a, b))
    assert all(text[i].isspace() for i in set(range(len(text))) - seen)
    assert all(x[1] < y[1] or overlap for x, y in zip(chunks, chunks[1:]))


def test_chunks_keep_blocks_whole():
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n"
    text = "word " * 30 + "\n" + table + "tail " * 30
    chunks = udf.Chunker(60, 0)(text)
    assert any(table.strip() in c[3] for c in chunks)
    with pytest.raises(ValueError):
        udf.Chunker(10, 10)


def test_nfkc_is_unicode_nfkc(spark):
    assert one(spark, udf.nfkc, "①Å") == unicodedata.normalize("NFKC", "①Å")
