import pytest

from lexmill.llm import chat, licenses, quality
from lexmill.llm.registry import ORACLE_SQL, QUERIES
from tests.llm import helpers as h
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


def test_license_edges(spark):
    rows = [*h.edge_rows(), (20, "x\nLicensed under the apache license, version 2.0\n"), (21, "Licensed under the Apache License"), (22, "MIT license released under the the the"), (23, "Released under the MIT License.\nReleased under the MIT License.")]
    df = h.clashing(h.docs(spark, rows + rows[-1:]))
    got = {(r.doc_id, r.block, r.last_line, r.license): r.containment for r in licenses.license_blocks(df).collect()}
    assert got == {(20, 1, 1, "apache-2.0"): 1.0, (22, 0, 0, "mit"): 1.0, (23, 0, 0, "mit"): 1.0, (23, 1, 1, "mit"): 1.0}
    assert licenses.license_blocks(df, {}).count() == licenses.license_blocks(df, {"x": "..."}).count() == licenses.license_blocks(df.limit(0)).count() == 0


def test_wrapped_templates_are_found(spark):
    import textwrap

    long = [n for n, t in licenses.TEMPLATES.items() if len(t) > 60]
    rows, names = [], {}
    for n in long:
        for width, lead in ((28, ""), (60, "# "), (74, " * "), (10_000, "")):
            names[len(rows)] = n
            wrapped = "\n".join(lead + x for x in textwrap.wrap(licenses.TEMPLATES[n], width))
            rows.append((len(rows), f"/*\nCopyright (c) 2020 Somebody\n\n{wrapped}\n\nint main() {{ return 0; }}\n" + "plain words of code here\n" * 50))
    got = {}
    for r in licenses.license_blocks(h.docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert all(n in got.get(i, ()) for i, n in names.items()), [(i, n, got.get(i)) for i, n in names.items() if n not in got.get(i, ())][:4]
    # the same words scattered over a page are no license
    words = licenses.TEMPLATES["gpl-notice"].split()
    scattered = "\n".join(f"{w} " + "filler words " * 12 for w in words)
    assert licenses.license_blocks(h.docs(spark, [(1, scattered)])).count() == 0


def naive_blocks(text, templates, threshold):
    """All runs of lines, then the smallest ones."""
    import re

    lines = [re.findall("[a-z0-9]+", x.lower()) for x in text.split("\n")]
    out = set()
    for name, t in templates.items():
        words = re.findall("[a-z0-9]+", t.lower())
        own, met = set(words), []
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if not all(lines[i : j + 1]):
                    break
                run = [w for x in lines[i : j + 1] for w in x]
                if (i == j or len(run) <= licenses.SPREAD * len(words)) and len(own & set(run)) >= licenses.needed(len(own), threshold):
                    met.append((i, j, len(own & set(run)) / len(own)))
        out |= {(i, j, name, round(c, 6)) for i, j, c in met if not any((a, b) != (i, j) and a >= i and b <= j for a, b, _ in met)}
    return out


def test_filters_lose_nothing(spark):
    import random

    random.seed(4)
    words = [f"v{i}" for i in range(12)]
    text = lambda: "".join(random.choice(words) + random.choice([" ", " ", "\n", "\n", "\n\n"]) for _ in range(random.randint(1, 30)))
    rows = [(i, text()) for i in range(300)]
    templates = {f"t{k}": " ".join(random.choices(words, k=random.randint(1, 8))) for k in range(6)}
    for threshold in (0.3, 0.7, 1.0):
        want = {(i, *b) for i, t in rows for b in naive_blocks(t, templates, threshold)}
        assert {tuple(r) for r in licenses.license_blocks(h.docs(spark, rows), templates, threshold).select("doc_id", "block", "last_line", "license", "containment").collect()} == want


def test_quality_edges(spark):
    df = h.clashing(h.docs(spark, h.edge_rows()))
    rows = quality.host_verdicts(df).collect()
    assert len(rows) == len(h.edge_rows())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert not by[1].keep and not by[2].keep and not by[3].keep and by[4].failed == 0
    assert quality.host_verdicts(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    hosts = quality.host_verdicts(df.withColumn("source", F.when(F.col("doc_id") > 4, "a"))).select("source", "host_docs").distinct().collect()
    assert {(r.source, r.host_docs) for r in hosts} == {("a", 5), (None, 6)}


def test_bad_host_loses_all_and_small_host_is_shrunk(spark):
    bad = [(i, "### $$$ %%% @@@", "en", "bad", 9) for i in range(50)] + [(99, "plain words of prose here", "en", "bad", 9)]
    good = [(100 + 60 * s + i, "plain words of prose here", "en", f"good{s}", 9) for s in range(8) for i in range(50)]
    small = [(1000, "### $$$ %%% @@@", "en", "small", 9), (1001, "plain words of prose", "en", "small", 9), (1002, "plain words", "en", "small", 9)]
    rows = {r.doc_id: r.keep for r in quality.host_verdicts(spark.createDataFrame(bad + good + small, h.DOCS)).collect()}
    assert not rows[99] and rows[100] and not rows[1000] and rows[1001]


def windows(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.chat_windows(h.clashing(df).drop("tokens"), **more).orderBy("conv_id", "window").collect()


def test_chat_windows_by_hand(spark):
    rows = [(1, 0, "system", "s s"), (1, 1, "user", "a a a"), (1, 2, "assistant", "b b b"), (1, 3, "user", "c c"), (1, 4, "assistant", "d d d"), (1, 5, "user", "e " * 30)]
    got = windows(spark, rows, budget=10, history=3)
    assert [(w.first_turn, w.last_turn, w.history_turns, w.tokens, w.target_tokens, w.mask) for w in got] == [
        (1, 3, 0, 10, 3, "0010"),
        (4, 4, 1, 7, 3, "001"),
        (5, 5, 0, 32, 0, "00"),
    ]
    assert got[1].text == "<|system|>s s\n<|user|>c c\n<|assistant|>d d d"


def test_every_answer_is_a_target_once(spark):
    import random

    random.seed(6)
    rows = [(c, t, "assistant" if t % 2 else "user", "x " * random.randint(0, 40)) for c in range(30) for t in range(random.randint(1, 120))]
    got = windows(spark, rows, budget=60, history=25)
    for c in range(30):
        own = [w for w in got if w.conv_id == c]
        turns = [r for r in rows if r[0] == c]
        assert [t for w in own for t in range(w.first_turn, w.last_turn + 1)] == [r[1] for r in turns]
        assert sum(w.target_tokens for w in own) == sum(len(r[3].split()) for r in turns if r[2] == "assistant")
        assert all(w.tokens <= 60 or w.first_turn == w.last_turn for w in own)


def test_chat_edges(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "x"), (2, 0, "system", "alone"), (3, 0, None, None), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "assistant", "word " * 100_000)]
    got = windows(spark, rows)
    assert [(w.conv_id, w.tokens, w.mask) for w in got] == [(3, 0, "0"), (4, 2, "00"), (5, 100_000, "1")]
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_windows(df).count() == 0
