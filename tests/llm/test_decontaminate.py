import random

from lexmill.llm import decontaminate as dc
from tests.llm import helpers as h
from tests.oracle import SMALL, assert_same


def brute(docs, items, threshold, width=5):
    out = {}
    words = lambda t: h.WORDS.findall((t or "").lower())
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    for q, t in items:
        w = words(t)
        if q is None or not w:
            continue
        n = min(width, len(w))
        own = grams(w, n)
        for d, x in docs:
            if d is not None:
                share = len(own & grams(words(x), n)) / len(own)
                if share >= threshold:
                    out[(d, q)] = max(round(share, 6), out.get((d, q), 0))
    return out


def found(df):
    return {(r.doc_id, r.item_id): r.containment for r in df.collect()}


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_its_sql(spark):
    assert_same(spark, dc.op2_benchmark_decontamination, dc.OP2_SQL)
    assert_same(spark, dc.op2_benchmark_decontamination, dc.OP2_SQL, "/root/testdata/sf0.01")


def test_short_items_in_long_texts(spark):
    random.seed(5)
    tests = [(i, h.sentence(i, n)) for i, n in enumerate([3, 5, 6, 15, 40, 120])]
    rows = []
    for d in range(60):
        filler = [f"f{random.randrange(10**6)}" for _ in range(random.choice([20, 2000, 20000]))]
        item = tests[d % len(tests)][1].split()
        at = random.randrange(len(filler))
        piece = item if d % 3 else item[: max(1, len(item) * 3 // 4)]
        rows.append((d, " ".join(filler[:at] + piece + filler[at:])))
    want = brute(rows, tests, 0.5)
    got = found(dc.contamination(h.docs(spark, rows), items(spark, tests)))
    assert got == want
    # a benchmark in several parts gives the same
    assert found(dc.contamination(h.docs(spark, rows), items(spark, tests), part_shingles=10)) == want


def test_edges_of_the_input(spark):
    df = h.clashing(h.docs(spark, h.edge_rows()))
    tests = [(None, "word"), (1, None), (2, ""), (3, "Word!"), (4, h.sentence(2)), (4, h.sentence(2)), (5, "tok59990 tok59991 tok59992 tok59993 tok59994 tok59995")]
    assert found(dc.contamination(df, items(spark, tests))) == {(4, 3): 1.0, (5, 3): 1.0, (6, 4): 1.0, (7, 5): 1.0}
    kept = dc.drop_contaminated(df, items(spark, tests))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 8]
    assert kept.filter("doc_id is null").count() == 2
    assert dc.contamination(df.limit(0), items(spark, tests)).count() == 0
    assert dc.contamination(df, items(spark, [])).count() == 0
    assert SMALL


def test_chinese_items_and_rows_of_one_id(spark):
    item = "".join(chr(0x4E00 + (i * 7919) % 900) for i in range(40))
    lead = "".join(chr(0x5200 + (i * 7907) % 900) for i in range(400))
    df = h.docs(spark, [(1, lead + item + lead), (2, lead), (3, f"“{h.sentence(7)}” — end"), (3, h.sentence(8))])
    tests = [(1, item), (2, h.sentence(7)), (2, h.sentence(9))]
    assert found(dc.contamination(df, items(spark, tests))) == brute([tuple(r)[:2] for r in df.collect()], tests, 0.5) == {(1, 1): 1.0, (3, 2): 1.0}
    assert sorted((r.doc_id, r.text) for r in dc.drop_contaminated(df, items(spark, tests)).collect()) == [(2, lead), (3, h.sentence(8))]


def test_rows_without_an_id_are_searched(spark):
    df = h.clashing(h.docs(spark, [(None, f"before {h.sentence(2)} after"), (None, h.sentence(3)), (None, None), (1, h.sentence(2)), (2, h.sentence(4))]))
    kept = dc.drop_contaminated(df, items(spark, [(1, h.sentence(2))]))
    assert kept.columns == df.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, h.sentence(3)), (None, None), (2, h.sentence(4))}
