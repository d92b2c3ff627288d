import random

import numpy as np

from lexmill.llm import near_dedup as nd
from tests.llm import helpers as h
from tests.oracle import SMALL


def truth(rows, threshold):
    """Connected components over exact shingle similarities."""
    sets = {}
    for i, t in rows:
        w = h.WORDS.findall((t or "").lower())
        if i is not None and w:
            sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return pairs, {i: find(i) for i in sets}


def test_groups_equal_brute_force(spark):
    random.seed(3)
    rows = []
    for g in range(12):
        base = h.sentence(g, 150).split()
        for c in range(random.randint(1, 6)):
            words = list(base)
            for _ in range(c % 3):
                words[random.randrange(len(words))] = f"edit{random.random()}"
            rows.append((len(rows), " ".join(words)))
    pairs, roots = truth(rows, 0.8)
    got = {r.doc_id: r for r in nd.near_groups(h.docs(spark, rows), 0.8).collect()}
    assert {i: g.group_id for i, g in got.items()} == {i: r for i, r in roots.items() if sum(x == r for x in roots.values()) > 1}
    assert all(g.keep == (i == g.group_id) and g.group_size == sum(x == g.group_id for x in roots.values()) for i, g in got.items())


def test_large_buckets_in_pieces_give_the_same_groups(spark):
    random.seed(5)
    rows = []
    for g in range(10):
        base = h.sentence(g, 60).split()
        for c in range(30):
            words = list(base)
            for _ in range(random.choice([0, 1, 2, 8, 20])):
                words[random.randrange(len(words))] = f"edit{random.random()}"
            rows.append((len(rows), " ".join(words)))
    groups = lambda **more: {(r.doc_id, r.group_id, r.group_size) for r in nd.near_groups(h.docs(spark, rows), 0.6, **more).collect()}
    want = groups()
    assert len(want) > 150 and groups(hot=4) == groups(hot=2) == want


def test_pieces_of_a_key():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 12, 500))
    rep = np.arange(500)
    rep = rep[np.lexsort((rep, key))]
    for step in (1, 7, 100, 500):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[a : a + step]), pa.array(rep[a : a + step])], names=["key", "rep"]) for a in range(0, 500, step))
        got = {}
        for out in nd._bucketer(30)(batches):
            for row in out.to_pylist():
                assert row["hub"] is None or len(row["reps"]) <= 30
                got.setdefault(row["bucket"], []).extend(row["reps"])
                assert row["hub"] in (None, rep[key == row["bucket"]][0] if row["hub"] is not None else None)
        assert sorted(map(tuple, got.values())) == sorted(tuple(rep[key == k].tolist()) for k in np.unique(key) if (key == k).sum() > 1)


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rows = [(3, h.sentence(1) + " x"), (5, h.sentence(1)), (5, h.sentence(2)), (5, h.sentence(2)), (6, h.sentence(2) + " y"), (7, h.sentence(3))]
    left = sorted((r.doc_id, r.text) for r in nd.drop_near_duplicates(h.clashing(h.docs(spark, rows))).collect())
    assert [x for x in left if x[1].startswith(h.sentence(1))] == [(3, h.sentence(1) + " x")]
    assert len([x for x in left if x[1].startswith(h.sentence(2))]) == 1 and (7, h.sentence(3)) in left and len(left) == 3


def test_chinese_copies_are_found(spark):
    text = "".join(chr(0x4E00 + (i * 7919) % 900) for i in range(300))
    other = "".join(chr(0x5200 + (i * 7907) % 900) for i in range(300))
    got = {r.doc_id for r in nd.near_groups(h.docs(spark, [(1, text), (2, text[:150] + "改" + text[151:]), (3, other)])).collect()}
    assert got == {1, 2}


def test_recall_on_given_documents(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    pairs, _ = truth([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], 0.7)
    group = {r.doc_id: r.group_id for r in nd.op1_minhash_near_dedup(spark, SMALL).collect()}
    assert pairs and sum(a in group and group[a] == group.get(b) for a, b in pairs) >= 0.9 * len(pairs)


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.6, 0.8, 0.95):
        a = rng.integers(0, 2**32, (256, 200), dtype=np.uint64).astype(np.uint32)
        b = np.where(rng.random(a.shape) < j, a, a + np.uint32(1))
        differ = np.bitwise_count(nd.odd_sketches(a, 1024) ^ nd.odd_sketches(b, 1024)).sum(1)
        assert abs(nd.sketch_similarity(differ, 256, 1024).mean() - j) < 0.02


def test_bucket_links_reach_every_pair_that_brute_force_links():
    rng = np.random.default_rng(2)
    sketches = rng.integers(0, 2**62, (40, 2), dtype=np.uint64)
    sketches[20:] = sketches[:20] ^ (np.uint64(1) << rng.integers(0, 60, (20, 2)).astype(np.uint64))
    a, b = nd.linked(sketches, np.arange(40), 4)
    assert set(zip(a.tolist(), b.tolist())) == {(i, i + 20) for i in range(20)}


def test_a_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in nd.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert nd.components(edges.limit(0)).count() == 0


def test_thousands_of_copies_make_one_group(spark):
    rows = [(i, h.sentence(1, 80) + f" extra{i}") for i in range(3000)]
    got = nd.near_groups(h.docs(spark, rows)).collect()
    assert len(got) == 3000 and {r.group_id for r in got} == {0}


def test_edges_of_the_input(spark):
    df = h.clashing(h.docs(spark, h.edge_rows()))
    assert {(r.doc_id, r.group_id) for r in nd.near_groups(df).collect()} == {(4, 4), (5, 4)}
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8] and ids.count(None) == 2
    assert nd.near_groups(df.limit(0)).count() == 0 and nd.drop_near_duplicates(df.limit(0)).count() == 0


def test_copies_without_an_id_are_dropped(spark):
    rows = [(None, h.sentence(1)), (None, h.sentence(1)), (None, h.sentence(1) + " more"), (None, h.sentence(2)), (9, h.sentence(2)), (None, h.sentence(3)), (None, None), (None, ""), (None, "")]
    df = h.clashing(h.docs(spark, rows))
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    first = [x for x in left if (x[1] or "").startswith(h.sentence(1))]
    assert len(first) == 1 and sorted((x for x in left if x not in first), key=str) == sorted([(9, h.sentence(2)), (None, h.sentence(3)), (None, None), (None, ""), (None, "")], key=str)
