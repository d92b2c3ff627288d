import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lexmill.llm import bpe
from lexmill.llm import repair as rp
from tests.llm import helpers as h

ALPHABET = ["'", "'", "s", "re", "ll", "l", "ve", "d", " ", "  ", "\n", "\n\n", "\t", " \n", "!", "é", "中", "1", "23", "٣", " ", " ", "Z", "\U0001f600", "m't"]


@pytest.fixture(scope="module")
def code():
    return bpe.encoder(bpe.VOCABULARY)


def texts(seed, n, longest):
    random.seed(seed)
    return ["".join(random.choices(ALPHABET, k=random.randint(0, longest))) for _ in range(n)]


def test_boundaries_are_those_of_the_pattern():
    for t in texts(1, 3000, 25):
        points, offsets = bpe.code_points([t])
        starts = bpe.boundaries(points, offsets).tolist()
        assert [t[a:b] for a, b in zip(starts, [*starts[1:], None])] == regex.findall(bpe.PATTERN, t)


def test_many_texts_equal_the_reference_coder(code):
    many = texts(2, 3000, 30)
    ids, offsets = bpe.encode_texts(many, code)
    assert all(ids[a:b].tolist() == code.coding.encode_ordinary(t) for t, a, b in zip(many, offsets, offsets[1:]))


def test_forgetting_changes_nothing(code, monkeypatch):
    small = bpe.Encoder(bpe.VOCABULARY)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for t in texts(3, 60, 60):
        assert bpe.encode_texts([t], small)[0].tolist() == code.coding.encode_ordinary(t)


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (40, 40), (100, 8)])
def test_stitched_chunks_equal_whole_texts(spark, code, chunk, overlap):
    many = texts(4, 400, 400) + ["a" * 500, " " * 500, "\n" * 300 + "x", "x" * 300 + " y" * 200, None, ""]
    df = h.docs(spark, list(enumerate(many)))
    got = {r.row.doc_id: r.ids for r in bpe.encode_documents(df, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: None if t is None else code.coding.encode_ordinary(t) for i, t in enumerate(many)}


def test_a_very_long_text_is_encoded_piece_by_piece(code):
    for text in ("".join(texts(9, 1, 40_000)) * 40, "x" * 1_200_000, " " * 1_100_000 + "y"):
        assert bpe.encode_bounded([text], code)[0].tolist() == bpe.encode_texts([text], code)[0].tolist()
        assert all(a < b for a, b in zip(bpe.cuts_within(text), bpe.cuts_within(text)[1:]))


def test_round_trip_of_given_documents(spark, code):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    coded = bpe.encode_documents(docs, chunk=4000, overlap=200, keep=["doc_id"]).cache()
    back = bpe.decode_documents(coded).select("row.doc_id", "text")
    assert docs.join(back.withColumnRenamed("text", "t"), "doc_id").filter("t = text").count() == docs.count()
    sample = coded.first()
    assert sample.ids == code.coding.encode_ordinary(docs.filter(F.col("doc_id") == sample.row.doc_id).first().text)


def test_every_given_document_decodes_to_itself(spark):
    rows = bpe.op10_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.exact for r in rows)


def chained_python(node, above=0):
    """The most Python passes that one task of a physical plan runs at once."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return chained_python(node.initialPlan())
    here = 0 if "Exchange" in node.nodeName() else above + (node.nodeName() == "MapInArrow")
    return max([here, *(chained_python(node.children().apply(i), here) for i in range(node.children().size()))])


def test_a_task_keeps_one_python_worker_busy(spark):
    plan = bpe.op10_byte_bpe(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan()
    assert chained_python(plan) == 1


def test_every_kind_of_text_is_compared_with_its_decoded_ids(spark, code, tmp_path, monkeypatch):
    words = " ".join(f"né{i}" for i in range(20_000))
    many = dict(enumerate([words, words, "x" * 70_000, "short 中文", "", None]))
    h.docs(spark, list(many.items())).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op10_byte_bpe(spark, str(tmp_path)).collect()}
    for i, t in many.items():
        ids = None if t is None else code.coding.encode_ordinary(t)
        assert (got[i].ids, got[i].n_tokens, got[i].exact) == (ids, ids if ids is None else len(ids), ids if ids is None else True)
    right = bpe._encode_chunks

    def first_id_lost(path):
        def run(batches):
            for b in right(path)(batches):
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x[1:] for x in b.column("ids").to_pylist()], pa.list_(pa.int32()))], names=b.schema.names)

        return run

    monkeypatch.setattr(bpe, "_encode_chunks", first_id_lost)
    assert {r.doc_id: r.exact for r in bpe.op10_byte_bpe(spark, str(tmp_path)).collect()} == {0: False, 1: False, 2: True, 3: True, 4: True, 5: None}


def test_wrong_ids_are_told_by_text(code):
    many = [*texts(10, 50, 30), "one more", ""]
    ids, offsets = bpe.encode_texts(many, code)
    decode = bpe.decoder(bpe.VOCABULARY)
    assert decode.gives(many, ids, offsets) == [True] * 52
    wrong = ids.copy()
    wrong[offsets[50]] += 1
    assert decode.gives(many, wrong, offsets) == [True] * 50 + [False, True]


def test_decoding_takes_little_more_than_the_text(code):
    text = "".join(texts(11, 1, 20_000)) * 200
    ids, offsets = bpe.encode_bounded([text], code)
    decode = bpe.decoder(bpe.VOCABULARY)
    tracemalloc.start()
    try:
        data, _ = decode(ids, offsets)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert data.decode() == text and most < 16 * len(data)


def test_encoding_edges(spark, code):
    df = h.clashing(h.docs(spark, h.edge_rows()))
    got = bpe.encode_documents(df).collect()
    assert len(got) == len(h.edge_rows())
    assert all(r.ids == (None if r.row.text is None else code.coding.encode_ordinary(r.row.text)) for r in got)
    assert bpe.encode_documents(df.limit(0)).count() == 0 and bpe.decode_documents(bpe.encode_documents(df)).filter("text is null").count() == 2


def naive_size(ids, starts, base, min_count):
    """Symbols and rules of plain Re-Pair: one most frequent pair at a time, counted without overlap."""
    docs = [list(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]
    rules = 0
    while True:
        counts = {}
        for d in docs:
            last = None
            for i in range(len(d) - 1):
                pair = (d[i], d[i + 1])
                if pair[0] == pair[1] and last == i - 1 and counts.get("last") == pair:
                    last, counts["last"] = None, None
                    continue
                counts[pair] = counts.get(pair, 0) + 1
                last, counts["last"] = i, pair
        counts.pop("last", None)
        best = max(counts, key=lambda p: (counts[p], p), default=None)
        if best is None or counts[best] < min_count:
            return sum(map(len, docs)), rules
        new, rules = base + rules, rules + 1
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                two = i + 1 < len(d) and (d[i], d[i + 1]) == best
                out.append(new if two else d[i])
                i += 2 if two else 1
            docs[k] = out


@pytest.mark.parametrize("shift", [0, 70_000, 5_000_000])
def test_grammar_round_trip_and_random_access(shift):
    random.seed(7)
    for _ in range(120):
        v, n = random.choice([2, 3, 10]), random.randint(0, 300)
        ids = np.array([shift + random.randrange(v) for _ in range(n)], np.int32)
        starts = np.array(sorted([0, *(random.randint(0, n) for _ in range(random.randint(0, 7)))]))
        lengths = np.diff(np.append(starts, n))
        shard = rp.shard_row("s", list(range(len(starts))), ids, lengths, shift + v, 2)
        rules, _ = rp.grammar(shard)
        assert (rp.expand(rp.unpack(shard["symbols"], shard["bits"], 0, shard["n_symbols"]), rules, shift + v) == ids).all()
        for d, (a, k) in enumerate(zip(starts, lengths)):
            i = random.randint(0, k)
            j = random.randint(i, k)
            assert (rp.read_tokens(shard, d, i, j) == ids[a + i : a + j]).all()


def test_a_wide_vocabulary_is_kept(spark):
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 200_000), 100_000).astype(np.int32) - 1
    shard = rp.shard_row("s", [1], ids, np.array([len(ids)]), 100_000)
    assert (rp.read_tokens(shard, 0) == ids).all() and shard["bits"] > 16


def test_size_is_near_that_of_plain_repair():
    random.seed(8)
    words = [[random.randrange(40) for _ in range(random.randint(2, 5))] for _ in range(60)]
    ids = np.array([i for _ in range(900) for i in random.choice(words)], np.int32)
    symbols, _, rules = rp.compress(ids, np.array([0]), 40, 4)
    n, k = naive_size(ids.tolist(), [0], 40, 4)
    assert len(symbols) + 2 * len(rules) <= 1.1 * (n + 2 * k)


def test_frequent_pairs_are_replaced():
    ids = np.tile(np.array([1, 2, 3, 4], np.int32), 500)
    symbols, _, rules = rp.compress(ids, np.array([0]), 10, 4)
    assert len(symbols) + 2 * len(rules) < 60


def test_shards_hold_every_document(spark, code):
    rows = h.edge_rows()
    df = h.clashing(h.docs(spark, rows))
    for size in (1, 10**6):
        shards = rp.repair_shards(df, shard_tokens=size)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in rp.restore_documents(shards).collect())
        assert got == sorted((i is None, i or 0, code.coding.encode_ordinary(t or "")) for i, t in rows)
    assert rp.repair_shards(df.limit(0)).count() == 0


def test_shards_of_given_documents_shrink(spark):
    shards = rp.op8_repair_shards(spark, "/root/testdata/sf0.01").collect()
    tokens = sum(sum(s.lengths) for s in shards)
    assert sum(len(s.symbols) + len(s.rules) + len(s.expansions) for s in shards) < 2 * 0.8 * tokens
    assert sum(len(s.doc_ids) for s in shards) == 1000
