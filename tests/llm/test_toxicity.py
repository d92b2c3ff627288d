import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import toxicity as tox
from tests.llm import helpers as h
from tests.oracle import SMALL


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(seed, n):
    """Texts of common words; the toxic ones hold rare insults that never repeat exactly."""
    random.seed(seed)
    syllables = ["ba", "de", "fi", "go", "lu", "ma", "ne", "po"]
    word = lambda: "".join(random.choices(syllables, k=random.randint(1, 3)))
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = [word() for _ in range(120)]
        if bad:
            for _ in range(4):
                text[random.randrange(120)] = "zorq" + word()
        rows.append((i, " ".join(text)))
        marks.append(int(bad))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = corpus(1, 400)
    known = labels(spark, [(i, 1, m) for (i, _), m in zip(rows[:250], marks)])
    got = {r.row.doc_id: r.is_toxic for r in tox.toxicity(h.docs(spark, rows), known).collect()}
    held = range(250, 400)
    right = sum(got[i] == bool(marks[i]) for i in held)
    assert right >= 0.97 * len(held)


def test_unlabelled_languages_are_judged_by_all(spark):
    rows, marks = corpus(3, 300)
    known = labels(spark, [(i, 1, m) for (i, _), m in zip(rows, marks)])
    full = [(i, t, "en", "src0", len(t)) for i, t in rows]
    full += [(1000 * k + i, t, lang, "src0", len(t)) for k, lang in enumerate((None, "EN", "xx", "en"), 1) for i, t in rows]
    df = spark.createDataFrame(full, h.DOCS)
    for more in ({}, {"part_ngrams": 100}):
        got = {r.row.doc_id: (r.score, r.is_toxic) for r in tox.toxicity(df, known, **more).collect()}
        assert all(got[1000 * k + i] == got[4000 + i] for k in (1, 2, 3) for i in range(300))
        assert np.mean([got[1000 + i][1] == bool(m) for i, m in enumerate(marks)]) >= 0.97


def test_held_out_labels_of_given_documents(spark):
    """Every labelled document is scored by the labels of the others."""
    got = {r.doc_id: r.is_toxic for r in tox.op9_toxicity(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000
    caught = [got[d] for d, t in truth.items() if t]
    false = [got[d] for d, t in truth.items() if not t]
    assert np.mean(caught) > 0.65 and np.mean(false) < 0.06
    assert SMALL


def test_a_label_does_not_judge_its_own_document(spark):
    rows, marks = corpus(5, 200)
    wrong = [(i, 1, 1 - m if i == 77 else m) for (i, _), m in zip(rows, marks)]
    score = lambda known: {r.row.doc_id: r.score for r in tox.toxicity(h.docs(spark, rows), labels(spark, known), keep=["doc_id"]).collect()}
    assert score(wrong)[77] == score([(i, 1, m) for (i, _), m in zip(rows, marks)])[77]


@pytest.mark.parametrize("alphabet", ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(map(chr, range(0x4E00, 0x5200)))])
def test_other_scripts(spark, alphabet):
    rows, marks = corpus(6, 400)
    turned = {ord(c): alphabet[(i * 7) % len(alphabet)] for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    rows = [(i, t.translate(turned)) for i, t in rows]
    known = labels(spark, [(i, 1, m) for (i, _), m in zip(rows[:250], marks)])
    got = {r.row.doc_id: r.is_toxic for r in tox.toxicity(h.docs(spark, rows), known, keep=["doc_id"]).collect()}
    assert np.mean([got[i] == bool(marks[i]) for i in range(250, 400)]) >= 0.97


def test_the_fit_can_be_bounded(spark):
    rows, marks = corpus(7, 400)
    known = labels(spark, [(i, 1, m) for (i, _), m in zip(rows, marks)])
    fitted, n = tox._known(known, 250)
    assert 180 < n < 320 and fitted.count() == n
    got = {r.row.doc_id: r.is_toxic for r in tox.toxicity(h.docs(spark, rows), known, keep=["doc_id"], fit_labels=250).collect()}
    assert np.mean([got[i] == bool(m) for i, m in enumerate(marks)]) >= 0.95


def brute_score(text, lang, train):
    """Score of a text by plain dictionaries: counts of symbols behind five symbols, discounts by counts of counts, continuation counts."""
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
    split = lambda t: {tuple(map(code, w)) for w in re.findall(r"[a-z0-9]+", t.lower())}

    def grams(word):
        s = (0,) * 5 + word + (0,)
        return [(s[i - 5 : i], s[i]) for i in range(5, len(s))]

    counts = {"t": Counter(), "o": Counter(), "all": Counter()}
    for x, g, toxic in train:
        assert g == lang
        for w in split(x):
            for gram in grams(w):
                counts["t" if toxic else "o"][gram] += 1
                counts["all"][gram] += 1

    def taken(values):
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2])
        out = [0.0, 0.75, 0.75, 0.75]
        for k in (1, 2, 3):
            if n[k] and 0 < (d := k - (k + 1) * y * n[k + 1] / n[k]) < k:
                out[k] = d
        return out

    off = {k: taken(c.values()) for k, c in counts.items()}
    kinds = Counter((c[3], c[4], x) for c, x in counts["all"])  # longer contexts before each (two symbols, symbol)
    total = sum(kinds.values())

    def p1(x):
        return (sum(n for (_, _, y), n in kinds.items() if y == x) + 0.75) / (total + 64 * 0.75)

    def interpolate(own, lower, x):
        whole = sum(own.values())
        return lower if not whole else (max(own.get(x, 0) - 0.75, 0) + 0.75 * len(own) * lower) / whole

    def shared(a, b, x):
        before = {}
        for (u, v, y) in kinds:
            if v == b:
                before[y] = before.get(y, 0) + 1
        middle = interpolate(before, p1(x), x)
        return interpolate({y: n for (u, v, y), n in kinds.items() if (u, v) == (a, b)}, middle, x)

    def smooth(which, context, x, lower, strength):
        own = {y: n for (c, y), n in counts[which].items() if c == context}
        reserve = sum(off[which][min(n, 3)] for n in own.values()) + strength
        n = own.get(x, 0)
        return (n - off[which][min(n, 3)] + reserve * lower) / (sum(own.values()) + strength)

    score = 0.0
    contexts = {c for c, _ in counts["all"]}
    for w in split(text):
        for context, x in grams(w):
            if context in contexts:
                both = smooth("all", context, x, shared(context[3], context[4], x), 1.0)
                score += math.log(smooth("t", context, x, both, tox.STRENGTH) / smooth("o", context, x, both, tox.STRENGTH))
    return score / (len(split(text)) + tox.PRIOR_WORDS)


def test_scores_and_cut_equal_brute_force(spark):
    rows, marks = corpus(8, 60)
    rows = [(i, " ".join(t.split()[:12])) for i, t in rows]
    known = labels(spark, [(i, 1, m) for (i, _), m in zip(rows[:50], marks)])
    got = {r.row.doc_id: (r.score, r.is_toxic) for r in tox.toxicity(h.docs(spark, rows), known, keep=["doc_id"]).collect()}
    half = {r["__id"]: r["__half"] for r in tox._known(known, 1000)[0].collect()}
    assert set(half.values()) == {0, 1}
    everything = [(x, "en", m) for (_, x), m in zip(rows[:50], marks)]
    for i in range(50, 60):  # judged by all labels
        assert abs(got[i][0] - brute_score(rows[i][1], "en", everything)) < 2e-6
    f1 = lambda chosen: 2 * sum(marks[i] for i in chosen) / (len(chosen) + sum(marks[:50]))
    cuts = {round(got[i][0], 4) - 0.00005 for i in range(50)}
    assert f1([i for i in range(50) if got[i][1]]) == max(f1([i for i in range(50) if got[i][0] >= c]) for c in cuts)


def test_very_long_texts_count_whole(spark):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(300_000)]
    text = " ".join(words)
    part = pa.RecordBatch.from_pydict({"text": [text], "lang": pa.array(["en"])})
    symbols, starts, ends, owner, _, hashes = tox._once_a_text(part)
    assert len(text) > 2_000_000 and len(set(hashes.tolist())) == len(hashes) == len(set(words))
    assert {"".join(chr(96 + c) for c in symbols[a:b]) for a, b in zip(starts, ends)} == set(words)


def test_parts_and_shuffled_labels_give_the_same(spark):
    rows, marks = corpus(2, 80)
    df, known = h.docs(spark, rows + rows[:3]), labels(spark, [(i, 1, m) for (i, _), m in zip(rows, marks)])
    flat = lambda d: sorted((r.row.doc_id, r.score, r.is_toxic) for r in d.collect())
    assert flat(tox.toxicity(df, known)) == flat(tox.toxicity(df, known, part_ngrams=100, broadcast_labels=0))


def test_counts_equal_brute_force(spark):
    rows = [(1, "Abc abc d9"), (2, "abc")]
    df = spark.createDataFrame([(t, "en", 1, 0) for _, t in rows], "text string, lang string, toxic long, half long")
    got = {r.ngram: r.c10 for r in tox.count_ngrams(df).collect()}
    want = Counter()
    code = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1)} | {str(d): 27 for d in range(10)}
    lang = 1 + __import__("zlib").crc32(b"en") % 63
    for _, t in rows:
        for word in set(t.lower().split()):
            symbols = [0] * tox.ORDER + [code[c] for c in word] + [0]
            for end in range(tox.ORDER, len(symbols)):
                key = lang
                for s in symbols[end - tox.ORDER + 1 : end + 1]:
                    key = key << 6 | s
                want[key] += 1
    assert got == dict(want)


def test_shared_distribution_adds_up():
    counts = np.random.default_rng(0).integers(0, 3, (64, 64, 64))
    counts[5] = 0
    p = tox.shared_backoff(counts)
    assert np.allclose(p.sum(-1), 1) and (p > 0).all()


def test_lookup_finds_every_key():
    keys = np.sort(np.random.default_rng(1).choice(10**9, 5000, replace=False)).astype(np.int64)
    table = tox.Lookup(keys)
    assert (table(keys) == np.arange(5000)).all() and (table(keys + 10**10) == -1).all()
    assert (tox.Lookup(keys[:0])(keys) == -1).all()


def test_edges_of_the_input(spark):
    df = h.clashing(h.docs(spark, h.edge_rows()))
    none = labels(spark, [])
    assert not any(r.is_toxic for r in tox.toxicity(df, none).collect())
    known = labels(spark, [(6, 1, 1), (6, 1, 0), (7, 1, 0), (8, 1, None), (None, 1, 1), (99, 1, 1)])
    got = tox.toxicity(df, known).collect()
    assert len(got) == len(h.edge_rows()) and all(r.score == 0 for r in got if not (r.row.text or "").strip())
    kept = tox.drop_toxic(df, none)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert tox.toxicity(df.limit(0), known).count() == 0
