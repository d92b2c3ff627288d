import re

import corpus_pipeline as cp
from lexmill.llm import toxicity
from tests.llm import helpers as h
from tests.llm.test_dedup import truth
from tests.llm.test_toxicity import brute_score, corpus, labels

FOLDER = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "byte_bpe"]
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen.append((docs, after))
        docs = after
    assert all(a.columns == columns for _, a in seen[:-1])
    texts = [({r.doc_id: r.text for r in b.collect()}, {r.doc_id: r.text for r in a.collect()} if "text" in a.columns else {r.doc_id: r.ids for r in a.collect()}) for b, a in seen]

    toxic = {r.row.doc_id for r in toxicity.toxicity(seen[0][0], spark.read.parquet(f"{FOLDER}/labels.parquet"), keep=["doc_id"]).collect() if r.is_toxic}
    assert toxic and texts[0][1].keys() == texts[0][0].keys() - toxic

    # exact similarities of all pairs: what is surely alike is folded, and what goes resembles something
    before = sorted(texts[1][0].items())
    pairs, roots = truth(before, 0.75)
    for a, b in pairs:
        assert not (a in texts[1][1] and b in texts[1][1]), (a, b)
    loose = {x for p in truth(before, 0.4)[0] for x in p}
    gone = texts[1][0].keys() - texts[1][1].keys()
    assert gone and gone <= loose and texts[1][0].keys() - loose <= texts[1][1].keys()
    same = {}
    for t in texts[1][1].values():
        same[t] = same.get(t, 0) + 1
    assert not any(n > 1 for t, n in same.items() if h.WORDS.findall(t.lower()))

    items = [r.text.lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {d for d, t in texts[2][0].items() if any(i in t.lower() for i in items)}
    assert leaked and texts[2][1].keys() == texts[2][0].keys() - leaked

    assert texts[3][1].keys() == texts[3][0].keys()
    assert not [d for d, t in texts[3][1].items() if re.search(r"(?i)[0-9a-f]{40}", t)]
    changed = {d for d, t in texts[3][1].items() if t != texts[3][0][d]}
    assert changed == {d for d, t in texts[3][0].items() if re.search(r"(?i)[0-9a-f]{40}", t)}

    assert {d: len(i) > 0 for d, i in texts[4][1].items()} == {d: bool(t) for d, t in texts[4][0].items()}
    assert cp.run(spark, FOLDER).count() == len(texts[4][1])


def test_toxicity_stage_against_brute_force(spark, tmp_path):
    rows, marks = corpus(8, 90)
    rows = [(i, " ".join(t.split()[:15])) for i, t in rows]
    labels(spark, [(i, 1, m) for (i, _), m in zip(rows[:60], marks)]).write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in cp.toxicity(spark, h.docs(spark, rows), str(tmp_path)).collect()}
    train = [(t, "en", m) for (_, t), m in zip(rows[:60], marks)]
    scores = {i: brute_score(t, "en", train) for i, t in rows[60:]}
    stay, go = [s for i, s in scores.items() if i in kept], [s for i, s in scores.items() if i not in kept]
    assert stay and go and max(stay) < min(go) + 2e-6
    known = {r["__id"]: r["__half"] for r in toxicity._known(labels(spark, [(i, 1, m) for (i, _), m in zip(rows[:60], marks)]), 1000)[0].collect()}
    assert set(known.values()) == {0, 1}


def test_each_stage_takes_edges(spark, tmp_path):
    docs = h.clashing(h.docs(spark, h.edge_rows()))
    for df in (docs, docs.limit(0)):
        n = df.count()
        for name, stage in cp.STAGES:
            df = stage(spark, df, FOLDER)
            path = str(tmp_path / f"{name}{n}")
            df.write.parquet(path)
            df = spark.read.parquet(path)
        assert df.count() <= n
