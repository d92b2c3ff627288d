import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill import build, cli
from lexmill.operators import evaluate, incremental, index, nodes, sharding, structure
from lexmill.sources import files, records, sinks
from lexmill.streaming import ingest


def test_files_are_read_by_suffix(spark, tmp_path):
    (tmp_path / "a V2.md").write_text("# Title\n\ntext")
    (tmp_path / "b.txt").write_bytes("Name\n====\n\nchapter one\n\nbody é".encode("cp1252"))
    data = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(data.getvalue())
    got = {r.source_file: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a V2.md"].title == "Title" and got["a V2.md"].version == "v2" and got["a V2.md"].doc_id == "a-v2"
    assert got["b.txt"].text == "# Name\n\n# chapter one\n\n### body é\n"
    assert got["c.docx"].text == "## Head\n\nBody\n"
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    with pytest.raises(Exception, match="no reader for d.pdf"):
        files.read_documents(spark, str(tmp_path)).collect()
    with pytest.raises(files.SourceError):
        files.docx_to_markdown(b"nothing")


def test_records(spark, tmp_path):
    rows = [
        {"type": "doc", "doc_id": "d", "title": "old"},
        {"type": "doc", "doc_id": "d", "title": "Title V4"},
        {"type": "doc", "doc_id": "unused", "title": "x"},
        {"doc_id": "d", "node_id": "n2", "kind": "item", "ordinal": 2, "body": "b  ", "is_active": "false", "confidence": 0, "aliases": ["A-b", "ab", " "]},
        {"type": "node", "doc_id": "d", "node_id": "n1", "kind": "item", "ordinal": 1, "body_md": "", "label": "L"},
        {"type": "node", "doc_id": "e", "node_id": "m", "kind": "odd"},
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    docs, tree = records.read_records(spark, str(path))
    d = {r.doc_id: r for r in docs.collect()}
    assert d.keys() == {"d", "e"} and d["d"].title == "Title V4" and d["d"].source_version == "v4" and d["e"].source_file == "e.ir"
    n = {r.node_id: r for r in tree.collect()}
    assert n["n2"].prev_id == "n1" and n["n1"].next_id == "n2" and n["m"].prev_id is None
    assert not n["n2"].is_active and n["n2"].confidence == 1.0 and n["n2"].aliases == ["A-b"] and n["n2"].body_md == "b\n"
    assert n["n1"].title == "L" and not n["m"].known_kind and n["n1"].source_version == "v4"
    path.write_text('{"type": "what", "doc_id": "d"}')
    with pytest.raises(Exception, match="unknown record type"):
        records.read_records(spark, str(path))[1].collect()
    path.write_text("no json")
    with pytest.raises(Exception):
        records.read_records(spark, str(path))[1].collect()


def test_inferred_headings(spark):
    text = "Book\n===\nPart\n---\n\n1.2.3 Deep\n\n- item\n\n1. one\n\nShort line\n\n" + "long " * 20 + "\n\nfollowed\nby text\n\n第三章 名\n"
    got = structure.infer_headings(spark.createDataFrame([(1, text)], "doc_key long, text string")).first().text
    assert got == "# Book\n## Part\n\n### 1.2.3 Deep\n\n- item\n\n1. one\n\n### Short line\n\n" + ("long " * 20).rstrip() + "\n\nfollowed\nby text\n\n# 第三章 名\n"


def test_change_classes(spark):
    kind = "doc_id string, source_path string, source_fingerprint string, text_fingerprint string"
    old = spark.createDataFrame([("a", "/a", "1", "1"), ("b", "/b", "1", "1"), ("c", "/c", "1", "1"), ("d", "/d", "1", "1")], kind)
    new = spark.createDataFrame([("a", "/a", "1", "1"), ("b", "/b", "2", "1"), ("c", "/c", "2", "2"), ("e", "/e", "1", "1")], kind)
    got = {r.doc_id: r.change for r in incremental.change_set(new, old).collect()}
    assert got == {"a": "unchanged", "b": "metadata_only", "c": "rebuild", "d": "removed", "e": "new"}
    kept = {r.doc_id: r.source_fingerprint for r in incremental.apply_changes(old, incremental.change_set(new, old), new).collect()}
    assert kept == {"a": "1", "b": "1", "c": "2", "e": "1"}


def test_build_modes(spark):
    kind = "doc_id string, change string"
    same, some = spark.createDataFrame([("a", "unchanged")], kind), spark.createDataFrame([("a", "unchanged"), ("b", "new")], kind)
    assert incremental.build_mode(same, True) == "none" and incremental.build_mode(some, True) == "incremental"
    assert incremental.build_mode(some, False) == "full" and incremental.build_mode(same.limit(0), True) == "full"


def test_shards_split_only_large_prefixes(spark):
    rows = spark.createDataFrame([(k,) for k in ["aa"] * 3 + ["ab"] * 2 + ["b", ""]], "key string")
    got = {(r.key, r.shard) for r in sharding.shard_keys(rows, max_rows=3, max_prefix=2).collect()}
    assert got == {("aa", "aa"), ("ab", "ab"), ("b", "b"), ("", "")}


def test_evaluation(spark):
    kind = "query string, patterns array<string>, hits array<string>, elapsed_ms double, bundle_chars long"
    r = spark.createDataFrame([("a", ["x*"], ["n", "x1"], 10.0, 5), ("b", [], ["x"], 20.0, 7), ("c", ["q"], None, 30.0, 9)], kind)
    ranked = evaluate.first_ranks(r)
    m = evaluate.metrics(ranked).first()
    assert (m.cases, m.hit_at_1, m.hit_at_3, m.mrr) == (3, 0.0, 0.333333, 0.166667)
    assert {x["query"] for x in evaluate.failures(ranked).collect()} == {"b", "c"}
    p = evaluate.latency(r).first()
    assert (p.p50, p.p95, p.max_ms, p.avg_chars, p.max_chars) == (20.0, 30.0, 30.0, 7.0, 9)
    empty = evaluate.metrics(evaluate.first_ranks(r.limit(0))).first()
    assert (empty.cases, empty.mrr) == (0, 0.0)


def test_command_line_round_trip(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.md").write_text("# One\n\nthe zebra runs\nzebra sleeps\n## Two\nlion\nend\n")
    (source / "two.txt").write_text("a lion sleeps")
    base = str(tmp_path / "base")
    assert build.build(spark, [str(source)], base)["documents"] == 2
    with pytest.raises(build.BuildError):
        build.build(spark, [str(source)], base)
    with pytest.raises(build.BuildError):
        build.build(spark, [str(source)], str(tmp_path / "No Name"))
    assert build.build(spark, [str(source)], base, force=True)["mode"] == "full"
    assert build.verify(spark, base)

    def run(*argv):
        capsys.readouterr()
        assert cli.main(list(argv)) == 0
        return capsys.readouterr().out.strip()

    out = json.loads(run("query", base, "zebra").splitlines()[-1])
    assert out["status"] == "high_confidence" and out["results"][0]["doc_id"] == "one" and out["out_path"] == "runs/query.md"
    assert "zebra sleeps" in (tmp_path / "base" / "runs" / "query.md").read_text()
    full = json.loads(run("query", base, "zebra", "--out", "").splitlines()[-1])
    assert "status" not in full and full["results"][0]["matches"][0]["text"] == "the zebra runs"
    assert json.loads(run("query", base, "lion", "--doc-ids", "two", "--stdout", "compact"))["results"][0]["doc_id"] == "two"
    assert "zebra sleeps **← HIT**" in run("read", base, "one", "--count", "40", "--tokens", "zebra")
    sections = run("read", base, "one,nothing", "--sections")
    assert "## Two" in sections and "Document not found: nothing" in sections
    line = int(re.search(r"- L(\d+)-.*: ## Two$", sections, re.M)[1])
    assert f"L{line + 1}: lion" in run("read", base, "one", "--around", str(line))
    assert "L" in run("read", base, "one", "--find", "SLEEPS", "--context", "1") and "nothing found" in run("read", base, "one", "--find", "unicorn")
    assert run("read", base, "one", "--jump", f"{line}, {line + 1}", "--count", "1", "--out", "runs/r.md").count("L") >= 2
    told = json.loads(run("--describe"))
    assert {a["flag"] for a in told["commands"]["read"]} >= {"--sections", "--around", "--find", "--jump"}
    assert records.read_state(spark, base + "/build_state.json")["active"] == 2
    assert records.read_state(spark, base + "/nothing.json") == {}
    for bad in ("../x", "docs/x", "."):
        with pytest.raises(ValueError):
            sinks.guarded_path(base, bad)


def test_incremental_builds(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "base")
    source.mkdir()
    texts = {"paper-a.md": "# Paper A\nzebra", "paper-b.md": "# Paper B\nlion", "paper-c.md": "# Paper C\ntiger", "paper-d.md": "# Paper D\ngrass"}
    for name, text in texts.items():
        (source / name).write_text(text)
    assert build.build(spark, [str(source)], base)["documents"] == 4
    assert build.build(spark, [str(source)], base, update=True)["mode"] == "none"
    (source / "paper-b.md").write_text("# Paper B\nlion water")  # another text
    (source / "paper-c.md").write_bytes(b"# Paper C\r\ntiger")  # the same canonical text
    (source / "paper-a.md").rename(source / "paper-e.md")  # a new document and a removed one
    (source / "paper-d.md").unlink()
    done = build.build(spark, [str(source)], base, update=True)
    assert done["mode"] == "incremental" and done["documents"] == 3
    assert done["changes"] == {"rebuild": 1, "metadata_only": 1, "new": 1, "removed": 2}
    assert build.verify(spark, base)
    stored = index.read(spark, base)
    fresh = index.temporary(stored.docs)  # all of it tokenised anew
    key = ["doc_key", "token", "is_active", "dl", "tf_title", "tf_body"]
    assert sorted(stored.postings.select(key).collect()) == sorted(fresh.postings.select(key).collect())
    assert (stored.n_docs, stored.avgdl) == (fresh.n_docs, fresh.avgdl)
    found = lambda q: [r["doc_id"] for r in cli.ask(spark, base, q).first().results]
    assert found("water") == ["paper-b"] and found("zebra") == ["paper-e"] and found("grass") == []
    (source / "paper-d.md").write_text("# Paper D\ngrass")
    assert build.build(spark, [str(source)], base, update=True)["documents"] == 4 and found("grass") == ["paper-d"]
    state = records.read_state(spark, base + "/build_state.json")
    sinks.write_state(spark, base + "/build_state.json", state | {"tools": "other"})
    assert build.build(spark, [str(source)], base, update=True)["mode"] == "full"
    assert spark.read.parquet(base + "/export/documents").count() == 4


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "Tea and cake", "a.md", "current", True, "# H\nx"), (2, "b", "Tea", "b.md", "v 2", True, "y")], "doc_key long, doc_id string, title string, source_file string, version string, is_active boolean, text string")
    sinks.write_shards(sharding.keyword_rows(docs), str(tmp_path), "kw", "keyword")
    assert spark.read.csv(str(tmp_path / "kw"), sep="\t", header=True).count() == 4
    sinks.write_manifest(docs, str(tmp_path))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "manifest")).collect()]
    assert [r["canonical_text_path"] for r in rows] == ["canonical_text/a--current.txt", "canonical_text/b--v-2.txt"]
    assert json.loads(sinks.structure_reports(docs).filter("doc_key = 1").first().report)["stats"]["heading_count"] == 1
    assert "doc_id: b" in sinks.document_metadata(docs).filter("doc_key = 2").first().metadata
    tree = nodes.typed_nodes(spark.createDataFrame([("a", "n", "item", "current", "p", "body", ["Al"])], "doc_id string, node_id string, kind string, source_version string, parent_id string, body_md string, aliases array<string>"))
    relations = sinks.export_relations(docs, tree)
    assert {k: v.count() for k, v in relations.items()} == {"documents": 2, "nodes": 1, "edges": 1, "aliases": 1, "locators": 1}
    assert relations["locators"].first().canonical_text_path == "canonical_text/a--current.txt"


def test_stream_keeps_the_newest_row(spark, tmp_path):
    source, folder = str(tmp_path / "s"), str(tmp_path / "f")
    kind = "doc_id string, is_active boolean, text string"
    stream = lambda: spark.readStream.schema(kind).parquet(source)
    spark.createDataFrame([("a", True, "1"), ("b", True, "1")], kind).write.parquet(source)
    ingest.follow(stream(), folder, str(tmp_path / "c")).awaitTermination(60)
    spark.createDataFrame([("a", True, "2"), ("b", False, "1")], kind).write.mode("append").parquet(source)
    ingest.follow(stream(), folder, str(tmp_path / "c")).awaitTermination(60)
    assert [(r.doc_id, r.text) for r in ingest.current(spark, folder).select("doc_id", "text").collect()] == [("a", "2")]


def test_stream_orders_rows_within_a_batch(spark, tmp_path):
    kind = "doc_id string, is_active boolean, text string, at int"
    rows = [("a", True, "1", 1), ("a", False, "2", 2), ("b", False, "1", 1), ("b", True, "2", 2), ("c", True, "1", 1), ("c", False, "1", 1)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "s"))
    for order, want in (("at", {"b"}), (None, set())):
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "s"))
        folder = str(tmp_path / f"f{order}")
        ingest.follow(stream, folder, str(tmp_path / f"c{order}"), order=order).awaitTermination(60)
        assert {r.doc_id for r in ingest.current(spark, folder).collect()} == want


def test_docx_images(spark):
    data, w = io.BytesIO(), "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body><w:p><w:r><w:t>Figure (1.2)</w:t><a:blip r:embed="i1"/></w:r></w:p><w:p><w:r><w:t>plain</w:t><a:blip r:embed="i1"/></w:r></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="i1" Type="http://x/relationships/image" Target="media/a.png"/></Relationships>')
    assert files.docx_to_markdown(data.getvalue()) == "Figure (1.2) [[IMAGE:media/a.png]]\n\nplain\n"


def test_names_globs_and_odd_records(spark, tmp_path):
    from lexmill.functions import text as tx

    got = [r.y for r in spark.createDataFrame([("ab-1",), ("a",), ("a--b",), ("-a",), ("a-",), ("A",), ("",)], "x string").select(tx.valid_name(F.col("x")).alias("y")).collect()]
    assert got == [True, True, False, False, False, False, False]
    cases = [("a[b", "a[b", True), ("a[!b]c", "axc", True), ("a[!b]c", "abc", False), ("[]x]", "]", True), ("*.m?", "x\ny.md", True), ("[*]", "*", True), ("[*]", "a", False), ("a.b", "axb", False), ("[a-c]1", "b1", True)]
    df = spark.createDataFrame(cases, "g string, s string, want boolean")
    assert [r.y for r in df.select(F.regexp("s", tx.glob_pattern(F.col("g"))).alias("y")).collect()] == [c[2] for c in cases]
    rows = [{"doc_id": "d", "node_id": f"n{i}", "kind": "item", "is_leaf": v, "aliases": a} for i, (v, a) in enumerate([(2, "One alias"), (0, [" A ", "ａ", 5]), ("2", 7), (None, None), (True, ""), (0.5, ["x"])])]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    tree = {r.node_id: (r.is_leaf, r.aliases) for r in records.read_records(spark, str(tmp_path / "r.jsonl"))[1].collect()}
    assert tree == {"n0": (True, ["One alias"]), "n1": (False, ["A", "5"]), "n2": (False, []), "n3": (True, []), "n4": (True, []), "n5": (True, ["x"])}


def test_unit_of_typed_flags(spark):
    from lexmill.functions import text as tx

    df = spark.createDataFrame([("true",), (" YES ",), ("0",), ("no",), (None,)], "x string")
    assert [r.y for r in df.select(tx.parse_flag(F.col("x")).alias("y")).collect()] == [True, True, False, False, True]
