"""Command line: build a knowledge base from files, query it, read from it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build as builds
from .functions.tokens import search_tokens
from .operators import evidence, index, reader
from .sources import sinks
from .sources.storage import Files

WORKFLOW = ["query", "read --around a line found", "read --sections for a map of the document", "answer with line numbers"]
ERRORS = {"retry_broader_or_stop": "ask with other words or stop", "out_of_scope": "the documents do not treat this"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill", description="Documents in a knowledge base: found by words, read by lines.")
    p.add_argument("--describe", action="store_true", help="print a machine-readable description")
    commands = p.add_subparsers(dest="command")
    b = commands.add_parser("build", help="make or update a knowledge base from files (.md .txt .docx) and tree records")
    b.add_argument("folder", help="folder of the knowledge base")
    b.add_argument("inputs", nargs="*", help="files or folders")
    b.add_argument("--force", action="store_true", help="replace what is there; documents that are gone stay known as inactive")
    b.add_argument("--incremental", action="store_true", help="extract and index only what changed")
    b.add_argument("--tree", default="", help="JSON lines of tree records to export")
    q = commands.add_parser("query", help="documents and lines for words")
    q.add_argument("folder", help="folder of the knowledge base")
    q.add_argument("query", help="words")
    q.add_argument("--limit", type=int, default=10, help="documents at most")
    q.add_argument("--doc-ids", default="", help="only these documents, parted by commas")
    q.add_argument("--stdout", choices=("auto", "compact", "full"), default="auto", help="auto is compact where --out is set, else full")
    q.add_argument("--out", default="runs/query.md", help="file inside the folder for all evidence; empty for none")
    r = commands.add_parser("read", help="lines of documents")
    r.add_argument("folder", help="folder of the knowledge base")
    r.add_argument("doc_id", help="documents, parted by commas")
    r.add_argument("--start", type=int, default=1, help="first line")
    r.add_argument("--count", type=int, default=reader.COUNT, help="lines")
    r.add_argument("--around", type=int, default=0, help="the section around this line")
    r.add_argument("--expand", type=int, default=0, help="with --around: sections more on each side")
    r.add_argument("--sections", action="store_true", help="list the sections with their lines")
    r.add_argument("--find", default="", help="the first line that holds this")
    r.add_argument("--after", type=int, default=0, help="with --find: only behind this line")
    r.add_argument("--context", type=int, default=reader.CONTEXT, help="with --find: lines on each side")
    r.add_argument("--jump", default="", help="ranges such as 210-230,450; goes before --start")
    r.add_argument("--tokens", default="", help="words to mark")
    r.add_argument("--out", default="", help="file inside the folder")
    return p


def describe(p: argparse.ArgumentParser) -> dict:
    """The commands and their arguments, taken from the parser itself."""

    def argument(a: argparse.Action) -> dict:
        kind = "enum" if a.choices else "bool" if a.nargs == 0 else "list" if a.nargs == "*" else "int" if a.type is int else "string"
        known = {"flag": a.option_strings[0] if a.option_strings else a.dest, "type": kind, "note": a.help, "required": not a.option_strings and a.nargs != "*"}
        return known | ({"choices": list(a.choices)} if a.choices else {}) | ({"default": a.default} if a.option_strings else {})

    commands = next(a for a in p._actions if isinstance(a, argparse._SubParsersAction)).choices
    listed = {n: [argument(a) for a in sub._actions if not isinstance(a, argparse._HelpAction)] for n, sub in commands.items()}
    return {"tool": "lexmill", "schema": "lexmill.tool.v1", "commands": listed, "workflow": WORKFLOW, "errors": ERRORS}


def ask(spark: SparkSession, folder: str, query: str, limit: int = 10, doc_ids: list[str] | None = None) -> DataFrame:
    """The answer to one query from a stored knowledge base."""
    only = F.array(*map(F.lit, doc_ids or [])).cast("array<string>")
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"), F.lit(limit).alias("top_k"), only.alias("doc_ids"))
    return evidence.answers(index.read(spark, folder), asked)


def payload(answer, query: str, out: str, compact: bool) -> dict:
    """What is printed of an answer: a compact one has status, match expression and the first results."""
    rows = [{"file": r["source_file"], "doc_id": r["doc_id"], "title": r["title"], "score": r["score"], "matches": [m.asDict() for m in r["matches"]]} for r in answer.results]
    if not compact:
        return {"tool": "lexmill", "cmd": "query", "query": query, "results": rows, "out": out} | ({"out_path": out} if out else {})
    head = {"tool": "lexmill", "cmd": "query", "query": query, "status": answer.status, "fts_match": answer.match, "results": rows[: evidence.SHOWN], "next_action": answer.next_action}
    return head | ({"out_path": out} if out else {})


def _write(spark: SparkSession, folder: str, name: str, text: str) -> None:
    Files(spark).write_text(sinks.guarded_path(folder, name), text)


def query(spark: SparkSession, args: argparse.Namespace) -> str:
    ids = [d.strip() for d in args.doc_ids.split(",") if d.strip()]
    answered = ask(spark, args.folder, args.query, args.limit, ids)
    answer = answered.first()
    if args.out:
        local = spark.createDataFrame([answer], answered.schema)
        _write(spark, args.folder, args.out, evidence.summary_markdown(local).first().markdown + evidence.markdown(local).first().markdown)
    compact = args.stdout == "compact" or (args.stdout == "auto" and bool(args.out))
    return json.dumps(payload(answer, args.query, args.out, compact), ensure_ascii=False)


def read(spark: SparkSession, args: argparse.Namespace) -> str:
    """Markdown of the lines asked for, document by document; of a missing document an error line."""
    names = [d.strip() for d in args.doc_id.split(",") if d.strip()]
    asked = spark.createDataFrame([(n, d) for n, d in enumerate(names)], "req_id int, doc_id string")
    stored = index.read(spark, args.folder)
    found = stored.names.filter("is_active").join(F.broadcast(asked), "doc_id").select("req_id", "doc_key", "doc_id", "file")
    places = found.collect()  # one row for each version of the few documents named
    docs = stored.texts(sorted({r.file for r in places})).join(F.broadcast(spark.createDataFrame([(r.doc_key,) for r in places], "doc_key long")), "doc_key", "left_semi")
    requests = spark.createDataFrame([(r.req_id, r.doc_key) for r in places], "req_id int, doc_key long")
    with_ = lambda **k: requests.select("*", *(F.lit(v).alias(n) for n, v in k.items()))
    out = {}
    if args.sections:
        for r in reader.section_list(docs).orderBy("doc_key", "nth").toLocalIterator():
            out.setdefault(r.doc_key, []).append(f"- L{r.line}-L{r.end_line} ({r.line_count} lines): {r.heading}")
        shown = {r.doc_key: f"## {r.doc_id} (sections, {len(out.get(r.doc_key, []))})\n\n" + "\n".join(out.get(r.doc_key, [])) + "\n" for r in places}
    else:
        if args.around:
            mode, lines = "around", reader.read_around(docs, with_(around=args.around, expand=args.expand))
        elif args.find:
            mode, lines = "find", reader.read_find(docs, with_(find=args.find, after=args.after, context=args.context))
        elif args.jump:
            mode, lines = "jump", reader.read_jump(docs, with_(jump=args.jump, count=args.count))
        else:
            mode, lines = "range", reader.read_range(docs, with_(start=args.start, count=args.count))
        marked = reader.mark_hits(lines, search_tokens(args.tokens))
        shown = {r.doc_key: r.markdown for r in reader.read_markdown(marked, docs, mode).toLocalIterator()}
    there = {r.doc_id for r in places}
    parts = [shown.get(r.doc_key, f"## {r.doc_id} (nothing found)\n") for r in sorted(places, key=lambda r: (r.req_id, r.doc_key))]
    text = "\n".join(parts + [f"Document not found: {n}\n" for n in names if n not in there])
    if args.out:
        _write(spark, args.folder, args.out, text)
    return text


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.describe or not args.command:
        print(json.dumps(describe(p)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        print(json.dumps(builds.build(spark, args.inputs, args.folder, args.force, args.incremental, args.tree or None)))
    else:
        print({"query": query, "read": read}[args.command](spark, args))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
