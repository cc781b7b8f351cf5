"""``python -m tesserae``: collections, indexing, search and upkeep over a warehouse, and the
registered queries over a folder of tables."""

from __future__ import annotations

import argparse

from tesserae import config

FORMATS = ["text", "json", "csv", "xml", "md", "files"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae")
    p.add_argument("--config")
    p.add_argument("--root", help="the warehouse, or for run the folder of tables")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("collection").add_subparsers(dest="action", required=True)
    add = c.add_parser("add")
    add.add_argument("name")
    add.add_argument("path")
    add.add_argument("--glob", action="append")
    add.add_argument("--type", default="filesystem")
    add.add_argument("--profile")
    c.add_parser("list")
    for name in ("show", "remove"):
        c.add_parser(name).add_argument("name")
    ren = c.add_parser("rename")
    ren.add_argument("name")
    ren.add_argument("new")
    move = c.add_parser("move")
    move.add_argument("name")
    move.add_argument("path")
    move.add_argument("--glob", action="append")
    for name, text in (("search", "full text"), ("vsearch", "vectors"), ("query", "hybrid")):
        s = sub.add_parser(name, help=text)
        s.add_argument("text")
        s.add_argument("--limit", type=int)
        s.add_argument("--collection")
        s.add_argument("--min-score", type=float, default=0.0)
        s.add_argument("--format", default="text", choices=FORMATS)
    s.add_argument("--rerank", action="store_true")
    s.add_argument("--expand", action="store_true")
    for name in ("index", "embed"):
        s = sub.add_parser(name)
        s.add_argument("collection")
        s.add_argument("--force", action="store_true")
    sub.choices["index"].add_argument("--embed", action="store_true")
    sub.add_parser("update-all").add_argument("--embed", action="store_true")
    sub.add_parser("cleanup")
    fill = sub.add_parser("backfill-metadata")
    fill.add_argument("--collection")
    fill.add_argument("--force", action="store_true")
    sub.add_parser("status").add_argument("--check-sync", action="store_true")
    sub.add_parser("sql").add_argument("text")
    run = sub.add_parser("run", help="a registered query")
    run.add_argument("name")
    run.add_argument("--rows", type=int, default=20)
    return p


def _collection(engine, args) -> str:
    if args.action == "add":
        engine.add_collection(args.name, args.path, args.glob, args.type, {"metadata_profile": args.profile} if args.profile else None)
        return f"added {args.name}"
    if args.action == "list":
        return "\n".join(f"{r['name']}\t{r['source_type']}\t{r['pwd']}" for r in engine.collections().collect())
    if args.action == "show":
        return "\n".join(f"{k}: {v}" for k, v in engine.collection(args.name).asDict().items())
    if args.action == "remove":
        documents, hashes = engine.remove_collection(args.name)
        return f"removed {documents} documents, {hashes} texts"
    if args.action == "rename":
        engine.rename_collection(args.name, args.new)
        return f"renamed {args.name} to {args.new}"
    engine.move_collection(args.name, args.path, args.glob)
    return f"moved {args.name}"


def command(engine, args) -> str:
    from tesserae.plans import answers

    show = lambda rows: answers.show([r.asDict() for r in rows.collect()], args.format)
    counts = lambda c: ", ".join(f"{k} {v}" for k, v in c.items())
    name = args.command
    if name == "collection":
        return _collection(engine, args)
    if name == "search":
        return show(engine.fts_search(args.text, args.limit, args.collection, args.min_score).select("file", "score"))
    if name == "vsearch":
        return show(engine.vector_search(args.text, args.limit, args.collection, args.min_score).select("file", "score"))
    if name == "query":
        found = engine.query(args.text, args.limit, args.collection, expand=args.expand, rerank=args.rerank)
        found = found.where(found["score"] >= args.min_score)
        return show(found.orderBy("pos").drop("query_id", "pos", "document_id", "raw_token", "confidence"))
    if name == "index":
        done = counts(engine.ingest(args.collection, force=args.force))
        return done + ("; " + counts(engine.embed(args.collection)) if args.embed else "")
    if name == "embed":
        return counts(engine.embed(args.collection, force=args.force))
    if name == "update-all":
        done = [f"{n}: {counts(c)}" for n, c in engine.ingest_all().items()]
        return "\n".join([*done, counts(engine.embed())] if args.embed else done)
    if name == "cleanup":
        return counts(engine.cleanup())
    if name == "backfill-metadata":
        return counts(engine.backfill(args.collection, force=args.force))
    if name == "sql":
        return engine.sql(args.text)._show_string(50, False)
    lines = [counts(engine.status())]
    if args.check_sync:
        lines += [f"{r['issue']}: {r['n']} {', '.join(r['samples'])}" for r in engine.sync_report().collect()]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    cfg = config.load(args.config, root=args.root)
    from pyspark.sql import SparkSession

    from tesserae.engine import Engine
    from tesserae.functions import providers
    from tesserae.plans.registry import QUERIES

    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    if args.command == "run":
        QUERIES[args.name](spark, cfg.root).show(args.rows, False)
        return 0
    print(command(Engine(spark, cfg.root, cfg, providers.from_environment()), args))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
