"""python -m quern.cli: version, init, doctor, ingest, docs, chunks, index, search, changes."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import quern
from quern import intake, ports, settings
from quern.catalog import Catalog
from quern.errors import ConfigError, QuernError
from quern.operators import chunking, fusion, ledger, reports


def plain(text: object) -> str:
    """Document-controlled text for a terminal: no control characters."""
    return "".join(c if c.isprintable() else " " for c in str(text))


def _show(rows: list, columns: list[str]) -> None:
    for r in rows:
        print(" | ".join(f"{c}: {plain(r[c])}" for c in columns))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--store", default="quern-store")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("init")
    sub.add_parser("doctor").add_argument("--tiers", action="store_true")
    sub.add_parser("ingest").add_argument("path")
    sub.add_parser("docs")
    chunks = sub.add_parser("chunks")
    chunks.add_argument("id", nargs="?")
    chunks.add_argument("--verify", action="store_true")
    sub.add_parser("index").add_argument("--rebuild", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--k", type=int, default=8)
    search.add_argument("--arms", default=",".join(fusion.ARMS))
    search.add_argument("--explain", action="store_true")
    search.add_argument("--json", action="store_true")
    sub.add_parser("changes").add_argument("run", nargs="?", help="by default the last one")
    return p


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    if args.command == "version":
        print(quern.__version__)
        return 0
    conf = settings.load(args.config or (str(found) if (found := settings.discover(".")) else None))
    if args.command == "doctor" and args.tiers:
        for name, tier, default in settings.tier_table():
            print(f"{name}\t{tier}\t{default}")
        return 0
    spark = spark or SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Catalog(spark, args.store)
    workspace = "default"
    if args.command == "init":
        store.create(settings.stamp(conf))
        print(f"made {args.store}")
        return 0
    store.stamp()
    if args.command == "doctor":
        for name, n in store.counts().items():
            print(f"{name}\t{n}")
        for name in intake.drift(store, conf):
            print(f"changed since the store was made: {name}")
    elif args.command == "ingest":
        out = intake.ingest(store, args.path, workspace, conf)
        _show(out.where("outcome = 'failed'").orderBy("external_id").collect(), ["external_id", "reason"])
        _show(out.groupBy("outcome").count().orderBy("outcome").collect(), ["outcome", "count"])
    elif args.command == "docs":
        docs = store.documents()
        _show(docs.orderBy("external_id").limit(200).collect(), ["external_id", "title", "doc_type", "published_at"])
        _show(reports.coverage(docs, ["title", "published_at", "doc_type", "meeting_or_project", "uri"]).collect(), ["title", "published_at", "doc_type", "meeting_or_project", "uri"])
    elif args.command == "chunks":
        if args.verify:
            bad = chunking.slice_back_failures(store.read("chunk"), store.read("version")).count()
            print(f"{bad} chunks are not slices of their version")
            return 1 if bad else 0
        rows = store.chunks()
        if args.id:
            rows = rows.where(F.startswith("id", F.lit(args.id)))
        _show(rows.orderBy("version_id", "ordinal").limit(200).collect(), ["id", "ordinal", "char_start", "char_end", "text"])
    elif args.command == "index":
        made = intake.index(store, workspace, ports.embedder(conf.embeddings.model, conf.embeddings.dimensions), args.rebuild, conf)
        print(f"{made} vectors written")
    elif args.command == "search":
        arms = fusion.check_arms(tuple(a for a in args.arms.split(",") if a))
        q = spark.createDataFrame([("q", args.query)], "query_id string, text string")
        model = ports.embedder(conf.embeddings.model, conf.embeddings.dimensions) if "dense" in arms and store.exists("embedding") else None
        hits = intake.search(store, q, model, conf, arms, args.k)
        told = fusion.explain(hits, "id", "text", "heading_path").orderBy("rank").collect()
        if args.json:
            print(json.dumps([r.asDict() for r in told], ensure_ascii=False, default=str))
        else:
            _show(told, ["rank", "score", "heading_path", *(["ranks"] if args.explain else []), "preview"])
    elif args.command == "changes":
        last = store.read("run").orderBy(F.desc("started_at"), "id").limit(1).collect()
        wanted = args.run or (last[0].id if last else "")
        report = ledger.change_report(store.read("change_event").where(F.col("run_id") == wanted))
        _show(report.orderBy("kind").collect(), ["kind", "n", "subjects"])
    return 0


def main() -> int:
    try:
        return run(parser().parse_args())
    except (QuernError, ValueError) as e:
        print(f"{type(e).__name__}: {plain(e)}", file=sys.stderr)
        return 2 if isinstance(e, ConfigError) else 1


if __name__ == "__main__":
    sys.exit(main())
