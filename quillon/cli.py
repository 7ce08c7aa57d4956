"""Command line of the engine: every command works on a store, a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.engine import MODES, SESSION_FILES, STRATEGIES, ContextEngine
from quillon.operators import store as T
from quillon.session import build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon", description=__doc__)
    top.add_argument("--store", required=True, help="folder of the tables")
    top.add_argument("--master", default=None, help="Spark master; left out, spark-submit decides")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("ingest", "ingest-project"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--large", action="store_true", help=f"take in more than {SESSION_FILES} files")
        p.add_argument("--allow", action="append", default=[], help="further folders that may be read")
    p = sub.add_parser("retrieve")
    p.add_argument("query")
    p.add_argument("--strategy", choices=STRATEGIES)
    p.add_argument("--mode", choices=MODES, default="focused")
    p.add_argument("--max-tokens", type=int)
    p = sub.add_parser("explain")
    p.add_argument("task")
    p.add_argument("chunk")
    p = sub.add_parser("score")
    p.add_argument("task")
    p.add_argument("--limit", type=int, default=50)
    for name in ("graph", "symbols", "stats", "health", "backfill-embeddings"):
        sub.add_parser(name)
    for name in ("export", "import"):
        p = sub.add_parser(name)
        p.add_argument("folder")
    p = sub.add_parser("watch")
    p.add_argument("events")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--once", action="store_true")
    return top


def show(rows: DataFrame, most: int = 100) -> None:
    """The first rows as JSON lines: a report on the screen, so bounded."""
    for line in rows.limit(most).toJSON().collect():
        print(line)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session(args.master)
    engine = ContextEngine.load(spark, args.store)
    if args.command in ("ingest", "ingest-project"):
        made = engine.ingest_directory(args.path, args.allow, project=args.command == "ingest-project", most_files=None if args.large else SESSION_FILES)
        print(json.dumps({"chunks": made.count(), "commit": engine.save(args.store)}))
    elif args.command == "retrieve":
        query = spark.createDataFrame([(1, args.query)], "query_id int, text string")
        print(engine.context_for(query, args.mode, args.max_tokens, args.strategy)["pack"].first().pack)
    elif args.command == "score":
        show(engine.score(spark.createDataFrame([(1, args.task)], "task_id int, text string"), F.current_timestamp()).orderBy(F.desc("score")), args.limit)
    elif args.command == "explain":
        show(engine.explain_routing(spark.createDataFrame([(1, args.task)], "task_id int, text string"), F.current_timestamp(), args.chunk))
    elif args.command == "graph":
        found = engine.update_graph()
        engine.save(args.store)
        show(found)
    elif args.command == "symbols":
        show(engine.symbols())
    elif args.command == "stats":
        show(engine.stats().orderBy(F.desc("tokens")))
    elif args.command == "health":
        print(json.dumps({name: rows.count() for name, rows in engine.tables.items()}))
    elif args.command == "backfill-embeddings":
        made = engine.backfill_embeddings()
        print(json.dumps({"embedded": made.count(), "commit": engine.save(args.store)}))
    elif args.command == "export":
        T.export_json(*(engine.tables[t] for t in ("chunks", "dependencies", "compression_cache")), args.folder)
    elif args.command == "import":
        engine = ContextEngine(spark, T.import_json(spark, args.folder))
        engine.backfill()
        print(json.dumps({"commit": engine.save(args.store)}))
    elif args.command == "watch":
        from quillon.streaming.ingest import watch

        watch(spark, args.events, args.store, args.checkpoint, args.once).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
