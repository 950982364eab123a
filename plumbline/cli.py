"""Command line: ``python -m plumbline.cli DATABASE COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest
from .config import index_config
from .engine import Engine
from .errors import PlumblineError
from .functions.validation import check_id
from .sources import files


def _value(text: str):
    """A number, a truth value, or the text itself."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (float,) if "." in text else (int,):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _metadata(pairs: list[str]) -> dict | None:
    return dict((k, _value(v)) for k, _, v in (p.partition("=") for p in pairs)) or None


def show(rows: list[dict], form: str, out) -> None:
    """Rows as a table, JSON or CSV."""
    if form == "json":
        print(json.dumps(rows, default=str), file=out)
        return
    names = list(rows[0]) if rows else []
    cells = [[f"{v:.6f}" if isinstance(v, float) else "" if v is None else str(v) for v in r.values()] for r in rows]
    if form == "csv":
        print(",".join(names), *[",".join(c) for c in cells], sep="\n", file=out)
        return
    widths = [max(map(len, col)) for col in zip(names, *cells)] if rows else []
    for line in [names, *cells]:
        print("  ".join(c.ljust(w) for c, w in zip(line, widths)).rstrip(), file=out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("database", help="folder of the database")
    p.add_argument("--format", choices=("table", "json", "csv"), default="table")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        own = sub.add_parser(name)
        for flags, options in arguments:
            own.add_argument(*flags, **options)

    k = (("-k",), {"type": int, "default": 10})
    meta = (("--meta",), {"action": "append", "default": []})
    path = (("path",), {})
    add("init", (("--index",), {"default": "flat"}), (("--metric",), {"default": "cosine"}))
    add("info")
    add("stats")
    add("insert", (("vector",), {}), (("--id",), {}), meta)
    add("get", (("id",), {}))
    add("update", (("id",), {}), (("--vector",), {}), meta)
    add("delete", (("ids",), {"nargs": "+"}))
    vectors = (("--show-vectors",), {"action": "store_true"})
    add("search", (("vector",), {}), k, (("--where",), {}), vectors)
    add("batch-search", path, k, vectors)
    add("batch-delete", path)
    number = {"type": int}
    add("ingest", path, (("--strategy",), {"default": "fixed"}), (("--size",), number | {"default": 500}), (("--overlap",), number | {"default": 50}), (("--terms",), number | {"default": 1000}))
    add("batch-insert", path)
    add("batch-update", path)
    add("list", (("--limit",), {"type": int, "default": 100}), (("--cursor",), {}))
    add("import", path)
    add("export", path)
    return p


def _imported(spark: SparkSession, path: str) -> DataFrame:
    return files.read_csv(spark, path) if path.endswith(".csv") else files.read_json(spark, path)


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    settings = f"{a.database}/_settings"
    try:
        if a.command == "init":
            index_config(a.index, metric=a.metric)  # raises on a bad one
            spark.createDataFrame([(json.dumps({"index": a.index, "metric": a.metric}),)], "value string").write.text(settings)
            print("created", file=out)
            return 0
        saved = json.loads(spark.read.text(settings).first()["value"])
        db = Engine(spark, a.database, index_config(saved["index"], metric=saved["metric"]))
        if a.command in ("info", "stats"):
            s = db.stats()
            show([{**s["storage"], **{f"index_{n}": v for n, v in s["index"].items()}}], a.format, out)
        elif a.command == "insert":
            ids = db.insert_batch([files.parse_vector(a.vector)], [_metadata(a.meta)], [check_id(a.id)] if a.id else None)
            print(*ids, sep="\n", file=out)
        elif a.command == "get":
            row = db.get(a.id)
            if row is None:
                print("not found", file=out)
                return 1
            print(json.dumps(row), file=out)
        elif a.command == "update":
            meta = _metadata(a.meta)
            rows = spark.createDataFrame([(a.id, files.parse_vector(a.vector) if a.vector else None, json.dumps(meta) if meta else None)], "id string, vector array<double>, metadata string")
            show([r.asDict() for r in db.update(rows).collect()], a.format, out)
        elif a.command == "delete":
            print("deleted" if db.delete(a.ids) else "some were not there", file=out)
        elif a.command == "batch-delete":
            gone = spark.read.text(a.path).select(F.trim("value").alias("id")).where("id <> '' and not id like '#%'")
            print("deleted" if db.delete(gone) else "some were not there", file=out)
        elif a.command == "ingest":
            show([r.asDict() for r in ingest.ingest_files(spark, db, a.path, ingest.TfidfEmbedder(a.terms), ingest.Chunking(a.strategy, a.size, a.overlap)).toLocalIterator()], a.format, out)
        elif a.command == "search":
            found = db.search(files.parse_vector(a.vector), a.k, a.where)
            show([{**r, "vector": db.get(r["id"])["vector"]} for r in found] if a.show_vectors else found, a.format, out)
        elif a.command == "batch-search":
            found = db.search_all(files.read_queries(spark, a.path), a.k)
            if a.show_vectors:
                found = found.join(db.table.read().select("id", "vector"), "id")
            show([r.asDict() for r in found.orderBy("query_id", "rank").toLocalIterator()], a.format, out)
        elif a.command in ("batch-insert", "import"):
            print(db.insert(_imported(spark, a.path)).count(), "inserted", file=out)
        elif a.command == "batch-update":
            rows = files.read_json(spark, a.path) if a.path.endswith(".json") else files.read_updates(spark, a.path)
            show([r.asDict() for r in db.update(rows).collect()], a.format, out)
        elif a.command == "list":
            page, cursor, more = db.table.page(a.limit, a.cursor)
            show([r.asDict() for r in page.select("id").collect()], a.format, out)
            if more:
                print(f"next: --cursor {cursor}", file=out)
        elif a.command == "export":
            (files.write_csv if a.path.endswith(".csv") else files.write_json)(db.table.read(), a.path)
            print("exported", file=out)
    except PlumblineError as e:
        print(f"error: {e}", file=out)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("plumbline").getOrCreate(), sys.argv[1:]))
