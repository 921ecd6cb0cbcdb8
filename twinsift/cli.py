"""Command line: ``hash``, ``query`` and ``report``; an option --foo-bar falls back to the variable FOO_BAR."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.config import mode as mode_of
from twinsift.functions.formatting import QUERY_PATH
from twinsift.lineage import cut
from twinsift.operators import docfreq, report
from twinsift.plans import engine
from twinsift.sources import files as sources
from twinsift.sources import git
from twinsift.sources.store import NotEmptyError, Store

MOST_PRINTED = 100  # repositories
log = logging.getLogger("twinsift")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinsift")
    sub = p.add_subparsers(dest="command", required=True)
    env = lambda option, default: os.environ.get(option[2:].replace("-", "_").upper(), default)

    def command(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for option, default in (("--store", "store"), ("--keyspace", "hashes"), ("--mode", "file"), ("--log-level", "warning")):
            c.add_argument(option, default=env(option, default))
        c.add_argument("-v", "--verbose", action="store_true", help="log at level debug")
        return c

    h = command("hash")
    h.add_argument("path")
    h.add_argument("--replace", action="store_true")
    h.add_argument("-f", "--format", choices=("files", "git"), default=env("--format", "files"), help="plain files, or git repositories at their HEAD")
    h.add_argument("--limit", type=int, default=int(env("--limit", 0)))
    h.add_argument("--docfreq-file", default=env("--docfreq-file", ""), help="also write the document frequencies there as JSON")
    q = command("query")
    q.add_argument("path", help="a folder, a file, or file:function:line")
    q.add_argument("--docfreq-file", default=env("--docfreq-file", ""), help="document frequencies in place of the store's")
    r = command("report")
    r.add_argument("--output-format", choices=("text", "json"), default=env("--output-format", "text"))
    r.add_argument("--group-by", action="store_true", help="count contents first and look up the places of those that repeat")
    r.add_argument("-o", "--output", action="store_true", help="keep components and communities in the store")
    return p


def no_function(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fn_name": F.lit(None).cast("string"), "fn_line": F.lit(None).cast("int")})


def stream(rows: DataFrame, column: str) -> Iterator[str]:
    """Row by row: the driver never holds more than a partition."""
    return (r[column] for r in rows.toLocalIterator())


def run_hash(args: argparse.Namespace, spark: SparkSession, store: Store) -> int:
    mode, files = mode_of(args.mode), cut(git.from_git(spark, args.path)) if args.format == "git" else sources.from_folder(spark, args.path)
    repos = sources.list_repositories(files, args.limit)
    if args.limit:
        files = sources.only_repositories(files, repos)
    names = [r["repository_id"] for r in repos.orderBy("repository_id").limit(MOST_PRINTED).collect()]
    print("Hashing the repositories:", *names, *["..."] * (len(names) == MOST_PRINTED), sep="\n  ")
    try:
        engine.hash_files(files, store, mode, args.replace)
    except NotEmptyError as e:
        print(e, file=sys.stderr)
        return 2
    if args.docfreq_file:
        docfreq.write_json(*store.docfreq(mode.name), args.docfreq_file)
    for r in sources.skip_report(files, mode.min_size or 0).orderBy(F.desc("files"), "reason").collect():
        log.info("%s: %d files", r["reason"], r["files"])
    return 0


def run_query(args: argparse.Namespace, spark: SparkSession, store: Store) -> int:
    path, function = args.path, None
    if hit := QUERY_PATH.fullmatch(path):
        path, function = hit[1], (hit[2], int(hit[3]))
        if args.mode != "func":
            print("a function is looked up in mode func", file=sys.stderr)
            return 2
    model = None
    if args.docfreq_file:
        model = docfreq.read_json(spark, args.docfreq_file)
        if model is None:
            log.warning("no file %s: the store's document frequencies are used", args.docfreq_file)
    dup, similar = engine.query_files(sources.from_folder(spark, path), store, mode_of(args.mode), function, model)
    for item in stream(report.with_links(no_function(dup)).orderBy("item"), "item"):
        print("duplicate", item)
    lines = report.with_links(similar).select("query_doc", "item", F.concat_ws(" ", F.lit("similar"), "query_doc", "item").alias("line"))
    for line in stream(lines.orderBy("query_doc", "item"), "line"):
        print(line)
    return 0


def run_report(args: argparse.Namespace, spark: SparkSession, store: Store) -> int:
    mode, meta = mode_of(args.mode), store.read("meta")
    counts = report.duplicate_counts(meta)
    dup = report.find_by_hash(counts, meta).join(counts, "sha1") if args.group_by else report.duplicates(meta)
    components, groups = engine.report_groups(store, mode)
    if args.output:
        store.save_groups(components, groups, mode.name)
        groups = store.read(f"communities_{mode.name}")
    sizes = groups.groupBy("community").agg(F.count("*").alias("n"))
    if log.isEnabledFor(logging.DEBUG):
        log.debug("sizes of communities: %s", sizes.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.max("n").alias("most")).first())
    places = engine.report_places(groups, store, mode)
    if args.output_format == "json":
        parts = (("duplicates", report.place_json(dup).orderBy("sha1", "json")), ("similarities", report.group_json(places).orderBy("community", "json")))
        for k, (name, rows) in enumerate(parts):
            print(("{" if not k else "], ") + f'"{name}": [', end="")
            for i, line in enumerate(stream(rows, "json")):
                print(("," if i else "") + "\n" + line, end="")
        print("]}")
        return 0
    for line in stream(report.duplicate_text(dup).orderBy("sha1", "kind", "line"), "line"):
        print(line)
    for line in stream(report.group_text(places).orderBy("community", "kind", "line"), "line"):
        print(line)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s %(message)s")
    log.setLevel("DEBUG" if args.verbose else args.log_level.upper())
    spark = spark or SparkSession.builder.appName("twinsift").getOrCreate()
    store = Store(spark, args.store, args.keyspace)
    return {"hash": run_hash, "query": run_query, "report": run_report}[args.command](args, spark, store)


if __name__ == "__main__":
    sys.exit(main())
