"""Command line: build, search, parquet-inspect, parquet-build."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Collection
from .functions.patterns import has_wildcard
from .operators import sizes
from .plans.query import QueryError
from .session import local_session
from .sources import store
from .sources.books import MIN_BYTES, read_books
from .sources.tables import infer_columns, inspect_rows, inspect_schema, load_documents

TABLE_INDEXES = ("coordinates", "stats", "postings", "universe", "dictionary", "doc_ids", "matrix", "bigrams", "compressed", "suffixes", "rotations", "trigrams")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgrid", description="Index and search document collections on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="index a folder of FB2 books")
    build.add_argument("-i", "--input", required=True)
    build.add_argument("-o", "--output", default="dictionary")
    build.add_argument("-f", "--formats", default="binary,json,text")
    build.add_argument("--min-bytes", type=int, default=MIN_BYTES)
    search = sub.add_parser("search", help="search a stored collection")
    search.add_argument("-q", "--query", required=True)
    search.add_argument("-d", "--dictionary", default="dictionary")
    search.add_argument("--mode", choices=("standard", "legacy"), default="standard")
    inspect = sub.add_parser("parquet-inspect", help="show a Parquet table's columns and first rows")
    inspect.add_argument("-i", "--input", required=True)
    table = sub.add_parser("parquet-build", help="index a Parquet table")
    table.add_argument("-i", "--input", required=True)
    table.add_argument("-o", "--output", default="parquet_dictionary")
    table.add_argument("--spimi", action="store_true", help="write blocks of sorted postings with spilling; Spark's shuffle does so in any case")
    table.add_argument("--memory-limit", type=int, default=512, help="MB of shuffle input a task aims at")
    return top


def report(collection: Collection, path: str, formats: tuple[str, ...]) -> None:
    stored = Collection.open(collection.spark, path)
    stored.stats.show(truncate=False)
    compared = store.compare_formats(stored.dictionary, stored.stats, path, formats)
    compared.show(truncate=False)
    store.format_ratio(compared).show(truncate=False)
    packing = sizes.packing_stats(stored.packed)
    packing.show(truncate=False)
    for form in formats:
        if form in store.FORMATS:
            print(f"packed {form}: {store.save_packed(stored.packed, stored.dictionary, stored.stats, packing, path, form)} bytes")
    report = stored.size_report()
    report.show(truncate=False)
    sizes.ratios(report).show(truncate=False)


def run_search(spark: SparkSession, args: argparse.Namespace) -> int:
    collection = Collection.open(spark, args.dictionary)
    wanted = ["matrix", "inverted", "coordinate"] + ["bigram"] * ('"' in args.query) + ["wildcard"] * has_wildcard(args.query)
    for index in wanted:
        began = time.perf_counter()
        try:
            docs = [r["doc"] for r in collection.search(args.query, index, args.mode).orderBy("doc").toLocalIterator()]
            print(f"{index}: {len(docs)} documents in {time.perf_counter() - began:.3f} s")
            for doc in docs:
                print(f"  {doc}")
        except QueryError as error:
            print(f"{index}: {error}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or local_session()
    if args.command == "search":
        return run_search(spark, args)
    if args.command == "parquet-inspect":
        table = spark.read.parquet(args.input)
        inspect_schema(table).show(1000, truncate=False)
        inspect_rows(table).show(truncate=False)
        print("text, id, metadata:", *infer_columns(table.schema))
        return 0
    if args.command == "build":
        docs = read_books(spark, args.input, args.min_bytes)
        found = docs.select(F.col("doc")).count()
        if not found:
            print("No FB2 files of the least size found")
            return 0
        if found < 10:
            print(f"Only {found} books; at least 10 are expected")
        collection = Collection(docs, "book")
        collection.save(args.output)
        report(collection, args.output, tuple(args.formats.split(",")))
        return 0
    if args.spimi:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{args.memory_limit}m")
    collection = Collection(load_documents(spark, args.input), "plain")
    collection.save(args.output, TABLE_INDEXES)
    report(collection, args.output, ("binary",))
    return 0


if __name__ == "__main__":
    sys.exit(main())
