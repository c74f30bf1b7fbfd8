"""Headline queries of the search engine, timed; prints one JSON line.

Tokens, postings and the positional index are built once and stored, as a user would; queries read them.
Each query runs twice and the second time counts, so that compiling isn't measured.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from quillgrid.engine import Collection
from quillgrid.operators import indexes
from quillgrid.session import local_session
from quillgrid.sources.tables import load_documents

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

QUERIES = {
    "bool_and": ("the and for", "inverted"),
    "bool_nested": ("(the or der) and not that", "inverted"),
    "bool_nested_matrix": ("(the or der) and not that", "matrix"),
    "bool_nested_coordinate": ("(the or der) and not that", "coordinate"),
    "phrase2": ('"the and"', "coordinate"),
    "phrase3": ('"the and the"', "coordinate"),
    "bigram_phrase3": ('"the and the"', "bigram"),
    "near5": ("near/5(the that for)", "coordinate"),
    "wild_prefix": ("the*", "wildcard"),
    "wild_infix": ("th*er", "wildcard"),
    "wild_medium": ("*tion*", "wildcard"),
    "wild_multi": ("t*i*n*", "wildcard"),
}


def main() -> int:
    spark = local_session(CPUS, memory="16g", shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    times: dict[str, float] = {}

    def timed(name, action) -> None:
        began = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - began, 3)

    try:
        path = f"{SF_DIR}/documents.parquet"
        docs = load_documents(spark, path)
        docs.count()
        noop = lambda df: df.write.format("noop").mode("overwrite").save()
        for _ in range(2):
            timed("tokens", lambda: noop(indexes.tokens(docs)))
            timed("dictionary", lambda: noop(indexes.dictionary(indexes.tokens(docs))))
            timed("postings", lambda: noop(indexes.postings(indexes.tokens(docs))))
            timed("coordinates", lambda: noop(indexes.coordinates(indexes.tokens(docs))))
            timed("bigrams", lambda: noop(indexes.bigrams(docs)))
        timed("build_all_indexes", lambda: Collection(docs).save(folder))
        stored = Collection.open(spark, folder)
        timed("vb_sizes", lambda: noop(indexes.compressed_sizes(indexes.posting_deltas(indexes.posting_ids(stored.postings, stored.doc_ids)))))
        for _ in range(2):
            for name, (query, index) in QUERIES.items():
                timed(name, lambda: stored.search(query, index).count())
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
