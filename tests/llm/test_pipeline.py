"""The pipeline's stages, each against brute force on its own input."""

import collections
import os

import corpus_pipeline
from quillgrid.llm import decontamination
from quillgrid.llm.common import table

from .test_operators import simple_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held[-1], SF).cache()
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
        held.append(out)
    given, rated, distinct, clean, mixed, placed = [[tuple(r) for r in d.collect()] for d in held]
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, SF, "labels").collect()}
    kept = {r[0] for r in rated}
    toxic, good = [i for i, x in labels.items() if x[1]], [i for i, x in labels.items() if x == (1, 0)]
    assert set(rated) <= set(given) and sum(i in kept for i in toxic) <= 0.05 * len(toxic) and sum(i in kept for i in good) >= 0.98 * len(good)

    fps = {r[0]: simple_fingerprint(r[1]) for r in rated}
    stays, here = {r[0] for r in distinct}, sorted(fps)
    root = {i: i for i in here}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(here):
        for b in here[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert stays == {i for i in here if find(i) == i} and len(distinct) == len(stays)

    windows = {w for r in table(spark, SF, "benchmark").collect() for w in decontamination.item_windows(decontamination.words_of(r.text.encode()))}

    def hit(text):
        words = decontamination.words_of(text.encode())
        return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))

    assert {r[0] for r in clean} == {r[0] for r in distinct if not hit(r[1])} and len(clean) < len(distinct)

    copies = collections.Counter(r[0] for r in mixed)
    assert set(mixed) <= set(clean) and max(copies.values()) <= 3
    shards = collections.defaultdict(list)
    for r in placed:
        shards[r[-2]].append(r[-1])
    assert sorted(r[:-2] for r in placed) == sorted(mixed)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_run_and_null_rows(spark, tmp_path):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    rows = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (None, "some text of no worth", "en", "a", 21), (None, "some text of no worth", "en", "a", 21)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, given in enumerate((rows, [])):
        sf = f"{tmp_path}/{k}"
        os.makedirs(sf)
        spark.createDataFrame(given, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert all(r.text == "some text of no worth" for r in out) and len(out) <= 3
