"""What leaves the tasks of the indexes: whole lists, few shuffles, bounded chunks; and the same results for any chunk."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.engine import Collection
from quillgrid.functions.codecs import decode_vb, encode_delta_vb
from quillgrid.operators import frontpack, indexes, inversion, sizes
from quillgrid.plans import catalog

SF = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def random_rows(seed: int = 5) -> list[tuple[str, list[str]]]:
    """Documents of 0 to 30 words; some of them stand in two rows."""
    rng = random.Random(seed)
    names = [f"d{rng.randrange(10**6)}" for _ in range(150)]
    return [(n, rng.choices("abc abd bcd xyz привіт für".split(), k=rng.randrange(30))) for n in names + names[:20]]


def test_f1_vb_bytes_has_whole_lists(spark, tmp_path):
    n = (1 << 16) + 500
    spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 60000 == 7, "cat dog").otherwise("cat").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.term: r for r in catalog.QUERIES["vb_bytes"](spark, str(tmp_path)).collect()}
    ids = {str(i): k for k, i in enumerate(sorted(map(str, range(n))))}
    assert (got["cat"].block, got["cat"].n_postings, got["cat"].data) == (0, n, encode_delta_vb(list(range(n))).hex().upper())
    assert (got["dog"].block, got["dog"].data) == (0, encode_delta_vb([ids["7"], ids["60007"]]).hex().upper()) and len(got) == 2


@pytest.mark.parametrize("single", [True, False])
def test_indexes_of_random_documents(spark, single):
    rows = random_rows()[:150] if single else random_rows()
    docs = spark.createDataFrame(rows, "doc string, words array<string>").repartition(5)
    c, held, seen = Collection(docs), {}, []
    for doc, words in rows:
        for w in words:
            held.setdefault(w, set()).add(doc)
            seen.append(w)
    assert c.single == single
    names = sorted({d for d, words in rows if words})
    ids = {d: i for i, d in enumerate(names)}
    lists = {t: sorted(ids[d] for d in ds) for t, ds in held.items()}
    assert {(r.term, r.doc) for r in c.postings.collect()} == {(t, d) for t, ds in held.items() for d in ds}
    assert c.postings.count() == sum(map(len, held.values())) and c.bigrams.count() == c.bigrams.distinct().count()
    assert {r.term: (r.tf, r.df, r.doc_bytes) for r in c.term_sums.collect()} == {t: (seen.count(t), len(ds), sum(map(len, ds))) for t, ds in held.items()}
    assert {r.term: bytes(r.data) for r in c.compressed.collect()} == {t: encode_delta_vb(x) for t, x in lists.items()}
    assert {r.term: (r.n_postings, r.vb_bytes) for r in c.compressed_sizes.collect()} == {t: (len(x), len(encode_delta_vb(x))) for t, x in lists.items()}
    bits = {(t, i // 32): sum(1 << j % 32 for j in x if j // 32 == i // 32) for t, x in lists.items() for i in x}
    assert {(r.term, r.block): r.bits for r in c.matrix.collect()} == bits and c.matrix.count() == len(bits)
    blocks = {(r.term, r.block): (r.frequency, r.documents) for r in c.block_dictionary(10).collect()}
    assert blocks == {(t, i // 10): (len(x), [names[j] for j in x if j // 10 == i // 10]) for t, x in lists.items() for i in x}
    if single:
        want = {}
        for doc, words in rows:
            for p, w in enumerate(words):
                want.setdefault((w, doc), []).append(p)
        assert {(r.term, r.doc): r.positions for r in c.coordinates.collect()} == want


@pytest.mark.parametrize("most", [1, 7, 60, 10**6])
def test_chunks_of_any_size_give_the_same_lists(most):
    rows = sorted((d, w) for d, w in dict(random_rows()).items() if w)
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in part]), "words": pa.array([w for _, (_, w) in part])}) for part in (list(enumerate(rows))[k : k + 11] for k in range(0, len(rows), 11))]
    lists, cut = {}, list(inversion.chunks(batches, 1, most))
    assert sum(t.num_rows for t in cut) == len(rows) and all(t.num_rows == 1 or inversion.lengths(t).sum() <= max(most, 60) for t in cut if most < 10**6)
    for table in cut:
        for run in pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in inversion.runs(table, 64).items()}).to_pylist():
            ids = [run["first"]]
            for d in decode_vb(run["inside"]):
                ids.append(ids[-1] + d)
            assert ids[-1] == run["last"] and len(ids) == run["n"] and ids[0] // 64 == ids[-1] // 64
            lists.setdefault(run["term"], []).extend(ids)
    want = {}
    for i, (_, words) in enumerate(rows):
        for w in set(words):
            want.setdefault(w, []).append(i)
    assert lists == want
    for table in inversion.chunks(batches, 32, most):
        assert not most < 60 or len({i // 32 for i in table["id"].to_pylist()}) == 1


def test_spans_hold_whole_blocks():
    for block in (32, 100, 1 << 16, 7):
        for count in (0, 5, 10_000, 3_000_000):
            span = indexes.span_size(count, block, 12)
            assert span <= max(block, indexes.LARGEST_SPAN) and (span % block == 0 or block % span == 0)


#: Query -> the most shuffles in its plan (before: two to six more, each of rows by word and document).
SHUFFLES = {"postings": 0, "postings_book": 0, "bigram_index": 0, "coordinate_index": 0, "dictionary": 1, "dictionary_book": 1, "wild_all": 1, "incidence_matrix": 2, "vb_sizes": 2, "block_dictionary": 3, "inverted_size": 4, "coordinate_size": 4, "compression_stats": 3}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_few_shuffles(spark, name):
    assert shuffles(catalog.QUERIES[name](spark, SF)) <= SHUFFLES[name]


@pytest.mark.parametrize("name", ["index_sizes", "index_matrix_ratio"])
def test_f2_f3_each_input_is_read_once(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 5


@pytest.mark.parametrize("single", [True, False])
def test_f2_f3_sizes_are_those_of_the_indexes(spark, single):
    """The report, and the sizes counted over the indexes themselves, with terms that share turns."""
    rows = [("d1", ["a$b", "b$a", "cat", "x", ""]), ("d2", ["cat", "a$b", "scatter", "cat"]), ("d3", ["für", "cat"])]
    docs = spark.createDataFrame(rows if single else [*rows, ("d1", ["cat", "dog"])], "doc string, words array<string>")
    c = Collection(docs)
    got = {r.structure: r.bytes for r in c.size_report().collect()}
    for key, name in (("rotation", "rotations"), ("trigram", "trigrams")):
        assert got[key] == sizes.key_index_bytes(getattr(c, name), key, key).head().bytes
    assert got["suffix"] == sizes.suffix_bytes(c.suffixes).head().bytes
    assert got["bigram"] == sizes.bigram_bytes(c.bigrams.withColumn("doc_bytes", F.octet_length("doc")), c.universe).head().bytes


def test_f4_round_trip_sorts_no_postings(spark):
    text = catalog.QUERIES["vb_round_trip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in text and "SortMergeJoin" not in text


def test_f15_packing_holds_a_batch():
    """Batches are packed as they come, with the same result as each first character packed at once."""
    rng = random.Random(3)
    terms = sorted({"".join(rng.choices("abcд", k=rng.randrange(1, 9))) for _ in range(3000)}, key=str.encode)
    taken, got = 0, []

    def batches():
        nonlocal taken
        for k in range(0, len(terms), 100):
            assert taken - len(got) < 100 + frontpack.MAX_BLOCK
            taken += len(terms[k : k + 100])
            yield terms[k : k + 100]

    for rows in frontpack.pack_sorted(batches()):
        got += rows
    assert got == [r for c in "abcд" for r in frontpack.pack([t for t in terms if t[0] == c])]


def test_f15_packing_by_sorted_rows(spark):
    assert "FlatMapGroupsInPandas" not in catalog.QUERIES["front_pack_sizes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
