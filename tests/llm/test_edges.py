"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

from quillgrid.llm import decontamination, exact_dedup, licenses, mixing, passages, personal, quality, sharding, simhash

from .helpers import ROWS, awkward


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "x y z"), (2, None), (None, "alpha beta"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def operators(bench, labels):
    return {
        "ring": lambda d: sharding.bounded_load_shards(d, "doc_id", 3),
        "copies": mixing.systematic_copies,
        "exact": exact_dedup.exact_groups,
        "simhash": simhash.near_duplicate_groups,
        "contamination": lambda d: decontamination.contamination(d, bench),
        "no benchmark": lambda d: decontamination.contamination(d, bench.limit(0)),
        "quality": lambda d: quality.score(d, quality.fit_on(d, labels)),
        "no labels": lambda d: quality.score(d, quality.fit_on(d, labels.limit(0))),
        "passages": passages.repeated_passages,
        "licenses": licenses.scan,
        "personal": lambda d: personal.find(d, personal.fit_on(d)),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(spark, bench, labels, name):
    run = operators(bench, labels)[name]
    rows = run(awkward(spark)).collect()
    assert len(rows) == len(ROWS)
    key = next(c for c in ("doc_id", "_key", "_all") if c in rows[0].asDict())
    ids = [r[key]["doc_id"] if key == "_all" else r[key] for r in rows]
    assert sorted(ids, key=repr) == sorted((i for i, _, _ in ROWS), key=repr)
    assert run(awkward(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["one_of_each_group", "clean", "accepted", "mix"])
def test_stages_keep_the_columns(spark, bench, labels, name):
    run = {
        "one_of_each_group": simhash.one_of_each_group,
        "clean": lambda d: decontamination.clean_documents(d, bench),
        "accepted": lambda d: quality.accepted_documents(d, labels),
        "mix": mixing.mix,
    }[name]
    docs = awkward(spark)
    out = run(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    given = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in out.collect()} <= given
    assert run(awkward(spark, [])).count() == 0


def test_one_row_stays_of_each_near_duplicate_group(spark):
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each_group(awkward(spark)).select("doc_id", "text").collect()]
    assert kept.count((1, "Alpha beta")) == 1 and (5, "Alpha BETA") not in kept
    assert [i for i, t in kept if not t] == [2]


def test_windows_of_short_items_and_null_ids(spark, bench):
    for bound in (decontamination.BOUND_BYTES, 0):
        rows = {(r.doc_id, r.text and r.text[:6]): (r._n_words, r._n_hit, r._items) for r in decontamination.contamination(awkward(spark, ROWS[:5]), bench, bound=bound).collect()}
        assert rows[(1, "Alpha ")] == (2, 2, ["null"])
        assert rows[(None, "x y z")] == (3, 3, ["1"])
        assert rows[(2, None)] == (0, 0, [])


def test_exact_groups_of_null_and_empty(spark):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(awkward(spark)).collect()}
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert {i for i, s in rows if s == empty} == {None, 2, 3}
    assert all(r.keep_id == 3 and r.group_size == 3 for (i, s), r in rows.items() if s == empty)
    assert [r.kept for (i, s), r in rows.items() if i == 5] == [True]
