"""Small collections with known answers, random ones against plain Python, and stored indexes."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgrid.engine import Collection
from quillgrid.functions.patterns import complexity, required_trigrams
from quillgrid.functions.tokenizers import book_words, plain_words
from quillgrid.operators import indexes
from quillgrid.plans.query import LEGACY, QueryError

TEXTS = {"d1": "red cat sat here", "d2": "cat red red dog", "d3": "dog sat", "d4": "the cat xxx sat", "d5": "to a"}


@pytest.fixture(scope="module")
def small(spark):
    return Collection(spark.createDataFrame(list(TEXTS.items()), "doc string, text string").cache())


def found(collection, *args, **options):
    return sorted(r["doc"] for r in collection.search(*args, **options).collect())


@pytest.mark.parametrize(
    ("query", "docs"),
    [
        ("cat and not dog", ["d1", "d4"]),
        ("not cat", ["d3"]),
        ("CAT OR dog and sat", ["d1", "d2", "d3", "d4"]),
        ("not not cat", ["d1", "d2", "d4"]),
        ("cat or zebra", ["d1", "d2", "d4"]),
        ("zebra", []),
        ("not (cat or dog)", []),
    ],
)
def test_boolean_on_every_index(small, query, docs):
    for index in ("inverted", "matrix", "coordinate"):
        assert found(small, query, index) == docs


@pytest.mark.parametrize(
    ("query", "docs"),
    [('"red cat"', ["d1"]), ('" red cat sat "', ["d1"]), ("near/2(cat sat)", ["d1", "d4"]), ("near/1(cat sat)", ["d1"]), ("near/2(cat zebra)", []), ('"red" and not "cat sat"', ["d2"])],
)
def test_phrases_and_near(small, query, docs):
    assert found(small, query, "coordinate") == docs


def test_legacy_habits(small):
    assert found(small, "cat dog", mode=LEGACY) == ["d1", "d2", "d4"]
    assert found(small, '" red cat sat "', "coordinate", LEGACY) == []
    assert found(small, '" red cat sat "', "bigram", LEGACY) == ["d1"]
    for query in ("not not cat", "cat or zebra"):
        with pytest.raises(QueryError, match="not found"):
            small.search(query, mode=LEGACY)
    with pytest.raises(QueryError, match="Term 'zebra' not found"):
        small.search("cat or zebra", strict=True)
    assert found(small, '" cat zebra "', "coordinate", LEGACY) == []


def test_bigram_phrases_may_be_apart(spark):
    c = Collection(spark.createDataFrame([("a", "one two xxx two three"), ("b", "one two three")], "doc string, text string"))
    assert found(c, '"one two three"', "bigram") == ["a", "b"]
    assert found(c, '"one two three"', "coordinate") == ["b"]


def test_tokenizers(spark):
    rows = [
        ("café naïve abc", ["abc"], ["café", "naïve", "abc"]),
        ("привіт мир ёлка їжак", ["мир", "ёлка"], ["привіт", "мир", "ёлка", "їжак"]),
        ("abc123 foo_bar don't über", ["don"], ["abc123", "foobar", "dont", "über"]),
        ("Hello, World! foo-bar to ab", ["hello", "world", "foo", "bar"], ["hello", "world", "foobar"]),
        ("да я 日 日本 é1 x yz　End", ["end"], ["да", "日", "日本", "é1", "end"]),
        ("Hello, World! This is a test.", ["hello", "world", "this", "test"], ["hello", "world", "this", "test"]),
        ("", [], []),
    ]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "text string")
    for r, (_, book, plain) in zip(df.select(book_words(F.col("text")).alias("b"), plain_words(F.col("text")).alias("p")).collect(), rows, strict=True):
        assert (r.b, r.p) == (book, plain)


def words(spark, *terms):
    return Collection(spark.createDataFrame([(f"doc{i}", [t]) for i, t in enumerate(terms)], "doc string, words array<string>"))


@pytest.mark.parametrize(
    ("terms", "pattern", "standard", "legacy"),
    [
        (("hello", "help", "world"), "hel*", {"hello", "help"}, {"hello", "help"}),
        (("testing", "running", "hello"), "*ing", {"testing", "running"}, {"testing", "running"}),
        (("hello", "world", "wonderful"), "w*l", {"wonderful"}, {"world", "wonderful"}),
        (("test", "testing", "tester"), "test??", {"tester"}, set()),
        (("testing", "test", "contest"), "*est*", {"testing", "test", "contest"}, set()),
        (("cat", "cut", "coat"), "c?t", {"cat", "cut"}, set()),
        (("other", "weather", "thing"), "*th*", {"other", "weather", "thing"}, {"other", "weather", "thing"}),
        (("a.b", "axb", "a"), "a.*", {"a.b"}, {"a.b"}),
    ],
)
def test_wildcards(spark, terms, pattern, standard, legacy):
    c = words(spark, *terms)
    assert {r.term for r in c.expand(pattern).collect()} == standard
    assert {r.term for r in c.expand(pattern, LEGACY).collect()} == legacy


def test_labels_and_trigrams():
    assert [complexity(p) for p in ("abc", "a*", "*tion*", "*th*", "t*i*n*")] == [None, "simple", "medium", "complex", "complex"]
    assert required_trigrams("*tion") == ["ion", "tio"] and required_trigrams("hel*") == ["$$h", "$he", "hel"]


def test_random_queries_and_patterns_on_stored_indexes(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(3, 6))) for _ in range(40)})
    texts = {f"doc{i:03}": [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] for i in range(80)}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc string, text string")
    Collection(docs).save(str(tmp_path))
    stored = Collection.open(spark, str(tmp_path))
    universe = {d for d, w in texts.items() if w}
    a, b, c = rng.sample(vocabulary, 3)
    at = lambda w, x: [i for i, y in enumerate(w) if y == x]
    expected = {
        f"{a} and not {b}": {d for d in universe if a in texts[d] and b not in texts[d]},
        f"not {a} or {c}": {d for d in universe if a not in texts[d] or c in texts[d]},
        f'"{a} {b}"': {d for d in universe if any((x, y) == (a, b) for x, y in zip(texts[d], texts[d][1:], strict=False))},
        f"near/3({a} {b} {c})": {d for d in universe if any(all(any(abs(p - q) <= 3 for q in at(texts[d], o)) for o in (b, c)) for p in at(texts[d], a))},
    }
    for query, docs_ in expected.items():
        assert set(found(stored, query, "coordinate")) == docs_
        if '"' not in query and "near" not in query:
            assert set(found(stored, query)) == docs_ == set(found(stored, query, "matrix"))
    terms = {w for ws in texts.values() for w in ws}
    for pattern in ("a*", "*b", "a*b", "?b*", "*a*", "a?c*", "*a*b*c*", "??", "*é*"):
        want = {t for t in terms if fnmatch.fnmatchcase(t, pattern)}
        assert {r.term for r in stored.expand(pattern).collect()} == want
        assert set(found(stored, pattern, "wildcard")) == {d for d in universe if want & set(texts[d])}
    assert set(found(stored, a, "wildcard")) == {d for d in universe if a in texts[d]}
    assert sorted(r.doc for r in stored.documents_for_term(a).collect()) == sorted(d for d in universe if a in texts[d])
    assert stored.contains_term(a) and not stored.contains_term("nonexistent")
    result = stored.search_with_stats("a*b")
    assert result.strategy == "Permutation Index" and result.error is None
    assert result.found == result.documents.count() and result.seconds > 0
    assert stored.search_with_stats(" ").error == "Empty query"
    plan = stored.postings.where(F.col("term").isin([a, b]))._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(term", plan)


def test_search_with_stats_times_the_search():
    import time

    from quillgrid.plans import wildcard

    class Slow:
        def count(self):
            time.sleep(0.2)
            return 7

    result = wildcard.search_with_stats("a*b", lambda q: Slow())
    assert result.seconds >= 0.2 and result.found == 7


def test_blocks_of_documents_are_the_whole_list(spark):
    rows = [("common", f"doc_{k:04d}") for k in range(250)] + [("rare", "doc_0100")]
    postings = spark.createDataFrame(rows, "term string, doc string")
    got = indexes.block_dictionary(postings, indexes.doc_ids(postings.select("doc")), 100).collect()
    common = sorted((r for r in got if r.term == "common"), key=lambda r: r.block)
    assert [len(r.documents) for r in common] == [100, 100, 50] and {r.frequency for r in common} == {250}
    assert [d for r in common for d in r.documents] == [f"doc_{k:04d}" for k in range(250)]


def test_names_that_begin_alike_are_ranked_in_many_heads(spark):
    """Ids doc_0, doc_1, .. and addresses: no head holds a large part of the names, and ranks are those of the sorted names."""
    for names in ([f"doc_{k}" for k in range(3000)], [f"https://www.example.com/page/{k}/index.html" for k in range(3000)], ["only"], []):
        df = spark.createDataFrame([(n,) for n in names], "doc string")
        assert {r.doc: r.id for r in indexes.doc_ids(df, cells=16).collect()} == {n: k for k, n in enumerate(sorted(names))}
        if len(names) > 1:
            heads = df.groupBy(indexes.ranked_head(indexes.rank_cells(df, 16), indexes.RANK_PREFIX).alias("h")).count()
            assert max(r["count"] for r in heads.collect()) <= len(names) / 8
