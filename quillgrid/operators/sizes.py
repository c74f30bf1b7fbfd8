"""Sizes of dictionaries and indexes. Byte sums are of the data; fixed costs per object are parameters."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indexes import beside


@dataclass(frozen=True)
class Costs:
    """Bytes of one string, vector or hash set header, of one machine word, and of a dictionary entry."""

    string: int = 24
    vector: int = 24
    hash_set: int = 48
    word: int = 8
    entry: int = 56
    node: int = 104
    child: int = 16


def _total(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("structure"), "bytes")


def _sum(name: str, *parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy().agg(F.sum("bytes").alias("bytes")).select(F.lit(name).alias("structure"), "bytes")


def documents_bytes(universe: DataFrame) -> DataFrame:
    return _total(universe, "documents", F.octet_length("doc"))


def dictionary_bytes(dictionary: DataFrame, packed: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Packed blob, four words of offsets a term, the terms, and an entry with its documents a term."""
    own = F.octet_length("term") + 4 * costs.word + costs.entry + F.col("df") * (costs.string + 16)
    return _sum("dictionary", _total(dictionary, "d", own), _total(packed, "p", F.octet_length("stored")))


def matrix_bytes(dictionary: DataFrame, universe: DataFrame) -> DataFrame:
    """Dense bits: a row per term, a bit per document, rows rounded up to whole words."""
    row = F.ceil(F.col("n") / 64) * 8
    terms = dictionary.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("names"), F.count("*").alias("t"))
    docs = universe.agg(F.coalesce(F.sum(F.octet_length("doc")), F.lit(0)).alias("docs"), F.count("*").alias("n"))
    return beside(terms, docs).select(F.lit("matrix").alias("structure"), (F.col("names") + F.col("docs") + F.col("t") * row).cast("long").alias("bytes"))


def inverted_size(costs: Costs) -> Column:
    """Of a term in `term_sums`: its name, a set, and the names of its documents."""
    return F.octet_length("term") + costs.hash_set + F.col("doc_bytes")


def coordinate_size(costs: Costs) -> Column:
    """Of a term in `term_sums`: its name and list, and by document a name, a list and the positions."""
    return F.octet_length("term") + costs.vector + F.col("doc_bytes") + F.col("df") * costs.vector + F.col("tf") * costs.word


def inverted_bytes(sums: DataFrame, universe: DataFrame, costs: Costs = Costs()) -> DataFrame:
    return _sum("inverted", _total(sums, "p", inverted_size(costs)), documents_bytes(universe))


def compressed_inverted_bytes(sizes: DataFrame, universe: DataFrame) -> DataFrame:
    """Terms and coded lists, and both directions of the document numbering."""
    names = _total(universe, "d", 2 * F.octet_length("doc") + 4)
    return _sum("compressed_inverted", _total(sizes, "p", F.octet_length("term") + F.col("vb_bytes")), names)


def bigram_bytes(sums: DataFrame, universe: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """From rows with a bigram and doc_bytes; a bigram may have several."""
    per_key = sums.groupBy("bigram").agg(F.sum("doc_bytes").alias("b"))
    return _sum("bigram", _total(per_key, "p", F.octet_length("bigram") + costs.vector + F.col("b")), documents_bytes(universe))


def coordinate_bytes(sums: DataFrame, universe: DataFrame, costs: Costs = Costs()) -> DataFrame:
    return _sum("coordinate", _total(sums, "p", coordinate_size(costs)), documents_bytes(universe))


def key_index_bytes(index: DataFrame, key: str, name: str, costs: Costs = Costs()) -> DataFrame:
    """Rotation and trigram indexes: a key with a set of terms."""
    per_key = index.groupBy(key).agg(F.sum(costs.string + F.octet_length("term")).alias("b"))
    return _total(per_key, name, costs.string + F.octet_length(key) + costs.hash_set + F.col("b"))


def suffix_bytes(suffixes: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A trie node per distinct prefix of a suffix, each holding the terms below it; the root holds none."""
    nodes = suffixes.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("suffix")), lambda i: F.left("suffix", i))).alias("path"), "term").distinct()
    per_node = nodes.groupBy("path").agg(F.sum(costs.string + F.octet_length("term")).alias("b"))
    return _sum("suffix", _total(per_node, "n", costs.node + costs.child + F.col("b")), suffixes.sparkSession.createDataFrame([("root", costs.node)], "structure string, bytes long"))


MOST_KEYS = 1 << 19


def term_keys(term: str) -> dict[str, set[str]]:
    """The keys of a term: trie nodes, trigrams, and turns if another term could have the same, that is with `$` in it."""
    n, padded = len(term), "$$" + term
    return {
        "suffix": {term[i:j] for i in range(n) for j in range(i + 1, n + 1)},
        "trigram": {padded[i : i + 3] for i in range(n)} if len(term.encode()) >= 3 else {padded + "$$"},
        "rotation": {term[i:] + "$" + term[:i] for i in range(n + 1)} if "$" in term else set(),
    }


def key_rows(batches: Iterable[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """kind, key, bytes from batches of terms and their own sums: distinct keys, at most MOST_KEYS held at once, and sums with the key ``."""
    keys, sums = defaultdict(set), Counter()

    def rows() -> pa.RecordBatch:
        flat = [(kind, key, 0) for kind, found in keys.items() for key in found] + [(kind, "", n) for kind, n in sums.items()]
        kinds, names, numbers = zip(*flat, strict=True)
        keys.clear()
        sums.clear()
        return pa.RecordBatch.from_pydict({"kind": pa.array(kinds), "key": pa.array(names), "bytes": pa.array(numbers, pa.int64())})

    for batch in batches:
        table = batch.to_pydict()
        for term in table["term"]:
            held = costs.string + len(term.encode())
            for kind, found in term_keys(term).items():
                keys[kind] |= found
                sums[f"{kind} terms"] += held * len(found)
        for kind in table:
            if kind != "term":
                sums[kind] += sum(table[kind])
        if sum(map(len, keys.values())) >= MOST_KEYS:
            yield rows()
    if keys or sums:
        yield rows()


def vocabulary_sizes(sums: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row: what `term_sums` tell of dictionary, matrix, inverted, coordinate, suffix, rotation and trigram indexes.

    Terms give their sums and keys in Arrow batches, and one pass by key counts the distinct ones. Turns of a
    term without `$` belong to it alone and are summed with it.
    """
    term, size = F.col("term"), F.octet_length("term").cast("long")
    turn = (F.char_length(term) + 1) * (2 * costs.string + costs.hash_set + 2 * size + 1)
    own = {
        "terms": F.lit(1),
        "names": size,
        "dictionary": size + 4 * costs.word + costs.entry + F.col("df") * (costs.string + 16),
        "inverted": inverted_size(costs),
        "coordinate": coordinate_size(costs),
        "turns": F.when(F.contains(term, F.lit("$")), 0).otherwise(turn),
    }
    rows = sums.select("term", *[value.cast("long").alias(name) for name, value in own.items()]).mapInArrow(lambda batches: key_rows(batches, costs), "kind string, key string, bytes long")
    by_key = rows.groupBy("kind", "key").agg(F.sum("bytes").alias("b"))
    by_kind = by_key.groupBy("kind").agg(F.sum("b").alias("b"), F.count("*").alias("n"), F.sum(F.octet_length("key").cast("long")).alias("k"))
    total = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    entries = lambda kind: total(f"{kind} terms", F.col("b")) + total(kind, F.col("n") * (costs.string + costs.hash_set) + F.col("k"))
    return by_kind.groupBy().agg(
        *[total(kind, F.col("b")).alias(kind) for kind in own if kind != "turns"],
        (total("suffix terms", F.col("b")) + total("suffix", F.col("n") * (costs.node + costs.child)) + costs.node).alias("suffix"),
        (total("turns", F.col("b")) + entries("rotation")).alias("rotation"),
        entries("trigram").alias("trigram"),
    )


def report(sums: DataFrame, packed: DataFrame, universe: DataFrame, coded: DataFrame, bigrams: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """structure, bytes of every structure: each input is read once, and one row of sums of each comes together."""
    one = beside(
        vocabulary_sizes(sums, costs),
        packed.agg(F.coalesce(F.sum(F.octet_length("stored")), F.lit(0)).alias("packed")),
        universe.agg(F.coalesce(F.sum(F.octet_length("doc")), F.lit(0)).alias("docs"), F.count("*").alias("n")),
        coded.agg(F.coalesce(F.sum("vb_bytes"), F.lit(0)).alias("coded")),
        bigram_bytes(bigrams, universe.limit(0), costs).select(F.col("bytes").alias("pairs")),
    )
    c = F.col
    found = {
        "dictionary": c("dictionary") + c("packed"),
        "matrix": c("names") + c("docs") + c("terms") * F.ceil(c("n") / 64) * 8,
        "inverted": c("inverted") + c("docs"),
        "compressed_inverted": c("names") + c("coded") + 2 * c("docs") + 4 * c("n"),
        "bigram": c("pairs") + c("docs"),
        "coordinate": c("coordinate") + c("docs"),
        "suffix": c("suffix"),
        "rotation": c("rotation"),
        "trigram": c("trigram"),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("structure"), value.cast("long").alias("bytes")) for name, value in found.items()])
    return with_engine(one.select(F.explode(rows).alias("e")).select("e.structure", "e.bytes"))


def compression_stats(sizes: DataFrame) -> DataFrame:
    """One row: 4 bytes a posting, coded bytes, and their ratio (1.0 for an empty index)."""
    whole = sizes.agg((4 * F.coalesce(F.sum("n_postings"), F.lit(0))).alias("original_bytes"), F.coalesce(F.sum("vb_bytes"), F.lit(0)).alias("compressed_bytes"))
    return whole.withColumn("ratio", F.when(F.col("original_bytes") > 0, F.col("compressed_bytes") / F.col("original_bytes")).otherwise(1.0))


def packing_stats(packed: DataFrame) -> DataFrame:
    """One row: bytes of all terms, bytes of the packed blob, and their ratio (1.0 for an empty dictionary)."""
    whole = packed.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum(F.octet_length("stored")), F.lit(0)).alias("packed_bytes"))
    return whole.withColumn("ratio", F.when(F.col("original_bytes") > 0, F.col("packed_bytes") / F.col("original_bytes")).otherwise(1.0))


ENGINE = ("inverted", "suffix", "rotation", "trigram")


def with_engine(report: DataFrame) -> DataFrame:
    """`report` (structure, bytes) with the row wildcard_engine; each structure is measured once."""
    both = F.when(F.col("structure").isin(*ENGINE), F.array("structure", F.lit("wildcard_engine"))).otherwise(F.array("structure"))
    return report.select(F.explode(both).alias("structure"), "bytes").groupBy("structure").agg(F.sum("bytes").alias("bytes"))


def ratios(report: DataFrame) -> DataFrame:
    """name, ratio: of bytes in a size report."""
    of = lambda name: F.max(F.when(F.col("structure") == name, F.col("bytes")))
    pairs = (("coordinate", "inverted"), ("compressed_inverted", "matrix"), ("inverted", "matrix"))
    one = report.agg(*[(of(a) / of(b)).alias(f"{a}/{b}") for a, b in pairs])
    return one.select(F.explode(F.create_map(*[x for a, b in pairs for x in (F.lit(f"{a}/{b}"), F.col(f"`{a}/{b}`"))])).alias("name", "ratio"))


def ratio(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """One row: name and bytes of a over bytes of b."""
    return beside(a.select(F.col("bytes").alias("a")), b.select(F.col("bytes").alias("b"))).select(F.lit(name).alias("name"), (F.col("a") / F.col("b")).alias("ratio"))
