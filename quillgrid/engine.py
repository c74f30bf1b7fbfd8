"""A collection with its indexes, lazily built or loaded, and one search function over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.patterns import has_wildcard
from .functions.tokenizers import Tokenizer
from .operators import frontpack, indexes, sizes
from .plans import compile as plans
from .plans import wildcard
from .plans.query import LEGACY, STANDARD, QueryError, parse
from .sources import store

INDEXES = ("inverted", "matrix", "bigram", "coordinate", "wildcard")


class Collection:
    """Indexes over documents (doc, text) or (doc, words).

    Each index is a DataFrame; nothing is computed before a result is asked for. `open` gives the same
    object over the Parquet folders that `save` wrote; `save` tokenizes once and makes every index from the
    words it has written.
    """

    def __init__(self, docs: DataFrame | None, tokenizer: str | Tokenizer = "plain", stored: str | None = None, spark: SparkSession | None = None):
        self.docs, self.tokenizer, self.stored = docs, tokenizer, stored
        self.spark = spark or docs.sparkSession

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        return cls(None, stored=path, spark=spark)

    def _index(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return store.load_index(self.spark, self.stored, name) if self.stored else build()

    @cached_property
    def tokens(self) -> DataFrame:
        if self.stored:
            return self.coordinates.select("term", "doc", F.explode("positions").alias("pos"))
        return indexes.tokens(self.docs, self.tokenizer)

    @cached_property
    def single(self) -> bool:
        """Whether no doc stands in two rows (one pass over the names); then nothing has to be made distinct by shuffles."""
        return indexes.distinct_docs(self.docs)

    @cached_property
    def numbers(self) -> indexes.Numbering:
        return indexes.numbering(self.docs, self.tokenizer)

    def numbered(self, block: int | None = None) -> DataFrame:
        return indexes.numbered(self.docs, self.numbers, self.tokenizer, block)

    @cached_property
    def term_sums(self) -> DataFrame:
        """term, tf, df, doc_bytes: what the dictionary and the sizes of indexes by term are made from."""
        if self.stored:
            return indexes.posting_sums(self.coordinates)
        if self.single:
            return indexes.term_sums(self.docs, self.tokenizer)
        return indexes.posting_sums(self.tokens.groupBy("term", "doc").agg(F.count("*").alias("n")))

    @property
    def bigram_sums(self) -> DataFrame:
        """bigram, doc_bytes: parts of what the size of the two-word index is made from."""
        if not self.stored and self.single:
            return indexes.bigram_sums(self.docs, self.tokenizer)
        return self.bigrams.select("bigram", F.octet_length("doc").cast("long").alias("doc_bytes"))

    @cached_property
    def dictionary(self) -> DataFrame:
        return self._index("dictionary", lambda: self.term_sums.select("term", "tf", "df"))

    @cached_property
    def stats(self) -> DataFrame:
        return self._index("stats", lambda: indexes.collection_stats(self.docs, self.tokenizer))

    @cached_property
    def postings(self) -> DataFrame:
        return self._index("postings", lambda: indexes.document_postings(self.docs, self.tokenizer) if self.single else indexes.postings(self.tokens))

    @cached_property
    def universe(self) -> DataFrame:
        return self._index("universe", lambda: indexes.universe(indexes.with_words(self.docs, self.tokenizer)))

    @cached_property
    def doc_ids(self) -> DataFrame:
        return self._index("doc_ids", lambda: indexes.doc_ids(self.universe))

    @cached_property
    def matrix(self) -> DataFrame:
        return self._index("matrix", lambda: indexes.numbered_matrix(self.numbered(indexes.MATRIX_BLOCK)))

    @cached_property
    def bigrams(self) -> DataFrame:
        return self._index("bigrams", lambda: indexes.bigrams(self.docs, self.tokenizer, self.single))

    @cached_property
    def coordinates(self) -> DataFrame:
        return self._index("coordinates", lambda: indexes.document_coordinates(self.docs, self.tokenizer) if self.single else indexes.coordinates(self.tokens))

    @cached_property
    def compressed(self) -> DataFrame:
        return self._index("compressed", lambda: self.compressed_lists())

    def compressed_lists(self, block: int | None = indexes.POSTING_BLOCK) -> DataFrame:
        """term, block, n_postings, data, coded in blocks of so many ids, or each list whole."""
        return indexes.run_postings(indexes.posting_runs(self.numbered(), block), block)

    @property
    def compressed_sizes(self) -> DataFrame:
        if self.stored:
            return indexes.compressed_sizes(indexes.posting_deltas(indexes.posting_ids(self.postings, self.doc_ids)))
        return indexes.run_sizes(indexes.posting_runs(self.numbered()))

    def block_dictionary(self, block: int = indexes.POSTING_BLOCK) -> DataFrame:
        if self.stored:
            return indexes.block_dictionary(self.postings, self.doc_ids, block)
        return indexes.numbered_block_dictionary(self.numbered(block), block)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.dictionary.select("term")

    @cached_property
    def suffixes(self) -> DataFrame:
        return self._index("suffixes", lambda: indexes.suffixes(self.vocabulary))

    @cached_property
    def rotations(self) -> DataFrame:
        return self._index("rotations", lambda: indexes.rotations(self.vocabulary))

    @cached_property
    def trigrams(self) -> DataFrame:
        return self._index("trigrams", lambda: indexes.trigrams(self.vocabulary))

    @cached_property
    def packed(self) -> DataFrame:
        return frontpack.front_pack(self.vocabulary)

    @cached_property
    def packed_parts(self) -> DataFrame:
        """For sums over the packed blob: offsets count from each first character."""
        return frontpack.packed_parts(self.vocabulary)

    def contains_term(self, term: str) -> bool:
        return bool(self.dictionary.where(F.col("term") == term).head(1))

    def term_entry(self, term: str) -> DataFrame:
        return self.dictionary.where(F.col("term") == term)

    def documents_for_term(self, term: str) -> DataFrame:
        """doc: decoded from the compressed lists."""
        coded = self.compressed.where(F.col("term") == term)
        return indexes.decompressed_postings(coded).join(self.doc_ids, "id").select("doc")

    def save(self, path: str, names: tuple[str, ...] | None = None) -> None:
        """Write indexes under `path`; all by default. Words are written first, and dependent indexes read back the files already written."""
        order = ("coordinates", "stats", "postings", "universe", "dictionary", "doc_ids", "matrix", "bigrams", "compressed", "suffixes", "rotations", "trigrams")
        words = self.docs if "words" in self.docs.columns else indexes.written_words(self.docs, self.tokenizer)
        store.save_index(words, path, "words")
        written = Collection(store.load_index(self.spark, path, "words"), self.tokenizer, spark=self.spark)
        for name in order:
            if names is None or name in names:
                store.save_index(getattr(written, name), path, name)
                written.__dict__[name] = store.load_index(self.spark, path, name)
                if name == "coordinates":
                    written.__dict__["tokens"] = written.coordinates.select("term", "doc", F.explode("positions").alias("pos"))

    def search(self, query: str, index: str = "inverted", mode: str = STANDARD, strict: bool | None = None) -> DataFrame:
        """doc: documents that match.

        index `wildcard` takes the whole query as one pattern if it has a wildcard. strict (the default in
        legacy mode) makes a looked-up word that isn't indexed an error.
        """
        strict = mode == LEGACY if strict is None else strict
        if index == "wildcard":
            if not query.strip():
                raise QueryError("Empty query")
            if has_wildcard(query):
                if self.stored:
                    return wildcard.documents_of(self.expand(query, mode), self.postings)
                return indexes.with_any_word(self.docs, lambda w: wildcard.matches(w, query, mode), self.tokenizer).select("doc").distinct()
            index = "inverted"
        if index not in INDEXES:
            raise QueryError(f"Unknown index {index}")
        node = parse(query, index, mode)
        if strict and index != "bigram":
            plans.require_terms(node, self.postings)
        if index == "inverted":
            return plans.search_inverted(node, self.postings, self.universe)
        if index == "matrix":
            return plans.search_matrix(node, self.matrix, self.doc_ids, self.universe)
        if index == "bigram":
            return plans.search_bigram(node, self.bigrams, self.universe)
        return plans.search_coordinate(node, self.coordinates if self.stored else self.tokens, self.universe, mode)

    def expand(self, pattern: str, mode: str = STANDARD) -> DataFrame:
        """term: vocabulary terms for a pattern; stored vocabulary indexes are used where there are any."""
        have = {"rotations": self.rotations, "trigrams": self.trigrams, "suffixes": self.suffixes} if self.stored else {}
        return wildcard.expand(pattern, self.vocabulary, mode=mode, **have)

    def search_with_stats(self, query: str, mode: str = STANDARD) -> wildcard.WildcardResult:
        return wildcard.search_with_stats(query, lambda q: self.search(q, "wildcard", mode))

    def size_report(self) -> DataFrame:
        """structure, bytes of every structure; wildcard_engine is the sum of the four that wildcard search holds."""
        return sizes.report(self.term_sums, self.packed_parts, self.universe, self.compressed_sizes, self.bigram_sums)

    def ratios(self) -> DataFrame:
        """name, ratio: coordinate over inverted, and compressed inverted over matrix."""
        return sizes.ratios(self.size_report())
