"""Index builders: each index is a DataFrame derived from documents (doc, text) or from tokens (doc, pos, term)."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow_words import left_out, name_of
from ..functions.codecs import decoded_deltas, vb_hex, vb_size
from ..functions.tokenizers import Tokenizer, has_words, resolve
from . import inversion

MATRIX_BLOCK = 32
POSTING_BLOCK = 1 << 16
RANK_PREFIX = 3
RANK_CELLS, RANK_SAMPLE = 256, 8192
LEAST_SPAN, LARGEST_SPAN = 1 << 10, 1 << 14


def beside(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return together.groupBy().agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns])


def word_arrays(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """doc, words. Documents that already have `words` keep them."""
    if "words" in docs.columns:
        return docs.select("doc", "words")
    return docs.select("doc", resolve(tokenizer)(F.col("text")).alias("words"))


def chunk_words(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> tuple[DataFrame, str | None]:
    """What `by_chunk` takes: docs whose texts are cut in its Arrow batches and the tokenizer's name, or docs with `words` and None."""
    name = name_of(tokenizer)
    if "words" in docs.columns or name is None:
        return word_arrays(docs, tokenizer), None
    return docs.select("doc", "text", left_out(F.col("text"), name).alias("words")), name


def tokens(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """doc, pos (0-based), term."""
    return word_arrays(docs, tokenizer).select("doc", F.posexplode("words").alias("pos", "term"))


def dictionary(tokens: DataFrame) -> DataFrame:
    """term, tf, df. Occurrences are first counted per document, so a frequent term's documents are spread."""
    per_doc = tokens.groupBy("term", "doc").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def collection_stats(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """One row: total_documents, collection_bytes, total_words, total_terms."""
    size = F.col("n_bytes") if "n_bytes" in docs.columns else F.octet_length("text")
    both = docs.select(size.alias("bytes"), (F.col("words") if "words" in docs.columns else resolve(tokenizer)(F.col("text"))).alias("words"))
    whole = both.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("collection_bytes"), F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0)).alias("total_words"))
    terms = both.select(F.explode("words").alias("term")).distinct().agg(F.count("*").alias("total_terms"))
    return beside(whole, terms)


def top_terms(terms: DataFrame, k: int = 1000) -> DataFrame:
    """The k most frequent terms; ties by term."""
    return terms.orderBy(F.desc("tf"), "term").limit(k)


def terms_by_frequency(terms: DataFrame) -> DataFrame:
    return terms.select("term", "tf").orderBy(F.desc("tf"), "term")


def sorted_terms(terms: DataFrame) -> DataFrame:
    return terms.select("term").orderBy("term")


def postings(tokens: DataFrame) -> DataFrame:
    """Inverted index: distinct (term, doc)."""
    return tokens.select("term", "doc").distinct()


def universe(tokens: DataFrame) -> DataFrame:
    """Documents with at least one term."""
    return tokens.select("doc").distinct()


def rank_cells(named: DataFrame, cells: int = RANK_CELLS, sample: int = RANK_SAMPLE) -> list[str]:
    """Docs, ascending, that cut the table into about equal cells: quantiles of the `sample` docs with the least hashes."""
    some = sorted((r["doc"] for r in named.orderBy(F.xxhash64("doc"), "doc").limit(sample).collect() if r["doc"] is not None), key=str.encode)
    return sorted({some[k * len(some) // cells] for k in range(1, cells)}, key=str.encode) if some else []


def ranked_head(cuts: list[str], prefix: int, first: int = 0) -> Column:
    """cell and head of a doc: its cell by comparisons, and `prefix` characters more than all docs of the cell share."""
    if not cuts:
        return F.struct(F.lit(first).alias("cell"), F.substring("doc", 1, prefix).alias("head"))

    def part(low: int, high: int) -> Column:
        if low == high:
            shared = len(os.path.commonprefix([cuts[low - 1], cuts[low]])) if 0 < low < len(cuts) else 0
            return F.struct(F.lit(first + low).alias("cell"), F.substring("doc", 1, shared + prefix).alias("head"))
        middle = (low + high) // 2
        return F.when(F.col("doc") < cuts[middle], part(low, middle)).otherwise(part(middle + 1, high))

    return part(0, len(cuts))


def doc_ids(docs: DataFrame, prefix: int = RANK_PREFIX, cells: int = RANK_CELLS) -> DataFrame:
    """doc, id: the rank of each distinct doc in byte order, from 0.

    Docs are cut into cells by quantiles of a bounded sample, and a cell into heads, by the characters that
    follow what all its docs begin with; so names that all begin alike (`doc_0`, URLs) are spread too. Ranks
    are taken inside each head and shifted by the counts of those before: no task sorts all documents,
    only the table of heads goes through one.
    """
    named = docs.select("doc").distinct()
    named = named.withColumn("_head", ranked_head(rank_cells(named, cells), prefix))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    starts = named.groupBy("_head").count().select("_head", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    ranked = named.withColumn("_n", F.row_number().over(Window.partitionBy("_head").orderBy("doc")) - 1)
    return ranked.join(starts, "_head").select("doc", (F.col("_start") + F.col("_n")).cast("long").alias("id"))


def posting_ids(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """term, id."""
    return postings.join(ids, "doc").select("term", "id")


def incidence_matrix(posting_ids: DataFrame, block: int = MATRIX_BLOCK) -> DataFrame:
    """term, block, bits: documents block*32 .. block*32+31 as bits of a long. Blocks without a bit have no row."""
    bit = F.expr(f"shiftleft(1L, cast(id % {block} as int))")
    return posting_ids.withColumn("_bit", bit).groupBy("term", F.floor(F.col("id") / block).alias("block")).agg(F.bit_or("_bit").alias("bits"))


def bigrams(docs: DataFrame, tokenizer: str | Tokenizer = "plain", single: bool = False) -> DataFrame:
    """Two-word index: distinct (bigram, doc). If no doc stands in two rows (`single`), nothing is shuffled."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)))
    found = word_arrays(docs, tokenizer).where(F.size("words") >= 2).select(F.explode(F.array_distinct(pairs)).alias("bigram"), "doc")
    return found if single else found.distinct()


def coordinates(tokens: DataFrame) -> DataFrame:
    """Positional index: term, doc, positions ascending."""
    return tokens.groupBy("term", "doc").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def suffixes(terms: DataFrame) -> DataFrame:
    """suffix, term: every non-empty suffix of every term."""
    each = F.transform(F.sequence(F.lit(1), F.char_length("term")), lambda i: F.substr("term", i))
    return terms.where(F.char_length("term") > 0).select(F.explode(F.array_distinct(each)).alias("suffix"), "term")


def rotation_keys(term: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.char_length(term)), lambda i: F.concat(F.substr(term, i + 1), F.lit("$"), F.left(term, i))))


def rotations(terms: DataFrame) -> DataFrame:
    """rotation, term: every rotation of term + `$`."""
    return terms.select(F.explode(rotation_keys(F.col("term"))).alias("rotation"), "term")


def trigram_keys(term: Column) -> Column:
    padded = F.concat(F.lit("$$"), term)
    windows = F.transform(F.sequence(F.lit(1), F.char_length(term)), lambda i: F.substr(padded, i, F.lit(3)))
    return F.array_distinct(F.when(F.octet_length(term) < 3, F.array(F.concat(padded, F.lit("$$")))).otherwise(windows))


def trigrams(terms: DataFrame) -> DataFrame:
    """trigram, term: three-character windows of `$$` + term; a term under three bytes has the one key `$$term$$`."""
    return terms.select(F.explode(trigram_keys(F.col("term"))).alias("trigram"), "term")


def posting_deltas(posting_ids: DataFrame, block: int = POSTING_BLOCK) -> DataFrame:
    """term, block, id, delta: the difference from the id before in the term's list (the first: from 0).

    Lists are cut into blocks of ids, each with the last id of the block before it, so that one frequent
    term's list is worked on by many tasks.
    """
    rows = posting_ids.withColumn("block", F.floor(F.col("id") / block))
    lasts = rows.groupBy("term", "block").agg(F.max("id").alias("_last"))
    lasts = lasts.select("term", "block", F.coalesce(F.lag("_last").over(Window.partitionBy("term").orderBy("block")), F.lit(0)).alias("_before"))
    inside = F.lag("id").over(Window.partitionBy("term", "block").orderBy("id"))
    return rows.withColumn("_prev", inside).join(lasts, ["term", "block"]).select("term", "block", "id", (F.col("id") - F.coalesce("_prev", "_before")).alias("delta"))


def compressed_sizes(deltas: DataFrame) -> DataFrame:
    """term, n_postings, vb_bytes."""
    return deltas.groupBy("term").agg(F.count("*").alias("n_postings"), F.sum(vb_size(F.col("delta"))).alias("vb_bytes"))


def compressed_postings(deltas: DataFrame) -> DataFrame:
    """term, block, n_postings, data: coded differences. The blocks of a term, joined in order, are its whole coded list."""
    listed = F.array_sort(F.collect_list(F.struct("id", "delta")))
    coded = F.unhex(F.array_join(F.transform(listed, lambda x: vb_hex(x["delta"])), ""))
    return deltas.groupBy("term", "block").agg(F.count("*").alias("n_postings"), coded.alias("data"))


def decompressed_postings(compressed: DataFrame) -> DataFrame:
    """term, id: the lists back from their coded blocks. A block starts from the sum of the differences before it."""
    blocks = compressed.select("term", "block", decoded_deltas(F.col("data")).alias("d"))
    earlier = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.element_at("d", -1)).over(earlier), F.lit(0))
    return blocks.select("term", "d", before.alias("before")).select("term", "before", F.explode("d").alias("n")).select("term", (F.col("before") + F.col("n")).alias("id"))


def block_dictionary(postings: DataFrame, ids: DataFrame, block: int = POSTING_BLOCK) -> DataFrame:
    """The large-collection build's dictionary: term, block, frequency (= number of documents of the term), documents sorted.

    A frequent term's documents are cut into blocks of document numbers; in order they are its whole list.
    """
    cut = postings.join(ids, "doc").withColumn("block", F.floor(F.col("id") / block))
    blocks = cut.groupBy("term", "block").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("doc")).alias("documents"))
    return blocks.select("term", "block", F.sum("_n").over(Window.partitionBy("term")).alias("frequency"), "documents")


def written_words(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """doc, words, n_bytes: what all other indexes can be made from without tokenizing again."""
    return docs.select("doc", resolve(tokenizer)(F.col("text")).alias("words"), F.octet_length("text").alias("n_bytes"))


def with_words(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """The documents that have a word; told by their first letters where those suffice."""
    return docs.where(F.size("words") > 0 if "words" in docs.columns else has_words(F.col("text"), tokenizer))


def with_any_word(docs: DataFrame, matches: Callable[[Column], Column], tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """doc, words of the documents that have a word for which `matches` holds."""
    return word_arrays(docs, tokenizer).where(F.exists("words", matches))


def distinct_docs(docs: DataFrame) -> bool:
    """Whether no doc stands in two rows; then what is distinct in a row is distinct in the table."""
    return not docs.groupBy("doc").count().where("count > 1").head(1)


def document_postings(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """`postings` where no doc stands in two rows: nothing is shuffled."""
    return word_arrays(docs, tokenizer).select(F.explode(F.array_distinct("words")).alias("term"), "doc")


def document_coordinates(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """`coordinates` where no doc stands in two rows: a document's words are sorted and cut where they change."""
    sorted_words = word_arrays(docs, tokenizer).select("doc", F.sort_array(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("p")))).alias("s"))
    begins = F.array_compact(F.transform("s", lambda x, i: F.when((i == 0) | (x["w"] != F.get("s", i - 1)["w"]), i)))
    cut = sorted_words.select("doc", "s", begins.alias("b"))
    end = lambda k: F.coalesce(F.get("b", k + 1), F.size("s"))
    each = F.transform("b", lambda i, k: F.struct(F.get("s", i)["w"].alias("term"), F.slice("s", i + 1, end(k) - i)["p"].alias("positions")))
    return cut.select("doc", F.explode(each).alias("e")).select("e.term", "doc", "e.positions")


def term_sums(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """term, tf, df, doc_bytes (of the names of its documents), where no doc stands in two rows: sums by term only."""
    rows, name = chunk_words(docs, tokenizer)
    parts = inversion.by_chunk(rows, "term string, tf long, df long, doc_bytes long", inversion.sums, tokenizer=name)
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("tf", "df", "doc_bytes")])


def bigram_sums(docs: DataFrame, tokenizer: str | Tokenizer = "plain") -> DataFrame:
    """bigram, doc_bytes (of the names of its documents) in parts by chunk, where no doc stands in two rows."""
    rows, name = chunk_words(docs, tokenizer)
    return inversion.by_chunk(rows, "bigram string, doc_bytes long", inversion.pair_sums, tokenizer=name)


def posting_sums(counts: DataFrame) -> DataFrame:
    """`term_sums` from rows by (term, doc): with n, or the positional index itself."""
    n = F.size("positions").cast("long") if "positions" in counts.columns else F.col("n")
    return counts.groupBy("term").agg(F.sum(n).alias("tf"), F.count("*").alias("df"), F.sum(F.octet_length("doc").cast("long")).alias("doc_bytes"))


@dataclass(frozen=True)
class Numbering:
    """Cells of docs by `cuts`, the number that each cell starts from, and the number of docs."""

    cuts: tuple[str, ...]
    starts: tuple[int, ...]
    count: int


def numbering(docs: DataFrame, tokenizer: str | Tokenizer = "plain", cells: int = RANK_CELLS) -> Numbering:
    """Counts the docs with a word by cell: at most `cells` rows come to the driver."""
    cuts = rank_cells(docs.select("doc").distinct(), cells)
    named = with_words(docs, tokenizer).select(ranked_head(cuts, 1)["cell"].alias("cell"), "doc").distinct()
    found = {r["cell"]: r["count"] for r in named.groupBy("cell").count().collect()}
    sizes = [found.get(c, 0) for c in range(len(cuts) + 1)]
    return Numbering(tuple(cuts), tuple(sum(sizes[:c]) for c in range(len(sizes))), sum(sizes))


def span_size(count: int, block: int, cores: int) -> int:
    """Ids in a span: a few spans a core, within bounds, and no block of ids in two spans unless it is cut into whole spans."""
    want = 1 << max(0, math.ceil(math.log2(max(1, count / (4 * cores)))))
    want = min(max(want, LEAST_SPAN), LARGEST_SPAN)
    return block * (want // block) if block <= want else math.gcd(block, want)


def numbered(docs: DataFrame, numbers: Numbering, tokenizer: str | Tokenizer = "plain", block: int | None = None) -> DataFrame:
    """id, doc, words of the documents that have any, in order of ids inside a task.

    Ids are those of `doc_ids`. Only texts are shuffled: to their cells, and then, where blocks of ids
    have to be whole in a task, to spans of blocks.
    """
    content = "words" if "words" in docs.columns else "text"
    named = with_words(docs, tokenizer).select("doc", content, ranked_head(list(numbers.cuts), 1)["cell"].alias("_cell"))
    start = F.get(F.array(*[F.lit(n).cast("long") for n in numbers.starts]), F.col("_cell"))
    rank = F.dense_rank().over(Window.partitionBy("_cell").orderBy("doc")) - 1
    ranked = named.select("doc", content, (start + rank).alias("id"))
    if block:
        span = span_size(numbers.count, block, docs.sparkSession.sparkContext.defaultParallelism)
        ranked = ranked.repartition(F.floor(F.col("id") / span)).sortWithinPartitions("id")
    words = F.col("words") if content == "words" else resolve(tokenizer)(F.col("text"))
    return ranked.select("id", "doc", words.alias("words"))


def numbered_matrix(rows: DataFrame, block: int = MATRIX_BLOCK) -> DataFrame:
    """`incidence_matrix` from `numbered` rows of the same block size."""
    return inversion.by_chunk(rows, "term string, block long, bits long", partial(inversion.matrix, block=block), block)


def posting_runs(rows: DataFrame, block: int | None = POSTING_BLOCK) -> DataFrame:
    """term, first, last, n, inside: parts of a term's list from `numbered` rows, with the coded differences after the first id."""
    return inversion.by_chunk(rows.select("id", "words"), "term string, first long, last long, n long, inside binary", partial(inversion.runs, block=block), 1)


def after_runs(runs: DataFrame) -> DataFrame:
    """Runs with delta: the first id less the last of the run before in the term's list (the first: from 0)."""
    ordered = Window.partitionBy("term").orderBy("first")
    return runs.withColumn("_before", F.lag("last").over(ordered)).withColumn("delta", F.col("first") - F.coalesce("_before", F.lit(0))).drop("_before")


def run_sizes(runs: DataFrame) -> DataFrame:
    """`compressed_sizes` from `posting_runs`."""
    whole = after_runs(runs.select("term", "first", "last", "n", F.octet_length("inside").alias("inside")))
    return whole.groupBy("term").agg(F.sum("n").alias("n_postings"), F.sum(F.col("inside") + vb_size(F.col("delta"))).alias("vb_bytes"))


def run_postings(runs: DataFrame, block: int | None = POSTING_BLOCK) -> DataFrame:
    """`compressed_postings` from `posting_runs` of the same block size; without one a term's whole list is its block 0.

    Only coded runs are shuffled; their first differences are coded after that.
    """
    number = F.floor(F.col("first") / block) if block else F.lit(0).cast("long")
    coded = after_runs(runs).select("term", number.alias("block"), "n", F.struct("first", "delta", "inside").alias("run"))
    listed = F.array_sort(F.collect_list("run"))
    data = F.unhex(F.array_join(F.transform(listed, lambda x: F.concat(vb_hex(x["delta"]), F.hex(x["inside"]))), ""))
    return coded.groupBy("term", "block").agg(F.sum("n").alias("n_postings"), data.alias("data"))


def numbered_block_dictionary(rows: DataFrame, block: int = POSTING_BLOCK) -> DataFrame:
    """`block_dictionary` from `numbered` rows of the same block size: only its rows are shuffled, once."""
    blocks = inversion.by_chunk(rows, "term string, block long, documents array<string>", partial(inversion.lists, block=block), block)
    return blocks.select("term", "block", F.sum(F.size("documents").cast("long")).over(Window.partitionBy("term")).alias("frequency"), "documents")
