"""Words cut in Arrow batches are those of the column expressions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.engine import Collection
from quillgrid.functions import arrow_words
from quillgrid.functions.arrow_words import ALL_KNOWN, KNOWN, left_out, worded
from quillgrid.functions.tokenizers import TOKENIZERS


def texts() -> list[str | None]:
    """Every known character in and between words, what isn't known, and random mixtures."""
    every = [chr(n) for a, b in KNOWN for n in range(a, b + 1)]
    rng = random.Random(9)
    some = ["İstanbul bir", "ΟΔΟΣ road", "ábcd efg", "naïve 日本語 words", "Ⱥbc def", "", " ", "ab", "_abc abc_ a_b", "x‍yz abc", "\U0001d400bc abc", "\x1cabc\x1fdef ghi", None, "don't—stop “now”"]
    mixed = ["".join(rng.choices([*"abcXYZ жЁé19_-. \n", *rng.sample(every, 12)], k=rng.randrange(60))) for _ in range(400)]
    return [*(f"ab{c}cd {c}{c}{c} x{c} {c}EFG" for c in every), *some, *mixed]


@pytest.mark.parametrize("size", [1, 300, 1 << 22])
@pytest.mark.parametrize("tokenizer", ["plain", "book"])
def test_same_words(spark, monkeypatch, tokenizer, size):
    monkeypatch.setattr(arrow_words, "SLICE_BYTES", size)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc int, text string").repartition(1).sortWithinPartitions("doc")
    want = [r.w or [] for r in df.select(TOKENIZERS[tokenizer](F.col("text")).alias("w")).collect()]
    table = df.select("doc", "text", left_out(F.col("text"), tokenizer).alias("words")).toArrow().combine_chunks()
    for start in (0, 7):
        got = [w for batch in table.slice(start).to_batches() for part in worded(batch, tokenizer) for w in part["words"].to_pylist()]
        assert got == want[start:]
    assert df.where(~F.col("text").rlike(ALL_KNOWN)).count() == 7
    assert list(worded(pa.RecordBatch.from_pylist([], table.schema), tokenizer)) == []


@pytest.mark.parametrize("tokenizer", ["plain", "book"])
def test_f12_f14_f15_f16_sums_cut_no_words_by_expressions(spark, tokenizer):
    """Text of known characters reaches Arrow as it is; bytes that aren't UTF-8 have the words of the expressions too."""
    rows = [(str(i), t.encode()) for i, t in enumerate(texts()) if t is not None] + [("bad", b"abc\xffdef ghi\xc3 \x80jkl mno")]
    docs = spark.createDataFrame(rows, "doc string, b binary").select("doc", F.col("b").cast("string").alias("text"))
    sums = Collection(docs, tokenizer).term_sums
    want = Collection(docs.select("doc", TOKENIZERS[tokenizer](F.col("text")).alias("words")), tokenizer).term_sums
    assert {tuple(r) for r in sums.collect()} == {tuple(r) for r in want.collect()}
    given = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" in given.lower() and "MapInArrow" in given
