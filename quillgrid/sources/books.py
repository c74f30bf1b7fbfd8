"""Documents from FB2 e-books (XML)."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenizers import book_words

MIN_BYTES = 150_000


def body_texts(data: bytes) -> list[str] | None:
    """Text runs inside <body> elements. Malformed XML keeps the runs before the error; an unknown entity or text that isn't UTF-8 gives None."""
    runs: list[str] = []
    piece: list[str] = []
    depth, in_cdata = 0, False
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return None

    def flush() -> None:
        if piece:
            runs.append("".join(piece))
            piece.clear()

    def start(name: str, _: dict) -> None:
        nonlocal depth
        flush()
        depth += name == "body"

    def end(name: str) -> None:
        nonlocal depth
        flush()
        depth -= name == "body"

    def text(value: str) -> None:
        if depth > 0 and not in_cdata:
            piece.append(value)

    def cdata(state: bool) -> None:
        nonlocal in_cdata
        flush()
        in_cdata = state

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: cdata(True), lambda: cdata(False)
    parser.CommentHandler = lambda _: flush()
    try:
        parser.Parse(data, True)
    except expat.ExpatError as error:
        if error.code == expat.errors.codes[expat.errors.XML_ERROR_UNDEFINED_ENTITY]:
            return None
    flush()
    return runs


def read_books(spark: SparkSession, path: str, min_bytes: int = MIN_BYTES, full_path: bool = False) -> DataFrame:
    """doc, n_bytes, words of every *.fb2 file of at least `min_bytes` under `path`.

    doc is the file's name, or its whole path with full_path, which keeps equal names in different
    folders apart. Files that can't be decoded are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.fb2").load(path).where(F.col("length") >= min_bytes)
    doc = F.col("path") if full_path else F.element_at(F.split("path", "/"), -1)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(runs=b.pop("content").map(body_texts))

    parsed = files.select(doc.alias("doc"), F.col("length").alias("n_bytes"), "content").mapInPandas(parse, "doc string, n_bytes long, runs array<string>")
    return parsed.where(F.col("runs").isNotNull()).select("doc", "n_bytes", F.flatten(F.transform("runs", book_words)).alias("words"))
