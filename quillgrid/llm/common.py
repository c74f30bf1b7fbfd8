"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir; a local session without one (tests) gets a temporary folder, on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """`df` as a compressed Parquet table in the shared folder: smaller than a checkpoint, and read by column.

    It goes with the application's folder.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, with its lineage cut.

    Losing an executor later costs a re-read, not a recomputation.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z lower-cased and every other character as it was."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_text(df: DataFrame, text: str, fields: str, compute: Callable[[list], Iterator[tuple]], as_bytes: bool = True, keep_text: bool = True) -> DataFrame:
    """`df` with new columns (`fields`, DDL) that compute() makes of its texts, a row's values at a time.

    Texts come as bytes or strings, null ones as None. The other columns pass through in Arrow batches as
    they are, whatever their types and nulls; columns with the names of new ones are replaced. Without
    keep_text the texts themselves don't come back.
    """
    new = T._parse_datatype_string(fields)
    kept = [c for c in df.columns if c not in new.names or c == text]
    given = df.select(*[F.col(f"`{c}`") for c in kept])
    at, kinds = kept.index(text), [to_arrow_type(f.dataType) for f in new.fields]
    through = [i for i, c in enumerate(kept) if c not in new.names and (keep_text or c != text)]
    names = [*(kept[i] for i in through), *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            if as_bytes:
                texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            rows = list(compute(texts.to_pylist()))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in through), *made], names)

    schema = T.StructType([*(given.schema.fields[i] for i in through), *new.fields])
    return given.mapInArrow(run, schema)


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of `df` in one, _all, so that no name of theirs can clash, and more columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), *more)


def byte_length(text: Column) -> Column:
    """UTF-8 bytes of `text`; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
