"""Documents from Parquet tables: column choice by name, loading and inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_NAMES, ID_NAMES, META_NAMES = ("text", "content", "body"), ("id",), ("title", "subject", "category")


def infer_columns(schema: T.StructType) -> tuple[str, str | None, str | None]:
    """(text, id, metadata) column names.

    The last name with text, content or body is the text, else the first name with id the id, else the
    last with title, subject or category the metadata. Without a text name the first string column is
    the text and, where no id was found, the next one the id.
    """
    text = key = meta = None
    for field in schema.fields:
        name = field.name.lower()
        if any(x in name for x in TEXT_NAMES):
            text = field.name
        elif key is None and any(x in name for x in ID_NAMES):
            key = field.name
        elif any(x in name for x in META_NAMES):
            meta = field.name
    if text is None:
        strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
        if not strings:
            raise ValueError("No text column found")
        text = strings[0]
        if key is None and len(strings) > 1:
            key = strings[1]
    return text, key, meta


def read_table(df: DataFrame, text_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """doc, text, metadata; rows with null text are left out.

    Ids that are null, or neither strings nor whole numbers, become doc_{n} with n unique over the table;
    in a stream, which has no row numbers, n is a hash of the text.
    """
    text, key, meta = infer_columns(df.schema) if text_col is None else (text_col, id_col, None)
    if not isinstance(df.schema[text].dataType, T.StringType):
        raise ValueError(f"Column {text} is not a string column")
    key = id_col or key
    number = F.lower(F.hex(F.xxhash64(F.col(f"`{text}`")))) if df.isStreaming else F.monotonically_increasing_id().cast("string")
    made = F.concat(F.lit("doc_"), number)
    usable = key is not None and isinstance(df.schema[key].dataType, (T.StringType, T.IntegralType))
    doc = F.coalesce(F.col(f"`{key}`").cast("string"), made) if usable else made
    note = F.col(f"`{meta}`") if meta and isinstance(df.schema[meta].dataType, T.StringType) else F.lit(None).cast("string")
    return df.where(F.col(f"`{text}`").isNotNull()).select(doc.alias("doc"), F.col(f"`{text}`").alias("text"), note.alias("metadata"))


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out evenly where its files have fewer splits than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_documents(spark: SparkSession, path: str, text_col: str | None = None, id_col: str | None = None) -> DataFrame:
    return read_table(spread(spark.read.parquet(path)), text_col, id_col)


def inspect_schema(df: DataFrame) -> DataFrame:
    """column_no, column_name, column_type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_no int, column_name string, column_type string")


def inspect_rows(df: DataFrame, n: int = 3, width: int = 100) -> DataFrame:
    """The first n rows: string and long columns only, strings over `width` bytes cut with dots."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            shown.append(F.when(F.octet_length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, T.LongType):
            shown.append(c)
    return df.limit(n).select(*shown)
