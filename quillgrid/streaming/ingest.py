"""Growing index: documents that arrive in a folder are added to stored tokens, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokenizers import Tokenizer
from ..operators.indexes import coordinates
from ..operators.indexes import tokens as explode_tokens
from ..sources.tables import read_table


def stream_documents(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """doc, text of Parquet files as they arrive in `folder`."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return read_table(raw).select("doc", "text")


def ingest(docs: DataFrame, path: str, checkpoint: str, tokenizer: str | Tokenizer = "plain", once: bool = True) -> StreamingQuery:
    """Append each batch's positional index under path/batch=<id>.

    A batch that is run again after a failure overwrites its own folder only, so its documents count once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        coordinates(explode_tokens(batch, tokenizer)).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def grown_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """The positional index over all batches so far."""
    return spark.read.parquet(path).select("term", "doc", "positions")


def grown_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """term, tf, df over all batches; a document that arrived in parts counts once in df."""
    per_doc = grown_coordinates(spark, path).groupBy("term", "doc").agg(F.sum(F.size("positions")).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
