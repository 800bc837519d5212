"""Segments that arrive as files of a folder, translated batch by batch. An extension: nothing like it is required elsewhere.

Each trigger takes new parquet files, runs the batch pipeline on them and appends the result; a restart goes on
from the checkpoint. There is no event time, hence no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomtext.plans.translate import Book, translate

SEGMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())])


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, book: Book, memory: DataFrame,
          files_per_batch: int = 100) -> StreamingQuery:
    """Translates the segments of all files in folder, present and to come, once; stops when none is left."""

    def step(batch: DataFrame, epoch: int) -> None:
        done = translate(batch, book, memory)
        done.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # the same epoch again writes the same folder

    return (
        spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        .writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
