"""Pages that arrive over time: occurrences are appended batch by batch.

Document frequencies are counted when read, so appending needs no rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from findwell.operators.indexing import occurrences, page_tokens
from findwell.sources.pages import PAGE_SCHEMA


def read_page_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(f"{path}/*/*")


def append_occurrences(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write (doc_id, pos, tag, token) of arriving pages, doc_id being the url; a batch is written once by its number."""

    def write(batch: DataFrame, number: int) -> None:
        occurrences(page_tokens(batch, doc_id="url", html="content")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
