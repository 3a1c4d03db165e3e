"""Pages that keep arriving, as an extension: the batch operators over a stream.

State is bounded by the watermark: an extraction of a page that comes again within it is dropped,
a later one passes and is settled in batch (operators.chunking.latest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip
from ..operators.chunking import LEAST, chunk_text


def read_pages(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files of pages as a stream, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def chunk_stream(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Chunks of the pages of a stream; of a page extracted again within `late` the first."""
    once = pages.withWatermark("extracted_at", late).dropDuplicatesWithinWatermark(["document", "page_number"])
    pieces = F.filter(chunk_text(strip(F.col("text"))), lambda p: F.length(strip(p)) >= LEAST)
    return once.select("document", "page_number", "extracted_at", F.posexplode(pieces).alias("piece", "text"))


def arrivals(pages: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Pages and distinct documents (approximately) in each window of time."""
    return pages.withWatermark("extracted_at", late).groupBy(F.window("extracted_at", window)).agg(F.count("*").alias("pages"), F.approx_count_distinct("document").alias("documents"))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the chunks to Parquet until the source has no more."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
