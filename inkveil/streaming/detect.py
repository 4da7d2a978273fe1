"""Detection over streams: stateless, so the batch projection runs as it is on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import DetectOptions, detect


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet document files; the schema is that of the files that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_matches(documents: DataFrame, path: str, checkpoint: str, opts: DetectOptions | None = None, keys: tuple[str, ...] = ("doc_id",)) -> StreamingQuery:
    """Append the matches of each micro-batch to Parquet files, once each; ends when all present files are read."""
    return detect(documents, opts, keys).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
