"""Quantization of vectors that arrive as a stream: stateless, a row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.quantize import GROUP_SIZE, quantize


def quantized_stream(spark: SparkSession, source: str, schema: str, values: str, k: int = GROUP_SIZE) -> DataFrame:
    """A streaming DataFrame over a folder of Parquet files, the array column quantized."""
    return spark.readStream.schema(schema).parquet(source).withColumn(values, quantize(F.col(values), k))


def run_to_parquet(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there and stop; called again, goes on after what was written."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
