"""Structured Streaming version of the metadata row counts.

New Parquet files of the observation table are read as a stream, classified
like the batch table (C1), and counted per metadata group.  The aggregation
state is one row per group, so it is bounded by the number of groups, not by
the number of observations; the query's checkpoint location (in the shared
folder) makes it restart from where it stopped after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from indicata.session import derived_table_dir
from indicata.sources.parquet import classify


def read_obt_stream(spark: SparkSession, path: str, schema: StructType,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of classified observations from Parquet files under ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return classify(reader.parquet(path))


def datamap_stream(spark: SparkSession, path: str, schema: StructType, group_cols,
                   query_name: str, *, sink: str,
                   checkpoint: str | None = None,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start a query that keeps ``count`` per group of ``group_cols`` current.

    Output mode ``complete``: every trigger emits the full (small) count
    table to ``sink``.  The ``memory`` sink, which makes the table queryable
    as ``query_name``, keeps it on the driver: for tests.
    """
    group_cols = list(group_cols)
    counts = (read_obt_stream(spark, path, schema, max_files_per_trigger)
              .groupBy(*group_cols).agg(F.count(F.lit(1)).alias("count")))
    ckpt = checkpoint or derived_table_dir(spark, f"stream-{query_name}")
    return (counts.writeStream.outputMode("complete").format(sink)
                  .queryName(query_name)
                  .option("checkpointLocation", ckpt)
                  .start())
