"""Append newly landed capture files to the captures table, each file once.

The data model has no windows or keyed state: a run reads a snapshot. The only
thing a stream is for is picking up files that arrived since the last run.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schema import CAPTURE
from ..sources.captures import with_platform


def ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, registry: DataFrame) -> StreamingQuery:
    """Process what is there now and stop; the table is partitioned by run and platform. ``checkpoint`` must be on shared storage."""
    landed = with_platform(spark.readStream.schema(CAPTURE).parquet(landing), registry)
    return (landed.writeStream.format("parquet").option("path", table)
            .option("checkpointLocation", checkpoint).partitionBy("run_id", "adapter").trigger(availableNow=True).start())
