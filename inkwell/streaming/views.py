"""Incremental page-view ingestion: each daily file once, however often the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.wiki import view_lines


def ingest_views(spark: SparkSession, folder: str, out: str, state: str) -> None:
    """Sum the lines of files not seen before and append the sums of each batch to `out`; state is the checkpoint."""
    lines = spark.readStream.text(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again after a failure overwrites its own part
        view_lines(batch).groupBy("lookup_title").agg(F.sum("views").alias("pageviews")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    lines.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def total_views(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("lookup_title").agg(F.sum("pageviews").alias("pageviews"))
