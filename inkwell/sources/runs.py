"""Result history: runs and their API, benchmark and quality facts as append-only tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = {
    "api": "run_id bigint, category string, query string, success boolean, recall double, latency_ms double, top_result string",
    "benchmark": "run_id bigint, name string, num_queries int, total_time double, qps double, avg_latency double, p50_latency double, p95_latency double, p99_latency double, success_rate double",
    "quality": "run_id bigint, test_type string, test_name string, success boolean, value double, details string",
}
RUNS = "run_id bigint, run_timestamp bigint, git_commit_hash string, notes string"


class History:
    """A folder with the table of runs and one for each kind of facts. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def create_run(self, notes: str = "", commit: str | None = None, at: int | None = None) -> int:
        run_id = (self.runs().agg(F.max("run_id")).first()[0] or 0) + 1
        self.spark.createDataFrame([(run_id, at or int(time.time()), commit, notes)], RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        return run_id

    def log(self, kind: str, run_id: int, rows: DataFrame) -> None:
        """Append facts; columns that rows lacks are null."""
        there = [f.split() for f in FACTS[kind].split(", ")]
        out = rows.withColumn("run_id", F.lit(run_id).cast("bigint")).select(*[(F.col(c) if c in [*rows.columns, "run_id"] else F.lit(None)).cast(t).alias(c) for c, t in there])
        out.write.mode("append").parquet(f"{self.folder}/{kind}")

    def facts(self, kind: str, run_id: int | None = None) -> DataFrame:
        df = self._read(kind, FACTS[kind])
        return df if run_id is None else df.where(F.col("run_id") == run_id)

    def previous(self, run_id: int) -> int | None:
        """T6."""
        return self.runs().where(F.col("run_id") < run_id).agg(F.max("run_id")).first()[0]

    def details(self, run_id: int, test_type: str, schema: str) -> DataFrame:
        """Facts of one type with their JSON details taken apart."""
        return self.facts("quality", run_id).where(F.col("test_type") == test_type).withColumn("d", F.from_json("details", schema)).select("test_name", "success", "value", "d.*")
