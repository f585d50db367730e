"""Timing of any call: sequential, concurrent and warm-up runs as a table of latencies."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, i int, latency_ms double, success boolean"


def measure(spark: SparkSession, name: str, call: Callable[[int], object], n: int, workers: int = 1, rate: float | None = None) -> DataFrame:
    """name, i, latency_ms, success of n calls by some workers, started at a rate a second if one is given.

    A call that raises is a failure with its latency; a call gets its number.
    """
    began = time.perf_counter()

    def one(i: int) -> tuple[str, int, float, bool]:
        if rate:
            time.sleep(max(0.0, began + i / rate - time.perf_counter()))
        start = time.perf_counter()
        try:
            call(i)
            ok = True
        except Exception:
            ok = False
        return name, i, (time.perf_counter() - start) * 1000, ok

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return spark.createDataFrame(list(pool.map(one, range(n))), SCHEMA)
