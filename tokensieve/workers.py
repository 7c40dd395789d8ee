"""What Python workers are told when they start."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Workers give memory back that they free: arrays beyond 1 MB are mapped one by one, and Arrow's lie there too.
MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 24)}


def frugal(spark: SparkSession) -> None:
    """MEMORY for the workers of functions that are made from now on, unless they are told otherwise."""
    for name, value in MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
