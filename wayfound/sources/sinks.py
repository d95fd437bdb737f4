"""Sinks: stage tables, core and detail shards."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def stage_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder; only a local test session without one uses a temporary folder."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before writing stage tables")
        base = tempfile.mkdtemp(prefix="wayfound-stage-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage table and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def split_core_detail(df: DataFrame, *, id: str, shard: str, core, detail) -> tuple[DataFrame, DataFrame]:
    """Core columns, and detail columns of rows that have any."""
    some = F.coalesce(*[F.col(c).isNotNull() & F.lit(True) for c in detail]) if len(detail) == 1 else F.greatest(*[F.col(c).isNotNull() for c in detail])
    return df.select(id, shard, *core), df.filter(some).select(id, shard, *detail)


def write_shards(df: DataFrame, path: str, shard: str, *, sort=(), buckets: int = 0, key: str | None = None) -> None:
    """Shards as partition folders. Shards present in the data are replaced, others stay. ``buckets`` splits big shards over several tasks by
    the hash of ``key``."""
    spread = [shard] if not buckets else [F.col(shard), F.pmod(F.xxhash64(key), F.lit(buckets))]
    out = df.repartition(*spread).sortWithinPartitions(shard, *sort) if sort else df.repartition(*spread)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)


def stale_shards(stored: DataFrame, current: DataFrame, shard: str) -> DataFrame:
    """Shard values that are stored but no longer in the data."""
    return stored.select(shard).distinct().join(current.select(shard).distinct(), shard, "left_anti")
