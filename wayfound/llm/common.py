"""Shared helpers: stage tables in the shared folder, text columns, splits by checksum, fixed-size bit maps."""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset (tests on one machine) a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: the lineage ends there, and what is read twice is computed once."""
    path = f"{shared_folder(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def id_remainder(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(text_crc32(col), F.lit(n))


def as_bytes(col: Column) -> Column:
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- fixed-size bit maps of 64-bit hashes: bounded by their parameter at every size of the data; false hits cost work, never results
def bitmap(df: DataFrame, hashed: str, bits: int) -> np.ndarray:
    """2**bits flags, set at the top bits of every hash in the column. At most 2**(bits-6) rows reach the driver."""
    at = F.shiftrightunsigned(F.col(hashed), 64 - bits)
    words = (df.select(F.shiftrightunsigned(at, 6).alias("w"), F.expr(f"shiftleft(1L, int(shiftrightunsigned({hashed}, {64 - bits}) & 63))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(1 << max(0, bits - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = int(flags.size).bit_length() - 1 + 6
    at = hashes >> np.uint64(64 - bits)
    return (flags[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
