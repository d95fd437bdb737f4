"""Whole-table orderings as data: dictionary codes, row indexes, delta and sparse encodings, percentile ranks."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .scale import cut_lineage, ranked, running_total


def dictionary(df: DataFrame, column: str, code: str) -> DataFrame:
    """Sorted distinct values with 0-based codes."""
    values = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return ranked(values, [], [column], "_rn").select(column, (F.col("_rn") - 1).alias(code))


def dictionary_encode(df: DataFrame, columns) -> DataFrame:
    """Adds ``<column>_code`` for each column; nulls stay null."""
    out = df
    for c in columns:
        codes = dictionary(df, c, c + "_code").withColumnRenamed(c, "_v")
        out = out.join(codes, F.col(c) == F.col("_v"), "left").drop("_v")
    return out


def row_index(df: DataFrame, order, out: str = "row") -> DataFrame:
    """0-based index along the (unique, ascending) order; the numbered table is a stage of its own (written once, read by each encoder)."""
    return cut_lineage(ranked(df, [], order, "_rn").withColumn(out, F.col("_rn") - 1).drop("_rn"))


def scaled(c, scale: int):
    return F.bround(F.col(c) * scale).cast("bigint")


def delta_encode(df: DataFrame, columns: dict[str, int], row: str = "row") -> DataFrame:
    """DataFrame(row, d_<col>...): each scaled value minus the previous non-null one in row order; null stays null."""
    out = df.select(row)
    for c, scale in columns.items():
        seen = ranked(df.filter(F.col(c).isNotNull()).select(F.col(row).alias("_r"), scaled(c, scale).alias("_x")), [], ["_r"], "_n")
        prev = seen.select((F.col("_n") + 1).alias("_pn"), F.col("_x").alias("_px"))
        d = seen.join(prev, F.col("_n") == F.col("_pn"), "left").select("_r", (F.col("_x") - F.coalesce("_px", F.lit(0))).alias("d_" + c))
        out = out.join(d, F.col(row) == F.col("_r"), "left").drop("_r")
    return out


def delta_decode(df: DataFrame, columns: dict[str, int], row: str = "row") -> DataFrame:
    """Inverse of :func:`delta_encode`: scaled integers back to values, nulls kept."""
    out = df.select(row)
    for c, scale in columns.items():
        part = df.filter(F.col("d_" + c).isNotNull()).select(F.col(row).alias("_r"), F.col("d_" + c).alias("_d"))
        back = running_total(part, [], ["_r"], "_d", "_x").select("_r", (F.col("_x") / scale).alias(c))
        out = out.join(back, F.col(row) == F.col("_r"), "left").drop("_r")
    return out


def fill_share(df: DataFrame, columns) -> DataFrame:
    """Long table (column, filled, total) of non-null counts."""
    one = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])
    return one.select(F.explode(pairs).alias("p"), "total").select("p.column", "p.filled", "total")


def sparse_columns(df: DataFrame, columns, below: float = 0.05) -> DataFrame:
    """Columns filled in less than ``below`` of the rows."""
    return fill_share(df, columns).filter(F.col("filled") < below * F.col("total"))


def sparse_encode(df: DataFrame, columns, row: str = "row", below: float = 0.05) -> DataFrame:
    """Long table (column, row, value) of the sparse columns' non-null values."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    cells = df.select(row, F.explode(items).alias("e")).select("e.column", row, "e.value").filter(F.col("value").isNotNull())
    return cells.join(sparse_columns(df, columns, below).select("column"), "column", "left_semi")


def sparse_decode(index: DataFrame, cells: DataFrame, columns: dict[str, str], row: str = "row") -> DataFrame:
    """Sparse cells back to columns of the given types, one row per index row."""
    wide = cells.groupBy(F.col(row).alias("_r")).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).cast(t).alias(c) for c, t in columns.items()])
    return index.select(row).join(wide, F.col(row) == F.col("_r"), "left").drop("_r")


def pct_rank_avg(df: DataFrame, column: str, out: str = "pct") -> DataFrame:
    """Percentile rank with average ties x100, one decimal (half-even); null for null."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    run = running_total(counts, [], ["_v"], "_n", "_upto")
    total = counts.agg(F.sum("_n")).scalar()
    share = run.select("_v", F.bround((F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2) / total * 100, 1).alias(out))
    return df.join(share, F.col(column) == F.col("_v"), "left").drop("_v")


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
