"""Sharding by Hilbert order: rows that are near in several metadata dimensions get near positions, so that a file's value ranges are narrow in
every dimension and readers skip files by any of them. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import shuffle_partitions, stage, text_crc32


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point with ``bits``-bit coordinates (at most 62 bits in all): undo the rotations from the top bit
    down, Gray-code the axes, interleave the bits."""
    n = len(coords)
    if n * bits > 62:
        raise ValueError("at most 62 bits in all")
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    start = F.array(*[c.cast("long") for c in coords])

    def turn(x, s):
        here, low = F.get(x, s["i"]), s["q"] - 1
        swap = F.get(x, F.lit(0)).bitwiseXOR(here).bitwiseAND(low)
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(here.bitwiseAND(s["q"]) != 0, inverted).otherwise(swapped)

    turned = F.aggregate(steps, start, turn)
    axes = F.sequence(F.lit(0), F.lit(n - 1))
    gray = F.aggregate(turned, F.array().cast("array<bigint>"), lambda acc, v: F.array_append(acc, v.bitwiseXOR(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0).cast("long")))))
    places = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])

    def interleave(x):
        last = F.get(x, F.lit(n - 1))
        flip = F.aggregate(places, F.lit(0).cast("long"), lambda t, b: F.when((b > 0) & (F.expr("1L") == _bit(last, b)), t.bitwiseXOR(_ones(b))).otherwise(t))
        flipped = F.transform(x, lambda v: v.bitwiseXOR(flip))
        return F.transform(F.array(flipped), lambda y: F.aggregate(places, F.lit(0).cast("long"), lambda t, b: F.aggregate(axes, t, lambda u, i: u * 2 + _bit(F.get(y, i), b))))

    return F.get(F.flatten(F.transform(F.array(gray), interleave)), F.lit(0))


def _bit(v: Column, b: Column) -> Column:
    """Bit ``b`` of a long: shifts by a column go through integer division by a power of two, as b < 62."""
    return F.call_function("shiftright", v, b.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def _ones(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) - 1


def quantile_edges(df: DataFrame, dim: str, bits: int) -> list:
    """At most 2**bits - 1 values that cut the rows into runs of nearly equal counts, from exact counts per distinct value (so reruns agree). Give a
    dimension with few distinct values: round measures first. Nulls come first."""
    counts = df.filter(F.col(dim).isNotNull()).groupBy(dim).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy(dim).rowsBetween(W.unboundedPreceding, -1))
    placed = counts.select(dim, F.coalesce(upto, F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("all"))
    bucket = F.floor(F.col("before") * (1 << bits) / F.col("all"))
    first = placed.select(dim, bucket.alias("b")).groupBy("b").agg(F.min(dim).alias("v"))
    return sorted(r["v"] for r in first.filter("b > 0").collect())


def quantised(value: Column, edges: list) -> Column:
    """Number of edges at or below the value, by binary search; null gives 0."""
    if not edges:
        return F.lit(0)
    points = F.array(*[F.lit(e) for e in edges])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(edges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(edges)) & F.coalesce(F.get(points, at + s - 1) <= value, F.lit(False)), at + s).otherwise(at))


def shard_by_curve(df: DataFrame, dims: list[str], ties: list[str], shards: int, bits: int = 6) -> DataFrame:
    """Adds ``curve`` (Hilbert index), ``shard`` (0 to shards-1, counts at most one apart) and ``slot`` (gapless from 0 in each shard).

    Rows go into curve order (then ``ties``) by one range exchange; each range is numbered on its own and starts where the ranges before it end, so
    a value with a third of the rows is cut like any other. ``df`` is read several times: stage it first. Rows that are equal in all of ``dims``
    and ``ties`` may swap places. Null dimensions sort first; an empty table gives an empty result."""
    spark = df.sparkSession
    edges = {d: quantile_edges(df, d, bits) for d in dims}
    placed = df.withColumn("curve", hilbert_index([quantised(F.col(d), edges[d]) for d in dims], bits))
    order = ["curve", *ties]
    ranges = stage(placed.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_range", F.spark_partition_id()), "curve")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    out = ranges.join(offsets, "_range").withColumn("_rank", rank).withColumn("shard", F.floor(F.col("_rank") * shards / F.col("_all")).cast("int"))
    # a shard starts at the least rank r with r * shards >= shard * all
    begin = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return out.withColumn("slot", F.col("_rank") - begin).drop("_range", "_before", "_all", "_rank")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size (UTF-8 bytes of the text plus 16; null: 16), text_crc32 and size_class (eighths of a power of two)."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 16
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), size.alias("size"),
                       text_crc32(F.col("text")).alias("text_crc32")).withColumn("size_class", F.floor(F.log2("size") * 8))


DIMS, TIES = ["source", "lang", "size_class"], ["text_crc32", "size", "doc_id"]


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document's shard and slot on the curve of source, language and size. Null texts have size 16; repeated rows each get a slot of their
    own."""
    slim = stage(measured(docs), "measured")
    return shard_by_curve(slim, DIMS, TIES, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                                           F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Writes all columns as one folder per shard in curve order. A shard is one task's work: give so many shards that one fits a task."""
    slim = docs.withColumn("_size", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 16)
    slim = slim.withColumn("_class", F.floor(F.log2("_size") * 8)).withColumn("_crc", text_crc32(F.col("text")))
    out = shard_by_curve(stage(slim, "shards"), ["source", "lang", "_class"], ["_crc", "_size", "doc_id"], shards)
    out.drop("_size", "_class", "_crc", "curve").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
