"""Building blocks that keep single-key and whole-table work spread over the cluster.

* ``top_rows``      first n rows per key; Spark cuts each map task's rows to n before the shuffle, so a hot key stays small.
* ``ranked``        exact row number per group (or over the whole table) without one task per group: rows go to value ranges, each range is
                    numbered on its own, and small per-range counts give the offsets.
* ``running_total`` exact running sum in the same way.
* ``carried``       the last value before each row, per key, in the same way.
* ``exact_median``  exact medians from counts per distinct value.
* ``on_distinct``   costly columns once per distinct input.
* ``components``    groups of nodes that hang together through links.
* ``cut_lineage``   reliable checkpoints between the rounds of an iterative rule and behind stages that are read several times.
"""
from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

def top_rows(df: DataFrame, by, order, n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order`` (end it with a unique column)."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_rows(df, keys, order, 1)


def _ranges(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, key: Column, ranges: int | None = None) -> DataFrame:
    """One row with at most ``ranges`` sorted values of ``key``, drawn by hash. They only steer where rows are processed; results do not
    depend on them."""
    n = ranges or _ranges(df.sparkSession)
    drawn = df.select(key.alias("_k")).orderBy(F.xxhash64("_k")).limit(n)
    return drawn.agg(F.array_sort(F.collect_list("_k")).alias("_points"))


def _range_of(key: Column, points: Column, ranges: int) -> Column:
    """Number of split points at or below the key, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, ranges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(points, at + step - 1) <= key, F.lit(False)) & (at + step <= F.size(points)), at + step).otherwise(at))


def in_ranges(df: DataFrame, order, name: str = "_range") -> DataFrame:
    """Adds the value range of the ascending order key (a list of columns, last one unique)."""
    n = _ranges(df.sparkSession)
    key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    with_points = df.withColumn("_points", split_points(df, key, n).scalar())
    return with_points.withColumn(name, _range_of(key, F.col("_points"), n)).drop("_points")


def _with_offsets(df: DataFrame, by, order, weight: Column, out: str, running: bool) -> DataFrame:
    ranged = in_ranges(df, order)
    keys = [*by, "_range"]
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys).agg(F.sum(weight).alias("_w"))
    offsets = sums.select(*[F.col(k).alias("o_" + k) for k in keys], F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"))
    on = [F.col(k).eqNullSafe(F.col("o_" + k)) for k in keys]
    joined = ranged.join(offsets, on, "left")
    inside = W.partitionBy(*keys).orderBy(*order)
    value = F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) if running else F.row_number().over(inside)
    return joined.withColumn(out, F.col("_off") + value).drop("_range", "_off", *["o_" + k for k in keys])


def ranked(df: DataFrame, by, order, out: str = "rn") -> DataFrame:
    """Exact 1-based row number per group in ascending ``order``; ``by=[]`` numbers the whole table."""
    return _with_offsets(df, list(by), order, F.lit(1), out, running=False)


def running_total(df: DataFrame, by, order, weight, out: str) -> DataFrame:
    """Exact running sum of ``weight`` per group in ascending ``order``, the row itself included."""
    return _with_offsets(df, list(by), order, F.coalesce(F.col(weight), F.lit(0)), out, running=True)


def carried(df: DataFrame, by, order, value: str, out: str) -> DataFrame:
    """Adds the last non-null ``value`` at or before each row in ascending ``order``, per key. A hot key is spread over value ranges; what holds at a range's start comes
    from the last values of the ranges before it, one row per key and range. ``df`` is read several times: cut its lineage first."""
    ranged = in_ranges(df, [*by, *order])
    keys = [*by, "_range"]
    ends = ranged.groupBy(*keys).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*[F.col(c) for c in order], F.col(value).alias("_v")))).alias("_last"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias("c_" + k) for k in keys], F.last("_last._v", True).over(before).alias("_carry"))
    joined = ranged.join(carry, [F.col(k).eqNullSafe(F.col("c_" + k)) for k in keys])
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.withColumn(out, F.coalesce(F.last(value, True).over(inside), F.col("_carry"))).drop("_range", "_carry", *["c_" + k for k in keys])


def exact_median(df: DataFrame, by, cols) -> DataFrame:
    """Exact median of each column per key, from counts per distinct value. Columns come back as ``median_<col>``; ``n_<col>`` is the
    number of values."""
    by = list(by)
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_e")) \
             .select(*by, "_e.dim", "_e.v").filter(F.col("v").isNotNull())
    counts = cut_lineage(long.groupBy(*by, "dim", "v").agg(F.count("*").alias("n")))
    run = running_total(counts, [*by, "dim"], ["v", "dim", *by], "n", "upto")
    total = counts.groupBy(*by, "dim").agg(F.sum("n").alias("total"))
    on = [run[k].eqNullSafe(total[k]) for k in [*by, "dim"]]
    pos = run.join(total, on).select(*[run[k] for k in [*by, "dim"]], "v", "n", "upto", "total")
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    covers = lambda at: (F.col("upto") >= at) & (F.col("upto") - F.col("n") < at)
    mid = pos.groupBy(*by, "dim").agg(((F.max(F.when(covers(lo), F.col("v"))) + F.max(F.when(covers(hi), F.col("v")))) / 2).alias("m"),
                                      F.max("total").alias("total"))
    pick = lambda c, v: F.max(F.when(F.col("dim") == c, F.col(v)))
    return mid.groupBy(*by).agg(*[pick(c, "m").alias("median_" + c) for c in cols], *[pick(c, "total").alias("n_" + c) for c in cols])


def on_distinct(df: DataFrame, cols, values: dict[str, Column], prepare: dict[str, Column] | None = None) -> DataFrame:
    """Adds costly columns computed once per distinct combination of ``cols`` (names repeat: chains, copies), then joined back. ``prepare`` names
    helper columns computed first, for the value expressions to share."""
    # few bytes, much work per row: an explicit repartition keeps adaptive execution from merging it into one task
    d = df.select(*cols).distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for name, expr in (prepare or {}).items():
        d = d.withColumn(name, expr)
    d = d.select(*[F.col(c).alias("_d_" + c) for c in cols], *[v.alias(n) for n, v in values.items()])
    return df.join(d, [F.col(c).eqNullSafe(F.col("_d_" + c)) for c in cols]).drop(*["_d_" + c for c in cols])


def mode_value(df: DataFrame, by, value: str, out: str, n: str | None = None) -> DataFrame:
    """Most frequent non-null value per key, the smallest on ties; ``n`` names an extra count column."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    best = top_rows(counts, by, [F.desc("_n"), F.asc(value)])
    cols = [*by, F.col(value).alias(out)] + ([F.col("_n").alias(n)] if n else [])
    return best.select(*cols)


def components(links: DataFrame, keep) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the least node reachable. Rounds of large and small stars, each written by ``keep``. Its joins
    are merged, never broadcast: nothing but a count and a sum passes through the driver in a round."""
    now = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while (new := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != mark:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.join(low.hint("merge"), "a").filter("b > a and b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        both = down.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        mark, now = new, keep(both.select("e.a", "e.b").filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names. Only a local test session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
            folder = tempfile.mkdtemp(prefix="wayfound-checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
