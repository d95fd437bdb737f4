"""Exact search for near-equal texts without comparing everything with everything.

If two texts reach similarity ``t``, at most ``D`` letters are inserted or deleted between them. Cut one text into D+1 pieces: at least one
piece stands unchanged in the other, shifted by at most D. Both sides list such pieces, an equal-piece join finds the candidates, and the
true similarity decides.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import sim_ratio


def _budget(n: Column, t: float) -> Column:
    return F.floor(n * F.lit(2 * (100.0 - t) / t) + 1e-9).cast("int")


def _start(i: Column, n: Column, d: Column) -> Column:
    return F.floor(i * n / (d + 1)).cast("int")


def _span(a: Column, b: Column) -> Column:
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def _pieces(c: Column, t: float) -> Column:
    n = F.length(c)
    d = _budget(n, t)
    return F.transform(F.sequence(F.lit(0), d), lambda i: F.struct(
        n.alias("n"), i.alias("i"), F.substring(c, _start(i, n, d) + 1, _start(i + 1, n, d) - _start(i, n, d)).alias("s")))


def _probes(c: Column, t: float) -> Column:
    m = F.length(c)
    lo, hi = F.ceil(m * F.lit(t / (200.0 - t)) - 1e-9).cast("int"), F.floor(m * F.lit((200.0 - t) / t) + 1e-9).cast("int")

    def for_length(n):
        d = _budget(n, t)

        def for_piece(i):
            at, size = _start(i, n, d) + 1, _start(i + 1, n, d) - _start(i, n, d)
            return F.transform(_span(F.greatest(at - d, F.lit(1)), F.least(at + d, m - size + 1)),
                               lambda p: F.struct(n.alias("n"), i.alias("i"), F.substring(c, p, size).alias("s")))
        return F.flatten(F.transform(F.sequence(F.lit(0), d), for_piece))
    return F.array_distinct(F.flatten(F.transform(_span(F.greatest(lo, F.lit(1)), hi), for_length)))


def near_text_pairs(left: DataFrame, right: DataFrame, l_col: str, r_col: str, min_ratio: float, block=()) -> DataFrame:
    """(block..., l_text, r_text, score) of all distinct text pairs with similarity >= ``min_ratio``; ``block`` names columns that must be
    equal on both sides. Works on distinct texts, so copies cost nothing."""
    block = list(block)
    l = left.filter(F.length(l_col) > 0).select(*block, F.col(l_col).alias("l_text")).distinct()
    r = right.filter(F.length(r_col) > 0).select(*[F.col(b).alias("r_" + b) for b in block], F.col(r_col).alias("r_text")).distinct()
    lp = l.withColumn("_p", F.explode(_pieces(F.col("l_text"), min_ratio)))
    rp = r.withColumn("_q", F.explode(_probes(F.col("r_text"), min_ratio)))
    on = (F.col("_p.n") == F.col("_q.n")) & (F.col("_p.i") == F.col("_q.i")) & (F.col("_p.s") == F.col("_q.s"))
    for b in block:
        on = on & (F.col(b) == F.col("r_" + b))
    cand = lp.join(rp, on).select(*block, "l_text", "r_text").distinct()
    return cand.withColumn("score", sim_ratio("l_text", "r_text")).filter(F.col("score") >= min_ratio)
