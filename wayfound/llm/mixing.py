"""Mixing sources to target weights by repeating documents: floor(rate) copies of each, plus one more by a hash-seeded draw with the fraction's
probability."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, stage

WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2.0


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """Evenly spread over [0, 1) and fixed by id, text and seed."""
    body = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    hexed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size). Sources in code point order, null last, take ``weights`` in turn and share
    ``total`` times all sizes; a target stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above.

    The sources that stop are those of least size for their weight, so one sorted pass finds the level: after the first k of that order have
    stopped, the level is (total - what they take) / (weight of the rest), and k is right once the next one does not stop."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    listed = sizes.select("source", F.col("source_size").cast("long").alias("source_size"),
                          (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1).alias("i")).withColumn("w", w)
    listed = listed.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "i")
    past, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    placed = listed.withColumn("taken_before", F.coalesce(F.sum("cap").over(past), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(past), F.lit(0.0))) \
                   .withColumn("share", F.lit(total) * F.sum("source_size").over(every)).withColumn("w_all", F.sum("w").over(every))
    level = (F.col("share") - F.col("taken_before")) / (F.col("w_all") - F.col("w_before"))
    # the level that holds: the first in the order whose own cap is not below it; none: all stop
    placed = placed.withColumn("level", F.when(F.col("cap") / F.col("w") >= level, level)).withColumn("level", F.first("level", True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return placed.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, seed: str = "mix", keep=()) -> DataFrame:
    """doc_id, ``keep`` columns, source, size (words), source_size, target, copies. Sizes are summed per source (combined on the map side) and joined
    back; no source is collected. Null source is a source of its own; a source without words gets rate 0; rows that are equal in id and text share
    their draw."""
    slim = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                             draw(F.col("doc_id"), F.col("text"), seed).alias("_u"), *keep), "sizes")
    totals = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("_u") < rate - F.floor(rate)).cast("long")
    return slim.join(totals, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("copies", copies).drop("_source", "_u")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document ``copies`` times, with its own columns only."""
    key = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
    slim = with_copies(docs.select("doc_id", "text", "source"), keep=[key.alias("_key")], **how)
    counts = slim.groupBy("_key", F.col("source").alias("_source")).agg(F.max("copies").alias("copies"))
    keyed = docs.select(F.struct("*").alias("_row"), key.alias("_of"), F.col("source").cast("string").alias("_from"))                # columns of any name
    joined = keyed.join(counts, (F.col("_of") == F.col("_key")) & F.col("_from").eqNullSafe(F.col("_source"))).filter("copies > 0")
    return joined.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


MIX_SQL = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
  cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 13) as bigint) / 4503599627370496e0 as u from documents),
s as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last)) - 1 as i from d group by source),
w as (select *, [3e0, 1e0, 2e0][cast(i % 3 as int) + 1] as w, 2e0 * source_size as cap from s),
p as (select *, coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as taken_before,
  coalesce(sum(w) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as w_before,
  1.5e0 * sum(source_size) over () as share, sum(w) over () as w_all from w),
l as (select min(case when cap / w >= (share - taken_before) / (w_all - w_before) then struct_pack(a := cap / w, i := i, level := (share - taken_before) / (w_all - w_before)) end) as x from p),
t as (select source, source_size, case when x is null then cap else least(cap, x.level * w) end as target from p, l),
r as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0e0 end as rate, u from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target, cast((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size as bigint) as taken,
  cast(floor(rate) + case when u < rate - floor(rate) then 1 else 0 end as bigint) as copies from r"""
