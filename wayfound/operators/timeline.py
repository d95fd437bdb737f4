"""Records on a time line: the period in force at a moment, chains of visits, counts over the days before.

A key with very many rows is cut by time: rows go to ranges of (key, time), each range is handled on its own, and what was in force at its start is carried in
from the small table of the ranges' last values."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scale import carried, cut_lineage


def status_at(probes: DataFrame, spans: DataFrame, *, key: str, time: str, start: str = "start", end: str = "end", fields=("status",)) -> DataFrame:
    """Every row of ``probes`` with the ``fields`` of the period in force at its time (null where none is). ``spans`` has key, start, end (exclusive; null: open).

    The period that started last counts, from its start (inclusive) on, also where an earlier one is still running; when it has ended nothing is in force. Of
    periods that start together the one that ends last counts (open ends latest), then the greatest fields. Null keys and times meet nothing. Probe rows are kept as they
    are, repeated ones too."""
    value = F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("end"), *[F.col(f).alias(f) for f in fields])
    starts = spans.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(start).alias("_time")).agg(F.max(value).alias("_value"))
    asked = probes.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.struct("*").alias("_row"))
    none = F.lit(None)
    events = starts.select("_key", "_time", F.lit(0).alias("_kind"), "_value", none.cast(asked.schema["_row"].dataType).alias("_row")) \
        .unionByName(asked.select("_key", "_time", F.lit(1).alias("_kind"), none.cast(starts.schema["_value"].dataType).alias("_value"), "_row"))
    last = carried(cut_lineage(events), ["_key"], ["_time", "_kind"], "_value", "_in_force").filter("_kind = 1")
    holds = F.col("_key").isNotNull() & F.col("_time").isNotNull() & (F.col("_in_force.open") | (F.col("_time") < F.col("_in_force.end")))
    return last.select("_row.*", *[F.when(holds, F.col(f"_in_force.{f}")).alias(f) for f in fields])


def spans_at(probes: DataFrame, spans: DataFrame, *, key: str, time: str, start: str = "start", end: str = "end", fields=("status",), days: int = 30) -> DataFrame:
    """Interval join: one row for every probe and every period of its key that holds its time, overlapping ones too (dates; end exclusive, null: open).

    A period is cut at multiples of ``days`` and meets only the probes of the same stretch, so a key with a third of the rows is spread over its stretches. Open ends
    reach to the last probe. Probes without a period don't come out."""
    last = probes.agg(F.max(F.unix_date(F.col(time)))).scalar()
    first = F.unix_date(F.col(start))
    until = F.coalesce(F.least(F.unix_date(F.col(end)) - 1, last), last)
    cut = spans.filter(F.col(start).isNotNull()).select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"), *fields, first.alias("_a"), until.alias("_b")) \
        .filter("_b >= _a").withColumn("_part", F.explode(F.sequence(F.floor(F.col("_a") / days), F.floor(F.col("_b") / days)))).drop("_a", "_b")
    asked = probes.withColumn("_at", F.floor(F.unix_date(F.col(time)) / days))
    met = asked.join(cut, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_part")) & (F.col("_start") <= F.col(time)) & (F.col("_end").isNull() | (F.col(time) < F.col("_end"))))
    return met.drop("_key", "_at", "_part").withColumnsRenamed({"_start": "span_start", "_end": "span_end"})


def visit_chains(visits: DataFrame, *, key: str, time: str, gap: str = "30 days", found: Column | None = None) -> DataFrame:
    """(key, first, last, visits, found): chains of visits in which each follows the one before within ``gap`` (a re-inspection chain); ``found`` counts the visits
    under a condition. The same rule runs on a stream whose time has a watermark."""
    chain = visits.groupBy(F.col(key), F.session_window(F.col(time), gap).alias("_w")).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("visits"), F.count_if(F.lit(False) if found is None else found).alias("found"))
    return chain.drop("_w")


def counts_before(visits: DataFrame, *, key: str, day: str, days: int = 365, counted: dict[str, Column] | None = None) -> DataFrame:
    """(key, day, n, ...): for every key and day with visits the rows of that day and the ``days`` - 1 days before, and of each counted condition. Rows are added up
    per key and day first, so a key's window holds its days, however many visits it has."""
    counted = counted or {}
    daily = visits.filter(F.col(day).isNotNull()).groupBy(key, day).agg(F.count("*").alias("_n"), *[F.count_if(c).alias("_" + n) for n, c in counted.items()])
    frame = W.partitionBy(key).orderBy(F.unix_date(F.col(day))).rangeBetween(-(days - 1), 0)
    return daily.select(key, day, *[F.sum("_" + n).over(frame).alias(n) for n in ("n", *counted)])


def sliding_counts(events: DataFrame, *, time: str, kind: str, width: str = "28 days", slide: str = "7 days") -> DataFrame:
    """(start, kind, n): rows in every window of ``width`` that begins each ``slide``; on a stream give the time a watermark first."""
    g = events.groupBy(F.window(time, width, slide).alias("_w"), kind).agg(F.count("*").alias("n"))
    return g.select(F.col("_w.start").alias("start"), kind, "n")
