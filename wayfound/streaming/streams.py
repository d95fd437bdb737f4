"""Incremental forms of the record rules on Structured Streaming. Each has a batch twin with the same result on the same rows.

``run_to_table`` runs a streaming query over what has arrived (availableNow) in update mode: every micro-batch appends its changed rows with
the batch number, and readers take the newest row per key.

Rules whose keys live for ever (a visit, an entity, a link) keep state per key and period of event time, which the watermark ends; a reader
merges the periods of a key (``merged_visits``, ``merged_state``, ``verdicts_at``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.scale import keep_first
from ..operators.stats import mention_counts


def read_stream(spark: SparkSession, folder: str, file: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet data of a folder as a stream, with the schema of what is already there: one file, the files that the pattern ``file`` finds, or a table that is itself a
    folder of files."""
    r = spark.readStream.schema(spark.read.parquet(f"{folder}/{file}").schema)
    pattern = file if any(c in file for c in "*?[{") else f"[{file[0]}]{file[1:]}"          # a pattern finds a file and a folder alike
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(f"{folder}/{pattern}")


def run_to_table(stream: DataFrame, table: str, checkpoint: str, *, mode: str = "update") -> None:
    """Process everything available; append each batch's rows with their batch number."""
    def write(batch: DataFrame, no: int) -> None:
        batch.withColumn("batch_no", F.lit(no)).write.mode("overwrite").parquet(f"{table}/batch={no:09d}")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_latest(spark: SparkSession, table: str, keys) -> DataFrame:
    """The newest row per key."""
    return keep_first(spark.read.parquet(table), list(keys), [F.desc("batch_no")]).drop("batch_no", "batch")


def _time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time as an instant with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def _by_period(df: DataFrame, time: str, period: str, delay: str, keys):
    """Groups by period of event time and keys; the period comes out as ``period``."""
    return _time(df, time, delay).groupBy(F.window(time, period).alias("_w"), *keys)


def dedupe_visits(visits: DataFrame, *, keys, time: str, delivery: str, fields, period="1 day", delay="7 days") -> DataFrame:
    """(keys, period, sent, fields): per visit key and period the latest delivery. ``merged_visits`` gives one row per key."""
    g = _by_period(visits, time, period, delay, keys).agg(F.max_by(F.struct(*fields), F.col(delivery)).alias("v"), F.max(delivery).alias("sent"))
    return g.select(*keys, F.col("_w.start").alias("period"), "sent", "v.*")


def merged_visits(stored: DataFrame, *, keys, fields) -> DataFrame:
    """One row per visit key from the newest rows per key and period; the latest delivery wins."""
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*fields), "sent").alias("v")).select(*keys, "v.*")


def dedupe_first(visits: DataFrame, *, keys, time: str, delay="7 days") -> DataFrame:
    """First delivery per key, for sinks that only append."""
    return _time(visits, time, delay).dropDuplicatesWithinWatermark(list(keys))


def publication_lag(events: DataFrame, *, time: str, fetched: str, lag_days: int = 7) -> DataFrame:
    """Rows old enough to be published on the fetch day; newer ones come with a later run."""
    return events.filter(F.to_date(time) <= F.date_sub(F.lit(fetched).cast("date"), lag_days))


def latest_state(visits: DataFrame, *, key: str, time: str, order, ok: Column, fields, period="1 day", delay="7 days") -> DataFrame:
    """(key, period, last, pos, foreign, visits): per key and period the latest visit and the latest foreign one, for ``merged_state``."""
    pos = F.struct(*[F.col(c) for c in order])
    g = _by_period(visits, time, period, delay, [key]).agg(F.max_by(F.struct(*fields), pos).alias("last"), F.max(pos).alias("pos"), F.max(F.when(~ok, pos)).alias("foreign"), F.count("*").alias("visits"))
    return g.select(key, F.col("_w.start").alias("period"), "last", "pos", "foreign", "visits")


def merged_state(stored: DataFrame, *, key: str) -> DataFrame:
    """Per key the latest visit and the number of visits; the current era is empty when the latest visit is foreign."""
    s = stored.groupBy(key).agg(F.max_by("last", "pos").alias("last"), F.max("pos").alias("p"), F.max("foreign").alias("foreign"), F.sum("visits").alias("visits"))
    return s.select(key, "last.*", "visits", (F.col("foreign").isNull() | (F.col("p") > F.col("foreign"))).alias("in_era"))


def verdict_ttl(verdicts: DataFrame, *, time="at", period="1 day", delay="1 day") -> DataFrame:
    """(url, period, at_, ok, v): per link and period the newest verdict (the better one on ties) and the rules it was made under."""
    g = _by_period(verdicts.withColumn("_s", F.unix_timestamp(time)), time, period, delay, ["url"]).agg(F.max(F.struct(F.col("_s").alias("at_"), "ok", "v")).alias("last"))
    return g.select("url", F.col("_w.start").alias("period"), "last.*")


def verdicts_at(stored: DataFrame, *, now, rules: int, days: int = 45) -> DataFrame:
    """(url, ok, at_, state) on reading: 'fresh' for a verdict under the current rules that is not due at ``now``, else 'expired'."""
    s = stored.groupBy("url").agg(F.max(F.struct("at_", "ok", "v")).alias("m")).select("url", "m.*")
    live = (F.col("v") == rules) & (F.col("at_") + days * 86400 > F.unix_timestamp(now))
    return s.select("url", "ok", "at_", F.when(live, F.lit("fresh")).otherwise(F.lit("expired")).alias("state"))


def mention_counts_stream(reviews: DataFrame, patterns: dict[str, str], *, by: str, prefilter: str | None = None) -> DataFrame:
    """Running mention counts as reviews arrive; the batch rule itself. State is one row of counts per place and does not expire."""
    return mention_counts(reviews, patterns, by=by, prefilter=prefilter)


def weekly_counts(events: DataFrame, *, time: str, kind: str, delay="7 days") -> DataFrame:
    """(week, kind, n): rows per publication week."""
    w = _time(events, time, delay).groupBy(F.window(time, "7 days").alias("w"), kind).agg(F.count("*").alias("n"))
    return w.select(F.to_date("w.start").alias("week"), kind, "n")
