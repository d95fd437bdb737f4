"""Streams with one state for each key, kept by Spark's state store and changed in place: no history is kept or read again.

A micro-batch hands every key its new rows; a processor reads the key's state, changes it and gives out the key's new row. Expiry is a timer in event time, so a key without new rows
comes out again when the watermark passes its day. State stores that hold timers and typed values need the RocksDB provider (``use_keyed_state``)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, for queries that start from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Latest(StatefulProcessor):
    """State: position and fields of the last visit, position of the last foreign one, number of visits. Rows may come in any order."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", "pos string, value string, foreign string, visits long")

    def handleInputRows(self, key, rows, timerValues):
        pos, value, foreign, visits = self.state.get() if self.state.exists() else (None, None, None, 0)
        for r in rows:
            visits += 1
            if pos is None or r["_pos"] > pos:
                pos, value = r["_pos"], r["_value"]
            if not r["_ok"] and (foreign is None or r["_pos"] > foreign):
                foreign = r["_pos"]
        self.state.update((pos, value, foreign, visits))
        yield Row(_key=key[0], value=value, visits=visits, in_era=foreign is None or pos > foreign)

    def close(self) -> None:
        pass


def latest_state(visits: DataFrame, *, key: str, order, ok, field: str) -> DataFrame:
    """(key, field, visits, in_era) of every key that has new visits: the last visit by ``order`` (a text column that sorts like time, greatest last), the number of visits so far, and
    whether the last one is not foreign. Late visits change the count, and the last visit only where they are later. A null key is a key of its own. Update mode."""
    kind = visits.schema[key].dataType.simpleString()
    slim = visits.select(key, order.cast("string").alias("_pos"), F.col(field).cast("string").alias("_value"), F.coalesce(ok, F.lit(True)).alias("_ok"))
    out = slim.groupBy(key).transformWithState(_Latest(), f"_key {kind}, value string, visits long, in_era boolean", "Update", "None")
    return out.withColumnsRenamed({"_key": key, "value": field})


class _Verdicts(StatefulProcessor):
    """State: time, result and rules of the newest verdict, and the moment at which its timer rings."""

    def __init__(self, days: int, rules: int):
        self.hold, self.rules = days * 86_400_000, rules

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("verdict", "at long, ok boolean, v int")

    def handleInputRows(self, key, rows, timerValues):
        had = self.state.get() if self.state.exists() else None
        best = had
        for r in rows:
            new = (r["_at"], r["ok"], r["v"])
            if best is None or new > tuple(best):
                best = new
        if had is None or tuple(best) != tuple(had):
            if had is not None:
                self.handle.deleteTimer(had[0] + self.hold)
            self.state.update(best)
            if best[2] == self.rules:
                self.handle.registerTimer(best[0] + self.hold)
        yield Row(url=key[0], at_=best[0], ok=best[1], state="fresh" if best[2] == self.rules else "expired")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            at, ok, _ = self.state.get()
            self.state.clear()
            yield Row(url=key[0], at_=at, ok=ok, state="expired")

    def close(self) -> None:
        pass


def expiring_verdicts(verdicts: DataFrame, *, rules: int, days: int = 45, time: str = "at", delay: str = "0 seconds") -> DataFrame:
    """(url, at_ in milliseconds, ok, state) whenever a link's verdict changes: 'fresh' for a new verdict under the current rules, 'expired' for one under other rules, and 'expired' again
    from the timer when the watermark (latest time seen less ``delay``) passes ``days`` after the verdict. An expired link's state is dropped; nothing else is read. ``verdicts``: url, ok, v, time.
    Of verdicts at one moment the greater (ok, v) counts. Update mode."""
    slim = verdicts.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).select("url", "ok", F.col("v").cast("int").alias("v"), F.unix_millis(F.col(time)).alias("_at"), time)
    return slim.groupBy("url").transformWithState(_Verdicts(days, rules), "url string, at_ long, ok boolean, state string", "Update", "EventTime")
