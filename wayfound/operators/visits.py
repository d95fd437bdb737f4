"""Visit, closure and fine records per entity: latest state, current era, history, summaries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.address import street_number_range
from .scale import cut_lineage, keep_first, on_distinct, top_rows

VISIT_ORDER = ("date", "insp_no", "visit")


def newest_first(order=VISIT_ORDER):
    return [F.desc_nulls_last(c) for c in order]


def publication_cutoff(df: DataFrame, date: str, fetched: str, lag_days: int = 7, since: str | None = None) -> DataFrame:
    """Rows dated inside the published period; rows without a date go."""
    through = (dt.date.fromisoformat(fetched) - dt.timedelta(days=lag_days)).isoformat()
    out = df.filter(F.col(date) <= F.lit(through).cast("date"))
    return out.filter(F.col(date) >= F.lit(since).cast("date")) if since else out


def dedupe_keep_first(df: DataFrame, keys, order) -> DataFrame:
    return keep_first(df, keys, [F.asc_nulls_last(c) for c in order])


def dedupe_keep_last(df: DataFrame, keys, order) -> DataFrame:
    return keep_first(df, keys, newest_first(order))


def latest_visit(df: DataFrame, key, order=VISIT_ORDER) -> DataFrame:
    """The last visit per key."""
    return keep_first(df, [key] if isinstance(key, str) else key, newest_first(order))


def latest_routine(df: DataFrame, key, routine: Column, order=VISIT_ORDER) -> DataFrame:
    """The last first-visit routine row per key."""
    return latest_visit(df.filter(routine & (F.col("visit") == 1)), key, order)


def current_era(df: DataFrame, key: str, ok: Column, order=VISIT_ORDER) -> DataFrame:
    """Visits after the last one under another business's name; nothing for keys whose latest visit is foreign."""
    pos = F.struct(*[F.col(c) for c in order])
    foreign = df.filter(~F.coalesce(ok, F.lit(True))).groupBy(F.col(key).alias("_k")).agg(F.max(pos).alias("_last"))
    joined = df.join(foreign, F.col(key) == F.col("_k"), "left")
    return joined.filter(F.col("_last").isNull() | (pos > F.col("_last"))).drop("_k", "_last")


def history_top_n(df: DataFrame, key: str, fields, n: int = 12, order=VISIT_ORDER, out: str = "history") -> DataFrame:
    """Newest ``n`` rows per key as an array, newest first."""
    newest = top_rows(df, [key], newest_first(order), n, rank="_rn")
    item = F.struct(F.col("_rn"), *[F.col(f) for f in fields])
    nested = newest.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_h"))
    return nested.select(key, F.transform("_h", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))


def visit_counters(df: DataFrame, key: str, emergency: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(emergency).alias("eo"))


def reopened_since_close(latest: DataFrame, closures: DataFrame, key: str, closed: Column) -> DataFrame:
    """Latest visits that closed a place, with the newest reopening dated on or after that visit (null when there is none)."""
    c = closures.select(F.col(key).alias("_k"), F.col("date").alias("_cdate"), F.col("reopened").alias("_re")).filter(F.col("_re").isNotNull())
    hit = latest.filter(closed).join(c, (F.col(key) == F.col("_k")) & (F.col("_cdate") >= F.col("date")) & (F.col("_cdate") <= F.col("_re")), "left")
    return hit.groupBy(*latest.columns).agg(F.max("_re").alias("reopened"))


def closure_disambiguation(closures: DataFrame, entities: DataFrame, *, agree, sentinel, number="num", cid="cid", eid="eid") -> DataFrame:
    """Closures filed by bare number, kept where the name agrees or a house number is shared; closures under the sentinel number are matched
    by (house number, town) and name. Both tables carry number, name, addr and town; ``agree(name_a, name_b)`` is a column predicate."""
    numbered = lambda d, id, p: cut_lineage(on_distinct(d.select(F.col(id), F.col(number).alias(p + "_num"), F.col("name").alias(p + "_name"), F.col("town").alias(p + "_town"), "addr"),
                                            ["addr"], {p + "_nums": street_number_range("addr")}).drop("addr"))
    c, e = numbered(closures, cid, "c"), numbered(entities, eid, "e")
    agreeing = lambda met: on_distinct(met, ["c_name", "e_name"], {"_agree": agree(F.col("c_name"), F.col("e_name"))})         # a pair of names is judged once
    by_number = agreeing(c.filter(F.col("c_num") != sentinel).join(e, F.col("c_num") == F.col("e_num"))) \
        .filter(F.col("_agree") | F.arrays_overlap("c_nums", "e_nums")).select(cid, eid, F.lit("number").alias("how"))
    # rows of one name at one place meet as one on both sides and are handed out after the test
    at = lambda d, p: d.withColumn("no", F.explode(p + "_nums")).withColumn("town", F.lower(p + "_town"))
    ce, ee = at(c.filter(F.col("c_num") == sentinel), "c").select(cid, "no", "town", "c_name"), at(e, "e").select(eid, "no", "town", "e_name")
    spot = ["no", "town"]
    met = agreeing(ce.select(*spot, "c_name").distinct().join(ee.select(*spot, "e_name").distinct(), spot)).filter("_agree").select(*spot, "c_name", "e_name")
    by_place = ce.join(met, [*spot, "c_name"]).join(ee, [*spot, "e_name"]).select(cid, eid, F.lit("address").alias("how")).distinct()
    return by_number.unionByName(by_place)


def inspection_summary(visits: DataFrame, closures: DataFrame, fines: DataFrame, *, key: str, ok: Column, routine: Column, emergency: Column,
                       group: Column, n_history: int = 12, n_closures: int = 5, n_fines: int = 6) -> DataFrame:
    """One wide row per key with current-era visits: latest result, latest routine counts, counters, history, closures and fines."""
    era = current_era(visits, key, ok)
    last = latest_visit(era, key).select(key, group.alias("g"), F.col("disp"), F.col("date").alias("d"), F.col("itype"))
    rout = latest_routine(era, key, routine).select(F.col(key).alias("_rk"), F.col("date").alias("rd"), "hp", "im", "bs")
    cnt = visit_counters(era, key, emergency).withColumnRenamed(key, "_ck")
    hist = history_top_n(era, key, ["date", "itype", "disp", "hp", "im", "bs"], n_history).withColumnRenamed(key, "_hk")
    clo = history_top_n(closures, key, ["date", "reason", "reopened"], n_closures, order=("date", "cid"), out="closures").withColumnRenamed(key, "_xk")
    fin = history_top_n(fines, key, ["order_date", "fine"], n_fines, order=("order_date", "case_id"), out="fines").withColumnRenamed(key, "_fk")
    return last.join(rout, F.col(key) == F.col("_rk"), "left").join(cnt, F.col(key) == F.col("_ck"), "left") \
        .join(hist, F.col(key) == F.col("_hk"), "left").join(clo, F.col(key) == F.col("_xk"), "left") \
        .join(fin, F.col(key) == F.col("_fk"), "left").drop("_rk", "_ck", "_hk", "_xk", "_fk")
