"""Lookup, cascade, semi/anti and merge joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scale import exact_median, keep_first, mode_value, top_rows


def join_using_id(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on)


def left_lookup(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left join; no match stays unknown (null), never false."""
    return left.join(right, on, "left")


def distinct_key_join(wanted: DataFrame, points: DataFrame, keys) -> DataFrame:
    """Points whose key is wanted; the distinct keys travel, not the wanted rows."""
    return points.join(wanted.select(*keys).distinct(), keys)


def anti_unmatched(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def semi_coverage(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def address_medians(points: DataFrame, keys, max_spread: float = 0.01) -> DataFrame:
    """(keys, lat, lon) medians of addresses whose latitudes spread less than the limit."""
    med = exact_median(points, keys, ["lat", "lon"])
    spread = points.groupBy(*[F.col(k).alias("s_" + k) for k in keys]).agg((F.max("lat") - F.min("lat")).alias("spread"))
    on = [med[k].eqNullSafe(spread["s_" + k]) for k in keys]
    return med.join(spread, on).filter(F.col("spread") < max_spread).select(*keys, F.col("median_lat").alias("lat"), F.col("median_lon").alias("lon"))


def unique_street_medians(points: DataFrame, keys, street: str) -> DataFrame:
    """(keys, lat, lon) medians of keys that stand for a single street."""
    one = points.filter(F.col(street).isNotNull()).groupBy(*[F.col(k).alias("u_" + k) for k in keys]) \
        .agg(F.min(street).alias("a"), F.max(street).alias("b")).filter(F.col("a") == F.col("b"))
    med = exact_median(points, keys, ["lat", "lon"])
    return med.join(one, [med[k] == one["u_" + k] for k in keys]).select(*keys, F.col("median_lat").alias("lat"), F.col("median_lon").alias("lon"))


def cascade(wanted: DataFrame, id: str, steps) -> DataFrame:
    """First hit wins: ``steps`` is an ordered list of (method, DataFrame(id, lat, lon)) with one row per id at most. Returns
    (id, lat, lon, method); rows without a hit keep nulls."""
    hits = None
    for no, (method, df) in enumerate(steps):
        part = df.select(F.col(id).alias("_id"), F.struct(F.lit(no).alias("no"), F.lit(method).alias("method"), "lat", "lon").alias("hit"))
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy("_id").agg(F.min("hit").alias("hit"))
    return wanted.select(id).join(best, F.col(id) == F.col("_id"), "left").select(id, "hit.lat", "hit.lon", "hit.method")


def geocode_cascade(wanted: DataFrame, points: DataFrame, cached: DataFrame, named: DataFrame) -> DataFrame:
    """Place addresses: full street key, then core key unique in the zip, then cached answers, then a name match. ``wanted`` carries
    (id, num, street, core, zip), ``points`` (num, street, core, zip, lat, lon); the other two are DataFrame(id, lat, lon)."""
    near = distinct_key_join(wanted.filter(F.col("num").isNotNull()), points, ["num", "zip"])
    full = address_medians(near.filter(F.col("street").isNotNull()), ["num", "street", "zip"])
    core = unique_street_medians(near.filter(F.col("core").isNotNull()), ["num", "core", "zip"], "street")
    by = lambda table, keys: wanted.join(table, keys).select("id", "lat", "lon")
    return cascade(wanted, "id", [("point", by(full, ["num", "street", "zip"])), ("point-core", by(core, ["num", "core", "zip"])),
                                  ("cached", cached), ("name", named)])


def address_unique_match(left: DataFrame, right: DataFrame, keys, *, lid: str, rid: str, agree=None) -> DataFrame:
    """(lid, rid) where an address holds exactly one row on each side (numbered highways excluded) and the names agree.
    ``keys`` = (number, street, zip); both sides carry ``name``."""
    usable = lambda df: df.filter(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull() & ~F.col(keys[1]).rlike("^(?:US|SR|CR) "))
    only = lambda df, id, p: usable(df).groupBy(*keys).agg(F.count("*").alias("n"), F.min(id).alias(id), F.min("name").alias(p + "name")) \
        .filter(F.col("n") == 1).drop("n")
    both = only(left, lid, "l_").join(only(right, rid, "r_"), list(keys))
    return (both.filter(agree(F.col("l_name"), F.col("r_name"))) if agree else both).select(lid, rid)


def core_detail_merge(core: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Core rows with detail fields; where both carry a column the detail's value wins."""
    d = detail.select(F.col(key).alias("_k"), *[F.col(c).alias("d_" + c) for c in detail.columns if c != key])
    out = core.join(d, F.col(key) == F.col("_k"), "left")
    shared = [c for c in detail.columns if c != key and c in core.columns]
    cols = [F.coalesce("d_" + c, c).alias(c) if c in shared else F.col(c) for c in core.columns]
    return out.select(*cols, *[F.col("d_" + c).alias(c) for c in detail.columns if c != key and c not in shared])


def remove_closed(df: DataFrame, closed_ids: DataFrame, id: str) -> DataFrame:
    return df.join(closed_ids, id, "left_anti")


def apply_fix_table(df: DataFrame, fixes: DataFrame, *, name="name", town="town", street="street") -> DataFrame:
    """Manual fixes keyed by (name, town, street number); the fixed name replaces the old one."""
    num = F.regexp_extract(F.coalesce(F.col(street), F.lit("")), r"^(\d+) ", 1)
    f = keep_first(fixes, ["name", "town", "street_number"], [F.asc("fixed")]) \
        .select(F.upper("name").alias("_n"), F.col("town").alias("_t"), F.col("street_number").cast("string").alias("_s"), "fixed")
    hit = df.join(f, (F.upper(name) == F.col("_n")) & (F.col(town) == F.col("_t")) & (num == F.col("_s")), "left")
    return hit.withColumn(name, F.coalesce("fixed", name)).drop("_n", "_t", "_s", "fixed")


def rename_from_registry(df: DataFrame, registry: DataFrame, *, id: str, license: str, agrees: Column, usable: Column, reset=()) -> DataFrame:
    """Rows tied to a registry row none of whose names agrees take the registry name and lose the dependent columns. ``registry`` carries
    (license, reg_name, reg_keys); ``agrees`` and ``usable`` are conditions over the joined columns."""
    j = df.join(registry, license, "left")
    wrong = F.col("reg_name").isNotNull() & ~F.coalesce(agrees, F.lit(False)) & F.coalesce(usable, F.lit(False))
    cols = []
    for c in df.columns:
        if c == "name":
            cols.append(F.when(wrong, F.col("reg_name")).otherwise(F.col(c)).alias(c))
        elif c in reset:
            cols.append(F.when(~wrong, F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols, wrong.alias("renamed"))


def calibration_lookup(df: DataFrame, rates: DataFrame, on) -> DataFrame:
    """Measured match rate per group as percent text."""
    return df.join(rates, on, "left").withColumn("rate_text", F.when(F.col("rate").isNotNull(), F.concat(F.format_number(F.bround(F.col("rate") * 100, 0), 0), F.lit("%"))))


def best_match_left(pairs: DataFrame, lid="lid", rid="rid", score="score") -> DataFrame:
    """At most one right row per left row (a right row may serve several): best score, then smallest ids. Pairs are counted down to one per left row and
    score as they come, so no task sorts or keeps all pairs of a row; pairs with further columns keep them and are ranked as they are."""
    if set(pairs.columns) == {lid, rid, score}:
        best = pairs.groupBy(lid, score).agg(F.min(rid).alias("_r"), F.bool_or(F.col(rid).isNull()).alias("_none"))
        pairs = best.select(lid, F.when(~F.col("_none"), F.col("_r")).alias(rid), score).select(*pairs.columns)
    return top_rows(pairs, [lid], [F.desc(score), F.asc(rid)])


def newest_wins(old: DataFrame, new: DataFrame, keys, stamp: str) -> DataFrame:
    """Two versions of a keyed table, the later stamp wins; on equal stamps the new version."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [F.desc_nulls_last(stamp), F.desc("_v")]).drop("_v")


def fill_from_mode(df: DataFrame, by: str, value: str) -> DataFrame:
    """Missing values from the group's most frequent one."""
    m = mode_value(df.filter(F.col(by).isNotNull()), [by], value, "_mode").withColumnRenamed(by, "_by")
    return df.join(m, F.col(by) == F.col("_by"), "left").withColumn(value, F.coalesce(value, "_mode")).drop("_by", "_mode")
