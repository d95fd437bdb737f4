"""Pairs by name and place where names are scored first: the same pairs as with all candidates, and no work that grows with rows that nothing speaks for."""
import random

from pyspark.sql import functions as F

from wayfound.functions import similarity as S
from wayfound.operators import matching as M

LEFT = "lid long, county string, k string, nums array<string>, street string, lat double, lon double"
RIGHT = "rid long, county string, keys array<string>, nums array<string>, street string, lat double, lon double"
LIMITS = dict(addr_score=75.0, near_m=150.0, near_score=88.0, close_m=60.0, close_score=80.0, addr_max_m=2000.0)


def _sides(spark, n, seed=3):
    rng = random.Random(seed)
    names = ["OYSTER BARN", "OYSTER BAR", "OAK GRILL", "OAK GRIL", "PELICAN DINER", "PELICAN", "GULL"]
    streets = ["MAIN ST", "N MAIN ST", "MAIN AVE", "N", "OAK AVE", "", None]
    where = lambda: (rng.choice(["c1", "c2", None] + ["c1"] * 4), [rng.choice("1234") for _ in range(rng.randint(0, 3))], rng.choice(streets), *rng.choice([(None, -80.0), (26.0, None)] + [(26.0 + rng.randint(0, 40) * 5e-4, -80.0 + rng.randint(0, 3) * 3e-4)] * 9))
    def row(i, name):
        county, nums, street, lat, lon = where()
        return (i, county, name, nums, street, lat, lon)
    l = [row(i, rng.choice(names + ["", None])) for i in range(n)]
    r = [row(1000 + i, [rng.choice(names) for _ in range(rng.randint(0, 2))]) for i in range(n)]
    return spark.createDataFrame(l, LEFT), spark.createDataFrame(r, RIGHT)


def _plain(l, r, **limits):
    """All candidates worked out, as the rules say."""
    l = l.filter(F.col("k") != "").select("lid", F.col("county").alias("b"), F.col("k").alias("lk"), "nums", "street", "lat", "lon")
    return M._pairs_of_repeated(l, r.withColumnRenamed("county", "b"), town_words=None, **limits)


def _set(df):
    return sorted((x["lid"], x["rid"], round(x["score"], 6), x["rule"]) for x in df.collect())


def test_similar_names_meet_as_all_candidates_do(spark):
    l, r = _sides(spark, 70)
    rules = set()
    for limits in (LIMITS, LIMITS | dict(addr_score=95.0, addr_max_m=50.0, close_m=400.0)):
        want = _set(_plain(l, r, **limits))
        assert _set(M.similar_name_pairs(l, r, block="county", **limits)) == want
        rules |= {rule for *_, rule in want}
    assert rules == {"address", "near", "close"}


def test_rows_that_share_an_id_still_count_together(spark):
    l, r = _sides(spark, 30)
    l = l.unionByName(l.filter("lid < 8").withColumn("lat", F.lit(26.0)).withColumn("street", F.lit("MAIN ST"))).unionByName(l.filter("lid > 20"))
    r = r.unionByName(r.filter("rid < 1008").withColumn("lat", F.lit(26.001)).withColumn("nums", F.array(F.lit("1"), F.lit("2"))))
    assert _set(M.similar_name_pairs(l, r, block="county", **LIMITS)) == _set(_plain(l.distinct(), r, **LIMITS))


def test_work_on_names_at_one_address_does_not_grow_with_rows(spark, monkeypatch):
    seen, plain = [], M.on_distinct
    monkeypatch.setattr(M, "on_distinct", lambda df, *a, **k: (seen.append(df.count()), plain(df, *a, **k))[1])
    names = ["OYSTER BARN", "GULL"]
    for n in (20, 60):
        l = spark.createDataFrame([(i, "c1", names[i % 2], ["1"], "MAIN ST", 26.0 + i * 1e-5, -80.0) for i in range(n)], LEFT)
        r = spark.createDataFrame([(100 + i, "c1", [names[i % 2]], ["1"], "MAIN ST", 26.0, -80.0 + i * 1e-5) for i in range(n)], RIGHT)
        assert M.similar_name_pairs(l, r, block="county").count() == n * n // 2
    assert len(seen) == 2 and seen[0] == seen[1] <= 4


def _twin_rows(spark, n, first, rng):
    names = ["OYSTER BARN", "OYSTER BAR", "OYSTER BARNS", "OAK GRILL", "OAK GRIL", "PELICAN DINER", None]
    def row(i):
        name = rng.choice(names)
        return (first + i, name, name, rng.choice(["1", "2", "90", None]), rng.choice(["MAIN ST", "N MAIN ST", "OAK AVE", None]), rng.choice(["c1", "c1", "c2", None]), rng.choice([None] + [26.0 + rng.randint(0, 20) * 5e-4] * 9), -80.0 + rng.randint(0, 4) * 4e-4)
    return spark.createDataFrame([row(i) for i in range(n)], "id long, name string, k string, num string, street string, county string, lat double, lon double")


def test_near_twins_by_falling_likeness_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    l, r = _twin_rows(spark, 50, 0, rng), _twin_rows(spark, 60, 100, rng)
    pre = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in d.columns])
    pairs = pre(l, "l_").crossJoin(pre(r, "r_")).withColumn("dist", F.sqrt(F.pow((F.col("l_lat") - F.col("r_lat")) * 111000, 2) + F.pow((F.col("l_lon") - F.col("r_lon")) * 99000, 2)))
    gap = F.abs(F.col("l_num").cast("int") - F.col("r_num").cast("int"))
    pairs = pairs.filter((F.col("l_county").isNull() | (F.col("l_county") == F.col("r_county"))) & ((F.col("dist") <= 150) | (F.col("l_num") == F.col("r_num")) & (F.col("l_street") == F.col("r_street"))))
    pairs = pairs.filter(~F.coalesce(M.street_compat("l_street", "r_street") & (gap > 40), F.lit(False))).withColumn("same", S.same_business("l_name", "r_name")).filter("same")
    want = pairs.withColumn("s", S.sim_ratio("l_k", "r_k")).groupBy("l_id").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("r_id").alias("twin"))).alias("m"))
    want = {x["l_id"]: x["m"]["twin"] for x in want.collect()}
    blocks, plain = [], M.proximity_join
    monkeypatch.setattr(M, "proximity_join", lambda *a, **k: (blocks.append(("l_no" in (got := plain(*a, **k)).columns, k.get("block", ()))), got)[1])
    assert {x["id"]: x["twin"] for x in M.hand_checked_twin(l, r).collect()} == want
    assert all("rn" in b for _, b in blocks) and {asked for asked, _ in blocks} == {True, False}         # rows of other names never meet; either side is laid on cells
