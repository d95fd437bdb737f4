"""Rows that share their values do not meet pair by pair: no step puts out many more rows than went in."""
from pyspark.sql import functions as F

from wayfound.operators import matching as M


def most_rows(df) -> tuple[list, int]:
    """The rows of ``df`` and the most rows that a step of its plan put out."""
    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().get("numOutputRows")
        below = plan.children()
        return max([own.get().value() if own.isDefined() else 0] + [walk(below.apply(i)) for i in range(below.size())])
    rows = df.collect()
    df._jdf.collectToPython()
    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_places_of_one_name_in_a_town(spark):
    n = 3000
    u = spark.range(n).select("id", F.lit("t").alias("town"), F.lit("RED GRILL").alias("k"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("num"), F.lit("1 Main").alias("address"))
    p = spark.range(n).select((F.col("id") + 10).alias("pid"), F.lit("t").alias("town"), F.lit("RED GRILLE").alias("k"), (F.col("id") % 2 + 1).cast("string").alias("num"),
                              (25 + F.col("id") * 1e-9).alias("lat"), F.lit(-80.0).alias("lon"))
    rows, most = most_rows(M.point_by_name_town(u.drop("address"), p))
    assert most <= 4 * n
    assert {r.id: r.lat for r in rows} == {i: 25 + (1e-9 if i % 3 == 2 else 0) for i in range(n)}
    far = p.withColumn("lat", F.when(F.col("num") == "2", F.col("lat") + F.col("pid") % 4).otherwise(F.col("lat")))
    assert {r.id % 3 for r in M.point_by_name_town(u.drop("address"), far).collect()} == {1}
    assert M.geocode_todo(M.place_unplaced(u, p, spark.createDataFrame([], "address string, lat double, lon double"))).count() == 0


def test_merge_same_town_close_meets_few_rows_of_a_dense_town(spark, monkeypatch):
    import random
    rng = random.Random(22)
    rows = [(i, rng.choice("AB"), "T", rng.randint(1, 4), rng.choice([True, False, False, None]), 26 + rng.randint(0, 40) * 0.001, -81 + rng.randint(0, 40) * 0.001) for i in range(500)]
    rows += [(900, "C", "T", 1, False, 26.0, -81.0), (900, "D", "T", 3, False, 26.0, -81.0), (901, "C", "T", 2, False, 26.0, -81.0), (902, "D", "T", 1, False, 26.0, -81.0), (None, "D", "T", 1, False, 26.0, -81.0)]
    df = spark.createDataFrame(rows, "id int, name string, town string, rank int, lic boolean, lat double, lon double")
    edges = []
    inner = M.suppress
    monkeypatch.setattr(M, "suppress", lambda e: (edges.append(e.count()), inner(e))[1])
    monkeypatch.setattr(M, "FIRST_RANKS", 64)
    got = {r.loser: r.survivor for r in M.merge_same_town_close(df, id="id", name="name", town="town", rank="rank", licensed="lic", radius_m=800.0).collect()}
    want, kept = {}, []
    for r in sorted(rows[:500], key=lambda r: (-r[3], r[0])):
        hit = next((k for k in kept if k[1] == r[1] and not (k[4] is not False and r[4] is not False)
                    and (((k[5] - r[5]) * 111000) ** 2 + ((k[6] - r[6]) * 99000) ** 2) ** 0.5 < 800), None)
        if hit is None:
            kept.append(r)
        else:
            want[r[0]] = hit[0]
    assert {k: v for k, v in got.items() if k < 900} == want
    assert {k: v for k, v in got.items() if k >= 900} == {900: 901}         # 902 stays: what stood over it is gone
    assert sum(edges) < 4 * len(rows)


def test_match_listings_meets_few_rows_of_a_dense_county(spark, monkeypatch):
    import random
    from wayfound.operators.scale import top_rows
    rng = random.Random(1)
    names = ["GULL ROCK", "GULL ROCKS GRILL", "HARBOR SUN", "BLUE MOON", "GULL", "SUN HARBOR CAFE"]
    spot = lambda: (None if rng.random() < 0.05 else 26 + rng.random() * 0.05, -81 + rng.random() * 0.05)
    place = lambda n: (rng.sample(["12", "14", "16"], rng.randint(1, 2)), rng.choice(["MAIN ST", "MAIN AVE", "N", "OAK AVE"]), *spot()) if n < 120 else (["1"], "ELM ST", 27 + rng.random() * 0.01, -81 + rng.random() * 0.01)
    l = spark.createDataFrame([(i, "X" if i < 120 else "D", rng.choice(names) if i < 120 else "GULL ROCK", *place(i)) for i in range(420)], "lid int, c string, k string, nums array<string>, street string, lat double, lon double")
    r = spark.createDataFrame([(i, "X" if i < 120 else "D", rng.sample(names, 2) if i < 120 else ["GULL ROCK"], *place(i)) for i in range(420)], "rid int, c string, keys array<string>, nums array<string>, street string, lat double, lon double")
    best = top_rows(M.similar_name_pairs(l, r, block="c"), ["lid"], [F.desc("score"), F.asc("rid")]).collect()
    met, join = [], M.proximity_join
    monkeypatch.setattr(M, "proximity_join", lambda *a, **k: (lambda p: (met.append(p.count()), p)[1])(join(*a, **k)))
    monkeypatch.setattr(M, "similar_name_pairs", None)                       # no step makes all pairs
    got = M.match_listings(l, r, block="c").collect()
    assert {(x.lid, x.rid, round(x.score, 6), x.rule) for x in got} == {(x.lid, x.rid, round(x.score, 6), x.rule) for x in best} and len(got) == len(best) > 300
    assert sum(met) < 300 * 300 / 3
