"""Streams give what the batch rules give, whatever the order of arrival; readers never fail on bad values."""
import datetime as dt
import json
import time

from pyspark.sql import functions as F

from wayfound.operators import stats, visits as V
from wayfound.sources import readers as R, sinks as K
from wayfound.streaming import streams as ST

DAY = dt.datetime(2024, 1, 1)


def feed(spark, folder, batches, schema):
    """One file per batch, oldest first."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in{i}")
        time.sleep(0.05)
    df = spark.read.parquet(*[f"{folder}/in{i}" for i in range(len(batches))])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")
    return df, stream


def run(spark, folder, stream, keys, mode="update"):
    ST.run_to_table(stream, f"{folder}/out", f"{folder}/ck", mode=mode)
    return ST.read_latest(spark, f"{folder}/out", keys)


def test_state_and_dedupe_equal_batch(spark, tmp_path):
    rows = [(k, n, DAY + dt.timedelta(hours=(n * 7 + k) % 60), f"d{n % 4}", n % 5 != 0) for k in range(5) for n in range(12)]
    df, stream = feed(spark, str(tmp_path), [rows[::2], rows[1::2]], "key int, insp_no int, ts timestamp, disp string, ok boolean")
    got = ST.merged_state(run(spark, f"{tmp_path}/a", ST.latest_state(stream, key="key", time="ts", order=["ts", "insp_no"], ok=F.col("ok"), fields=["disp", "insp_no"]), ["key", "period"]), key="key")
    assert {r.visits for r in got.collect()} == {12}
    last = V.latest_visit(df.withColumn("visit", F.lit(1)).withColumn("date", F.col("ts")), "key")
    assert {(r.key, r.insp_no, r.in_era) for r in got.collect()} == {(r.key, r.insp_no, r.ok) for r in last.collect()}
    dd = run(spark, f"{tmp_path}/b", ST.dedupe_visits(stream, keys=["key", "disp"], time="ts", delivery="insp_no", fields=["insp_no"]), ["key", "disp", "period"])
    dd = ST.merged_visits(dd, keys=["key", "disp"], fields=["insp_no"])
    want = df.groupBy("key", "disp").agg(F.max("insp_no").alias("n"))
    assert {tuple(r) for r in dd.select("key", "disp", "insp_no").collect()} == {tuple(r) for r in want.collect()}
    weeks = run(spark, f"{tmp_path}/c", ST.weekly_counts(stream, time="ts", kind="disp"), ["week", "disp"])
    assert sum(r.n for r in weeks.collect()) == len(rows)


def test_first_delivery_and_lag(spark, tmp_path):
    rows = [(k, DAY + dt.timedelta(hours=k)) for k in range(10)]
    _, stream = feed(spark, str(tmp_path), [rows, rows], "key int, ts timestamp")
    assert run(spark, f"{tmp_path}/a", ST.dedupe_first(stream, keys=["key"], time="ts"), ["key"], mode="append").count() == 10
    assert run(spark, f"{tmp_path}/b", ST.publication_lag(stream, time="ts", fetched="2024-01-08"), ["key"], mode="append").count() == 10
    assert run(spark, f"{tmp_path}/c", ST.publication_lag(stream, time="ts", fetched="2024-01-07"), ["key"], mode="append").count() == 0


def test_verdicts_expire(spark, tmp_path):
    b1 = [("u1", True, 3, DAY), ("u2", True, 2, DAY), ("u3", True, 3, DAY + dt.timedelta(days=40))]
    b2 = [("u4", True, 3, DAY + dt.timedelta(days=60)), ("u3", False, 3, DAY)]
    _, stream = feed(spark, str(tmp_path), [b1, b2], "url string, ok boolean, v int, at timestamp")
    stored = run(spark, f"{tmp_path}/a", ST.verdict_ttl(stream), ["url", "period"])
    at = lambda days: {r.url: (r.state, r.ok) for r in ST.verdicts_at(stored, now=F.lit(DAY + dt.timedelta(days=days)), rules=3).collect()}
    assert at(60) == {"u1": ("expired", True), "u2": ("expired", True), "u3": ("fresh", True), "u4": ("fresh", True)}
    assert at(90)["u3"] == ("expired", True) and at(44)["u1"] == ("fresh", True) and at(45)["u1"] == ("expired", True)


def test_state_ends_with_its_period(spark, tmp_path):
    """Three batches, rows repeated and late within the delay: the result is the batch result, and state of past periods is gone."""
    day = lambda k, d, n: (k, n, DAY + dt.timedelta(days=d), f"d{n}", n != 3)
    batches = [[day(1, 0, 1), day(2, 0, 1)], [day(1, 20, 2), day(1, 0, 1), day(2, 15, 3)], [day(1, 40, 4), day(2, 39, 5), day(2, 38, 6)]]
    df, stream = feed(spark, str(tmp_path), batches, "key int, insp_no int, ts timestamp, disp string, ok boolean")
    rule = ST.latest_state(stream, key="key", time="ts", order=["ts", "insp_no"], ok=F.col("ok"), fields=["disp"])
    query = rule.writeStream.outputMode("update").foreachBatch(lambda b, no: b.withColumn("batch_no", F.lit(no)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={no:09d}")) \
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = ST.merged_state(ST.read_latest(spark, f"{tmp_path}/out", ["key", "period"]), key="key")
    visits = {r["key"]: r["count"] for r in df.groupBy("key").count().collect()}                    # a repeated row counts, as in the batch rule
    assert {(r.key, r.disp, r.visits, r.in_era) for r in got.collect()} == {(1, "d4", visits[1], True), (2, "d5", visits[2], True)}
    assert held[-1] <= 3


def test_mentions_grow(spark, tmp_path):
    pat = {"crab": r"\bstone crabs?\b", "pie": r"\bkey lime\b"}
    _, stream = feed(spark, str(tmp_path), [[("a", "Stone crab!", 5.0), ("a", "nothing", 1.0)], [("a", "more STONE CRABS and key lime", 3.0), ("b", "key lime", None)]], "g string, text string, rating double")
    df = spark.read.parquet(f"{tmp_path}/in*")
    got = run(spark, f"{tmp_path}/a", ST.mention_counts_stream(stream, pat, by="g"), ["g"]).collect()
    want = stats.mention_counts(df, pat, by="g", prefilter="(?i)crab|lime").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} == {("a", 2, 1, 4.0, 3.0), ("b", 0, 1, None, None)}


def test_csv_keeps_empty_text_and_bad_values(spark, tmp_path):
    (tmp_path / "d1.csv").write_text('Key,Name,Zip\n1,"Gull, ""Rock""",33101\n2,,\n')
    (tmp_path / "d2.csv").write_text("Key,Name,Zip\n2,Harbor,34102\n")
    d = R.scan_csv_union(spark, str(tmp_path / "d*.csv"), ["Key", "Name", "Zip"], {"Key": "k", "Name": "n"})
    assert sorted(map(tuple, d.collect())) == [("1", 'Gull, "Rock"'), ("2", ""), ("2", "Harbor")]
    (tmp_path / "h.csv").write_text("7,12/31/2024,5.5\n8,99/99/2024,x\n")
    h = R.scan_headerless(spark, str(tmp_path / "h.csv"), ["c", "d", "f"], dates=["d"], numbers=["f"])
    assert [tuple(r) for r in h.orderBy("c").collect()] == [("7", dt.date(2024, 12, 31), 5.5), ("8", None, None)]


def test_json_variants(spark, tmp_path):
    docs = {"a": json.dumps([{"id": 1, "name": "x"}]), "b": json.dumps({"places": [{"id": 2, "name": "y"}]}, indent=1), "c": json.dumps({"restaurants": [{"id": 3}]}), "d": "[broken"}
    for k, v in docs.items():
        (tmp_path / f"{k}.json").write_text(v)
    items, bad = R.scan_json_variant(spark, str(tmp_path / "*.json"), "id:bigint,name:string")
    assert sorted((r.id, r.name) for r in items.select("id", "name").collect()) == [(1, "x"), (2, "y"), (3, None)] and [r.file[-6:] for r in bad.collect()] == ["d.json"]


def test_bbox_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "named_struct('xmin', id*1.0D, 'xmax', id*1.0D, 'ymin', 1D, 'ymax', 1D) bbox", "repeat('x', 100) wide").write.parquet(str(tmp_path / "p"))
    d = R.scan_bbox(spark, str(tmp_path / "p"), xmin=3, xmax=5, ymin=0, ymax=2, columns=("id",))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 3 and "PushedFilters" in plan and "bbox.xmin" in plan and "wide" not in plan


def test_shards_are_replaced_one_by_one(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, 1.0), (2, "b", "n", None), (3, "b", None, None)], "id int, region string, name string, bal double")
    core, detail = K.split_core_detail(df, id="id", shard="region", core=["name"], detail=["bal"])
    assert core.count() == 3 and detail.count() == 1
    K.write_shards(df, str(tmp_path / "s"), "region")
    K.write_shards(df.filter("id = 2"), str(tmp_path / "s"), "region")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.id for r in back.collect()) == [1, 2] and [r.region for r in K.stale_shards(back, df.filter("id = 2"), "region").collect()] == ["a"]


def test_current_era(spark):
    rows = [(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True), (2, 1, True), (2, 2, False), (3, 1, None)]
    df = spark.createDataFrame(rows, "key int, insp_no int, ok boolean").withColumn("date", F.lit("2024-01-01").cast("date")).withColumn("visit", F.lit(1))
    assert sorted((r.key, r.insp_no) for r in V.current_era(df, "key", F.col("ok")).collect()) == [(1, 3), (1, 4), (3, 1)]
