"""Registered queries over scans, sinks and incremental forms: tables are written in the source's layout, then read back."""
from pyspark.sql import functions as F

from ..sources import readers as R, sinks as K
from ..streaming import streams as ST
from .report_queries import _MC, _WORDS
from .tables import Catalog, table, view

C = Catalog()


def _csv(spark, df, header=True):
    path = K.stage_folder(spark, "csv")
    df.write.option("header", header).option("escape", '"').csv(path)
    return path


@C.add("scan_csv_union", "select cast(lic as varchar) as lic, addr, zip from (select *, row_number() over (partition by lic%1000 order by lic) as rn from fx_address) where rn=1", ["fx_address"])
def scan_csv_union(spark, sf):
    a = view(spark, sf, "fx_address")
    path = K.stage_folder(spark, "csv")
    for part in (0, 1):
        a.filter(F.col("lic") % 2 == part).select(F.lpad((F.col("lic") % 1000).cast("string"), 4, "0").alias("License Key"), F.lpad(F.col("lic").cast("string"), 12, "0").alias("License Number"), F.col("addr").alias("Street Address"), F.col("zip").alias("Zip")) \
            .write.option("header", True).csv(f"{path}/district={part}")
    cols = ["License Key", "License Number", "Street Address", "Zip"]
    d = R.scan_csv_union(spark, f"{path}/*", cols, {"License Key": "k", "License Number": "lic", "Street Address": "addr", "Zip": "zip"}, key=["k"], order=[F.asc("lic")])
    return d.select(F.col("lic").cast("bigint").cast("string").alias("lic"), "addr", "zip")


@C.add("scan_schema_evolve", "select event_id, user_id as num, event_id%4 as hp, case when event_id%2=0 then event_id%6 end as v01 from events where event_id%10<>0 or event_id%2=1")
def scan_schema_evolve(spark, sf):
    e = table(spark, sf, "events")
    old = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("INSP_NO"), F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias(" LICENSE_NO "), F.when(F.col("event_id") % 10 == 0, "Lodging").when(F.col("event_id") % 4 == 0, "food ").alias("INSPCLASS"), (F.col("event_id") % 4).cast("string").alias("HIGH_VIOL"), (F.col("event_id") % 6).cast("string").alias("V_01"))
    new = e.filter("event_id % 2 = 1").select(F.col("event_id").alias("Inspection  Number"), F.col("user_id").cast("string").alias("License Number"), (F.col("event_id") % 4).cast("string").alias("High Priority"))
    alias = {"INSP_NO": "Inspection Number", "LICENSE_NO": "License Number", "INSPCLASS": "Inspection Class", "HIGH_VIOL": "High Priority"}
    d = R.scan_schema_evolve([old, new], alias, keep=("Inspection Class", "Food"), types={"License Number": "bigint", "High Priority": "int", "Violation 01": "int"})
    return d.select(F.col("Inspection Number").alias("event_id"), F.col("License Number").alias("num"), F.col("High Priority").alias("hp"), F.col("Violation 01").alias("v01"))


@C.add("scan_tagged_union", "select event_id, case when event_id%3=0 then '2324' when event_id%3=1 then '2425' else 'cur' end as src from events")
def scan_tagged_union(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    base = K.stage_folder(spark, "years")
    for tag, part in (("insp_2324", 0), ("insp_2425", 1), ("fdinspi", 2)):
        e.filter(F.col("event_id") % 3 == part).write.parquet(f"{base}/{tag}")
    d = R.scan_tagged_union([(spark.read.parquet(f"{base}/insp_2324", f"{base}/insp_2425"), r"insp_(\d{4})", "old"), (spark.read.parquet(f"{base}/fdinspi"), r"insp_(\d{4})", "cur")])
    return d.select("event_id", "src")


@C.add("scan_headerless", "select o_orderkey, case when o_orderkey%10=0 then null else strftime(o_orderdate,'%Y-%m-%d') end as order_date, case when o_orderkey%7=0 then null else o_totalprice end as fine from orders")
def scan_headerless(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit("13/45/2024")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("d"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("f"))
    d = R.scan_headerless(spark, _csv(spark, o, False), ["o_orderkey", "order_date", "fine"], dates=["order_date"], numbers=["fine"])
    return d.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), "fine")


def _boxed(spark, sf):
    p = view(spark, sf, "fx_place")
    src = F.array(*[F.struct(F.when(F.col("id") % 2 == k, "meta").otherwise("other").alias("dataset"), F.col("brand").alias("record")) for k in (0, 1)])
    d = p.select("id", "name", "category", F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax")).alias("bbox"), src.alias("sources"),
                 F.array(F.struct(F.lit("FL").alias("value")), F.struct(F.col("county_id").cast("string").alias("value"))).alias("address_levels"))
    path = K.stage_folder(spark, "boxes")
    K.write_stage(d, path)
    return path


@C.add("scan_bbox_parquet", "select id, name from fx_place where lon between -85 and -83 and lat between 25 and 28", ["fx_place"])
def scan_bbox_parquet(spark, sf):
    return R.scan_bbox(spark, _boxed(spark, sf), xmin=-85.0, xmax=-83.0, ymin=25.0, ymax=28.0, columns=("id", "name"))


@C.add("scan_array_project", "select id, case when id%2=0 then 'meta,other' else 'other,meta' end as ds, 2 as n from fx_place where category in ('PROMO','ECONOMY')", ["fx_place"])
def scan_array_project(spark, sf):
    d = spark.read.parquet(_boxed(spark, sf)).filter(F.col("category").isin("PROMO", "ECONOMY"))
    return d.select("id", F.array_join(R.array_field("sources", "dataset"), ",").alias("ds"), F.size("sources").alias("n"))


@C.add("scan_address_points", "select id, 'FL' as state, cast(county_id as varchar) as muni from fx_place where lon between -85 and -83 and lat between 25 and 28", ["fx_place"])
def scan_address_points(spark, sf):
    return R.scan_address_points(spark, _boxed(spark, sf), xmin=-85.0, xmax=-83.0, ymin=25.0, ymax=28.0).select("id", "state", "muni")


@C.add("scan_polygons", "select name, round(x0,3)||','||round(y0,3) as corner, 4 as points from fx_polygon where county_id%2=0", ["fx_polygon"])
def scan_polygons(spark, sf):
    p = view(spark, sf, "fx_polygon")
    pt = lambda x, y, s=0.0: F.struct((F.col(x) + F.lit(s)).alias("x"), F.col(y).alias("y"))
    ring = F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1"))
    tiny = F.array(pt("x0", "y0"), pt("x0", "y0", 0.0001), pt("x0", "y1", 0.0001))
    d = R.scan_polygons(p.withColumn("polygons", F.array(ring, tiny)), where=F.col("county_id") % 2 == 0, name="name", polygons="polygons", min_area=0.001, digits=3)
    first = F.get("ring", 0)
    return d.select("name", F.concat_ws(",", first["x"].cast("string"), first["y"].cast("string")).alias("corner"), F.size("ring").alias("points"))


def _docs_json(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array(F.col("lang"), F.col("source")).alias("category"), "n_chars", "text")
    path = K.stage_folder(spark, "jsonl")
    d.write.option("compression", "gzip").json(path)
    return path


@C.add("scan_jsonl_any", "select doc_id, n_chars from documents where (regexp_matches(source,'1') or regexp_matches(lang,'1')) and lang<>'de'")
def scan_jsonl_any(spark, sf):
    return R.scan_jsonl_any(spark, _docs_json(spark, sf), "doc_id bigint, category array<string>, n_chars bigint", "category", "1", ["^de$"]).select("doc_id", "n_chars")


@C.add("scan_prefilter_text", "select doc_id, n_chars from documents where contains(text,'this') or contains(source,'this')")
def scan_prefilter_text(spark, sf):
    return R.scan_prefilter_text(spark, _docs_json(spark, sf), "this", "doc_id bigint, n_chars bigint")


@C.add("scan_json_variant", "select id, name from fx_place where not (id//100)%5=4", ["fx_place"])
def scan_json_variant(spark, sf):
    """Places in research files of at most a hundred rows: plain lists, wrapped lists, and some unreadable files."""
    p = view(spark, sf, "fx_place").select("id", "name", F.floor(F.col("id") / 100).alias("file_no"))
    j = p.groupBy("file_no").agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("j"))
    kind = F.col("file_no") % 5
    doc = F.when(kind == 0, F.col("j")).when(kind == 1, F.concat(F.lit('{"places": '), "j", F.lit("}"))).when(kind.isin(2, 3), F.concat(F.lit('{"restaurants": '), "j", F.lit("}"))).otherwise(F.concat(F.lit("[broken"), "j"))
    path = K.stage_folder(spark, "research")
    j.select(doc.alias("value")).write.text(path)
    return R.scan_json_variant(spark, path, "id:bigint,name:string", whole_files=False)[0].select("id", "name")


@C.add("sink_parquet_stage", "select l_returnflag, count(*) as n, round(sum(l_quantity),2) as qty from lineitem group by 1")
def sink_parquet_stage(spark, sf):
    d = K.write_stage(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), K.stage_folder(spark, "stage"))
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@C.add("sink_partitioned_detail", "select c_custkey as id, c_nationkey%5 as region, c_name as name, case when c_acctbal>0 then c_acctbal end as bal from customer")
def sink_partitioned_detail(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("region"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))
    core, detail = K.split_core_detail(c, id="id", shard="region", core=["name"], detail=["bal"])
    path = K.stage_folder(spark, "detail")
    K.write_shards(detail, path, "region", sort=["id"], buckets=4, key="id")
    back = spark.read.parquet(path).select(F.col("id").alias("_id"), "bal")
    return core.join(back, F.col("id") == F.col("_id"), "left").select("id", "region", "name", "bal")


# --- incremental forms ------------------------------------------------------------------------------------------------------------
def _run(spark, stream, keys, mode="update"):
    out = K.stage_folder(spark, "stream")
    ST.run_to_table(stream, f"{out}/table", f"{out}/checkpoint", mode=mode)
    return ST.read_latest(spark, f"{out}/table", keys)


def _events(spark, sf):
    return ST.read_stream(spark, sf, "events.parquet")


@C.add("stream_dedupe_visits", "select user_id, day, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from (select *, strftime(ts,'%Y-%m-%d') as day from events) group by 1,2")
def stream_dedupe_visits(spark, sf):
    e = _events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    got = _run(spark, ST.dedupe_visits(e, keys=["user_id", "day"], time="ts", delivery="event_id", fields=["event_type", "event_id"]), ["user_id", "day", "period"])
    return ST.merged_visits(got, keys=["user_id", "day"], fields=["event_type", "event_id"])


@C.add("stream_publication_lag", "select event_id from events where cast(ts as date)<=date '2024-01-20'")
def stream_publication_lag(spark, sf):
    return _run(spark, ST.publication_lag(_events(spark, sf), time="ts", fetched="2024-01-27"), ["event_id"], mode="append").select("event_id")


@C.add("stream_latest_state", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as visits, arg_max(event_type, (ts, event_id))<>'error' as in_era from events group by 1")
def stream_latest_state(spark, sf):
    s = ST.latest_state(_events(spark, sf), key="user_id", time="ts", order=["ts", "event_id"], ok=F.col("event_type") != "error", fields=["event_type"])
    return ST.merged_state(_run(spark, s, ["user_id", "period"]), key="user_id")


@C.add("stream_verdict_ttl", "select cast(user_id as varchar) as url, case when arg_max(event_type,(date_trunc('second',ts), event_id))='error' then 'expired' else 'fresh' end as state from (select *, row_number() over (partition by user_id, date_trunc('second',ts) order by event_id) as rn from events) where rn=1 group by 1")
def stream_verdict_ttl(spark, sf):
    v = _events(spark, sf).select(F.col("user_id").cast("string").alias("url"), (F.col("event_type") == "view").alias("ok"), F.when(F.col("event_type") == "error", 2).otherwise(3).alias("v"), F.col("ts").alias("at"))
    stored = _run(spark, ST.verdict_ttl(v), ["url", "period"])
    newest = stored.agg(F.timestamp_seconds(F.max("at_"))).scalar()
    return ST.verdicts_at(stored, now=newest, rules=3).select("url", "state")


@C.add("stream_mention_counts", _MC.replace("from fx_review) where", "from (select documents.doc_id as doc_id, source as gmap_id, text, cast(n_chars%5 as double) as rating from documents)) where"))
def stream_mention_counts(spark, sf):
    d = ST.read_stream(spark, sf, "documents.parquet").select(F.col("source").alias("gmap_id"), "text", (F.col("n_chars") % 5).cast("double").alias("rating"))
    return _run(spark, ST.mention_counts_stream(d, _WORDS, by="gmap_id", prefilter="this|the|erin"), ["gmap_id"])


@C.add("stream_weekly_counts", "select strftime(date '1970-01-01' + cast(7*floor(date_diff('day', date '1970-01-01', cast(ts as date))/7.0) as int),'%Y-%m-%d') as week, event_type, count(*) as n from events group by 1,2")
def stream_weekly_counts(spark, sf):
    w = ST.weekly_counts(_events(spark, sf), time="ts", kind="event_type").withColumn("week", F.date_format("week", "yyyy-MM-dd"))
    return _run(spark, w, ["week", "event_type"])
