"""Registered queries over time lines, grouping sets, merged facts, the cuisine cascade, quarantined records, published files and keyed streams."""
from pyspark.sql import functions as F

from ..operators import classify as K, snapshots as S, stats, timeline as T
from ..sources import readers as R, sinks
from ..streaming import keyed, streams as ST
from .tables import Catalog, table, view

C = Catalog()

# periods of a license: from each purchase for some days, open where the number is a multiple of 11; two periods of a license may overlap or start on one day
_PERIODS = "periods as (select user_id as key, cast(ts as date) as start, case when event_id%11<>0 then cast(ts as date)+cast(event_id%9 as int) end as \"end\", 'P'||cast(event_id%4 as varchar) as status from events where event_type='purchase')"


def _periods(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'purchase'")
    day = F.to_date("ts")
    return e.select(F.col("user_id").alias("key"), day.alias("start"), F.when(F.col("event_id") % 11 != 0, F.date_add(day, (F.col("event_id") % 9).cast("int"))).alias("end"),
                    F.concat(F.lit("P"), (F.col("event_id") % 4).cast("string")).alias("status"))


@C.add("status_at", f"""with {_PERIODS}, s as (select key, start, max(struct_pack(open := "end" is null, e := "end", status := status)) as v from periods group by key, start),
 c as (select num as key, date as start, max(struct_pack(open := reopened is null, e := reopened, reason := reason)) as v from fx_closure group by num, date)
 select v.insp_no as insp_no, v.key as key, case when s.v.open or v.date < s.v.e then s.v.status end as status, case when c.v.open or v.date < c.v.e then c.v.reason end as closed
 from fx_visit v asof left join s on v.key=s.key and v.date>=s.start asof left join c on v.key=c.key and v.date>=c.start""", ["fx_visit", "fx_closure"])
def status_at(spark, sf):
    """License period and closure in force on the day of every visit."""
    v = view(spark, sf, "fx_visit").select("insp_no", "key", "date")
    licensed = T.status_at(v, _periods(spark, sf), key="key", time="date")
    closures = view(spark, sf, "fx_closure").select(F.col("num").alias("key"), "date", "reopened", F.col("reason").alias("closed"))
    return T.status_at(licensed, closures, key="key", time="date", start="date", end="reopened", fields=["closed"]).select("insp_no", "key", "status", "closed")


@C.add("spans_at", f"with {_PERIODS} select v.insp_no as insp_no, p.status as status, strftime(p.start,'%Y-%m-%d') as since from fx_visit v join periods p on v.key=p.key and p.start<=v.date and (p.\"end\" is null or v.date<p.\"end\")", ["fx_visit"])
def spans_at(spark, sf):
    """Every period of its license that holds the day of a visit, overlapping ones too."""
    v = view(spark, sf, "fx_visit").select("insp_no", "key", "date")
    return T.spans_at(v, _periods(spark, sf), key="key", time="date", days=7).select("insp_no", "status", F.date_format("span_start", "yyyy-MM-dd").alias("since"))


_CHAINS = """select user_id as key, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as first, strftime(max(ts),'%Y-%m-%d %H:%M:%S') as last, count(*) as visits, count(*) filter (event_type='error') as found from
 (select *, sum(fresh) over (partition by user_id order by ts, event_id) as chain from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 18 hours then 0 else 1 end as fresh from events)) group by user_id, chain"""


def _said(chains):
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return chains.select(F.col("user_id").alias("key"), t("first"), t("last"), "visits", "found")


@C.add("visit_chains", _CHAINS)
def visit_chains(spark, sf):
    return _said(T.visit_chains(table(spark, sf, "events"), key="user_id", time="ts", gap="18 hours", found=F.col("event_type") == "error"))


@C.add("stream_visit_chains", _CHAINS)
def stream_visit_chains(spark, sf):
    """Chains on a stream: session windows that grow and join as visits come in; the newest row of a chain counts."""
    e = ST.read_stream(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days")
    out = sinks.stage_folder(spark, "stream")
    ST.run_to_table(T.visit_chains(e, key="user_id", time="ts", gap="18 hours", found=F.col("event_type") == "error"), f"{out}/table", f"{out}/checkpoint", mode="complete")
    return _said(ST.read_latest(spark, f"{out}/table", ["user_id", "first"]))


@C.add("counts_before", """with d as (select key, date, count(*) as n, count(*) filter (disp='error') as eo from fx_visit group by 1,2)
 select key, strftime(date,'%Y-%m-%d') as day, cast(sum(n) over w as bigint) as n, cast(sum(eo) over w as bigint) as eo from d window w as (partition by key order by date range between interval 6 days preceding and current row)""", ["fx_visit"])
def counts_before(spark, sf):
    return T.counts_before(view(spark, sf, "fx_visit"), key="key", day="date", days=7, counted={"eo": F.col("disp") == "error"}).select("key", F.date_format("date", "yyyy-MM-dd").alias("day"), "n", "eo")


_SLIDING = """select strftime(date '1970-01-01' + cast(7*k as int),'%Y-%m-%d') as start, event_type, count(*) as n from
 (select event_type, unnest(range(cast(floor(d/7.0) as bigint)-3, cast(floor(d/7.0) as bigint)+1)) as k from (select event_type, date_diff('day', date '1970-01-01', cast(ts as date)) as d from events)) group by 1,2"""


@C.add("sliding_counts", _SLIDING)
def sliding_counts(spark, sf):
    return T.sliding_counts(table(spark, sf, "events"), time="ts", kind="event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@C.add("stream_sliding_counts", _SLIDING)
def stream_sliding_counts(spark, sf):
    e = ST.read_stream(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days")
    out = sinks.stage_folder(spark, "stream")
    ST.run_to_table(T.sliding_counts(e, time="ts", kind="event_type"), f"{out}/table", f"{out}/checkpoint")
    return ST.read_latest(spark, f"{out}/table", ["start", "event_type"]).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


# --- grouping sets
_MEASURES = "count(*) as n, count(*) filter (founded is not null) as dated, round(avg(price),4) as price"
_NAMED = "p as (select *, case when county_id%6=0 then null else cast(county_id as varchar) end as county, cast(county_id%4 as varchar) as region, category as kind from fx_place)"
_SETS = "coalesce(county,'unknown') as county"


def _grouped(spark, sf):
    p = view(spark, sf, "fx_place")
    p = p.select(F.when(F.col("county_id") % 6 != 0, F.col("county_id").cast("string")).alias("county"), (F.col("county_id") % 4).cast("string").alias("region"), F.col("category").alias("kind"), "founded", "price")
    return p, {"n": F.count("*"), "dated": F.count("founded"), "price": F.round(F.avg("price"), 4)}


def _set_sql(sets, dims):
    name = lambda d: f"case when grouping({d})=1 then 'all' else {d} end as {d}"
    return f"with {_NAMED}, q as (select region, {_SETS}, kind, founded, price from p) select {', '.join(name(d) for d in dims)}, cast(grouping({', '.join(dims)}) as bigint) as level, {_MEASURES} from q group by {sets}"


@C.add("report_cube", _set_sql("cube (region, county, kind)", ["region", "county", "kind"]), ["fx_place"])
def report_cube(spark, sf):
    """State, region, county and kind in all combinations, a missing county apart from the total."""
    p, m = _grouped(spark, sf)
    return stats.grouped_report(p, ["region", "county", "kind"], m)


@C.add("report_rollup", _set_sql("rollup (region, county, kind)", ["region", "county", "kind"]), ["fx_place"])
def report_rollup(spark, sf):
    p, m = _grouped(spark, sf)
    return stats.grouped_report(p, ["region", "county", "kind"], m, sets="rollup")


@C.add("report_sets", _set_sql("grouping sets ((region), (county, kind), ())", ["region", "county", "kind"]), ["fx_place"])
def report_sets(spark, sf):
    p, m = _grouped(spark, sf)
    return stats.grouped_report(p, ["region", "county", "kind"], m, sets=[["region"], ["county", "kind"], []])


# --- merged facts
@C.add("merge_facts", """with v as (select county_id, brand, count(distinct category) as category_n, list_slice(list_sort(list(distinct category)),1,5) as c, min(founded) as founded, arg_max(name, (confidence, id)) as name from fx_place group by 1,2)
 select county_id, brand, founded, name, array_to_string(c,'|') as category, category_n from v""", ["fx_place"])
def merge_facts(spark, sf):
    p = view(spark, sf, "fx_place")
    m = stats.merge_facts(p, ["county_id", "brand"], least=["founded"], best={"name": ["confidence", "id"]}, lists={"category": 5})
    return m.select("county_id", "brand", "founded", "name", F.array_join("category", "|").alias("category"), "category_n")


@C.add("ordered_first_and_rest", """with f as (select county_id, category, min(id) as o from fx_place group by 1,2), r as (select *, row_number() over (partition by county_id order by o, category) as place from f)
 select county_id, category, place from r""", ["fx_place"])
def ordered_first_and_rest(spark, sf):
    """The first eight kinds of a county from the bounded list, all others as rows."""
    p = view(spark, sf, "fx_place")
    first = stats.ordered_distinct(p, "county_id", "id", "category", "kinds", 8).select("county_id", F.posexplode("kinds").alias("at", "category"))
    return first.select("county_id", "category", (F.col("at") + 1).cast("long").alias("place")).unionByName(stats.ordered_rest(p, "county_id", "id", "category", 8).withColumn("place", F.col("place").cast("long")))


# --- cuisine cascade over the parts: a part's name gives the words, its size the categories, its type and size a taxonomy label of three levels
_CASCADE = """p as (select p_partkey as id, upper(p_name) as k, case when p_partkey%13=0 then p_name||' Café' else p_name end as raw, case when p_partkey%3=0 then null else lower(p_type)||' '||p_size%5||' '||p_size%2 end as label,
  case when p_partkey%4=0 then '' else (case p_size%4 when 0 then 'MED BOX' when 1 then 'BIG DRUM' when 2 then 'JAR' else 'BAG' end)||'|#'||p_size%3 end as cats, case when p_partkey%5=0 then 'bar' when p_partkey%5=1 then 'cafe' else 'x' end as kind, case when p_partkey%6=0 then p_brand end as brand from part),
 t as (select id, k, kind, brand, cats, label, raw, case when regexp_matches(k, '\\bRING\\b') then 'Pizza' when regexp_matches(k, '\\bRED\\b') then 'Thai' end as s1,
  case when label like 'promo%' then 'Grill' when label like 'economy%' then 'Café' when label like 'standard%' then 'Bakery' end as s2, case when regexp_matches(k, '\\bSMALL\\b') then 'Bar' end as s3,
  case when cats='' then null when regexp_matches(split_part(cats,'|',1),'BOX') then 'Deli' when regexp_matches(split_part(cats,'|',1),'DRUM') then 'Bar' when regexp_matches(split_part(cats,'|',2),'#1') then 'Steak' end as s4,
  case when cats='' and regexp_matches(upper(raw), '\\bCAF[EÉ]') then 'Café' end as s5 from p),
 a as (select *, coalesce(s1,s2,s3,s4,s5,'Other') as c, case when s1 is not null then 'name' when s2 is not null then 'taxonomy' when s3 is not null then 'weak name' when s4 is not null then 'category' when s5 is not null then 'word' else 'none' end as g from t),
 b as (select *, label like 'economy%' and c='Café' and cats<>'' and not regexp_matches(split_part(cats,'|',1),'JAR') as again from a),
 d as (select *, case when again then coalesce(s1,s3,s4,'Other') else c end as c2, case when again then case when s1 is not null or s3 is not null then 'name' when s4 is not null then 'category' else 'none' end else g end as g2 from b),
 e as (select *, case when c2='Other' and kind='bar' then 'Bar' when c2='Other' and kind='cafe' then 'Café' else c2 end as c3, case when c2='Other' and kind in ('bar','cafe') then 'kind' else g2 end as g3 from d),
 m as (select brand, c3 as chain from (select brand, c3, row_number() over (partition by brand order by (c3='Other'), count(*) desc, c3) as rn from e where brand is not null group by brand, c3) where rn=1)"""


@C.add("cuisine_cascade", f"with {_CASCADE} select e.id as id, case when e.brand is null then c3 when e.brand='Brand#11' then 'House' else chain end as cuisine, case when e.brand is null then g3 else 'brand' end as stage from e left join m on e.brand=m.brand")
def cuisine_cascade(spark, sf):
    i = F.col("p_partkey")
    kinds = lambda: F.when(i % 5 == 0, "bar").when(i % 5 == 1, "cafe").otherwise("x")
    part = table(spark, sf, "part")
    size = F.col("p_size")
    label = F.concat_ws(" ", F.lower("p_type"), (size % 5).cast("string"), (size % 2).cast("string"))
    cats = F.array(F.when(size % 4 == 0, "MED BOX").when(size % 4 == 1, "BIG DRUM").when(size % 4 == 2, "JAR").otherwise("BAG"), F.concat(F.lit("#"), (size % 3).cast("string")))
    p = part.select(i.alias("id"), F.upper("p_name").alias("k"), F.when(i % 13 == 0, F.concat("p_name", F.lit(" Café"))).otherwise(F.col("p_name")).alias("raw"),
                    F.when(i % 3 != 0, label).alias("label"), F.when(i % 4 != 0, cats).alias("cats"), kinds().alias("kind"), F.when(i % 6 == 0, F.col("p_brand")).alias("brand"))
    types = part.select(label.alias("label")).distinct()
    up = lambda n: F.expr(f"substring_index(label, ' ', {n})")
    parent = types.select("label", up(2).alias("parent")).unionByName(types.select(up(2).alias("label"), up(1).alias("parent"))).distinct()
    named = spark.createDataFrame([("promo", "Grill"), ("economy", "Café"), ("standard", "Bakery")], "label string, cuisine string")
    cafes = [r["label"] for r in types.filter("label like 'economy%'").collect()]           # types and ten size classes
    return K.cuisine_cascade(p, id="id", name_key="k", raw_name="raw", label="label", categories="cats", kind="kind", brand="brand",
                             name_rules=[("Pizza", r"\bRING\b"), ("Thai", r"\bRED\b"), ("Bar", r"\bSMALL\b")], category_rules=[("Deli", "BOX"), ("Bar", "DRUM"), ("Steak", "#1")], label_cuisine=named, taxonomy=parent,
                             cafe_labels=cafes, cafe="Café", cafe_categories="JAR", kind_cuisine={"bar": "Bar", "cafe": "Café"}, chain_cuisine={"Brand#11": "House"}, weak=["Bar"], other="Other")


# --- quarantined records
@C.add("scan_json_quarantine", """with p as (select id, name, id//100 as f from fx_place), r as (select f%5 as k, f, id, name from p)
 select 'item' as side, id, name, cast(null as varchar) as reason from r where k<>4 and id%17<>0 union all
 select 'item', null, null, 'a field has another type' from r where k<>4 and id%17=0 and id%2=0 union all select 'item', null, null, 'without name' from r where k<>4 and id%17=0 and id%2=1 union all
 select distinct 'document', cast(null as bigint), cast(f as varchar), 'not JSON' from r where k=4""", ["fx_place"])
def scan_json_quarantine(spark, sf):
    """Places in research files of both shapes with bad items and bad files: every one comes out once, on one side or the other."""
    p = view(spark, sf, "fx_place").select("id", "name", F.floor(F.col("id") / 100).alias("f"))
    item = F.when((F.col("id") % 17 == 0) & (F.col("id") % 2 == 0), F.concat(F.lit('{"id": "x", "name": "bad"}'))).when(F.col("id") % 17 == 0, F.concat(F.lit('{"id": '), "id", F.lit("}"))) \
        .otherwise(F.to_json(F.struct("id", "name")))
    j = p.groupBy("f").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ", "), F.lit("]")).alias("j"))
    kind = F.col("f") % 5
    doc = F.when(kind == 0, F.col("j")).when(kind == 1, F.concat(F.lit('{"places": '), "j", F.lit("}"))).when(kind.isin(2, 3), F.concat(F.lit('{"more": 1, "restaurants": '), "j", F.lit("}"))).otherwise(F.concat(F.lit("[broken "), F.col("f").cast("string")))
    path = sinks.stage_folder(spark, "research")
    j.select(doc.alias("value")).write.text(path)
    items, bad = R.scan_json_quarantine(spark, path, "id bigint, name string", required=["id", "name"], whole_files=False)
    whole = F.col("row").isNull()
    return items.select(F.lit("item").alias("side"), "id", "name", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.when(whole, "document").otherwise("item").alias("side"), F.lit(None).cast("long").alias("id"), F.when(whole, F.regexp_extract("text", "(\\d+)$", 1)).alias("name"), "reason"))


# --- published files
@C.add("published_verify")
def published_verify(spark, sf):
    """One file a source, with a flipped digest, missing and stray files, wrong counts, a bad version and a copy before that is gone. The files' digests are worked out from their texts here; the tests
    read real files with ``file_digests``."""
    d = table(spark, sf, "documents").groupBy(F.concat(F.lit("places-"), F.lower("source")).alias("name")).agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), ",").alias("ids"))
    day = "2024-06-30"
    body = F.concat(F.lit('{"generated": "' + day + '", "rows": ['), "ids", F.lit("]}"))
    made = d.select("name", "rows", body.alias("body")).withColumn("sha256", F.sha2("body", 256)).withColumn("path", F.concat("name", F.lit("-"), F.substring("sha256", 1, 12), F.lit(".json")))
    stored = made.select(F.col("path").alias("file"), F.octet_length("body").cast("long").alias("bytes"), "sha256", F.json_array_length(F.get_json_object("body", "$.rows")).cast("long").alias("rows"), F.get_json_object("body", "$.generated").alias("generated"))
    kind = F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(7))
    entries = made.select("name", "path", F.when(kind == 1, F.sha2("name", 256)).otherwise(F.col("sha256")).alias("sha256"), F.octet_length("body").cast("long").alias("bytes"), (F.col("rows") + (kind == 2).cast("long")).alias("rows"))
    head = spark.createDataFrame([(1, day + ".0", day, 1)], "schema int, version string, records_through string, min_build int")
    previous = made.filter(kind == 3).select("name", F.concat("name", F.lit("-0123456789ab.json")).alias("path"))
    return S.verify_published(head, entries.filter(kind != 4), stored.filter(F.substring("file", -6, 1) != "7"), previous, schema=1, main="places-src1")


# --- streams with keyed state
def _run(spark, stream, keys):
    keyed.use_keyed_state(spark)
    out = sinks.stage_folder(spark, "stream")
    ST.run_to_table(stream, f"{out}/table", f"{out}/checkpoint")
    return ST.read_latest(spark, f"{out}/table", keys)


@C.add("stream_keyed_state", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as visits, arg_max(event_type, (ts, event_id))<>'error' as in_era from events group by 1")
def stream_keyed_state(spark, sf):
    e = ST.read_stream(spark, sf, "events.parquet")
    pos = F.concat(F.lpad(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    s = keyed.latest_state(e, key="user_id", order=pos, ok=F.col("event_type") != "error", field="event_type")
    return _run(spark, s, ["user_id"])


@C.add("stream_keyed_verdicts", """with v as (select cast(user_id as varchar) as url, epoch_ms(ts) as t, event_type='view' as ok, case when event_type='error' then 2 else 3 end as v from events), n as (select max(t) as m from v),
 l as (select url, max(struct_pack(t := t, ok := ok, v := v)) as x from v group by url) select url, x.ok as ok, case when x.v=3 and x.t + 7*86400000 > m then 'fresh' else 'expired' end as state from l, n""")
def stream_keyed_verdicts(spark, sf):
    """Links whose verdict is due a week after it was given, as far as the stream's own time has come."""
    v = ST.read_stream(spark, sf, "events.parquet").select(F.col("user_id").cast("string").alias("url"), (F.col("event_type") == "view").alias("ok"), F.when(F.col("event_type") == "error", 2).otherwise(3).alias("v"), F.col("ts").alias("at"))
    return _run(spark, keyed.expiring_verdicts(v, rules=3, days=7), ["url"]).select("url", "ok", "state")
