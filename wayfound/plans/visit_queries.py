"""Registered queries over visit, closure and fine records."""
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions._col import lookup
from ..functions.text import norm_name
from ..operators import numbering as N, scale, visits as V
from .latest_results import EVENT_GROUP, SQL as LATEST_SQL, latest_results
from .tables import Catalog, table, view

C = Catalog()
C.add("latest_results_by_region", LATEST_SQL, ["fx_visit"])(latest_results)
_RN = "row_number() over (partition by key order by date desc, insp_no desc, visit desc)"
_GRP = "case disp when 'view' then 0 when 'click' then 0 when 'purchase' then 1 when 'error' then 2 end"
def _ok():
    return F.col("ok_name")



@C.add("license_number", "select l_orderkey, l_linenumber, l_partkey, case when l_linenumber%2=0 then cast(l_partkey as varchar) else concat('sea', cast(l_partkey as varchar)) end as num from lineitem")
def license_number(spark, sf):
    li = table(spark, sf, "lineitem")
    lic = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("SEA"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("sea"), F.col("l_partkey").cast("string")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", R.license_number(lic).alias("num"))


@C.add("code_maps", f"select key, insp_no, {_GRP} as grp from fx_visit", ["fx_visit"])
def code_maps(spark, sf):
    return view(spark, sf, "fx_visit").select("key", "insp_no", R.code_lookup("disp", EVENT_GROUP).alias("grp"))


@C.add("sparse_counts_string", """select event_id, array_to_string(list_filter([case when hp<>0 then '3:'||hp end, case when im<>0 then '22:'||im end, case when bs<>0 then '35:'||bs end], lambda x: x is not null), ',') as cats
 from (select event_id, cast(floor(value) as int)%5 as hp, event_id%4 as im, event_id%6 as bs from events)""")
def sparse_counts_string(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "cast(floor(value) as int)%5 hp", "event_id%4 im", "event_id%6 bs")
    return e.select("event_id", R.sparse_counts({22: F.col("im"), 3: F.col("hp"), 35: F.col("bs"), 46: F.col("bs")}).alias("cats"))


@C.add("license_in_grace", """select o_orderkey, (o_orderstatus='F' or (o_orderstatus='O' and date_diff('day', cast(o_orderdate as date), date '1998-07-01') between 0 and 90)) as active from orders""")
def license_in_grace(spark, sf):
    o = table(spark, sf, "orders")
    status = lookup({"F": "20", "O": "45"}, "o_orderstatus", "46")
    return o.select("o_orderkey", R.license_active(status, F.date_format("o_orderdate", "MM/dd/yyyy"), "1998-07-01").alias("active"))


@C.add("zip_valid", "select lic, case when regexp_matches(zip, '^3[234][0-9]{3}') then substr(zip,1,5) end as zip from (select lic, case when lic%3=0 then '9'||zip else zip||'-1234' end as zip from fx_address)", ["fx_address"])
def zip_valid(spark, sf):
    z = F.when(F.col("lic") % 3 == 0, F.concat(F.lit("9"), "zip")).otherwise(F.concat("zip", F.lit("-1234")))
    return view(spark, sf, "fx_address").select("lic", R.zip_valid(z).alias("zip"))


@C.add("publication_cutoff", "select insp_no, strftime(date, '%Y-%m-%d') as date from fx_visit where date <= date '2024-01-20' and date >= date '2024-01-05'", ["fx_visit"])
def publication_cutoff(spark, sf):
    return V.publication_cutoff(view(spark, sf, "fx_visit"), "date", "2024-01-27", since="2024-01-05").select("insp_no", R.iso_day("date").alias("date"))


@C.add("latest_visit", f"select key, insp_no, disp from (select *, {_RN} as rn from fx_visit) where rn=1", ["fx_visit"])
def latest_visit(spark, sf):
    return V.latest_visit(view(spark, sf, "fx_visit"), "key").select("key", "insp_no", "disp")


@C.add("latest_routine", f"select key, insp_no, hp, im, bs from (select *, {_RN} as rn from fx_visit where itype='Routine' and visit=1) where rn=1", ["fx_visit"])
def latest_routine(spark, sf):
    return V.latest_routine(view(spark, sf, "fx_visit"), "key", F.col("itype") == "Routine").select("key", "insp_no", "hp", "im", "bs")


_ERA = """select * from (select v.*, row_number() over w as rn, max(case when not ok_name then pos end) over (partition by key) as lastbad from
 (select *, row_number() over (partition by key order by date, insp_no, visit) as pos from fx_visit) v window w as (partition by key order by date desc, insp_no desc, visit desc)) where lastbad is null or pos > lastbad"""


@C.add("current_era", f"select key, insp_no, disp from ({_ERA})", ["fx_visit"])
def current_era(spark, sf):
    return V.current_era(view(spark, sf, "fx_visit"), "key", _ok()).select("key", "insp_no", "disp")


@C.add("history_top_n", "select key, string_agg(strftime(date,'%Y-%m-%d')||' '||disp, '; ' order by rn) as history, count(*) as shown from (select *, row_number() over (partition by key order by date desc, insp_no desc, visit desc) as rn from fx_visit) where rn<=12 group by key", ["fx_visit"])
def history_top_n(spark, sf):
    h = V.history_top_n(view(spark, sf, "fx_visit"), "key", ["date", "disp"], 12)
    return h.select("key", F.array_join(F.transform("history", lambda x: F.concat_ws(" ", R.iso_day(x["date"]), x["disp"])), "; ").alias("history"), F.size("history").alias("shown"))


@C.add("visit_counters", f"select key, count(*) as n, count(*) filter (disp='purchase') as eo from ({_ERA}) group by key", ["fx_visit"])
def visit_counters(spark, sf):
    return V.visit_counters(V.current_era(view(spark, sf, "fx_visit"), "key", _ok()), "key", F.col("disp") == "purchase")


@C.add("dedupe_keep_first", "select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn=1")
def dedupe_keep_first(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return V.dedupe_keep_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@C.add("dedupe_keep_last", "select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as rn from lineitem) where rn=1")
def dedupe_keep_last(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return V.dedupe_keep_last(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


def _closures(spark, sf):
    return view(spark, sf, "fx_closure").withColumnRenamed("num", "key")


@C.add("reopened_since_close", f"""with l as (select key, date, disp from (select *, {_RN} as rn from fx_visit) where rn=1 and disp='error')
 select l.key, strftime(max(c.reopened), '%Y-%m-%d') as reopened from l left join fx_closure c on c.num=l.key and c.date>=l.date and c.reopened>=c.date group by l.key""", ["fx_visit", "fx_closure"])
def reopened_since_close(spark, sf):
    last = V.latest_visit(view(spark, sf, "fx_visit"), "key").select("key", "date", "disp")
    out = V.reopened_since_close(last, _closures(spark, sf), "key", F.col("disp") == "error")
    return out.select("key", R.iso_day("reopened").alias("reopened"))


_CD = """with e as (select lic as eid, lic as num, concat('SHOP ', cast(lic%9 as varchar)) as name, cast(lic%900+1 as varchar) as no, zip as town from fx_address),
 c as (select cid, c.num, concat('SHOP ', cast(cid%9 as varchar)) as name, cast(cid%900+1 as varchar) as no, concat('32', lpad(cast(cid%40 as varchar),3,'0')) as town from fx_closure c)
 select cid, eid, 'number' as how from c join e on c.num=e.num where c.num<>9999999 and (c.name=e.name or c.no=e.no)
 union all select cid, eid, 'address' as how from c join e on c.no=e.no and c.town=e.town and c.name=e.name where c.num=9999999"""


@C.add("closure_disambiguation", _CD, ["fx_address", "fx_closure"])
def closure_disambiguation(spark, sf):
    shop = lambda c: F.concat(F.lit("Shop "), (F.col(c) % 9).cast("string"))
    street = lambda c: F.concat((F.col(c) % 900 + 1).cast("string"), F.lit(" Main St"))
    e = view(spark, sf, "fx_address").select(F.col("lic").alias("eid"), F.col("lic").alias("num"), shop("lic").alias("name"), "addr", F.col("zip").alias("town"))
    c = view(spark, sf, "fx_closure").select("cid", "num", shop("cid").alias("name"), street("cid").alias("addr"),
                                            F.concat(F.lit("32"), F.lpad((F.col("cid") % 40).cast("string"), 3, "0")).alias("town"))
    return V.closure_disambiguation(c, e, agree=lambda a, b: norm_name(a) == norm_name(b), sentinel=9999999)


_SUM = f"""with era as ({_ERA}), last as (select * from era where rn=1), rt as (select * from (select *, row_number() over (partition by key order by date desc, insp_no desc) as r2 from era where itype='Routine') where r2=1),
 cnt as (select key, count(*) as n, count(*) filter (disp='purchase') as eo, least(count(*),12) as n_hist from era group by key),
 cl as (select num, least(count(*),5) as n_closures from fx_closure group by num), fi as (select num, least(count(*),6) as n_fines from fx_fine group by num)
 select last.key as key, {_GRP.replace('disp', 'last.disp')} as g, strftime(last.date,'%Y-%m-%d') as d, strftime(rt.date,'%Y-%m-%d') as rd, rt.hp as hp, rt.im as im, rt.bs as bs, n, eo, n_hist, n_closures, n_fines
 from last left join rt on last.key=rt.key left join cnt on last.key=cnt.key left join cl on last.key=cl.num left join fi on last.key=fi.num"""


@C.add("inspection_summary", _SUM, ["fx_visit", "fx_closure", "fx_fine"])
def inspection_summary(spark, sf):
    fines = view(spark, sf, "fx_fine").withColumnRenamed("num", "key")
    s = V.inspection_summary(view(spark, sf, "fx_visit"), _closures(spark, sf), fines, key="key", ok=_ok(), routine=F.col("itype") == "Routine",
                             emergency=F.col("disp") == "purchase", group=lookup(EVENT_GROUP, "disp"))
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return s.select("key", "g", R.iso_day("d").alias("d"), R.iso_day("rd").alias("rd"), "hp", "im", "bs", "n", "eo", count("history").alias("n_hist"),
                    count("closures").alias("n_closures"), count("fines").alias("n_fines"))


# --- percentile rank, group statistics, encodings ----------------------------------------------------------------------------
@C.add("pct_rank_avg", """select id, round_even((r + (t-1)/2.0)/n*100, 1) as pct from (select id, rank() over (order by price) as r, count(*) over (partition by price) as t, count(*) over () as n
 from (select id, floor(price/10) as price from fx_place))""", ["fx_place"])
def pct_rank_avg(spark, sf):
    p = view(spark, sf, "fx_place").select("id", F.floor(F.col("price") / 10).alias("price"))
    return N.pct_rank_avg(p, "price").select("id", "pct")


@C.add("group_transform", "select id, round(median(lat) over (partition by county_id), 6) as med_lat, round(median(lon) over (partition by county_id), 6) as med_lon, count(*) over (partition by county_id) as size from fx_place", ["fx_place"])
def group_transform(spark, sf):
    p = view(spark, sf, "fx_place")
    med = scale.exact_median(p, ["county_id"], ["lat", "lon"]).withColumnRenamed("county_id", "_c")
    return p.join(med, F.col("county_id") == F.col("_c")).select("id", F.round("median_lat", 6).alias("med_lat"), F.round("median_lon", 6).alias("med_lon"), F.col("n_lat").alias("size"))


def _export_rows(spark, sf):
    p = view(spark, sf, "fx_place").select("id", "county_id", "name", "category", "brand", F.when(F.col("id") % 4 != 0, F.col("lat")).alias("lat"),
                                          F.when(F.col("id") % 4 != 0, F.col("lon")).alias("lon"), F.when(F.col("id") % 37 == 0, F.col("founded")).alias("note_year"), "founded")
    return N.row_index(p, ["county_id", "name", "id"])


_ROWS = """rows as (select *, row_number() over (order by county_id, name, id) - 1 as row from (select id, county_id, name, category, brand, case when id%4<>0 then lat end as lat, case when id%4<>0 then lon end as lon,
 case when id%37=0 then founded end as note_year, founded from fx_place))"""


@C.add("export_order", f"with {_ROWS} select row, id from rows", ["fx_place"])
def export_order(spark, sf):
    return _export_rows(spark, sf).select("row", "id")


@C.add("delta_encode", f"""with {_ROWS}, s as (select row, cast(round_even(lat*10000,0) as bigint) as la, cast(round_even(lon*10000,0) as bigint) as lo from rows)
 select row, la - coalesce(lag(la ignore nulls) over (order by row),0) as d_lat, lo - coalesce(lag(lo ignore nulls) over (order by row),0) as d_lon from s""", ["fx_place"])
def delta_encode(spark, sf):
    return N.delta_encode(_export_rows(spark, sf), {"lat": 10000, "lon": 10000})


@C.add("decode_columnar_sparse", f"with {_ROWS} select row, round_even(lat*10000,0)/10000 as lat, round_even(lon*10000,0)/10000 as lon, cast(note_year as bigint) as note_year from rows", ["fx_place"])
def decode_columnar_sparse(spark, sf):
    rows = _export_rows(spark, sf)
    coords = N.delta_decode(scale.cut_lineage(N.delta_encode(rows, {"lat": 10000, "lon": 10000})), {"lat": 10000, "lon": 10000})
    cells = N.sparse_encode(rows, ["note_year", "founded"])
    notes = N.sparse_decode(rows, cells, {"note_year": "bigint"}).withColumnRenamed("row", "_r2")
    return coords.join(notes, F.col("row") == F.col("_r2")).drop("_r2")


@C.add("sink_columnar_sparse", f"with {_ROWS} select 'note_year' as \"column\", row, cast(note_year as varchar) as value from rows where note_year is not null and (select count(note_year) < 0.05*count(*) from rows)", ["fx_place"])
def sink_columnar_sparse(spark, sf):
    return N.sparse_encode(_export_rows(spark, sf), ["note_year", "founded", "name"])


@C.add("sink_dictionary_encode", "select id, dense_rank() over (order by category)-1 as category_code, dense_rank() over (order by brand)-1 as brand_code from fx_place", ["fx_place"])
def sink_dictionary_encode(spark, sf):
    return N.dictionary_encode(view(spark, sf, "fx_place").select("id", "category", "brand"), ["category", "brand"]).select("id", "category_code", "brand_code")
