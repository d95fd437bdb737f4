"""Registered queries over joins, matching, spatial joins and duplicate handling."""
from pyspark.sql import functions as F

from ..functions import address as A, similarity as S, text as T
from ..functions._col import lookup
from ..operators import joins as J, matching as M, scale, spatial as SP
from ..operators.numbering import union_all
from .tables import Catalog, ring_table, table, view
from .text_queries import lcs_of, sql_norm

C = Catalog()


def _place(spark, sf):
    return view(spark, sf, "fx_place")


@C.add("join_using_id", "select l_orderkey, l_linenumber, l_partkey, p_name, p_brand from lineitem join part on l_partkey=p_partkey where p_size>10 and l_quantity>30")
def join_using_id(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity > 30").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return J.join_using_id(li, p, "l_partkey")


@C.add("left_lookup", "select c_custkey, n_name, r_name from customer left join nation on c_nationkey=n_nationkey and n_nationkey%2=0 left join region on n_regionkey=r_regionkey")
def left_lookup(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey % 2 = 0")
    out = J.left_lookup(table(spark, sf, "customer"), n, F.col("c_nationkey") == F.col("n_nationkey"))
    return J.left_lookup(out, table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@C.add("distinct_key_join", "select o_orderkey, o_custkey from orders where o_custkey in (select distinct c_custkey from customer where c_acctbal<0)")
def distinct_key_join(spark, sf):
    want = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.distinct_key_join(want, table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@C.add("anti_unmatched", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus='F')")
def anti_unmatched(spark, sf):
    return J.anti_unmatched(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"))


@C.add("semi_coverage", "select s_suppkey from supplier where s_suppkey in (select l_suppkey from lineitem where l_returnflag='R' and l_quantity>45)")
def semi_coverage(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45")
    return J.semi_coverage(table(spark, sf, "supplier").select("s_suppkey"), li, F.col("s_suppkey") == F.col("l_suppkey"))


def _addr(spark, sf):
    a = scale.on_distinct(view(spark, sf, "fx_address").select("lic", "zip", "lat", "lon", "addr"), ["addr"], {"k": A.street_key("addr")})
    a = a.select("lic", "zip", "lat", "lon", "addr", F.col("k.num").alias("num"), F.col("k.street").alias("street"))
    # written once: filters on the keys would otherwise be inferred for every row, keys computed again
    return scale.cut_lineage(scale.on_distinct(a, ["street"], {"core": A.core_street("street")}))


_STREET = "case lic%6 when 0 then 'NW 27 AVE' when 1 then 'NW 27 AVE' when 2 then 'MAIN ST' when 3 then 'MAIN ST' when 4 then 'US 301 N' else 'SR 70' end"
_AD = f"ad as (select lic, cast(lic%900+1 as varchar) as num, {_STREET} as street, zip, lat, lon from fx_address)"


@C.add("group_median_spread", f"with {_AD} select street, zip, round(median(lat),6) as lat, round(median(lon),6) as lon from ad group by street, zip having max(lat)-min(lat)<4.0", ["fx_address"])
def group_median_spread(spark, sf):
    m = J.address_medians(_addr(spark, sf), ["street", "zip"], 4.0)
    return m.select("street", "zip", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@C.add("group_nunique_filter", f"with {_AD} select num, zip, round(median(lat),6) as lat, round(median(lon),6) as lon from ad group by num, zip having count(distinct street)=1", ["fx_address"])
def group_nunique_filter(spark, sf):
    m = J.unique_street_medians(_addr(spark, sf), ["num", "zip"], "street")
    return m.select("num", "zip", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_CORE = "case lic%6 when 0 then '27' when 1 then '27' when 2 then 'MAIN' when 3 then 'MAIN' when 4 then 'US 301' else 'SR 70' end"


@C.add("geocode_cascade", f"""with ad as (select lic, cast(lic%900+1 as varchar) as num, {_STREET} as street, {_CORE} as core, zip, lat, lon from fx_address), pts as (select * from ad where lic%3=0),
 f as (select num, street, zip, median(lat) as lat from pts group by all having max(lat)-min(lat)<0.01), c as (select num, core, zip, median(lat) as lat from pts group by all having count(distinct street)=1)
 select ad.lic as id, case when f.lat is not null then 'point' when c.lat is not null then 'point-core' when ad.lic%5=0 then 'cached' when ad.lic%7=0 then 'name' end as method,
  round(coalesce(f.lat, c.lat, case when ad.lic%5=0 or ad.lic%7=0 then ad.lat end),6) as lat from ad left join f using (num, street, zip) left join c using (num, core, zip)""", ["fx_address"])
def geocode_cascade(spark, sf):
    a = _addr(spark, sf).withColumnRenamed("lic", "id")
    got = J.geocode_cascade(a.drop("lat", "lon", "addr"), a.filter("id % 3 = 0"), a.filter("id % 5 = 0").select("id", "lat", "lon"), a.filter("id % 7 = 0").select("id", "lat", "lon"))
    return got.select("id", "method", F.round("lat", 6).alias("lat"))


@C.add("address_unique_match", f"""with {_AD.replace("street, zip, lat", "street, substr(zip,1,2) as zip, lat")}, l as (select num, street, zip, min(lic) as lid, count(*) as n from ad where lic<1000 group by 1,2,3), r as (select num, street, zip, min(lic) as rid, count(*) as n from ad where lic>=1000 group by 1,2,3)
 select lid, rid from l join r using (num, street, zip) where l.n=1 and r.n=1 and street not like 'US %' and street not like 'SR %'""", ["fx_address"])
def address_unique_match(spark, sf):
    a = _addr(spark, sf).withColumn("name", F.lit("SHOP")).withColumn("zip", F.substring("zip", 1, 2))
    return J.address_unique_match(a.filter("lic < 1000").withColumnRenamed("lic", "lid"), a.filter("lic >= 1000").withColumnRenamed("lic", "rid"),
                                  ["num", "street", "zip"], lid="lid", rid="rid", agree=S.same_business)


_NEAR = "abs(l.lat-r.lat)<0.003 and abs(l.lon-r.lon)<0.003 and sqrt(pow((l.lat-r.lat)*111000,2)+pow((l.lon-r.lon)*99000,2))"
_DIST = "sqrt(pow((l.lat-r.lat)*111000,2)+pow((l.lon-r.lon)*99000,2))"


@C.add("proximity_join", f"select l.id as l_id, r.reg_id as r_reg_id, round({_DIST},3) as dist_m from fx_place l join fx_registry r on r.county_id between l.county_id-1 and l.county_id+1 and {_NEAR}<=200", ["fx_place", "fx_registry"])
def proximity_join(spark, sf):
    p = SP.proximity_join(_place(spark, sf).select("id", "lat", "lon"), view(spark, sf, "fx_registry").select("reg_id", "lat", "lon"), radius_m=200.0)
    return p.select("l_id", "r_reg_id", F.round("dist_m", 3).alias("dist_m"))


def _keyed(spark, sf):
    nums = F.array(F.col("id_").cast("string"))
    street = lookup({"0": "MAIN ST", "1": "OAK AVE", "2": "NW 27 AVE"}, (F.col("id_") % 3).cast("string"))
    l = _place(spark, sf).withColumn("id_", F.col("id") % 300).select(F.col("id").alias("lid"), "county_id", F.col("name").alias("k"), nums.alias("nums"), street.alias("street"), "lat", "lon")
    r = view(spark, sf, "fx_registry").withColumn("id_", F.col("reg_id") % 300).select(F.col("reg_id").alias("rid"), "county_id", F.array(T.norm_name("name")).alias("keys"), nums.alias("nums"), street.alias("street"), "lat", "lon", "active")
    return l, r


@C.add("similar_name_join")
def similar_name_join(spark, sf):
    l, r = _keyed(spark, sf)
    return M.similar_name_pairs(l, r, block="county_id").select("lid", "rid", F.round("score", 4).alias("score"), "rule")


@C.add("match_listings")
def match_listings(spark, sf):
    l, r = _keyed(spark, sf)
    return M.match_listings(l, r, block="county_id").select("lid", "rid", F.round("score", 4).alias("score"), "rule")


_EXACT = "with e as (select l.id as lid, r.reg_id as rid, cast(100 - abs(l.id-r.reg_id)%7 as double) as score from fx_place l join fx_registry r on l.county_id=r.county_id and l.name=r.name)"


def _exact_pairs(spark, sf):
    l = _place(spark, sf).select("id", "county_id", "name")
    r = view(spark, sf, "fx_registry").select("reg_id", F.col("county_id").alias("rc"), F.col("name").alias("rn"))
    return l.join(r, (F.col("county_id") == F.col("rc")) & (F.col("name") == F.col("rn"))).select(
        F.col("id").alias("lid"), F.col("reg_id").alias("rid"), (100 - F.abs(F.col("id") - F.col("reg_id")) % 7).cast("double").alias("score"))


@C.add("best_match_left", _EXACT + " select lid, rid from (select *, row_number() over (partition by lid order by score desc, rid) as rn from e) where rn=1", ["fx_place", "fx_registry"])
def best_match_left(spark, sf):
    return J.best_match_left(_exact_pairs(spark, sf)).select("lid", "rid")


@C.add("one_to_one_match")
def one_to_one_match(spark, sf):
    """Listings to registry rows, one to one: nearest by name and place. Copies (one name at one spot) are assigned as classes."""
    l = _place(spark, sf).select("id", "name", "lat", "lon")
    r = view(spark, sf, "fx_registry").select(F.col("reg_id").alias("id"), T.norm_name("name").alias("name"), "lat", "lon")
    lc, lm = M.classes(l, ["name", "lat", "lon"], "id")
    rc, rm = M.classes(r, ["name", "lat", "lon"], "id")
    pairs = scale.cut_lineage(M.near_named(lc, rc, S.sim_token_set, radius_m=200.0, min_score=75.0).select(
        F.col("l_cls").alias("lid"), F.col("r_cls").alias("rid"), (F.col("s") - F.col("dist_m") / 25).alias("score")))
    return M.one_to_one_classes(pairs, scale.cut_lineage(lm), scale.cut_lineage(rm)).select("lid", "rid", F.round("score", 4).alias("score"))


_PIP = "select id, pg.name as name from fx_place p join fx_polygon pg on p.lat>{0} and p.lat<{1} and p.lon>{2} and p.lon<{3}"


def _tiers(spark, sf):
    tight = ring_table(spark, sf).select("name", "ring")
    wide = tight.select("name", F.transform("ring", lambda p, i: F.struct((p["x"] + F.when(i.isin(1, 2), 0.01).otherwise(-0.01)).alias("x"), (p["y"] + F.when(i.isin(2, 3), 0.01).otherwise(-0.01)).alias("y"))).alias("ring"))
    return [tight, wide]


_TIERS = """t as (select id, pg.name as name from fx_place p join fx_polygon pg on lat>y0 and lat<y1 and lon>x0 and lon<x1), w as (select id, pg.name as name from fx_place p join fx_polygon pg on lat>y0-0.01 and lat<y1+0.01 and lon>x0-0.01 and lon<x1+0.01),
 c as (select id, min(name) as name from (select * from t union all select * from w where id not in (select id from t)) group by id)"""


@C.add("point_in_polygon_join", f"with {_TIERS} select id, name from c", ["fx_place", "fx_polygon"])
def point_in_polygon_join(spark, sf):
    return SP.point_in_polygon(_place(spark, sf), _tiers(spark, sf))


@C.add("flag_outside_polygon", f"with {_TIERS} select id, (id not in (select id from c)) as outside from fx_place", ["fx_place", "fx_polygon"])
def flag_outside_polygon(spark, sf):
    return SP.flag_outside(_place(spark, sf), _tiers(spark, sf)).select("id", "outside")


@C.add("curated_match")
def curated_match(spark, sf):
    l, r = _keyed(spark, sf)
    places = l.select(F.col("lid").alias("pid"), "k", F.element_at("nums", 1).alias("num"), "nums", "street", F.col("county_id").cast("string").alias("town"), F.lit("").alias("zip"))
    cur = r.select(F.col("rid").alias("cid"), F.col("keys").alias("names"), F.element_at("nums", 1).alias("num"), "nums", "street", F.col("county_id").cast("string").alias("town"), F.lit(None).cast("string").alias("zip"), F.lit(False).alias("chain"))
    return M.curated_match(cur, places)


@C.add("nearest_unique_borrow", """select n.reg_id as reg_id, case when count(d.id)=1 then min(d.name) end as name from fx_registry n left join fx_place d on d.county_id between n.county_id-1 and n.county_id+1 and abs(n.lat-d.lat)<0.004 and abs(n.lon-d.lon)<0.004 group by n.reg_id""", ["fx_registry", "fx_place"])
def nearest_unique_borrow(spark, sf):
    return SP.nearest_unique_borrow(view(spark, sf, "fx_registry").drop("name"), _place(spark, sf), id="reg_id", donor_id="id", value="name", box=0.004)


@C.add("core_detail_merge", "select c.c_custkey as c_custkey, c.c_name as c_name, coalesce(d.bal, c.c_acctbal) as c_acctbal, d.n_orders as n_orders from customer c left join (select o_custkey, round(max(o_totalprice),2) as bal, count(*) as n_orders from orders group by 1) d on c.c_custkey=d.o_custkey")
def core_detail_merge(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("c_acctbal"), F.count("*").alias("n_orders"))
    return J.core_detail_merge(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), d, "c_custkey")


@C.add("hand_checked_twin")
def hand_checked_twin(spark, sf):
    l, r = _keyed(spark, sf)
    one = lambda d, i, k: d.select(F.col(i).alias("id"), k.alias("name"), k.alias("k"), F.element_at("nums", 1).alias("num"), "street", F.col("county_id").alias("county"), "lat", "lon")
    return M.hand_checked_twin(one(l, "lid", F.col("k")), one(r, "rid", F.element_at("keys", 1)))


@C.add("remove_verified_closed", "select id from fx_place where id not in (select p.id from fx_place p join fx_registry r on p.id=r.reg_id and p.name=r.name where not r.active)", ["fx_place", "fx_registry"])
def remove_verified_closed(spark, sf):
    closed = view(spark, sf, "fx_registry").filter(~F.col("active")).select(F.col("reg_id").alias("id"), F.col("name").alias("rn"))
    hit = _place(spark, sf).join(closed, "id").filter(F.col("name") == F.col("rn")).select("id")
    return J.remove_closed(_place(spark, sf), hit, "id").select("id")


@C.add("rename_from_registry", """select p.id as id, case when r.name is not null and r.name<>p.name and r.name not like '% LLC' then r.name else p.name end as name,
 case when r.name is not null and r.name<>p.name and r.name not like '% LLC' then null else p.brand end as brand, (r.name is not null and r.name<>p.name and r.name not like '% LLC') as renamed from fx_place p left join fx_registry r on p.id=r.reg_id""", ["fx_place", "fx_registry"])
def rename_from_registry(spark, sf):
    reg = view(spark, sf, "fx_registry").select(F.col("reg_id").alias("id"), F.col("name").alias("reg_name"), F.array("name").alias("reg_keys"))
    flags = T.legal_flags("reg_name")
    return J.rename_from_registry(_place(spark, sf).select("id", "name", "brand"), reg, id="id", license="id", agrees=F.array_contains("reg_keys", F.col("name")),
                                  usable=~flags["is_legal"] & ~flags["holder"], reset=["brand"])


@C.add("apply_fix_table", "select id, case when name='RED RING' and county_id in (3,5) and id%90+1=case county_id when 3 then 29 else 31 end then 'Fixed Ring' else name end as name from fx_place", ["fx_place"])
def apply_fix_table(spark, sf):
    p = _place(spark, sf).select("id", "name", F.col("county_id").cast("string").alias("town"), F.concat((F.col("id") % 90 + 1).cast("string"), F.lit(" Main St")).alias("street"))
    fixes = spark.createDataFrame([("Red Ring", "3", 29, "Fixed Ring"), ("red ring", "5", 31, "Fixed Ring")], "name string, town string, street_number int, fixed string")
    return J.apply_fix_table(p, fixes).select("id", "name")


@C.add("calibration_lookup", "select p.id as id, case when r.n is null then null else cast(cast(round_even(r.rate*100,0) as int) as varchar)||'%' end as rate_text from fx_place p left join (select category, count(*) as n, avg(case when hc then 1e0 else 0e0 end) as rate from fx_place where category<>'PROMO' group by category) r on p.category=r.category", ["fx_place"])
def calibration_lookup(spark, sf):
    p = _place(spark, sf)
    rates = p.filter("category <> 'PROMO'").groupBy("category").agg(F.avg(F.col("hc").cast("double")).alias("rate"))
    return J.calibration_lookup(p.select("id", "category"), rates, "category").select("id", "rate_text")


_NAMED = lcs_of(f"select distinct p.name as a, {sql_norm('r.name')} as b from fx_registry r join fx_place p on p.county_id=r.county_id")


@C.add("point_by_name_town", _NAMED + f""" select r.reg_id as id, arg_min(p.lat,p.id) as lat, arg_min(p.lon,p.id) as lon from fx_registry r join fx_place p on p.county_id=r.county_id
 join lcs on lcs.a=p.name and lcs.b={sql_norm('r.name')} where s>=92 group by r.reg_id having max(p.lat)-min(p.lat)<0.02""", ["fx_registry", "fx_place"])
def point_by_name_town(spark, sf):
    p = _place(spark, sf).select(F.col("id").alias("pid"), F.col("county_id").alias("town"), F.col("name").alias("k"), F.lit(None).cast("string").alias("num"), "lat", "lon")
    u = view(spark, sf, "fx_registry").select(F.col("reg_id").alias("id"), F.col("county_id").alias("town"), T.norm_name("name").alias("k"), F.lit(None).cast("string").alias("num"))
    return M.point_by_name_town(u, p, max_spread=0.02)


_PLACED = _NAMED + f""", u as (select reg_id as id, county_id as town, {sql_norm('name')} as k, case when reg_id%2=0 then reg_id%7 end as num, case when reg_id%5<>0 then (reg_id%900+1)||' Main St, Town '||county_id end as address from fx_registry),
 g as (select (lic%900+1)||' Main St, Town '||(lic%25) as address, min(case when lic%4<>0 then struct_pack(la := lat, lo := lon) end) as at from fx_address group by 1),
 n as (select u.id as id, arg_min(p.lat,p.id) as lat, arg_min(p.lon,p.id) as lon from u join fx_place p on p.county_id=u.town join lcs on lcs.a=p.name and lcs.b=u.k
  where s>=92 and (num is null or p.id%11=0 or num=p.id%7) group by u.id having max(p.lat)-min(p.lat)<0.02),
 f as (select u.id as id, u.address as address, case when g.at is not null then g.at.la else n.lat end as lat, case when g.at is not null then g.at.lo else n.lon end as lon,
  case when g.at is not null then 'cache' when n.id is not null then 'listing' end as placed_by from u left join g on u.address=g.address left join n on u.id=n.id)"""


def _placed(spark, sf):
    r, p = F.col("reg_id"), F.col("id")
    line = lambda n, town: F.concat((n % 900 + 1).cast("string"), F.lit(" Main St, Town "), town.cast("string"))
    u = view(spark, sf, "fx_registry").select(r.alias("id"), F.col("county_id").alias("town"), T.norm_name("name").alias("k"), F.when(r % 2 == 0, (r % 7).cast("string")).alias("num"),
                                              F.when(r % 5 != 0, line(r, F.col("county_id"))).alias("address"))
    places = _place(spark, sf).select(p.alias("pid"), F.col("county_id").alias("town"), F.col("name").alias("k"), F.when(p % 11 != 0, (p % 7).cast("string")).alias("num"), "lat", "lon")
    known = F.col("lic") % 4 != 0
    cached = view(spark, sf, "fx_address").select(line(F.col("lic"), F.col("lic") % 25).alias("address"), F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"))
    return M.place_unplaced(u, places, cached, max_spread=0.02)


@C.add("place_unplaced", _PLACED + " select id, address, lat, lon, placed_by from f", ["fx_registry", "fx_place", "fx_address"])
def place_unplaced(spark, sf):
    return _placed(spark, sf)


@C.add("geocode_todo", _PLACED + " select distinct address from f where placed_by is null and address is not null", ["fx_registry", "fx_place", "fx_address"])
def geocode_todo(spark, sf):
    return M.geocode_todo(_placed(spark, sf))


@C.add("flag_closed_twin", """with c as (select name, lat, lon from fx_place where hc) select id, (hc or exists (select 1 from c where c.name=p.name and abs(c.lat-p.lat)<0.0015 and abs(c.lon-p.lon)<0.002)) as closed_twin
 from (select id, hc, lat, lon, name from fx_place) p""", ["fx_place"])
def flag_closed_twin(spark, sf):
    return M.flag_closed_twin(_place(spark, sf), id="id", name_key="name", closed="hc", bare_key="name", min_score=99.0).select("id", "closed_twin")


# --- set operations, duplicates, merging --------------------------------------------------------------------------------------
@C.add("union_by_name", "select id, name, brand, null as active from fx_place union all select reg_id, name, null, active from fx_registry", ["fx_place", "fx_registry"])
def union_by_name(spark, sf):
    return union_all([_place(spark, sf).select("id", "name", "brand"), view(spark, sf, "fx_registry").select(F.col("reg_id").alias("id"), "name", "active")])


def _suppressed(spark, sf):
    p = _place(spark, sf).select("id", "name", "brand", "lat", "lon", "confidence")
    return M.suppress_duplicates(p, id="id", rank_order=[-F.col("confidence")], name="name", brand="brand", same_name_m=800.0, same_brand_m=800.0, similar=None)


@C.add("suppress_duplicates_ranked")
def suppress_duplicates_ranked(spark, sf):
    return _suppressed(spark, sf)[1]


@C.add("merge_same_address", f"""select lic from (select lic, row_number() over (partition by num, street, zip order by rank desc, lic) as rn from (select lic, cast(lic%900+1 as varchar) as num, {_STREET} as street, zip, lic%4 as rank from fx_address)) where rn=1""", ["fx_address"])
def merge_same_address(spark, sf):
    a = _addr(spark, sf).withColumn("rank", F.col("lic") % 4)
    return M.merge_same_address(a, keys=["num", "street", "zip"], rank_order=[F.desc("rank")], id="lic").select("lic")


@C.add("merge_same_town_close")
def merge_same_town_close(spark, sf):
    p = _place(spark, sf).withColumn("town", F.col("county_id").cast("string")).withColumn("rank", (F.col("confidence") * 50).cast("int"))
    return M.merge_same_town_close(p, id="id", name="name", town="town", rank="rank", licensed="hc", radius_m=800.0)


@C.add("coalesce_merged_facts", """with s as (select * from fx_place where id%3=0), l as (select id-id%3 as sv, * from fx_place where id%3<>0)
 select s.id as id, (s.hc or coalesce(bool_or(l.hc), false)) as hc, coalesce(s.founded, arg_min(l.founded, l.id) filter (l.founded is not null)) as founded from s left join l on l.sv=s.id group by s.id, s.hc, s.founded""", ["fx_place"])
def coalesce_merged_facts(spark, sf):
    p = _place(spark, sf).select("id", "hc", "founded")
    pairs = p.filter("id % 3 <> 0").select(F.col("id").alias("loser"), (F.col("id") - F.col("id") % 3).alias("survivor"))
    return M.coalesce_merged(p.filter("id % 3 = 0"), p, pairs, id="id", flags=["hc"], facts=["founded"])


@C.add("merge_facts_by_key", """select name, county_id, min(founded) as founded, arg_max(brand, (confidence, id)) as best_brand, array_to_string(list_sort(list(distinct category)),'|') as categories from fx_place group by name, county_id""", ["fx_place"])
def merge_facts_by_key(spark, sf):
    p = _place(spark, sf)
    cats = p.select("name", "county_id", "category").distinct().groupBy("name", "county_id").agg(F.array_join(F.array_sort(F.collect_list("category")), "|").alias("categories"))
    facts = p.groupBy("name", "county_id").agg(F.min("founded").alias("founded"), F.max_by("brand", F.struct("confidence", "id")).alias("best_brand"))
    return facts.join(cats, ["name", "county_id"])


@C.add("distinct_intersect_except", """select 'both' as side, k from (select distinct name as k from fx_place intersect select distinct name from fx_registry) union all
 select 'place', k from (select distinct name as k from fx_place except select distinct name from fx_registry) union all select 'registry', k from (select distinct name as k from fx_registry except select distinct name from fx_place)""", ["fx_place", "fx_registry"])
def distinct_intersect_except(spark, sf):
    a, b = _place(spark, sf).select(F.col("name").alias("k")).distinct(), view(spark, sf, "fx_registry").select(F.col("name").alias("k")).distinct()
    tag = lambda d, s: d.select(F.lit(s).alias("side"), "k")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "place")).unionByName(tag(b.exceptAll(a), "registry"))


@C.add("newest_wins_merge", """select o_custkey, o_orderstatus, strftime(o_orderdate,'%Y-%m-%d') as checked from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, v desc, o_orderkey) as rn from
 (select *, o_orderkey%2 as v from orders)) where rn=1""")
def newest_wins_merge(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    first = lambda d: scale.keep_first(d, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])
    out = J.newest_wins(first(o.filter("o_orderkey % 2 = 0")), first(o.filter("o_orderkey % 2 = 1")), ["o_custkey"], "o_orderdate")
    return out.select("o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("checked"))
