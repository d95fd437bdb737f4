"""Registered queries over aggregates and reports."""
from pyspark.sql import functions as F

from ..operators import directory as D, stats as S
from .directory_queries import _D, _V, places
from .latest_results import EVENT_GROUP
from ..functions._col import lookup
from .tables import Catalog, table, view

C = Catalog()


def q(key, body):
    return C.add(key, f"with {_D}{body if body.startswith(',') else ' ' + body}", _V)


@C.add("group_mode", "select county_id, category as mode from (select county_id, category, row_number() over (partition by county_id order by count(*) desc, category) as rn from fx_place group by county_id, category) where rn=1", ["fx_place"])
def group_mode(spark, sf):
    return S.group_mode(view(spark, sf, "fx_place"), ["county_id"], "category")


@C.add("majority_value", "select l_suppkey, l_returnflag from (select l_suppkey, l_returnflag, count(*) as n, sum(count(*)) over (partition by l_suppkey) as t, row_number() over (partition by l_suppkey order by count(*) desc, l_returnflag) as rn from lineitem group by 1,2) where rn=1 and t>=3 and n>=0.35*t")
def majority_value(spark, sf):
    return S.majority_value(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", 3, 0.35)


@C.add("value_counts", "select disp, count(*) as n from fx_visit group by disp", ["fx_visit"])
def value_counts(spark, sf):
    return S.value_counts(view(spark, sf, "fx_visit"), "disp")


@C.add("match_rates_multi_scope", """with b as (select c_mktsegment as grp, case when c_custkey%3=0 then 'cafe-type' else 'restaurant/bar' end as kind, r_name as region, case when c_acctbal>0 then 1e0 else 0e0 end as c, case when c_acctbal>-500 then 1e0 else 0e0 end as a
 from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey) select 'statewide' as scope, grp, kind, count(*) as n, round(avg(c),3) as current, round(avg(a),3) as \"any\" from b group by grp, kind
 union all select region, grp, kind, count(*), round(avg(c),3), round(avg(a),3) from b group by region, grp, kind""")
def match_rates_multi_scope(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = j.withColumn("kind", F.when(F.col("c_custkey") % 3 == 0, "cafe-type").otherwise("restaurant/bar"))
    return S.match_rates(j, group="c_mktsegment", kind="kind", region="r_name", current=F.col("c_acctbal") > 0, any_=F.col("c_acctbal") > -500)


@C.add("coverage_report", """with a as (select c_nationkey as area, count(*) as licenses, round(avg(case when c_acctbal>0 then 1e0 else 0e0 end),3) as found, round(avg(case when c_custkey%4>0 then 1e0 else 0e0 end),3) as placed from customer group by 1),
 b as (select s_nationkey as area, count(*) as listings, round(avg(case when s_acctbal>5000 then 1e0 else 0e0 end),3) as matched from supplier group by 1) select a.area as area, licenses, found, placed, listings, matched from a left join b on a.area=b.area""")
def coverage_report(spark, sf):
    lic, lst = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "area"), table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "area")
    return S.coverage_report(lic, lst, "area", found=F.col("c_acctbal") > 0, placed=F.col("c_custkey") % 4 > 0, matched=F.col("s_acctbal") > 5000)


_WORDS = {"this": r"\bthis\b", "thed": r"\bthe(?:d|s)\b", "erin": r"\berin\b"}
_MC = "select gmap_id, " + ", ".join(f"count(*) filter (regexp_matches(t,'{rx}')) as n_{k}, round(avg(rating) filter (regexp_matches(t,'{rx}')),3) as r_{k}" for k, rx in _WORDS.items()) + \
    " from (select gmap_id, lower(text) as t, rating from fx_review) where " + " or ".join(f"regexp_matches(t,'{rx}')" for rx in _WORDS.values()) + " group by gmap_id"


def _mentions(spark, sf):
    return S.mention_counts(view(spark, sf, "fx_review"), _WORDS, by="gmap_id", prefilter="this|the|erin")


@C.add("mention_counts", _MC, ["fx_review"])
def mention_counts(spark, sf):
    return _mentions(spark, sf)


@C.add("mention_strength", f"select m.gmap_id as gmap_id, n_this+n_erin as n, n_this+n_erin>=3 and n_this+n_erin>=0.02*t.reviews as strong from ({_MC}) m join (select gmap_id, count(*) as reviews from fx_review group by 1) t on m.gmap_id=t.gmap_id", ["fx_review"])
def mention_strength(spark, sf):
    totals = view(spark, sf, "fx_review").groupBy("gmap_id").agg(F.count("*").alias("reviews"))
    return S.mention_strength(_mentions(spark, sf), totals, "gmap_id", ["n_this", "n_erin"]).select("gmap_id", (F.col("n_this") + F.col("n_erin")).alias("n"), "strong")


@C.add("chain_size", """with s as (select id, case when id%3=0 then brand end as b, case when id%5<>0 then 'site'||(id%40)||'.com' end as dom, split_part(name,' ',1) as w from fx_place), t as (select *, case when b is null and dom is not null and dom<>'site3.com' then dom||'|'||w end as g from s)
 select id, coalesce(case when b is not null then count(*) over (partition by b) end, case when g is not null and count(*) over (partition by g)>=2 then count(*) over (partition by g) end, 1) as chain_n from t""", ["fx_place"])
def chain_size(spark, sf):
    p = view(spark, sf, "fx_place").select("id", F.when(F.col("id") % 3 == 0, F.col("brand")).alias("b"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("site"), (F.col("id") % 40).cast("string"), F.lit(".com"))).alias("dom"), F.element_at(F.split("name", " "), 1).alias("w"))
    return S.chain_size(p, id="id", brand="b", domain="dom", first_word="w", store_domains=["site3.com"]).select("id", "chain_n")


@q("crosstab_group_by_county", "select county, count(*) filter (insp_group=0) as \"0\", count(*) filter (insp_group=1) as \"1\", count(*) filter (insp_group=2) as \"2\" from d group by county")
def crosstab_group_by_county(spark, sf):
    return S.crosstab(places(spark, sf), "county", "insp_group", [0, 1, 2])


@q("city_dashboard", """, x as (select * from d where not venue), t as (select city, cuisine, count(*) as n, row_number() over (partition by city order by count(*) desc, cuisine) as rn from x where cuisine<>'PROMO' group by 1,2)
 select x.city as city, count(*) as restaurants, count(*) filter (tier>0) as listed, count(*) filter (hc and tags&1<>0) as g_cuban, count(*) filter (award>0 or jbf is not null) as g_honors, count(*) filter (insp_group=0) as group_0, count(*) filter (insp_group=1) as group_1, count(*) filter (insp_group=2) as group_2,
 max(tt.top_cuisines) as top_cuisines from x left join (select city, string_agg(cuisine||':'||n, ', ' order by rn) as top_cuisines from t where rn<=3 group by city) tt on x.city=tt.city group by x.city""".replace(", x as", ", x as", 1))
def city_dashboard(spark, sf):
    p = places(spark, sf).filter(~F.col("venue"))
    return S.city_dashboard(p, guides={"cuban": D.guide_filter("cuban"), "honors": D.guide_filter("honors")}, default_cuisine="PROMO", top=3, listed=F.col("tier") > 0)


@C.add("closure_stats", """select count(distinct num) as places, count(*) as total, count(*) filter (date_diff('day', date, reopened)<=3) as within_3, count(*) filter (reopened is null) as open_ended, strftime(min(date),'%Y-%m-%d') as first, strftime(max(date),'%Y-%m-%d') as last,
 (select string_agg(reason,' | ' order by n desc, reason) from (select reason, count(*) as n from fx_closure group by reason order by n desc, reason limit 3)) as top_reasons from fx_closure""", ["fx_closure"])
def closure_stats(spark, sf):
    s = S.closure_stats(view(spark, sf, "fx_closure"))
    return s.withColumn("first", F.date_format("first", "yyyy-MM-dd")).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@q("global_stats", "select count(*) filter (not venue) as restaurants, count(distinct city) as towns, count(distinct county) as counties, count(*) filter (tier=2) as licensed, count(*) filter (hc) as hand_checked, count(*) filter (award=2) as bib, strftime(min(insp_date),'%Y-%m-%d') as since from d")
def global_stats(spark, sf):
    return S.global_stats(places(spark, sf), {"restaurants": F.count_if(~F.col("venue")), "towns": F.count_distinct("city"), "counties": F.count_distinct("county"), "licensed": F.count_if(F.col("tier") == 2),
                                              "hand_checked": F.count_if("hc"), "bib": F.count_if(F.col("award") == 2), "since": F.date_format(F.min("insp_date"), "yyyy-MM-dd")})


@C.add("min_listed_having", "select name, count(*) as listed from fx_place group by name having count(*)>=30", ["fx_place"])
def min_listed_having(spark, sf):
    return S.min_listed(view(spark, sf, "fx_place"), "name", 30)


@C.add("dish_frequency", "select item, count(*) as n from (select distinct doc_id, lower(trim(unnest(string_split(text,'; ')))) as item from documents) where item<>'' group by item having count(*)>=2 order by n desc, item limit 10")
def dish_frequency(spark, sf):
    return S.dish_frequency(table(spark, sf, "documents"), "text", top=10)


@C.add("collect_link_context", "select source, (select string_agg(n,',' order by n) from (select distinct cast(n_chars%50 as varchar) as n from documents x where x.source=d.source order by n limit 8)) as sizes, (select string_agg(l,',' order by l) from (select distinct lang as l from documents x where x.source=d.source order by l limit 8)) as langs from (select distinct source from documents) d")
def collect_link_context(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", (F.col("n_chars") % 50).cast("string").alias("size"))
    c = S.collect_context(d, "source", ["size", "lang"])
    return c.select("source", F.array_join("size", ",").alias("sizes"), F.array_join("lang", ",").alias("langs"))


@C.add("ordered_distinct_collect", "select key, string_agg(disp, '>' order by o) as seen from (select key, disp, min(insp_no) as o from fx_visit group by key, disp) group by key", ["fx_visit"])
def ordered_distinct_collect(spark, sf):
    return S.ordered_distinct(view(spark, sf, "fx_visit"), "key", "insp_no", "disp", "seen").select("key", F.array_join("seen", ">").alias("seen"))


@C.add("chain_domain_verdict", """with u as (select distinct 'd'||(page_id%30) as domain, 'u'||page_id as url, case when page_id%30<15 then 'Brand' else 'B'||(page_id%7) end as brand, page_id from pages),
 v as (select url, page_id%5<>0 as ok, case when page_id%5<>0 then 'ok' else 'http 403' end as why from u where page_id%2=0 or page_id%30>=15),
 s as (select domain, count(*) as links from u group by 1), l as (select domain, max(n) as n from (select domain, brand, count(*) as n from u group by 1,2) group by 1),
 ch as (select s.domain as domain from s join l using (domain) where links>=5 and n>=0.8*links), f as (select u.domain as domain, u.url as url, row_number() over (partition by u.domain order by u.url) as rn from u join ch using (domain)),
 f3 as (select f.domain as domain, f.url as url, v.ok as ok, v.why as why from f left join v using (url) where rn<=3),
 jd as (select domain, count(*) filter (ok)>=2 as passed, count(ok)>0 and bool_and(ok or why='http 403') filter (ok is not null) as fine from f3 group by 1)
 select u.url as url, case when jd.domain is not null and (f3.url is null or (not passed and fine)) then passed or fine else v.ok end as ok, case when jd.domain is not null and (f3.url is null or (not passed and fine)) then case when passed then 'chain domain ok' when fine then 'brand''s own site (blocked the check)' else 'chain domain failed its samples' end else v.why end as why
 from u left join v on u.url=v.url left join jd on u.domain=jd.domain left join f3 on u.url=f3.url""")
def chain_domain_verdict(spark, sf):
    p = table(spark, sf, "pages").select("page_id")
    m = F.col("page_id") % 30
    u = p.select(F.concat(F.lit("d"), m.cast("string")).alias("domain"), F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), F.when(m < 15, F.lit("Brand")).otherwise(F.concat(F.lit("B"), (F.col("page_id") % 7).cast("string"))).alias("brand"), F.lit(True).alias("own_site"))
    v = p.filter((F.col("page_id") % 2 == 0) | (m >= 15)).select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), (F.col("page_id") % 5 != 0).alias("ok"), F.when(F.col("page_id") % 5 != 0, "ok").otherwise("http 403").alias("why"))
    return S.chain_domain_verdict(u, v)


@C.add("unusable_sources_report", "with n as (select distinct source as host, lang as reason, cast(n_chars%97 as varchar) as name from documents where lang<>'en'), r as (select *, row_number() over (partition by host, reason order by name) as rn from n) select host, reason, count(*) as n, string_agg(name,'; ' order by name) filter (rn<=12) as names from r group by host, reason")
def unusable_sources_report(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("host"), F.when(F.col("lang") != "en", F.col("lang")).alias("reason"), (F.col("n_chars") % 97).cast("string").alias("name"))
    return S.unusable_sources(d)


@C.add("ungrouped_values", "select disp, count(*) as n from fx_visit where disp not in ('view','click','purchase','error') group by disp", ["fx_visit"])
def ungrouped_values(spark, sf):
    codes = spark.createDataFrame([(k,) for k in EVENT_GROUP], "code string")
    return S.ungrouped_values(view(spark, sf, "fx_visit"), "disp", codes)


@q("season_note_count", "select count(*) filter (jbf is not null) as n from d where award>0")
def season_note_count(spark, sf):
    return S.note_count(places(spark, sf).filter("award > 0"), "jbf")
