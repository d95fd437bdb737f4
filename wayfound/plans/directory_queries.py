"""Registered queries over the directory: guides, filters, search, orders."""
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import directory as D, joins as J, search as Q
from ..operators.visits import latest_visit
from .latest_results import EVENT_GROUP
from ..functions._col import lookup
from .tables import Catalog, table, view

C = Catalog()


def places(spark, sf):
    """fx_place as a directory table."""
    p = view(spark, sf, "fx_place")
    last = latest_visit(view(spark, sf, "fx_visit"), "key").select((F.col("key") * 7).alias("_k"), lookup(EVENT_GROUP, "disp").alias("insp_group"), F.col("date").alias("insp_date"), "hp", "im", "bs")
    d = p.join(last, F.col("id") == F.col("_k"), "left").drop("_k")
    return d.select("id", "name", F.concat(F.lit("Town "), F.col("county_id").cast("string")).alias("city"), F.concat(F.lit("County "), (F.col("county_id") % 5).cast("string")).alias("county"),
                    F.col("category").alias("cuisine"), "brand", (F.col("id") % 9).cast("int").alias("chain_n"), (F.col("id") % 3).cast("int").alias("tier"), (F.col("id") % 11 == 0).alias("venue"), "hc",
                    F.col("tags").cast("int").alias("tags"), (F.col("tags") % 16).cast("int").alias("honors"), (F.col("id") % 6).cast("int").alias("award"),
                    F.when(F.col("id") % 13 == 0, F.lit("winner")).alias("jbf"), F.when(F.col("id") % 4 == 0, F.col("price")).alias("ip"), "founded", "insp_group", "insp_date", "hp", "im", "bs",
                    F.concat((F.col("id") % 90 + 1).cast("string"), F.lit(" SW 8th St")).alias("street"), F.when(F.col("id") % 17 != 0, F.col("lat")).alias("lat"), F.when(F.col("id") % 17 != 0, F.col("lon")).alias("lon"))


_GRP = "case disp when 'view' then 0 when 'click' then 0 when 'purchase' then 1 when 'error' then 2 end"
_D = f"""lv as (select key*7 as k, {_GRP} as insp_group, date as insp_date, hp, im, bs from (select *, row_number() over (partition by key order by date desc, insp_no desc) as rn from fx_visit) where rn=1),
 d as (select id, name, 'Town '||county_id as city, 'County '||(county_id%5) as county, category as cuisine, brand, id%9 as chain_n, id%3 as tier, id%11=0 as venue, hc, tags, tags%16 as honors, id%6 as award,
  case when id%13=0 then 'winner' end as jbf, case when id%4=0 then price end as ip, founded, insp_group, insp_date, hp, im, bs, (id%90+1)||' SW 8th St' as street, lower(name) as sort_key,
  case when id%17<>0 then lat end as lat, case when id%17<>0 then lon end as lon from fx_place left join lv on id=k)"""
_V = ["fx_place", "fx_visit"]


def q(key, body):
    return C.add(key, f"with {_D}{body if body.startswith(',') else ' ' + body}", _V)


@q("user_filters", "select id from d where not venue and cuisine='ECONOMY' and chain_n<5 and tier>0 union all select id from d where award=2 and city='Town 3'")
def user_filters(spark, sf):
    p = places(spark, sf)
    a = p.filter(D.Filters(cuisine="ECONOMY", hide_chains=True, confirmed_only=True).condition())
    b = p.filter(D.Filters(town="Town 3", include_non_restaurants=True, bib_gourmand=True).condition())
    return a.select("id").unionAll(b.select("id"))


@q("guide_filter", "select id, hc and tags&1<>0 as cuban, award>0 or jbf is not null as honors, founded is not null and tags&128<>0 as oldest, insp_date is not null as inspections from d")
def guide_filter(spark, sf):
    return places(spark, sf).select("id", *[D.guide_filter(g).alias(g) for g in ("cuban", "honors", "oldest", "inspections")])


@q("map_layers", """select 'seafood' as layer, id from d where hc and tags&62<>0 and not venue and lat is not null union all
 select 'all', id from (select id from d where not venue and abs(lat-26.3)<=0.75*0.25 and abs(lon+84.7)<=0.75*0.25 order by (honors<>0 or award>0 or (hc and tags<>0)) desc, pow(lat-26.3,2)+pow((lon+84.7)*cos(radians(26.3e0)),2), id limit 600)""")
def map_layers(spark, sf):
    p = places(spark, sf)
    view_ = lambda layer: D.map_view(p, layer, D.Filters(), 26.3, -84.7, 0.25, 0.25).select(F.lit(layer).alias("layer"), "id")
    return view_("seafood").unionAll(view_("all"))


@q("capped_viewport", "select id from (select id from d where lat is not null order by (honors<>0 or award>0 or (hc and tags<>0)) desc, pow(lat-26.3,2)+pow((lon+84.7)*cos(radians(26.3e0)),2), id limit 600)")
def capped_viewport(spark, sf):
    return D.capped_viewport(places(spark, sf).filter("lat is not null"), 26.3, -84.7).select("id")


@q("in_region_box", "select id, lat between 25 and 28 and lon between -87 and -82 as inside from d")
def in_region_box(spark, sf):
    return places(spark, sf).select("id", D.in_region_box(box=(25, 28, -87, -82)).alias("inside"))


@q("promo_ok", "select id from d where insp_group is null or insp_group not in (1,2)")
def promo_ok(spark, sf):
    return places(spark, sf).filter(D.promo_ok()).select("id")


@q("index_selection", "select id from d where not venue and (honors<>0 or award>0 or hc) and chain_n<5")
def index_selection(spark, sf):
    return places(spark, sf).filter(D.index_selection()).select("id")


_ORDERS = {
    "sort_featured": ("featured", "coalesce(ip,-1) desc, coalesce(founded,9999), sort_key, id"),
    "sort_oldest": ("oldest", "coalesce(founded,9999), sort_key, id"),
    "sort_name": ("name", "sort_key, id"),
    "sort_iconic": ("iconic", "award desc, case when honors&1<>0 then 4 when honors&2<>0 then 3 when honors&4<>0 then 2 when honors&8<>0 then 1 else 0 end desc, sort_key, id"),
    "sort_recent": ("recent", "insp_date desc nulls last, sort_key, id"),
    "sort_high_priority": ("most_high", "hp desc nulls last, coalesce(im,0)+coalesce(bs,0) desc, sort_key, id"),
    "sort_fewest_high_priority": ("fewest_high", "hp asc nulls last, coalesce(im,0)+coalesce(bs,0), sort_key, id"),
}
for _key, (_order, _sql) in _ORDERS.items():
    q(_key, f"select id, row_number() over (order by {_sql}) as pos from d order by pos limit 200")(
        lambda spark, sf, _order=_order: D.sort_places(places(spark, sf), _order, limit=200, position="pos").select("id", "pos"))


@q("sort_nearest", "select id, round(mi,4) as miles, row_number() over (order by mi nulls last, sort_key, id) as pos from (select id, sort_key, 2*3958.8*asin(sqrt(least(1, pow(sin(radians(26.3e0-lat)/2),2)+cos(radians(lat))*cos(radians(26.3e0))*pow(sin(radians(-84.7e0-lon)/2),2)))) as mi from d order by mi nulls last, sort_key, id limit 200)")
def sort_nearest(spark, sf):
    return D.sort_places(places(spark, sf), "nearest", (26.3, -84.7), limit=200, position="pos").select("id", F.round("miles", 4).alias("miles"), "pos")


@q("page_rows", "select id from (select id, row_number() over (order by sort_key, id) as rn from d) where rn>300 and rn<=500")
def page_rows(spark, sf):
    return D.page_rows(places(spark, sf), "name", 2).select("id")


@C.add("random_pick")
def random_pick(spark, sf):
    return D.random_pick(places(spark, sf).filter(D.guide_filter("honors")), 7, last=13).select("id")


@q("regional_listing", "select id, case county when 'County 3' then 1 when 'County 1' then 2 else 3 end as region_ord from d")
def regional_listing(spark, sf):
    return D.regional_listing(D.with_sort_columns(places(spark, sf)), ["County 3", "County 1"], region="county").select("id", "region_ord")


@q("top_k_counts", "select cuisine, count(*) as n from d group by cuisine order by n desc, cuisine limit 4")
def top_k_counts(spark, sf):
    return D.top_k_counts(places(spark, sf), "cuisine", 4)


@q("sections_by_size", "select cuisine, count(*) as n, case cuisine when 'PROMO' then 1 when 'ECONOMY' then 2 else 3 end as ord from d group by cuisine")
def sections_by_size(spark, sf):
    return D.sections_by_size(places(spark, sf), "cuisine", ["PROMO", "ECONOMY"])


@q("mark_counts", "select g as guide, case g when 'cuban' then count(*) filter (hc and tags&1<>0) when 'honors' then count(*) filter (award>0 or jbf is not null) when 'inspections' then count(*) filter (insp_date is not null) else count(*) end as n from d, (select unnest(['cuban','honors','inspections','all']) as g) where not venue and chain_n<5 group by g")
def mark_counts(spark, sf):
    return D.mark_counts(places(spark, sf), D.Filters(hide_chains=True), ("cuban", "honors", "inspections", "all"))


# --- search -----------------------------------------------------------------------------------------------------------------------
def query_table(spark, sf):
    """Query texts taken from the data: names, name starts, towns, guide phrases, street words."""
    p = view(spark, sf, "fx_place").select("name").distinct()
    low = F.lower("name")
    t = p.select(F.explode(F.array(low, F.substring(low, F.lit(1), F.length(low) - 2), F.concat(F.element_at(F.split(low, " "), 1), F.lit(" town "), (F.length("name") % 7).cast("string")),
                                   F.concat(F.lit("stone crab "), F.element_at(F.split(low, " "), 2)), F.concat(F.element_at(F.split(low, " "), 2), F.lit(" southwest 8th street")), F.lit("!!!"))).alias("text")).distinct()
    return t.select(F.xxhash64("text").alias("query_id"), "text")


def _search_sides(spark, sf):
    p = D.with_search_columns(places(spark, sf))
    towns = Q.town_lookup(p.filter(~F.col("venue")))
    return p, Q.parse_queries(query_table(spark, sf), towns)


_QT = """qs as (select distinct unnest([lower(name), substr(lower(name),1,length(name)-2), split_part(lower(name),' ',1)||' town '||(length(name)%7), 'stone crab '||split_part(lower(name),' ',2), split_part(lower(name),' ',2)||' southwest 8th street', '!!!']) as text from (select distinct name from fx_place))"""


@q("parse_query_terms", f""", {_QT} select text, case when text like 'stone crab %' then 'stonecrab' end as tag, case when regexp_matches(text,' town [0-9]+$') then 'Town '||regexp_extract(text,'town ([0-9]+)$',1) end as town,
 case when text='!!!' then 0 when regexp_matches(text,' town [0-9]+$') or text like 'stone crab %' then 1 when text like '% southwest 8th street' then 3 else 2 end as n_tokens from qs""".replace(", qs", ", qs", 1))
def parse_query_terms(spark, sf):
    return _search_sides(spark, sf)[1].select("text", "tag", "town", F.size("tokens").alias("n_tokens"))


_HAY = f"""{_QT}, h as (select id, city, tags, hc, venue, ' '||lower(name)||' '||lower(city)||' '||lower(county)||' '||regexp_replace(lower(cuisine),'[^a-z0-9]+',' ','g')||' '||regexp_replace(lower(brand),'[^a-z0-9]+',' ','g')||' '||lower(street)||' ' as st,
 ' '||lower(name)||' '||regexp_replace(lower(brand),'[^a-z0-9]+',' ','g')||' ' as nt from d),
 m as (select q.text as text, id, h.venue as venue, case when text like '% southwest 8th street' or regexp_matches(text,' town [0-9]+$') or text like 'stone crab %' then contains(nt,' '||case when text like 'stone crab %' then split_part(text,' ',3) else split_part(text,' ',1) end) and text not like '% street' else contains(nt,' '||split_part(text,' ',1)||case when length(split_part(text,' ',1))<=2 then ' ' else '' end) and contains(nt,' '||split_part(text,' ',2)) end as name_hit
 from qs q join h on case when text='!!!' then false when text like '% southwest 8th street' then contains(st,' '||split_part(text,' ',1)) and contains(st,' sw ') and contains(st,' 8th st ')
 when regexp_matches(text,' town [0-9]+$') then contains(st,' '||split_part(text,' ',1)) and (city='Town '||regexp_extract(text,'town ([0-9]+)$',1))
 when text like 'stone crab %' then contains(st,' '||split_part(text,' ',3)) and tags&2<>0 else contains(st,' '||split_part(text,' ',1)||case when length(split_part(text,' ',1))<=2 then ' ' else '' end) and contains(st,' '||split_part(text,' ',2)) end)"""


@q("search_match", f", {_HAY} select text, id as place_id, name_hit from m")
def search_match(spark, sf):
    p, parsed = _search_sides(spark, sf)
    return Q.search_match(p, parsed).join(parsed.select("query_id", "text"), "query_id").select("text", "place_id", "name_hit")


@q("search_name_first", f", {_HAY}, c as (select text, count(*) as n, count(*) filter (name_hit) as named from m group by text) select m.text as text, m.id as place_id, case when named>0 and named<n and name_hit then 0 else 1 end as lead from m join c on m.text=c.text")
def search_name_first(spark, sf):
    p, parsed = _search_sides(spark, sf)
    return Q.name_first(Q.search_match(p, parsed)).join(parsed.select("query_id", "text"), "query_id").select("text", "place_id", "lead")


@C.add("search_no_terms", "select '!!!' as text, count(*) as typed from fx_place where id < 0 or name is not null having count(*) > 0".replace("count(*) as typed", "true as typed"), ["fx_place"])
def search_no_terms(spark, sf):
    return Q.nothing_searchable(_search_sides(spark, sf)[1]).select("text", "typed")


@q("town_lookup", "select lower(city) as town_key, city as town from d where not venue group by city")
def town_lookup(spark, sf):
    return Q.town_lookup(places(spark, sf).filter(~F.col("venue")))


@q("find_by_id", "select id, name from d where id=77 union all select id, name from d where id in (select o_custkey*3 from orders where o_orderstatus='F')")
def find_by_id(spark, sf):
    p = places(spark, sf)
    saved = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select((F.col("o_custkey") * 3).alias("id"))
    return Q.find_by_id(p, 77).select("id", "name").unionAll(Q.saved_places(p, saved).select("id", "name"))


@q("town_picker", "select distinct city as town from d where city like 'Town 1%'")
def town_picker(spark, sf):
    return Q.town_picker(places(spark, sf).select(F.col("city").alias("town")).distinct(), "1")


@q("elsewhere_count", f", {_HAY}, n as (select m.text as text, count(*) filter (d.hc and d.tags&1<>0) as here, count(*) as everywhere from m join d on m.id=d.id where not d.venue group by m.text) select text, here, case when here<5 and everywhere>here then everywhere else 0 end as elsewhere from n")
def elsewhere_count(spark, sf):
    p, parsed = _search_sides(spark, sf)
    n = Q.elsewhere_count(p, "cuban", D.Filters(), Q.search_match(p, parsed))
    return n.join(parsed.select("query_id", "text"), "query_id").select("text", "here", "elsewhere")


@q("guide_query", "select id, row_number() over (order by lead, sort_key, id) as pos from (select id, sort_key, case when contains(' '||lower(name),' ring') then 0 else 1 end as lead from d where not venue and tier>0 and (award>0 or jbf is not null) and contains(' '||lower(name)||' '||lower(cuisine),' ring'))")
def guide_query(spark, sf):
    p = D.with_search_columns(places(spark, sf))
    return Q.guide_query(p, "honors", D.Filters(confirmed_only=True), "ring", "name", position="pos").select("id", "pos")


# --- labels -----------------------------------------------------------------------------------------------------------------------
def _said(text):
    return "'" + text.replace("'", "''") + "'"


_HONOR_SQL = "case " + " ".join(f"when honors&{b}<>0 then {_said(label)}" for b, label in R.HONOR_LABELS) + f" when jbf is not null then {_said(R.GROUP_HONOR)} end"
_CHIPS_SQL = "list_filter([" + ", ".join([f"case award {' '.join(f'when {i} then {_said(x)}' for i, x in enumerate(R.AWARD_LABELS, 1))} end", _HONOR_SQL,
    *[f"case when hc and tags&{b}<>0 then {_said(label)} end" for b, label in R.GUIDE_CHIPS], f"case when hc and tags&{R.OLDEST_BIT}<>0 then 'Since '||founded end",
    f"case when chain_n>={R.CHAIN_MIN} then 'Chain · '||chain_n end", "case when tier=0 and honors=0 and award=0 and not hc then 'Listing only' end"]) + "], lambda x: x is not null)"
_KNOW_SQL = f"""case when brand='Brand#11' then {_said(R.KNOWN_BY['research'])} when tier=2 and brand='Brand#12' then {_said(R.KNOWN_BY['official'])} when tier=2 then {_said(R.KNOWN_BY['matched'])}
 else case when tier=1 then {_said(R.KNOWN_BY['confirmed'])} else {_said(R.KNOWN_BY['listing'])} end||coalesce(replace({_said(R.KNOWN_BY['rate'])}, '%s', cast(cast(round_even(rate*100,0) as int) as varchar)||'%'),'')||case when hc then {_said(R.KNOWN_BY['checked'])} else '' end end"""


@q("place_labels", f", rt as (select cuisine as c, avg(case when tier=2 then 1e0 else 0e0 end) as rate from d where cuisine<>'PROMO' group by cuisine) select id, {_HONOR_SQL} as honor, array_to_string({_CHIPS_SQL},'; ') as chips, array_to_string(({_CHIPS_SQL})[1:4],'; ') as first_chips, {_KNOW_SQL} as known from d left join rt on cuisine=c")
def place_labels(spark, sf):
    p = places(spark, sf)
    rates = p.filter("cuisine <> 'PROMO'").groupBy("cuisine").agg(F.avg((F.col("tier") == 2).cast("double")).alias("rate"))
    j = J.calibration_lookup(p, rates, "cuisine")
    src = F.when(F.col("brand") == "Brand#11", "research").when(F.col("brand") == "Brand#12", "official").otherwise("meta")
    chips = R.place_chips(award="award", flags="honors", honors="jbf", hand_checked="hc", tags="tags", founded="founded", chain_n="chain_n", tier="tier")
    return j.select("id", R.honor_label("honors", "jbf").alias("honor"), F.array_join(chips, "; ").alias("chips"), F.array_join(F.slice(chips, 1, 4), "; ").alias("first_chips"),
                    R.how_we_know(src, "tier", "hc", "rate_text").alias("known"))
