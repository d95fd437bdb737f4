"""Registered queries over rules, flags, imputation and scores."""
from pyspark.sql import functions as F

from ..functions import similarity as SIM, text as T
from ..functions._col import lookup
from ..operators import classify as K, directory as D, enrich as E, scale
from .directory_queries import _D, _V, places
from .match_queries import _TIERS, _tiers
from .tables import Catalog, table, view
from .text_queries import _TSET, _TSET_OUT, _TSET_PRS, lcs_of

C = Catalog()


def q(key, body):
    return C.add(key, f"with {_D}{body if body.startswith(',') else ' ' + body}", _V)


_RULES = [("Ring", r"\bRING\b"), ("Reds", r"^RED\b"), ("Small", r"\bSMALL\b"), ("Gear", r"\bGEAR\b")]
_CASE = "case when contains(' '||name||' ',' RING ') then 'Ring' when name like 'RED %' then 'Reds' when contains(' '||name||' ',' SMALL ') then 'Small' when contains(' '||name||' ',' GEAR ') then 'Gear' else {} end"


@C.add("brand_by_rules", f"select id, {_CASE.format('null')} as brand from fx_place", ["fx_place"])
def brand_by_rules(spark, sf):
    return view(spark, sf, "fx_place").select("id", K.brand_by_rules("name", _RULES[:2], _RULES[2:]).alias("brand"))


@C.add("rule_table", f"select id, {_CASE.format('null')} as label from fx_place", ["fx_place"])
def rule_table(spark, sf):
    rules = spark.createDataFrame([(i, b, rx) for i, (b, rx) in enumerate(_RULES)], "priority int, label string, pattern string")
    return K.apply_rule_table(view(spark, sf, "fx_place"), "name", rules, "label").select("id", "label")


@C.add("brand_validate", """with s as (select id, case when id%4=0 then null else brand end as b, case id%5 when 0 then 'AllThePlaces' when 1 then 'official' else 'meta' end as src, case when id%7=0 then brand else 'none' end as nb, case when id%3=0 then 'x.com' when id%3=1 then 'y.com' end as dom, 'x.com' as own, category from fx_place)
 select id, case when b is null then null when src<>'AllThePlaces' and nb<>b then null when src='official' then b when dom='x.com' then b when dom is not null then null when category='PROMO' then null else b end as brand from s""", ["fx_place"])
def brand_validate(spark, sf):
    p = view(spark, sf, "fx_place")
    s = p.select("id", F.when(F.col("id") % 4 != 0, F.col("brand")).alias("b"), F.when(F.col("id") % 5 == 0, "AllThePlaces").when(F.col("id") % 5 == 1, "official").otherwise("meta").alias("src"), F.when(F.col("id") % 7 == 0, F.col("brand")).otherwise("none").alias("nb"),
                 F.when(F.col("id") % 3 == 0, "x.com").when(F.col("id") % 3 == 1, "y.com").alias("dom"), F.lit("x.com").alias("own"), "category", F.lit("ECONOMY").alias("bc"), F.lit("ZZ").alias("bk"), F.col("name").alias("nk"), F.lit("").alias("lk"))
    family = {"PROMO": "p", "ECONOMY": "e"}
    ok = K.brand_validate(brand="b", brand_key="bk", name_key="nk", label_key="lk", source="src", own_domain="own", domain="dom", cuisine="category", brand_cuisine="bc", known_cuisine=F.lit(True), name_brand="nb",
                          core_ratio=F.lit(0.0), partial=F.lit(70.0), label_set=F.lit(0.0), label_partial=F.lit(0.0), family=family)
    return s.select("id", ok.alias("brand"))


@C.add("cuisine_by_rules", f"""with c as (select id, brand, {_CASE.format("case when category='PROMO' then 'Bar' else 'Other' end")} as cu from fx_place), m as (select brand, cu from (select brand, cu, row_number() over (partition by brand order by count(*) desc, cu) as rn from c where cu<>'Other' group by brand, cu) where rn=1)
 select c.id as id, case when c.id%3=0 then coalesce(m.cu, c.cu) else c.cu end as cuisine from c left join m on c.brand=m.brand""", ["fx_place"])
def cuisine_by_rules(spark, sf):
    from ..operators.stats import group_mode
    p = view(spark, sf, "fx_place")
    c = p.select("id", "brand", F.coalesce(K.first_rule("name", _RULES), lookup({"PROMO": "Bar"}, "category", "Other")).alias("cu"))
    m = group_mode(c, ["brand"], "cu", "chain_cu", ignore=F.col("cu") == "Other").withColumnRenamed("brand", "_b")
    return c.join(m, F.col("brand") == F.col("_b"), "left").select("id", F.when(F.col("id") % 3 == 0, F.coalesce("chain_cu", "cu")).otherwise(F.col("cu")).alias("cuisine"))


@C.add("flag_junk_listing", """select doc_id, regexp_matches(n,'^[0-9\\s#-]+$') or regexp_matches(n,'(?i)\\b(church|insurance|storage|operations|salon|plumbing|tires?|dental)\\b') as junk, st='' and z='' as nowhere
 from (select doc_id, case when doc_id%9=0 then '#12 34' when doc_id%9=1 then source||' Insurance' else source end as n, case when doc_id%4=0 then '' else '1 Main St' end as st, case when doc_id%3=0 then '' else '33101' end as z from documents)""")
def flag_junk_listing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("#12 34")).when(F.col("doc_id") % 9 == 1, F.concat("source", F.lit(" Insurance"))).otherwise(F.col("source")).alias("n"),
                                             F.when(F.col("doc_id") % 4 == 0, "").otherwise("1 Main St").alias("st"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("33101").alias("z"))
    return d.select("doc_id", K.flag_junk_listing("n", "z", "st").alias("junk"), K.flag_nowhere("st", "z").alias("nowhere"))


@C.add("flag_closed_name", "select doc_id, doc_id%6 in (0,1,2,3) as closed from documents")
def flag_closed_name(spark, sf):
    m = F.col("doc_id") % 6
    n = F.when(m == 0, F.concat("source", F.lit(" - CLOSED"))).when(m == 1, F.concat(F.lit("Closed: "), "source")).when(m == 2, F.concat("source", F.lit(" (permanently closed)"))).when(m == 3, F.lit("Coming Soon Cafe")).otherwise(F.concat(F.lit("Enclosed Garden "), "source"))
    return table(spark, sf, "documents").select("doc_id", K.flag_closed_name(n).alias("closed"))


@C.add("flag_far_outlier", """with m as (select brand, median(lat) as la, median(lon) as lo, count(*) as n from fx_place group by brand) select id, n>=5 and sqrt(pow((p.lat-la)*111,2)+pow((p.lon-lo)*99,2))>150 as far from fx_place p join m on p.brand=m.brand""", ["fx_place"])
def flag_far_outlier(spark, sf):
    return E.flag_far_outlier(view(spark, sf, "fx_place"), id="id", town="brand", max_km=150.0).select("id", "far")


@C.add("keep_rule", """with s as (select id, id%10<>0 as base, id%8=0 as lapsed, id%5=0 as off, id%17=0 as ver, category in ('PROMO','ECONOMY') as cafe, case id%3 when 0 then 'meta' when 1 then 'DAC' else 'Microsoft' end as src, confidence as c, id%2=0 as snap, id%6=0 as gone from fx_place)
 select id, base and not lapsed and (off or ver or (cafe and ((src='meta' and c>=0.95) or src='DAC'))) as app, base and not lapsed and (off or ver or (cafe and ((src='meta' and (snap or c>=0.95)) or (src='DAC' and snap)) and not gone)) as web from s""", ["fx_place"])
def keep_rule(spark, sf):
    i = F.col("id")
    src = F.when(i % 3 == 0, "meta").when(i % 3 == 1, "DAC").otherwise("Microsoft")
    p = view(spark, sf, "fx_place").withColumn("src", src)
    args = dict(base_ok=i % 10 != 0, lapsed=i % 8 == 0, official=i % 5 == 0, verified=i % 17 == 0, kind_ok=F.col("category").isin("PROMO", "ECONOMY"), source="src", confidence="confidence", in_snapshot=i % 2 == 0, closed_snapshot=i % 6 == 0)
    return p.select("id", K.keep_rule(app=True, **args).alias("app"), K.keep_rule(app=False, **args).alias("web"))


@C.add("flag_junk_display", "select id, id%6 in (0,1,2) or (id%6=3 and id%7<>0) as junk from fx_place", ["fx_place"])
def flag_junk_display(spark, sf):
    m = F.col("id") % 6
    n = F.when(m == 0, F.lit("123 Main St")).when(m == 1, F.lit("Kitchen")).when(m == 2, F.concat("name", F.lit(" (closed)"))).when(m == 3, F.lit("Naples")).otherwise(F.col("name"))
    p = view(spark, sf, "fx_place").withColumn("n", n).withColumn("off", F.col("id") % 7 == 0).withColumn("b", F.lit(None).cast("string"))
    return p.select("id", K.flag_junk_display("n", is_town=F.lower("n").isin("naples"), brand="b", official="off").alias("junk"))


@q("classify_non_restaurant", "select id, (contains(' '||name||' ',' RING ') or (contains(' '||name||' ',' SMALL ') and not (chain_n>6 or contains(' '||name||' ',' GEAR '))) or (tier=2 and contains(' '||name||' ',' BLUE ') and chain_n<=6 and not contains(' '||name||' ',' GEAR '))) and not hc as venue from d")
def classify_non_restaurant(spark, sf):
    return places(spark, sf).select("id", K.non_restaurant("name", store=r"\bRING\b", hard=r"\bNOTHING\b", soft=r"\bSMALL\b", real_food=r"\bGEAR\b", busy=F.col("chain_n") > 6, plain_food=F.lit(False),
                                                           license_only=F.col("tier") == 2, license_words=r"\bBLUE\b", exempt=F.col("hc")).alias("venue"))


_VENUE = (f"with recursive {_D}, p as (select name as k, lat, lon from d where cuisine='PROMO' and lat is not null), u as (select distinct n.name as a, q.k as b from d n, (select k from p union select 'SMALL RING') q), {_TSET}"
          + lcs_of(f"select distinct a, b from ({_TSET_PRS})").removeprefix("with recursive ") + f", {_TSET_OUT}, sim as (select a, b from tset where s>=85)")


@C.add("flag_adult_venue", _VENUE + """ select d.id as id, (contains(name,'RED RING') or id%89=0 or id%97=0 or (city='Town 3' and id%90+1=29 and exists (select 1 from sim where a=d.name and b='SMALL RING'))
 or exists (select 1 from p join sim on sim.b=p.k where sim.a=d.name and sqrt(pow((p.lat-d.lat)*111000,2)+pow((p.lon-d.lon)*99000,2))<=45)) and not hc as listed_venue from d""", _V)
def flag_adult_venue(spark, sf):
    p = places(spark, sf)
    web = F.when(F.col("id") % 89 == 0, F.concat(F.lit("https://stripclub"), F.col("id").cast("string"), F.lit(".example"))).otherwise(F.lit(""))
    d = p.select("id", "name", F.col("name").alias("name_key"), web.alias("web"), F.when(F.col("id") % 97 == 0, F.concat(F.lit("L"), F.col("id").cast("string"))).alias("lic"), F.col("city").alias("town"), (F.col("id") % 90 + 1).cast("string").alias("num"), "lat", "lon", "hc", "cuisine")
    return K.flag_listed_venue(d, id="id", name="name", web="web", license="lic", pattern="RED RING", web_pattern="stripclub", licenses=d.filter("lic is not null").select(F.col("lic").alias("license")),
                               listed=spark.createDataFrame([("Town 3", "29", "SMALL RING")], "town string, num string, name_key string"), points=d.filter("cuisine = 'PROMO'"), exempt=F.col("hc")).select("id", "listed_venue")


@C.add("flag_operator", "select c_custkey, contains(c_name,'0007') as mouse from customer")
def flag_operator(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", K.flag_operator("c_name", r"CUSTOMER#\d*0007").alias("mouse"))


@C.add("usable_sources_filter", "select id, case when id%4=0 then null when id%4=1 then 'b' else 'b,'||lower(split_part(name,' ',2)) end as sources from fx_place", ["fx_place"])
def usable_sources_filter(spark, sf):
    m = F.col("id") % 4
    p = view(spark, sf, "fx_place").select("id", F.when(m == 0, F.array(F.lit("bad"))).when(m == 1, F.array(F.lit("bad"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lower(F.element_at(F.split("name", " "), 2)))).alias("sources"))
    verdicts = spark.createDataFrame([("bad", False), ("b", True)], "source string, allowed boolean")
    kept, waiting = K.usable_sources(p, id="id", sources="sources", verdicts=verdicts)
    return kept.select("id", F.array_join("sources", ",").alias("sources")).unionByName(waiting.select("id", F.lit(None).cast("string").alias("sources")))


@C.add("geocode_agreement", "select lic, lic%3=0 and lic%2=0 as ok from fx_address", ["fx_address"])
def geocode_agreement(spark, sf):
    m = F.concat("addr", F.when(F.col("lic") % 2 == 0, F.concat(F.lit(", OCALA, FL, "), "zip")).otherwise(F.lit(", OCALA, GA, 30301")))
    d = view(spark, sf, "fx_address").withColumn("m", m).withColumn("st", F.when(F.col("lic") % 3 == 0, "Match").otherwise("Tie")).withColumn("k", F.lit("Exact")).withColumn("t", F.lit(""))
    return d.select("lic", K.geocode_agreement(status="st", kind="k", matched="m", zip="zip", town="t").alias("ok"))


@C.add("tier_and_source", "select id, case when hc then 'official' when id%3=0 then 'both' else 'listing' end as tier, round((case when hc then 8 else 0 end)+(case when id%2=0 then 4 else 0 end)+(case when id%4=0 then 2 else 0 end)+confidence,4) as rank from fx_place", ["fx_place"])
def tier_and_source(spark, sf):
    p = view(spark, sf, "fx_place").withColumn("both", F.col("id") % 3 == 0).withColumn("snap", F.col("id") % 2 == 0).withColumn("src", F.when(F.col("id") % 4 == 0, "meta").otherwise("other"))
    return p.select("id", K.tier_and_rank(official="hc", confirmed="both", in_snapshot="snap", source="src", confidence="confidence").alias("t")).select("id", "t.tier", F.round("t.rank", 4).alias("rank"))


@C.add("guide_tags", "select id, hc and contains(lower(name),'ring') as ring, (hc and contains(lower(name),'gear')) or confidence>0.9 as gear from fx_place", ["fx_place"])
def guide_tags(spark, sf):
    tags = K.guide_tags("name", hand_checked=F.col("hc"), patterns={"ring": r"\bring\b", "gear": r"\bgear\b"}, strong={"gear": F.col("confidence") > 0.9})
    return view(spark, sf, "fx_place").select("id", *[c.alias(t) for t, c in tags.items()])


_SRC = "case id%5 when 0 then 'meta' when 1 then 'DAC' when 2 then 'BrightQuery' when 3 then 'Microsoft' end"


@C.add("source_group_label", f"""select id, case when hc then 'closed per listing/name' when s='meta' and c>=0.95 then 'meta_high' when s='meta' and c>=0.9 and id%2=0 then 'meta_mid_web' when s='meta' and c>=0.9 then 'meta_mid_noweb' when s='DAC' then 'brand_feed' when s='BrightQuery' and c>=0.95 then 'bq_high' when s='Microsoft' and c>=0.95 then 'ms_high' when s='meta' then 'meta_low' else 'other_sources' end as app,
 case when id%9=0 then 'snapshot says closed' when hc then 'listing says closed' when s='meta' and id%2=0 then 'meta + open in snapshot' when s='meta' then 'meta only' when s='DAC' and id%2=0 then 'brand feed + snapshot' when s='DAC' then 'brand feed only' when id%2=0 then 'other source + snapshot' when s='BrightQuery' then 'BrightQuery only' when s='Microsoft' then 'Microsoft only' else 'other' end as web from (select id, hc, {_SRC} as s, confidence as c from fx_place)""", ["fx_place"])
def source_group_label(spark, sf):
    m = F.col("id") % 5
    p = view(spark, sf, "fx_place").withColumn("s", F.when(m == 0, "meta").when(m == 1, "DAC").when(m == 2, "BrightQuery").when(m == 3, "Microsoft"))
    return p.select("id", K.source_group(closed=F.col("hc"), source="s", confidence="confidence", has_web=F.col("id") % 2 == 0).alias("app"),
                    K.source_group_web(closed_snapshot=F.col("id") % 9 == 0, closed=F.col("hc"), source="s", in_snapshot=F.col("id") % 2 == 0).alias("web"))


@C.add("match_provenance", "select id, case when id%3=0 then 'calibrate' when id%5=0 then 'second pass' else 'license row' end as via from fx_place where id%3=0 or id%5=0 or id%7=0", ["fx_place"])
def match_provenance(spark, sf):
    p = view(spark, sf, "fx_place").select("id", F.col("id").alias("match"))
    return K.match_provenance([("calibrate", p.filter("id % 3 = 0")), ("second pass", p.filter("id % 5 = 0")), ("license row", p.filter("id % 7 = 0"))], id="id").select("id", "via")


# --- imputation and scores ------------------------------------------------------------------------------------------------------
_PRICE = """with s as (select id, case when id%3=0 then 1+p_size%4 end as price, case when id%2=0 then brand end as brand, category as cuisine, case when id%5=0 then 'k'||(id%50) end as ckey from fx_place join part on p_partkey=id),
 mb as (select brand, median(price) as m from s where price is not null and brand is not null group by 1), mc as (select cuisine, median(price) as m from s where price is not null group by 1), mk as (select ckey, median(price) as m from s where price is not null and ckey is not null group by 1)
 select id, cast(least(4, greatest(1, round_even(case when price is not null then price when mk.m is not null then mk.m when mb.m is not null then mb.m when mc.m is not null then mc.m else 2 end, 0))) as int) as price, price is null as est from s left join mb on s.brand=mb.brand left join mc on s.cuisine=mc.cuisine left join mk on s.ckey=mk.ckey"""


def _priced(spark, sf):
    p = view(spark, sf, "fx_place").join(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("id") == F.col("p_partkey"))
    s = p.select("id", F.when(F.col("id") % 3 == 0, 1 + F.col("p_size") % 4).alias("price"), F.when(F.col("id") % 2 == 0, F.col("brand")).alias("brand"), F.col("category").alias("cuisine"),
                 F.when(F.col("id") % 5 == 0, F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("ckey"))
    return E.impute_price(s, price="price", brand="brand", cuisine="cuisine", chain_key="ckey")


@C.add("impute_price_cascade", _PRICE, ["fx_place"])
def impute_price_cascade(spark, sf):
    return _priced(spark, sf).select("id", F.col("price_out").alias("price"), F.col("price_est").alias("est"))


@C.add("snap_rare_spelling")
def snap_rare_spelling(spark, sf):
    p = view(spark, sf, "fx_place")
    low = F.initcap(F.lower("name"))
    v = F.when(F.col("id") % 61 == 0, F.concat(low, F.lit("g"))).when(F.col("id") % 67 == 0, F.concat(low, F.lit(", Fl, Us"))).otherwise(low)
    return E.snap_rare_spelling(p.select(v.alias("town"), F.col("county_id").cast("string").alias("zip")), value="town", zip="zip")


@C.add("fill_city_from_zip", "with s as (select lic, zip, case when lic%4<>0 then 'T'||(lic%7) end as city from fx_address), m as (select zip, city from (select zip, city, row_number() over (partition by zip order by count(*) desc, city) as rn from s where city is not null group by 1,2) where rn=1) select lic, coalesce(s.city, m.city) as city from s left join m on s.zip=m.zip", ["fx_address"])
def fill_city_from_zip(spark, sf):
    from ..operators.joins import fill_from_mode
    s = view(spark, sf, "fx_address").select("lic", "zip", F.when(F.col("lic") % 4 != 0, F.concat(F.lit("T"), (F.col("lic") % 7).cast("string"))).alias("city"))
    return fill_from_mode(s, "zip", "city").select("lic", "city")


@C.add("bayes_rating", "select id, round((n*r+40*(select avg(confidence*5) from fx_place))/(n+40),6) as bayes from (select id, confidence*5 as r, id%300 as n from fx_place)", ["fx_place"])
def bayes_rating(spark, sf):
    p = view(spark, sf, "fx_place").select("id", (F.col("confidence") * 5).alias("r"), (F.col("id") % 300).alias("n"))
    return E.bayes_rating(p, rating="r", reviews="n").select("id", F.round("bayes", 6).alias("bayes"))


_SALES = """with s as (select id, 1+id%4 as price, case when id%4<>3 then id%300 end as n, id%10=0 as bar, id%9 as chain_n, case when id%2=0 then brand end as brand, category as cuisine, confidence*5 as bayes from fx_place),
 m as (select price, median(n) as m from s where n is not null and chain_n<5 group by 1), bm as (select brand, median(n) as bm from s where brand is not null group by 1),
 pc as (select id, round_even((rank() over (order by bayes)+(count(*) over (partition by bayes)-1)/2.0)/count(*) over ()*100,1) as pct from s),
 j as (select s.*, m.m as m, bm.bm as bm, case when s.brand='Brand#1' then 1500000 end as auv, pct from s left join m on s.price=m.price left join bm on s.brand=bm.brand join pc on s.id=pc.id)
 select id, round(case when auv is not null then auv*greatest(0.6,least(1.5,coalesce(pow(n/bm,0.35),0.85))) else greatest(100000,least(40000000, case price when 1 then 600000 when 2 then 1000000 when 3 then 2200000 else 3500000 end*(case when bar then 1.15e0 else 1e0 end)*pow(coalesce((n+10)/(m+10),0.6),0.764))) end,2) as rev,
 case when auv is not null then 'chain' when n is not null then 'model' else 'model-low' end as rev_src, round_even((case price when 1 then 0.075e0 when 2 then 0.05e0 when 3 then 0.055e0 else 0.045e0 end)*(0.8+0.4*pct/100),4) as margin from j"""


@C.add("sales_profit_model", _SALES, ["fx_place"])
def sales_profit_model(spark, sf):
    i = F.col("id")
    s = view(spark, sf, "fx_place").select("id", (1 + i % 4).cast("int").alias("price"), F.when(i % 4 != 3, i % 300).alias("n"), (i % 10 == 0).alias("bar"), (i % 9).alias("chain_n"), F.when(i % 2 == 0, F.col("brand")).alias("brand"), F.col("category").alias("cuisine"), (F.col("confidence") * 5).alias("bayes"))
    m = E.sales_model(s, price="price", reviews="n", bar=F.col("bar"), chain_n="chain_n", brand="brand", cuisine="cuisine", bayes="bayes", venue=F.lit(False), brand_sales=spark.createDataFrame([("Brand#1", 1500000.0)], "brand string, auv double"))
    return m.select("id", F.round("rev", 2).alias("rev"), "rev_src", "margin")


@q("icon_score", """, pc as (select id, round_even((rank() over (order by chain_n)+(count(*) over (partition by chain_n)-1)/2.0)/count(*) over ()*100,1) as pct from d) select d.id as id, case when honors<>0 or award>0 then round(least(100, least(70, (case when honors&1<>0 then 40 else 0 end)+(case when honors&2<>0 then 26 when honors&4<>0 then 14 when honors&8<>0 then 6 else 0 end)
 +(case award when 5 then 70 when 4 then 62 when 3 then 52 when 2 then 36 when 1 then 22 else 0 end)+(case when venue then 16 else 0 end)) + least(greatest(coalesce(2026-founded,0),0),100)/100.0*24 + pct/100*14),4) end as icon from d join pc on d.id=pc.id""")
def icon_score(spark, sf):
    p = places(spark, sf)
    return E.icon_score(p, honors="honors", award="award", oldest="venue", founded="founded", reviews="chain_n", honored=D.is_honored(), year=2026).select("id", F.round("icon", 4).alias("icon"))


@C.add("county_and_region_assign", f"with {_TIERS}, l as (select id, case when id%4=0 then 'NATION_'||(id%25) when id%4=1 then 'NATION_3' end as lic, lat from fx_place) select l.id as id, coalesce(l.lic, c.name) as county, not (l.lic is not null and c.name is not null and l.lic<>c.name) as placed from l left join c on l.id=c.id", ["fx_place", "fx_polygon"])
def county_and_region_assign(spark, sf):
    i = F.col("id")
    p = view(spark, sf, "fx_place").withColumn("lic", F.when(i % 4 == 0, F.concat(F.lit("NATION_"), (i % 25).cast("string"))).when(i % 4 == 1, F.lit("NATION_3")))
    return E.county_assign(p, _tiers(spark, sf), id="id", license_county="lic").select("id", "county", F.col("lat").isNotNull().alias("placed"))


@C.add("region_assign", f"with {_TIERS}, l as (select id, case when id%4=0 then 'NATION_'||(id%25) when id%4=1 then 'NATION_3' end as lic from fx_place), k as (select l.id as id, coalesce(l.lic, c.name) as county from l left join c on l.id=c.id) "
       "select k.id as id, k.county as county, r.r_name as region from k left join nation n on n.n_name=k.county left join region r on r.r_regionkey=n.n_regionkey", ["fx_place", "fx_polygon"])
def region_assign(spark, sf):
    i = F.col("id")
    p = view(spark, sf, "fx_place").withColumn("lic", F.when(i % 4 == 0, F.concat(F.lit("NATION_"), (i % 25).cast("string"))).when(i % 4 == 1, F.lit("NATION_3")))
    regions = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("county"), F.col("r_name").alias("region"))
    return E.county_assign(p, _tiers(spark, sf), id="id", license_county="lic", regions=regions).select("id", "county", "region")


@C.add("split_same_name_town", """with s as (select 'T'||(id%40) as town, 'C'||county_id as county, lat, lon from fx_place), m as (select town, county, median(lat) as la, median(lon) as lo, count(*) as n from s group by 1,2), b as (select * from (select *, row_number() over (partition by town order by n desc, county) as rn from m) where rn=1)
 select m.town as town, m.county as county, m.town||' ('||m.county||' Co.)' as new_town from m join b on m.town=b.town where sqrt(pow((m.la-b.la)*111,2)+pow((m.lo-b.lo)*99,2))>40""", ["fx_place"])
def split_same_name_town(spark, sf):
    p = view(spark, sf, "fx_place").select(F.concat(F.lit("T"), (F.col("id") % 40).cast("string")).alias("town"), F.concat(F.lit("C"), F.col("county_id").cast("string")).alias("county"), "lat", "lon")
    return E.split_same_name_town(p, town="town", county="county")
