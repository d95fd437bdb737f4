"""Registered queries over name, address and link functions, run on whole tables."""
from pyspark.sql import functions as F

from ..functions import address as A, records as R, similarity as S, text as T, urls as U, vocab as V
from ..functions._col import lookup
from ..operators import joins as J, matching as M, scale
from .tables import Catalog, table, view

C = Catalog()


def _in_list(words):
    return ",".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_norm(c):
    """SQL of the name key for texts of plain letters, digits and spaces."""
    return (f"trim(regexp_replace(array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(upper(coalesce({c},'')),'&',' AND ','g'),'''S','S','g'),'[^A-Z0-9 ]',' ','g'),' +'), "
            f"lambda w: w not in ('',{_in_list(V.STOP)}) and not regexp_full_match(w,'[0-9][0-9]+')),' '),' +',' ','g'))")


def sql_stems(c):
    g = _in_list(V.GENERIC)
    return (f"list_sort(list_distinct(list_filter(list_transform(list_filter(string_split({c},' '), lambda w: w<>'' and w not in ({g})), "
            f"lambda w: case when length(w)>3 and w like '%S' then substr(w,1,length(w)-1) else w end), lambda w: w not in ({g}))))")


def _docs(spark, sf):
    return table(spark, sf, "documents")


@C.add("fix_encoding", "select doc_id, md5(trim(regexp_replace(translate(text, '’‘´“”', '''''''\"\"'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as fixed from documents")
def fix_encoding(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.fix_encoding("text")).alias("fixed"))


@C.add("norm_name", f"select reg_id, {sql_norm('name')} as k from fx_registry", ["fx_registry"])
def norm_name(spark, sf):
    return view(spark, sf, "fx_registry").select("reg_id", T.norm_name("name").alias("k"))


@C.add("repair_mojibake")
def repair_mojibake(spark, sf):
    d = _docs(spark, sf)
    broken = F.decode(F.encode(F.concat(F.lit("Café "), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(" &amp; Söhne | best in town")), "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", T.repair_mojibake(broken).alias("name"))


@C.add("nice_case")
def nice_case(spark, sf):
    r = view(spark, sf, "fx_registry").select("reg_id", T.nice_case("name").alias("shown"))
    a = view(spark, sf, "fx_address").select("lic", T.nice_case("addr", addr=True).alias("addr"))
    return r.join(a, r.reg_id == a.lic, "full").select("reg_id", "lic", "shown", "addr")


@C.add("canon_city", "select c_custkey, case c_custkey%4 when 0 then 'Port St. Lucie' when 1 then 'North Bay Village' when 2 then 'St. Petersburg' else 'Segment '||substr(c_mktsegment,1,1)||lower(substr(c_mktsegment,2)) end as town from customer")
def canon_city(spark, sf):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit("PT SAINT LUCIE, FL 34952")).when(F.col("c_custkey") % 4 == 1, F.lit("N BAY VLG")) \
        .when(F.col("c_custkey") % 4 == 2, F.lit("City of St Pete")).otherwise(F.concat(F.lit("segment "), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", T.canon_city(raw).alias("town"))


@C.add("town_key", "select c_custkey, 'northfort'||regexp_replace(lower(c_mktsegment),'[^a-z]','','g')||'beach' as k from customer")
def town_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.town_key(F.concat(F.lit("N. Ft. "), "c_mktsegment", F.lit(" Bch"))).alias("k"))


@C.add("name_stems", f"select reg_id, array_to_string({sql_stems('k')},' ') as stems from (select reg_id, {sql_norm('name')} as k from fx_registry)", ["fx_registry"])
def name_stems(spark, sf):
    r = view(spark, sf, "fx_registry")
    return r.select("reg_id", F.array_join(F.array_sort(T.name_stems(T.norm_name("name"))), " ").alias("stems"))


_KINDS = {"RING": "ring", "WIDGET": "widget", "GEAR": "gear", "RED": "red", "SMALL": "small", "LARGE": "large"}
_KIND_SQL = "list_sort(list_distinct(list_filter(string_split({},' '), lambda w: w in ('RING','WIDGET','GEAR','RED','SMALL','LARGE'))))"


@C.add("name_kinds", f"select reg_id, lower(array_to_string({_KIND_SQL.format('r.name')},' ')) as kinds, (len({_KIND_SQL.format('r.name')})>0 and len({_KIND_SQL.format('p.name')})>0 and not list_has_any({_KIND_SQL.format('r.name')},{_KIND_SQL.format('p.name')})) as conflict from fx_registry r join fx_place p on p.id=r.reg_id+3", ["fx_registry", "fx_place"])
def name_kinds(spark, sf):
    r, p = view(spark, sf, "fx_registry").withColumnRenamed("name", "rname"), view(spark, sf, "fx_place")
    return r.join(p, F.col("id") == F.col("reg_id") + 3).select("reg_id", F.array_join(F.array_sort(T.name_kinds("rname", _KINDS)), " ").alias("kinds"),
                                                               T.kind_conflict("rname", "name", _KINDS).alias("conflict"))


_STREET = "case lic%6 when 0 then 'NW 27 AVE' when 1 then 'NW 27 AVE' when 2 then 'MAIN ST' when 3 then 'MAIN ST' when 4 then 'US 301 N' else 'SR 70' end"
_CORE = "case lic%6 when 0 then '27' when 1 then '27' when 2 then 'MAIN' when 3 then 'MAIN' when 4 then 'US 301' else 'SR 70' end"
_NUM = "cast(lic%900+1 as varchar)"


@C.add("split_house_number", f"select lic, {_NUM} as num, case lic%6 when 0 then 'NW 27TH AVE' when 1 then 'NORTHWEST 27 AVENUE' when 2 then 'MAIN ST' when 3 then 'MAIN STREET' when 4 then 'US HWY 301 N' else 'STATE ROAD 70' end as street from fx_address", ["fx_address"])
def split_house_number(spark, sf):
    return view(spark, sf, "fx_address").select("lic", A.split_house_number("addr").alias("k")).select("lic", "k.num", "k.street")


@C.add("road_norm", f"select lic, case lic%6 when 4 then {_NUM}||' US 301 N' when 5 then {_NUM}||' SR 70' else addr end as road from fx_address", ["fx_address"])
def road_norm(spark, sf):
    return view(spark, sf, "fx_address").select("lic", A.road_norm("addr").alias("road"))


@C.add("street_key", f"select lic, {_NUM} as num, {_STREET} as street from fx_address", ["fx_address"])
def street_key(spark, sf):
    return view(spark, sf, "fx_address").select("lic", A.street_key("addr").alias("k")).select("lic", "k.num", "k.street")


@C.add("core_key", f"select lic, {_NUM} as num, {_CORE} as street from fx_address", ["fx_address"])
def core_key(spark, sf):
    return view(spark, sf, "fx_address").select("lic", A.core_key("addr").alias("k")).select("lic", "k.num", "k.street")


@C.add("street_number_range", f"""select lic, case when lic%3=0 then array_to_string(list_transform(range(lic%900+1, lic%900+1+lic%14+1, case when (lic%14)%2=0 then 2 else 1 end), lambda x: cast(x as varchar)), ',') else {_NUM} end as nums
 from fx_address where not (lic%3=0 and lic%14>12) union all select lic, {_NUM} as nums from fx_address where lic%3=0 and lic%14>12""", ["fx_address"])
def street_number_range(spark, sf):
    lo = F.col("lic") % 900 + 1
    raw = F.when(F.col("lic") % 3 == 0, F.concat(lo.cast("string"), F.lit("-"), (lo + F.col("lic") % 14).cast("string"), F.lit(" Main St"))).otherwise(F.col("addr"))
    return view(spark, sf, "fx_address").select("lic", F.array_join(A.street_number_range(raw), ",").alias("nums"))


@C.add("street_compat", f"""select a.lic as lic, (x.s = y.s or x.c = y.c and not (x.c = '27' and a.lic%2 = 1)) as same from fx_address a
 join (select lic, {_STREET} as s, {_CORE} as c from fx_address) x on x.lic=a.lic join (select lic, {_STREET} as s, {_CORE} as c from fx_address) y on y.lic=a.lic+1""", ["fx_address"])
def street_compat(spark, sf):
    a = view(spark, sf, "fx_address").select("lic", A.street_key("addr")["street"].alias("s"))
    b = a.select((F.col("lic") - 1).alias("_l"), F.col("s").alias("s2"))
    return a.join(b, F.col("lic") == F.col("_l")).select("lic", A.street_compat("s", "s2").alias("same"))


@C.add("tidy_street", f"select lic, case when lic%2=0 then {_NUM}||' Meadow Ln' else addr end as street, case when lic%2=0 then null else 'Naples' end as town from fx_address", ["fx_address"])
def tidy_street(spark, sf):
    raw = F.when(F.col("lic") % 2 == 0, F.concat(F.lit("Located in: Mall, between X and Y, "), (F.col("lic") % 900 + 1).cast("string"), F.lit(" Meadow Ln"))) \
        .otherwise(F.concat("addr", F.lit(", Naples, FL")))
    return view(spark, sf, "fx_address").select("lic", A.tidy_street(raw).alias("k")).select("lic", "k.street", "k.town")


@C.add("clean_listing_name", "select id, case id%4 when 0 then name when 1 then (case when id%3=0 then name else name||' Ocala' end) when 2 then name else brand end as name from fx_place", ["fx_place"])
def clean_listing_name(spark, sf):
    p = view(spark, sf, "fx_place")
    raw = F.when(F.col("id") % 4 == 0, F.concat("name", F.lit(" - Ocala, FL"))).when(F.col("id") % 4 == 1, F.concat("name", F.lit(" Ocala"))) \
        .when(F.col("id") % 4 == 2, F.concat("name", F.lit(" of Ocala, Florida"))).otherwise(F.lit("Ocala"))
    brand = F.when((F.col("id") % 4 == 3) | (F.col("id") % 3 == 0), F.col("brand"))
    return p.select("id", T.clean_listing_name(raw, F.lit("Ocala"), brand, lambda c: c.isin("ocala", "naples")).alias("name"))


@C.add("split_trade_names", f"select reg_id, array_to_string(list_filter([k, 'CORNER '||k, 'OTHER SIDE'], lambda x: x is not null),'|') as keys from (select reg_id, {sql_norm('name')} as k from fx_registry)", ["fx_registry"])
def split_trade_names(spark, sf):
    r = view(spark, sf, "fx_registry")
    return r.select("reg_id", F.array_join(T.split_trade_names("name", F.concat(F.lit("Corner "), "name", F.lit(" d/b/a The Other Side")), F.concat("name", F.lit(" Inc"))), "|").alias("keys"))


@C.add("clean_official_name")
def clean_official_name(spark, sf):
    r = view(spark, sf, "fx_registry")
    trade = F.array(F.concat("name", F.lit(" INC")), F.concat(F.lit("SHOP "), "name"))
    return r.select("reg_id", T.clean_official_name(F.concat("name", F.when(F.col("reg_id") % 2 == 0, F.lit(" HOLDINGS")).otherwise(F.lit(" #1234"))), trade).alias("shown"))


@C.add("tidy_display_name")
def tidy_display_name(spark, sf):
    p = view(spark, sf, "fx_place")
    return p.select("id", T.tidy_display_name(F.concat(F.initcap(F.lower("name")), F.when(F.col("id") % 3 == 0, F.lit(" - Best Pizza In Town")).when(F.col("id") % 3 == 1, F.lit(", LLC 寿司")).otherwise(F.lit(", The")))).alias("shown"))


def _sql_words(pattern):
    """A pattern of whole words for SQL, whose \\b knows no letters beyond A-Z."""
    return pattern.replace(r"\b(?:", r"(?:^|[^\p{L}\p{N}_])(?:").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])")


@C.add("legal_holder_flags", f"""select doc_id, regexp_matches(s, '{T.LEGAL_END}') as is_legal, regexp_matches(s, '{T.LEGALISH}') as legalish, regexp_matches(s, '{_sql_words(T.HOLDER)}') as holder, regexp_matches(s, '{_sql_words(T.FOODISH)}') as foodish
 from (select doc_id, text||case when doc_id%2=0 then ' llc' else '' end as s from documents)""")
def legal_holder_flags(spark, sf):
    s = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" llc")).otherwise(F.lit("")))
    return _docs(spark, sf).select("doc_id", T.legal_flags(s).alias("f")).select("doc_id", "f.*")


@C.add("stable_id", """select id, case when rn=1 then h else h||repeat('x', rn-1) end as sid from (select id, h, row_number() over (partition by h order by id) as rn from
 (select id, substr(md5(case when id%4=0 then cast(id as varchar) else k||'|'||cast(county_id as varchar) end),1,12) as h from (select id, county_id, """ + sql_norm("name") + " as k from fx_place)))", ["fx_place"])
def stable_id(spark, sf):
    p = view(spark, sf, "fx_place")
    src = F.coalesce(F.when(F.col("id") % 4 == 0, F.col("id").cast("string")), F.concat_ws("|", T.norm_name("name"), F.col("county_id").cast("string")))
    h = p.select("id", R.stable_id(src).alias("h"))
    n = scale.ranked(h, ["h"], ["id"], "rn")
    return n.select("id", F.concat("h", F.repeat(F.lit("x"), (F.col("rn") - 1).cast("int"))).alias("sid"))


@C.add("search_normalize", "select doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(lower(strip_accents(text)), '\\b([a-z0-9])\\s*&\\s*([a-z0-9])\\b', '\\1\\2', 'g'),'&',' and '),'''',''),'’',''),'`',''), '[^\\p{L}\\p{N}]+', ' ', 'g'))) as s from documents")
def search_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.search_normalize("text")).alias("s"))


@C.add("search_text", "select id, ' '||lower(name)||' '||regexp_replace(lower(brand),'[^a-z0-9]+',' ','g')||' county '||county_id||' '||(id%90+1)||' sw 8th st ' as s from fx_place", ["fx_place"])
def search_text(spark, sf):
    p = view(spark, sf, "fx_place")
    return p.select("id", T.search_text("name", "brand", F.concat(F.lit("County "), F.col("county_id").cast("string")), address=F.concat((F.col("id") % 90 + 1).cast("string"), F.lit(" Southwest 8th Street"))).alias("s"))


@C.add("url_registrable_domain", "select page_id, array_to_string(list_slice(string_split(h,'.'), -2, -1),'.') as dom from (select page_id, regexp_replace(regexp_extract(lower(url),'^[a-z]+://([^/?#:]*)',1),'^www[0-9]?\\.','') as h from fx_url)", ["fx_url"])
def url_registrable_domain(spark, sf):
    return view(spark, sf, "fx_url").select("page_id", U.url_registrable_domain("url").alias("dom"))


_TRACK_VALUES = " or ".join(f"(lower(split_part(p,'=',1))='{name}' and regexp_matches(split_part(p,'=',2),'{rx}'))" for name, rx in V.TRACKING_VALUES.items())
_TRACK = f"(regexp_matches(split_part(p,'=',1), '{V.TRACKING_NAMES}') or {_TRACK_VALUES})"
_CLEAN = f"""parts as (select page_id, url, regexp_extract(url,'^([^?#]*)(\\?[^#]*)?(#.*)?$',1) as path, substr(regexp_extract(url,'^([^?#]*)(\\?[^#]*)?(#.*)?$',2),2) as q, substr(regexp_extract(url,'^([^?#]*)(\\?[^#]*)?(#.*)?$',3),2) as f from fx_url),
 kept as (select *, array_to_string(list_filter(string_split(q,'&'), lambda p: not {_TRACK}),'&') as q2,
  case when not contains(f,'=') then f when contains(f,'?') then regexp_extract(f,'^(.*)\\?([^?]*)$',1)||coalesce('?'||nullif(array_to_string(list_filter(string_split(regexp_extract(f,'^(.*)\\?([^?]*)$',2),'&'), lambda p: not {_TRACK}),'&'),''),'')
   else array_to_string(list_filter(string_split(f,'&'), lambda p: not {_TRACK}),'&') end as f2,
  array_to_string(list_transform(string_split(path,'/'), lambda g: case when contains(g,'=') then array_to_string(list_filter(string_split(g,'&'), lambda p: p<>'' and not {_TRACK}),'&') else g end),'/') as path2 from parts),
 cleaned as (select page_id, url as old, path2||case when q2<>'' then '?'||q2 else '' end||case when f2<>'' then '#'||f2 else '' end as url from kept)"""


@C.add("url_strip_tracking", f"with {_CLEAN} select page_id, url from cleaned", ["fx_url"])
def url_strip_tracking(spark, sf):
    return view(spark, sf, "fx_url").select("page_id", U.url_strip_tracking("url").alias("url"))


@C.add("url_safe", """select page_id, case page_id%3 when 0 then url when 1 then 'https://'||u else null end as safe, rtrim(regexp_replace(lower(u),'^www\\.',''),'/') as key
 from (select page_id, url, regexp_replace(url,'^https?://','') as u from fx_url)""", ["fx_url"])
def url_safe(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    raw = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, bare).otherwise(F.concat(F.lit("javascript:"), bare))
    return view(spark, sf, "fx_url").select("page_id", U.url_safe(raw).alias("safe"), U.url_key("url").alias("key"))


@C.add("tracked_links_audit", f"with {_CLEAN} select page_id, case when url<>old then 1 else 0 end as tracked from cleaned", ["fx_url"])
def tracked_links_audit(spark, sf):
    u = view(spark, sf, "fx_url")
    return u.select("page_id", F.size(U.tracked_links(F.concat(F.lit('{"w":"'), F.replace("url", F.lit("/"), F.lit("\\/")), F.lit('"}')))).alias("tracked"))


@C.add("slug", "select doc_id, regexp_replace(regexp_replace(lower(strip_accents(source)),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') as slug, date_diff('day', date '2000-01-01', date '2024-01-01' + cast(doc_id%400 as int)) as day_no, strftime(date '2024-01-01' + cast(doc_id%400 as int), '%B %-d, %Y') as day from documents")
def slug(spark, sf):
    d = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    return _docs(spark, sf).select("doc_id", T.slug("source").alias("slug"), R.day_number(d).alias("day_no"), R.day_text(d).alias("day"))


@C.add("tag_bitmask", "select id, cast(tags & 15 as int) as mask, (tags & 4) <> 0 as third from fx_place", ["fx_place"])
def tag_bitmask(spark, sf):
    bits = [F.col("tags").bitwiseAND(F.lit(1 << i)) != 0 for i in range(4)]
    return view(spark, sf, "fx_place").select("id", R.tag_bitmask(*bits).alias("mask"), R.has_tag(R.tag_bitmask(*bits), 2).alias("third"))


_HONORS = ["Best Chef: South semifinalist", "Best Chef: South winner", "America's Classic", "Outstanding Restaurateur finalist; Best New Restaurant finalist", "Outstanding Restaurateur winner"]


@C.add("honor_flags", "select id, case id%5 when 0 then 8 when 1 then 2 when 2 then 1 when 3 then 4 else 0 end + case when hc then 16 else 0 end as flags from fx_place", ["fx_place"])
def honor_flags(spark, sf):
    h = F.element_at(F.array(*[F.lit(x) for x in _HONORS]), (F.col("id") % 5 + 1).cast("int"))
    return view(spark, sf, "fx_place").select("id", R.honor_flags(h, "hc").alias("flags"))


@C.add("display_labels", "select id, case when hc then 'Licensed' when county_id%3=1 then 'Confirmed listing' else 'Map listing' end as tier, case when confidence<0.1 then 'Here' else format('{:.1f} mi', confidence) end as away from fx_place", ["fx_place"])
def display_labels(spark, sf):
    return view(spark, sf, "fx_place").select("id", R.tier_label(F.col("county_id") % 3, "hc").alias("tier"), R.distance_text("confidence").alias("away"))


@C.add("first_real_source", "select doc_id, case when doc_id%3=0 then null when doc_id%3=1 then source else 'meta' end as src from documents")
def first_real_source(spark, sf):
    arr = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Overture"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("Overture"), F.col("source"))).otherwise(
        F.array(F.lit("Overture-signals"), F.lit("meta"), F.col("source")))
    return _docs(spark, sf).select("doc_id", T.first_real_source(arr).alias("src"))


@C.add("unique_anchor", "select id, case when s in ('red-ring') then s||'-'||(rn+1) when rn=1 then s else s||'-'||rn end as anchor from (select id, s, row_number() over (partition by s order by id) as rn from (select id, replace(lower(name),' ','-') as s from fx_place))", ["fx_place"])
def unique_anchor(spark, sf):
    p = view(spark, sf, "fx_place").select("id", T.slug("name").alias("s"))
    n = scale.ranked(p, ["s"], ["id"], "rn").withColumn("rn", F.col("rn") + F.when(F.col("s").isin("red-ring"), 1).otherwise(0))
    return n.select("id", F.when(F.col("rn") == 1, F.col("s")).otherwise(F.concat("s", F.lit("-"), F.col("rn").cast("string"))).alias("anchor"))


# --- similarity -----------------------------------------------------------------------------------------------------------------
_PAIRS = f"""with recursive pr as (select r.county_id as county_id, p.a as a, r.b as b, r.n*p.n as pairs from (select county_id, {sql_norm('name')} as b, count(*) as n from fx_registry group by 1,2) r
  join (select county_id, name as a, count(*) as n from fx_place group by 1,2) p on p.county_id=r.county_id),
 prs as (select distinct {{a}} as a, {{b}} as b from pr),
 dp(a,b,i,r) as (select a,b,0, list_transform(range(0,length(b)+1), lambda x: cast(0 as bigint)) from prs union all
  select a,b,i+1, list_transform(range(1,length(b)+2), lambda k: list_max(list_slice(t,1,k))) from (select a,b,i, list_transform(range(0,length(b)+1), lambda j: case when j=0 then 0 else greatest(r[j+1], r[j]+case when substr(b,j,1)=substr(a,i+1,1) then 1 else 0 end) end) as t from dp where i<length(a))),
 lcs as (select a,b, 200e0*r[length(b)+1]/(length(a)+length(b)) as s from dp where i=length(a))"""


def _pair_rows(spark, sf):
    """Every pair of a registry name and a place name of one county, once, with the number of row pairs it stands for."""
    r = view(spark, sf, "fx_registry").groupBy(F.col("county_id").alias("rc"), T.norm_name("name").alias("b")).agg(F.count("*").alias("nr"))
    p = view(spark, sf, "fx_place").groupBy("county_id", F.col("name").alias("a")).agg(F.count("*").alias("np"))
    return r.join(p, F.col("county_id") == F.col("rc")).select("county_id", "a", "b", (F.col("nr") * F.col("np")).alias("pairs"))


def lcs_of(prs: str) -> str:
    """Common table expressions ending in lcs(a, b, s): similarity of the text pairs (a, b) of ``prs``."""
    return f"""with recursive prs as ({prs}),
 dp(a,b,i,r) as (select a,b,0, list_transform(range(0,length(b)+1), lambda x: cast(0 as bigint)) from prs union all
  select a,b,i+1, list_transform(range(1,length(b)+2), lambda k: list_max(list_slice(t,1,k))) from (select a,b,i, list_transform(range(0,length(b)+1), lambda j: case when j=0 then 0 else greatest(r[j+1], r[j]+case when substr(b,j,1)=substr(a,i+1,1) then 1 else 0 end) end) as t from dp where i<length(a))),
 lcs as (select a,b, 200e0*r[length(b)+1]/greatest(length(a)+length(b),1) as s from dp where i=length(a))"""


def _SW_SQL(c):
    return f"array_to_string(list_sort(string_split({c},' ')),' ')"


def _lcs(ctes: str, prs: str) -> str:
    """Common table expressions ending in lcs(a, b, s): similarity of the text pairs of ``prs``."""
    return f"""with recursive pr as (select r.county_id as county_id, p.a as a, r.b as b, r.n*p.n as pairs from (select county_id, {sql_norm('name')} as b, count(*) as n from fx_registry group by 1,2) r
  join (select county_id, name as a, count(*) as n from fx_place group by 1,2) p on p.county_id=r.county_id),
 u as (select distinct a, b from pr), {ctes}prs as (select distinct a, b from ({prs})),
 dp(a,b,i,r) as (select a,b,0, list_transform(range(0,length(b)+1), lambda x: cast(0 as bigint)) from prs union all
  select a,b,i+1, list_transform(range(1,length(b)+2), lambda k: list_max(list_slice(t,1,k))) from (select a,b,i, list_transform(range(0,length(b)+1), lambda j: case when j=0 then 0 else greatest(r[j+1], r[j]+case when substr(b,j,1)=substr(a,i+1,1) then 1 else 0 end) end) as t from dp where i<length(a))),
 lcs as (select a,b, 200e0*r[length(b)+1]/greatest(length(a)+length(b),1) as s from dp where i=length(a))"""


_WORDS_OF = "list_distinct(string_split({},' '))"
_TSET = """w as (select a, b, array_to_string(list_sort(list_filter(wa, lambda x: list_contains(wb,x))),' ') as both_, array_to_string(list_sort(list_filter(wa, lambda x: not list_contains(wb,x))),' ') as oa,
  array_to_string(list_sort(list_filter(wb, lambda x: not list_contains(wa,x))),' ') as ob from (select a, b, list_distinct(string_split(a,' ')) as wa, list_distinct(string_split(b,' ')) as wb from u)),
 ts as (select *, trim(both_||' '||oa) as ta, trim(both_||' '||ob) as tb from w), """
_TSET_PRS = "select ta as a, tb as b from ts union all select both_, ta from ts union all select both_, tb from ts"
_TSET_OUT = """tset as (select ts.a as a, ts.b as b, case when both_<>'' and (oa='' or ob='') then 100e0 else greatest(x.s, case when both_<>'' then y.s else 0 end, case when both_<>'' then z.s else 0 end) end as s from ts
  join lcs x on x.a=ta and x.b=tb join lcs y on y.a=both_ and y.b=ta join lcs z on z.a=both_ and z.b=tb)"""
_SIM_PARTIAL = _lcs("""v as (select a, b, case when length(a)<=length(b) then a else b end as sh, case when length(a)<=length(b) then b else a end as lo from u),
 win as (select a, b, sh, substr(lo, greatest(k,0)+1, least(k+length(sh), length(lo))-greatest(k,0)) as w from (select *, unnest(range(1-length(sh), length(lo))) as k from v)), """, "select sh as a, w as b from win") + \
    ", best as (select win.a as a, win.b as b, max(s) as s from win join lcs on lcs.a=sh and lcs.b=w group by 1,2) select county_id, pr.a as a, pr.b as b, pairs, round(s,4) as score from pr join best on pr.a=best.a and pr.b=best.b"
_STEM_CTE = f"st as (select a, b, {sql_stems('a')} as sa, {sql_stems('b')} as sb from u), "
_FILL = "(" + ",".join("'" + w + "'" for w in V.FILLER) + ")"
_REAL = _lcs(_STEM_CTE + "wp as (select a, b, x, unnest(sb) as y from (select a, b, unnest(sa) as x, sb from st)), wl as (select * from wp where length(x)>=5 and length(y)>=5), ", "select x as a, y as b from wl") + \
    f""", cl as (select wl.a as a, wl.b as b, max(s) as s from wl join lcs on lcs.a=x and lcs.b=y group by 1,2)
 select county_id, pr.a as a, pr.b as b, pairs, list_has_any(list_filter(sa, lambda w: w not in {_FILL}), list_filter(sb, lambda w: w not in {_FILL})) as shared, list_has_any(sa,sb) or coalesce(cl.s,0)>=85 as close from pr join st on pr.a=st.a and pr.b=st.b left join cl on pr.a=cl.a and pr.b=cl.b"""
_JOIN = "replace({},' ','')"
_NAME_SIM = _lcs(_STEM_CTE + _TSET, _TSET_PRS + f" union all select a, b from u union all select {_JOIN.format('a')}, {_JOIN.format('b')} from u union all select {_SW_SQL('a')}, {_SW_SQL('b')} from u") + f""", {_TSET_OUT},
 f as (select u.a as a, u.b as b, j.s as js, r.s as rs, o.s as os, t.s as tss, sa, sb, len(list_filter({_WORDS_OF.format('u.a')}, lambda x: list_contains(string_split(u.b,' '),x))) as nb, len({_WORDS_OF.format('u.a')}) as na, len({_WORDS_OF.format('u.b')}) as nn from u
  join lcs j on j.a={_JOIN.format('u.a')} and j.b={_JOIN.format('u.b')} join lcs r on r.a=u.a and r.b=u.b join lcs o on o.a={_SW_SQL('u.a')} and o.b={_SW_SQL('u.b')} join tset t on t.a=u.a and t.b=u.b join st on st.a=u.a and st.b=u.b),
 sc as (select a, b, case when js>=92 then 96 when not list_has_any(sa,sb) and rs<95 then 60 else greatest(case when nb<0.5*least(na,nn)+0.5 or nb<0.4*greatest(na,nn) then least(tss,72) else tss end, rs, os) end as s from f)
 select county_id, pr.a as a, pr.b as b, pairs, round(s,4) as score from pr join sc on pr.a=sc.a and pr.b=sc.b"""


def _scored(spark, sf, values, prepare=None):
    """Scores of all pairs, computed once per distinct pair of names; a county's pairs grow with its names, not with its rows."""
    return scale.on_distinct(_pair_rows(spark, sf), ["a", "b"], values, prepare).select("county_id", "a", "b", "pairs", *values)


@C.add("sim_ratio", _PAIRS.format(a="a", b="b") + " select county_id, pr.a as a, pr.b as b, pairs, round(s,6) as score from pr join lcs using (a,b)", ["fx_registry", "fx_place"])
def sim_ratio(spark, sf):
    return _scored(spark, sf, {"score": F.round(S.sim_ratio("a", "b"), 6)})


_SW = "array_to_string(list_sort(string_split({},' ')),' ')"


@C.add("sim_token_sort", _PAIRS.format(a=_SW.format("a"), b=_SW.format("b")) + f" select county_id, pr.a as a, pr.b as b, pairs, round(s,6) as score from pr join lcs on lcs.a={_SW.format('pr.a')} and lcs.b={_SW.format('pr.b')}", ["fx_registry", "fx_place"])
def sim_token_sort(spark, sf):
    return _scored(spark, sf, {"score": F.round(S.sim_token_sort("a", "b"), 6)})


@C.add("sim_token_set", _lcs(_TSET, _TSET_PRS) + ", " + _TSET_OUT + " select county_id, pr.a as a, pr.b as b, pairs, round(s,4) as score from pr join tset on pr.a=tset.a and pr.b=tset.b", ["fx_registry", "fx_place"])
def sim_token_set(spark, sf):
    return _scored(spark, sf, {"score": F.round(S.sim_token_set("a", "b"), 4)})


@C.add("sim_partial", _SIM_PARTIAL, ["fx_registry", "fx_place"])
def sim_partial(spark, sf):
    return _scored(spark, sf, {"score": F.round(S.sim_partial("a", "b"), 4)})


def _STEMS():
    return {"sa": T.name_stems("a"), "sb": T.name_stems("b")}


@C.add("name_sim", _NAME_SIM, ["fx_registry", "fx_place"])
def name_sim(spark, sf):
    return _scored(spark, sf, {"score": F.round(S.name_sim("a", "b", None, "sa", "sb"), 4)}, _STEMS())


@C.add("same_business")
def same_business(spark, sf):
    return _scored(spark, sf, {"same": S.same_business("a", "b")})


@C.add("real_share", _REAL, ["fx_registry", "fx_place"])
def real_share(spark, sf):
    return _scored(spark, sf, {"shared": S.real_share("sa", "sb"), "close": S.close_words("sa", "sb")}, _STEMS())


@C.add("close_words", _REAL.replace(" select county_id, pr.a as a,", " select county_id, a, b, pairs, close from (select county_id, pr.a as a,") + ")", ["fx_registry", "fx_place"])
def close_words(spark, sf):
    return _scored(spark, sf, {"close": S.close_words("sa", "sb")}, _STEMS())


@C.add("kind_conflict", f"select r.reg_id as reg_id, (len({_KIND_SQL.format('r.name')})>0 and len({_KIND_SQL.format('p.name')})>0 and not list_has_any({_KIND_SQL.format('r.name')},{_KIND_SQL.format('p.name')})) as conflict from fx_registry r join fx_place p on p.id=r.reg_id+5", ["fx_registry", "fx_place"])
def kind_conflict(spark, sf):
    r, p = view(spark, sf, "fx_registry").withColumnRenamed("name", "rname"), view(spark, sf, "fx_place")
    return r.join(p, F.col("id") == F.col("reg_id") + 5).select("reg_id", T.kind_conflict("rname", "name", _KINDS).alias("conflict"))


@C.add("url_key", "select page_id, rtrim(regexp_replace(regexp_replace(lower(url),'^[a-z]+://',''),'^www\\.',''),'/') as key from fx_url", ["fx_url"])
def url_key(spark, sf):
    return view(spark, sf, "fx_url").select("page_id", U.url_key("url").alias("key"))


@C.add("day_number", "select o_orderkey, date_diff('day', date '2000-01-01', cast(o_orderdate as date)) as day_no, strftime(o_orderdate,'%Y-%m-%d') as iso from orders")
def day_number(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", R.day_number(F.to_date("o_orderdate")).alias("day_no"), R.iso_day("o_orderdate").alias("iso"))


@C.add("town_word_set", "select distinct w as word from (select unnest([w, case when length(w)>3 and w like '%S' then substr(w,1,length(w)-1) else w end]) as w from (select unnest(string_split(upper(c_mktsegment),' ')) as w from customer union all select unnest(['AMELIA','BEACHES','ROSA']) as w) where length(w)>=4) where w not in ('BEACHES','BEACH')")
def town_word_set(spark, sf):
    return S.town_word_rows(table(spark, sf, "customer"), "c_mktsegment", extra=("AMELIA", "BEACHES", "ROSA"))


@C.add("label_to_brand")
def label_to_brand(spark, sf):
    p = view(spark, sf, "fx_place")
    src = lookup({"0": "AllThePlaces", "1": "meta"}, (F.col("id") % 2).cast("string"))
    return p.select("id", T.label_to_brand("name", "brand", src, S.sim_partial(T.norm_name("brand"), T.norm_name("name"))).alias("name"))


@C.add("brand_display_name")
def brand_display_name(spark, sf):
    p = view(spark, sf, "fx_place").withColumn("b", F.initcap(F.element_at(F.split(F.lower("name"), " "), 2)))
    return p.select("id", T.brand_display_name(F.col("name"), "b", S.sim_ratio(T.norm_name("name"), T.norm_name("b"))).alias("shown"))
