"""Registered queries over data-quality checks and snapshots."""
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import directory as D, quality as Q, snapshots as S
from .directory_queries import _D, _V, places
from .latest_results import EVENT_GROUP
from .match_queries import _keyed
from .tables import Catalog, table, view

C = Catalog()


def q(key, body):
    return C.add(key, f"with {_D}{body if body.startswith(',') else ' ' + body}", _V)


@C.add("qa_license_mismatch", "select reg_id as id, reg_id as lic, case when reg_id%2=0 then 'same address, other business' else 'name and address differ' end as problem from fx_registry where reg_id%5=0", ["fx_registry"])
def qa_license_mismatch(spark, sf):
    l, r = _keyed(spark, sf)
    p = l.select(F.col("lid").alias("id"), F.col("lid").alias("lic"), F.when(F.col("lid") % 5 == 0, F.lit("QUIXOTE VAULT")).otherwise(F.col("k")).alias("name"), F.element_at("nums", 1).alias("num"), F.when(F.col("lid") % 2 == 0, F.col("street")).otherwise(F.lit("ELM RD")).alias("street"))
    return Q.license_mismatch(p, r.select(F.col("rid").alias("lic"), "keys", F.element_at("nums", 1).alias("num"), "street"))


@C.add("qa_curated_address", "select id as cid, id from fx_place where id%7=0 and id%2=0", ["fx_place"])
def qa_curated_address(spark, sf):
    l, _ = _keyed(spark, sf)
    p = l.select(F.col("lid").alias("id"), F.element_at("nums", 1).alias("num"), "street")
    cur = p.filter("id % 7 = 0").select(F.col("id").alias("cid"), "id", "num", F.when(F.col("id") % 2 == 0, F.lit("LONELY PINE TRL")).otherwise(F.col("street")).alias("street"))
    return Q.curated_address(cur, p).select("cid", "id")


@C.add("qa_unique_ids", "select l_orderkey as id, count(*) as n from lineitem group by 1 having count(*)>1")
def qa_unique_ids(spark, sf):
    return Q.duplicate_ids(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@C.add("qa_orphan_details", "select o_orderkey as id, case when o_custkey%50=0 then 'not in core' else 'in the wrong shard' end as problem from orders where o_custkey%50=0 or o_orderkey%100=3")
def qa_orphan_details(spark, sf):
    o = table(spark, sf, "orders")
    core = o.filter("o_custkey % 50 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("shard"))
    detail = o.select("o_orderkey", F.when(F.col("o_orderkey") % 100 == 3, F.lit("elsewhere")).otherwise(F.col("o_orderpriority")).alias("shard"))
    return Q.orphan_details(detail, core, "o_orderkey", "shard").withColumnRenamed("o_orderkey", "id")


@C.add("qa_group_consistency", "select insp_no, disp, case when insp_no%40=0 then 9 else case disp when 'view' then 0 when 'click' then 0 when 'purchase' then 1 when 'error' then 2 end end as grp, case disp when 'view' then 0 when 'click' then 0 when 'purchase' then 1 when 'error' then 2 end as expected from fx_visit where insp_no%40=0", ["fx_visit"])
def qa_group_consistency(spark, sf):
    from ..functions._col import lookup
    v = view(spark, sf, "fx_visit").select("insp_no", "disp", F.when(F.col("insp_no") % 40 == 0, 9).otherwise(lookup(EVENT_GROUP, "disp")).alias("grp"))
    codes = spark.createDataFrame(list(EVENT_GROUP.items()), "code string, grp int")
    return Q.group_consistency(v, codes, id="insp_no", value="disp", group="grp")


@C.add("qa_guards", """select id, r as rule from (select id, unnest([case when id%50=1 then 'no letters' end, case when id%50=2 then 'closed' end, case when id%50=3 then 'legal name' end, case when id%50=4 and length(name)>12 then 'one case' end]) as r from fx_place) where r is not null""", ["fx_place"])
def qa_guards(spark, sf):
    m = F.col("id") % 50
    p = view(spark, sf, "fx_place").select("id", F.when(m == 1, F.lit("12 34")).when(m == 2, F.concat("name", F.lit(" (closed)"))).when(m == 3, F.concat("name", F.lit(" Holdings"))).when(m == 4, F.col("name")).otherwise(F.initcap(F.lower("name"))).alias("name"))
    return Q.guards(p, Q.name_guards(), id="id")


@C.add("qa_forbidden_columns", "select 'value' as \"column\", count(*) as n from events where event_id%30=0 union all select 'name: p_retailprice', 1 from part limit 2")
def qa_forbidden_columns(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 30 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    bad = Q.non_finite(e, ["value", "event_id"])
    p = table(spark, sf, "part")
    names = p.agg(F.count("*").alias("k")).select(F.explode(F.array(*[F.lit("name: " + c) for c in Q.forbidden_columns(p, ["p_retailprice", "rating"])])).alias("column"), F.lit(1).cast("bigint").alias("n"))
    return bad.unionByName(names)


@C.add("qa_row_bounds", "select name, n, least from (select 'orders' as name, count(*) as n, 1000000000 as least from orders union all select 'part', count(*), 1 from part union all select 'gone', 0, 5) where n<least")
def qa_row_bounds(spark, sf):
    count = lambda t: table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    bounds = spark.createDataFrame([("orders", 1000000000), ("part", 1), ("gone", 5)], "name string, least bigint")
    return Q.row_bounds(count("orders").unionByName(count("part")), bounds)


@C.add("qa_bad_names_in_text", "with n as (select distinct upper(p_type)||' '||upper(p_brand) as name, upper(p_type)||' BRAND'||case when length(p_brand)=7 then ' '||substr(p_brand,7) else '' end as k from part where p_partkey%9=0), t as (select o_orderkey, 'We liked '||p_type||' '||p_brand||' a lot' as body, 'WE LIKED '||upper(p_type)||' BRAND '||substr(p_brand,7)||' A LOT' as k from orders join part on p_partkey=o_custkey) select o_orderkey, n.name as name from t join n on contains(t.k, ' '||n.k||' ')")
def qa_bad_names_in_text(spark, sf):
    p = table(spark, sf, "part")
    names = p.filter("p_partkey % 9 = 0").select(F.upper(F.concat_ws(" ", "p_type", "p_brand")).alias("name")).distinct()
    texts = table(spark, sf, "orders").join(p, F.col("p_partkey") == F.col("o_custkey")).select("o_orderkey", F.concat(F.lit("We liked "), "p_type", F.lit(" "), "p_brand", F.lit(" a lot")).alias("body"))
    return Q.bad_names_in_text(texts, names, text_id="o_orderkey", body="body")


@q("qa_list_membership", "select o_orderkey*2 as id from orders where o_orderkey%20=0 and o_orderkey*2 not in (select id from d where hc)")
def qa_list_membership(spark, sf):
    listed = table(spark, sf, "orders").filter("o_orderkey % 20 = 0").select((F.col("o_orderkey") * 2).alias("id"))
    return Q.list_membership(listed, places(spark, sf), id="id", tag_ok=F.col("hc"))


@q("qa_expected_hits", ", e as (select cuisine, count(*) as n from d where award=2 group by 1) select cuisine, n, n+1 as want from e where cuisine='ECONOMY'")
def qa_expected_hits(spark, sf):
    p = places(spark, sf)
    got = p.filter(D.Filters(bib_gourmand=True, include_non_restaurants=True).condition()).groupBy("cuisine").agg(F.count("*").alias("n"))
    want = p.filter("award = 2").groupBy("cuisine").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + F.when(F.col("cuisine") == "ECONOMY", 1).otherwise(0))
    return Q.expected_hits(got, want, key="cuisine")


# --- snapshots ------------------------------------------------------------------------------------------------------------------
_COLS = ["doc_id", "text", "lang", "checked"]


_ROWS_OLD = "old as (select source as shard, doc_id, text, lang, '2024-01-01' as checked from documents)"


def _sql_manifest(name, src):
    t = "concat_ws(chr(1), cast(doc_id as varchar), text, lang, checked)"
    u = "concat_ws(chr(1), cast(doc_id as varchar), text, lang)"
    return (f"{name} as (select shard, count(*) as rows, sum(strlen({t})) as bytes, md5(concat_ws('-', cast(count(*) as varchar), " + ", ".join(f"cast(sum(cast('0x'||substr(md5({t}),{1 + 8 * i},8) as bigint)) as varchar)" for i in range(4)) +
            ")) as hash, md5(concat_ws('-', cast(count(*) as varchar), " + ", ".join(f"cast(sum(cast('0x'||substr(md5({u}),{1 + 8 * i},8) as bigint)) as varchar)" for i in range(4)) + f")) as core_hash from {src} group by shard)")


_ROWS_NEW = "new as (select case when lang='de' then source||'-new' else source end as shard, doc_id, case when doc_id%97=0 then text||'!' else text end as text, lang, case when lang='fr' then '2024-02-01' else '2024-01-01' end as checked from documents where doc_id%13<>0 or lang<>'es')"


def _snap(spark, sf, new: bool):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    if new:
        d = d.filter((i % 13 != 0) | (F.col("lang") != "es")).select("doc_id", F.when(i % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), "lang",
                                                                    F.when(F.col("lang") == "de", F.concat("source", F.lit("-new"))).otherwise(F.col("source")).alias("source"), F.when(F.col("lang") == "fr", "2024-02-01").otherwise("2024-01-01").alias("checked"))
    else:
        d = d.withColumn("checked", F.lit("2024-01-01"))
    return S.manifest(d, shard="source", columns=_COLS, dated=["checked"])


@C.add("snapshot_manifest", f"with {_ROWS_OLD}, {_sql_manifest('m', 'old')} select shard, rows, bytes, hash, core_hash, shard||'-'||substr(hash,1,12) as file from m")
def snapshot_manifest(spark, sf):
    return _snap(spark, sf, False)


@C.add("snapshot_diff", f"with {_ROWS_OLD}, {_ROWS_NEW}, {_sql_manifest('a', 'old')}, {_sql_manifest('b', 'new')} select coalesce(a.shard,b.shard) as shard, case when a.hash is null then 'added' when b.hash is null then 'removed' when a.hash=b.hash then 'unchanged' when a.core_hash=b.core_hash then 'date only' else 'changed' end as status from a full join b on a.shard=b.shard")
def snapshot_diff(spark, sf):
    return S.diff(_snap(spark, sf, False), _snap(spark, sf, True))


@C.add("snapshot_version", "with o as (select cast(o_orderdate as date) as d from orders), days as (select date '1998-06-15' as day union select max(d) from o union select cast(max(d) + interval 1 day as date) from o) select strftime(day,'%Y-%m-%d') as day, case when (select max(d) from o) > day then null else strftime(day,'%Y-%m-%d')||'.'||((select count(*) from o where d=day)+1) end as version from days")
def snapshot_version(spark, sf):
    """The next version on a day before the last one of the whole history (refused), on the last one, and on the day after."""
    from ..operators import scale
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderkey")
    held = scale.cut_lineage(scale.ranked(o, ["d"], ["o_orderkey"], "n").select(F.concat_ws(".", "d", F.col("n").cast("string")).alias("version")))
    last = o.agg(F.max("d"), F.date_format(F.date_add(F.max(F.to_date("d")), 1), "yyyy-MM-dd")).first()
    days = ["1998-06-15", *[d for d in last if d and d != "1998-06-15"]]
    one = lambda d: S.next_version(held, d).select(F.lit(d).alias("day"), "version")
    out = one(days[0])
    for d in days[1:]:
        out = out.unionByName(one(d))
    return out


@C.add("swing_guard", f"with {_ROWS_OLD}, {_ROWS_NEW}, a as (select shard, count(*) as n from old group by 1), b as (select shard, count(*) as n from new group by 1) select coalesce(a.shard,b.shard) as shard, a.n as old_rows, b.n as new_rows from a full join b on a.shard=b.shard where abs(coalesce(b.n,0)-coalesce(a.n,0))>0.15*coalesce(a.n,0)")
def swing_guard(spark, sf):
    return S.swing_guard(_snap(spark, sf, False), _snap(spark, sf, True))


@C.add("snapshot_verify", f"with {_ROWS_OLD}, {_ROWS_NEW}, {_sql_manifest('a', 'old')}, {_sql_manifest('b', 'new')}, j as (select coalesce(a.shard,b.shard) as shard, a.hash as ah, b.hash as bh, a.rows as ar, b.rows as br, a.bytes as ab, b.bytes as bb from a full join b on a.shard=b.shard) select shard, 'missing' as problem from j where bh is null union all select shard, 'not in the manifest' from j where ah is null union all select shard, 'rows differ' from j where ar<>br union all select shard, 'bytes differ' from j where ab<>bb union all select shard, 'hash differs' from j where ah<>bh")
def snapshot_verify(spark, sf):
    return S.verify(_snap(spark, sf, False), _snap(spark, sf, True))


@C.add("retention_set", f"with {_ROWS_OLD}, {_ROWS_NEW}, {_sql_manifest('a', 'old')}, {_sql_manifest('b', 'new')} select source||'-'||lang as file from documents group by 1")
def retention_set(spark, sf):
    a, b = _snap(spark, sf, False), _snap(spark, sf, True)
    junk = table(spark, sf, "documents").select(F.concat_ws("-", "source", "lang").alias("file")).distinct()
    return S.retention(b, a, a.select("file").unionByName(b.select("file")).unionByName(junk))


@C.add("build_version", f"with {_ROWS_OLD}, {_sql_manifest('m', 'old')}, h as (select md5(shard||':'||hash) as h from m), o as (select substr(md5(concat_ws('-', cast(count(*) as varchar), " + ", ".join(f"cast(sum(cast('0x'||substr(h,{1 + 8 * i},8) as bigint)) as varchar)" for i in range(4)) + ")),1,12) as build from h) select shard, build from m, o")
def build_version(spark, sf):
    return S.build_version(_snap(spark, sf, False)).select("shard", "build")
