"""Readers for the given tables and the views derived from them (the DataFrame form and the SQL form of each view)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


HEAVY = ("part", "customer", "documents", "pages")      # inputs of compute-heavy rules


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Where the session sets spark.wayfound.scanPartitions (one small file, many cores), inputs of heavy rules are dealt out to so many tasks;
    without it the scan's own splits stay."""
    df, n = spark.read.parquet(f"{sf}/{name}.parquet"), spark.conf.get("spark.wayfound.scanPartitions", None)
    return df.repartition(int(n)) if n and name in HEAVY else df


# --- SQL of the views, accepted by Spark and by the checking engine alike
VIEW_SQL = {
    "fx_place": (["part"], """select p_partkey as id, upper(p_name) as name, p_brand as brand, p_type as category, p_size/50e0 as confidence,
 p_retailprice as price, p_partkey%25 as county_id, (p_partkey%7=0) as hc, p_partkey%256 as tags,
 case when p_partkey%5=0 then null else 1900+p_partkey%120 end as founded,
 24.3e0+(p_partkey%25)*0.2e0+((p_partkey*p_partkey*7919+p_partkey*31)%997)/10000e0 as lat,
 -87.7e0+(p_partkey%25)*0.3e0+((p_partkey*p_partkey*p_partkey*13+p_partkey*104729)%991)/10000e0 as lon from part"""),
    "fx_registry": (["part"], """select p_partkey as reg_id, case p_partkey%4 when 0 then upper(p_name) when 1 then concat(upper(p_name),' LLC')
 when 2 then substr(upper(p_name),1,length(p_name)-1) else concat('OTHER ',split_part(upper(p_name),' ',2)) end as name, p_partkey%25 as county_id,
 24.3e0+(p_partkey%25)*0.2e0+((p_partkey*p_partkey*7919+p_partkey*31)%997)/10000e0+(p_partkey%5)*0.0003e0 as lat,
 -87.7e0+(p_partkey%25)*0.3e0+((p_partkey*p_partkey*p_partkey*13+p_partkey*104729)%991)/10000e0 as lon, (p_partkey%10<>0) as active
 from part where p_partkey%3<>0"""),
    "fx_visit": (["events"], """select user_id as key, event_id as insp_no, 1 as visit, cast(ts as date) as date, event_type as disp,
 case when event_id%3<>0 then 'Routine' else 'Complaint' end as itype, cast(floor(value) as int)%5 as hp, event_id%4 as im, event_id%6 as bs,
 (event_type<>'error') as ok_name from events"""),
    "fx_closure": (["events"], """select event_id as cid, case when event_id%50=0 then 9999999 else user_id end as num, cast(ts as date) as date, props as reason,
 case when event_id%4=0 then null else cast(ts as date)+cast(event_id%6 as int) end as reopened from events where event_type='error'"""),
    "fx_fine": (["orders"], """select o_orderkey as case_id, o_custkey as num, o_totalprice as fine, cast(o_orderdate as date) as order_date from orders"""),
    "fx_address": (["customer"], """select c_custkey as lic, concat(cast(c_custkey%900+1 as varchar(10)),' ',case c_custkey%6 when 0 then 'NW 27TH AVE'
 when 1 then 'NORTHWEST 27 AVENUE' when 2 then 'MAIN ST STE 4' when 3 then 'MAIN STREET' when 4 then 'US HWY 301 N' else 'STATE ROAD 70' end) as addr,
 concat('32',lpad(cast(c_custkey%40 as varchar(10)),3,'0')) as zip,
 24.3e0+(c_custkey%25)*0.2e0+((c_custkey*c_custkey*7919+c_custkey*31)%997)/10000e0 as lat,
 -87.7e0+(c_custkey%25)*0.3e0+((c_custkey*c_custkey*c_custkey*13+c_custkey*104729)%991)/10000e0 as lon from customer"""),
    "fx_review": (["documents", "labels"], """select documents.doc_id as doc_id, source as gmap_id, text, case when quality=1 then 5 when quality=0 then 2 end as rating
 from documents left join labels on documents.doc_id=labels.doc_id"""),
    "fx_url": (["pages"], """select page_id, concat(url, case page_id%4 when 0 then '?utm_source=x' when 1 then '&ref=google' when 2 then '#utm_medium=y' else '' end) as url
 from pages"""),
    "fx_polygon": (["nation"], """select n_name as name, n_nationkey as county_id, 24.3e0+n_nationkey*0.2e0 as y0, 24.3e0+n_nationkey*0.2e0+0.1e0 as y1,
 -87.7e0+n_nationkey*0.3e0 as x0, -87.7e0+n_nationkey*0.3e0+0.1e0 as x1 from nation"""),
    "fx_page": (["pages"], """select page_id, url, case page_id%10 when 1 then concat(html,'<div style="left:-9999px"><a href="https://casino-x.example/a">best online casino</a></div>')
 when 2 then concat(html,'<p><a href="https://partner.example/x">our partner</a></p>')
 when 3 then concat(html,'<noscript><a href="https://pills.example/b">buy viagra online pharmacy</a></noscript>')
 when 4 then concat(html,'<p>This domain is for sale! Buy this domain now.</p>')
 when 5 then concat(html,'<div style="display:none"><a href="https://sister.example/m">sister site</a></div>')
 when 6 then concat(html,'<p>slot gacor situs judi online casino online casino</p>') else html end as html from pages"""),
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables it needs."""
    tables, sql = VIEW_SQL[name]
    return spark.sql(_braced(_in_residues(sql), tables), **{t: table(spark, sf, t) for t in tables})


def _in_residues(sql: str) -> str:
    """The same values without large products: in a polynomial of a key modulo n the key stands as its own remainder, so that no key is too large for 64 bits."""
    import re
    return re.sub(r"\(([\w*+]+)\)%(\d+)", lambda m: "(" + re.sub(r"\b[A-Za-z_]\w*", lambda k: f"({k[0]}%{m[2]})", m[1]) + f")%{m[2]}", sql)


def _braced(sql: str, tables) -> str:
    import re
    for t in tables:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}} as {t}", sql)
    return sql


def with_views(body: str, *names: str) -> str:
    """SQL text for the checking engine: the views as common table expressions, then the body."""
    ctes = [f"{n} as ({VIEW_SQL[n][1]})" for n in names]
    rest = body.strip()
    if rest.lower().startswith("with recursive "):
        return "with recursive " + ", ".join(ctes) + ", " + rest[15:]
    if rest.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + rest[5:]
    return "with " + ", ".join(ctes) + " " + rest


def ring_table(spark: SparkSession, sf: str) -> DataFrame:
    """fx_polygon with its ring as array<struct<x,y>>."""
    p = view(spark, sf, "fx_polygon")
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return p.select("name", "county_id", F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1")).alias("ring"))


class Catalog(dict):
    """Query key -> (callable, SQL or None). Modules fill one with the ``add`` decorator."""

    def add(self, key: str, sql: str | None = None, views=()):
        def keep(fn):
            self[key] = (fn, with_views(sql, *views) if sql and views else sql)
            return fn
        return keep
