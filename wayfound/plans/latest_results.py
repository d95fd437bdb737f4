"""Flagship: latest result per entity, joined to its entity, counted by region and result group."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions._col import lookup
from ..operators.visits import latest_visit, publication_cutoff
from .tables import table, view

EVENT_GROUP = {"view": 0, "click": 0, "purchase": 1, "error": 2}


def latest_results(spark: SparkSession, sf: str) -> DataFrame:
    visits = publication_cutoff(view(spark, sf, "fx_visit"), "date", "2024-02-04")
    last = latest_visit(visits, "key").select("key", lookup(EVENT_GROUP, "disp").alias("grp"))
    who = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    where = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    placed = last.join(who, F.col("key") == F.col("c_custkey"), "left").join(where, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return placed.groupBy(F.col("r_name").alias("region")).agg(
        *[F.count_if(F.col("grp") == g).alias(n) for n, g in (("met", 0), ("followup", 1), ("closed", 2))],
        F.count_if(F.col("grp").isNull()).alias("ungrouped"))


SQL = """
select r_name as region, count(*) filter (grp=0) as met, count(*) filter (grp=1) as followup, count(*) filter (grp=2) as closed,
 count(*) filter (grp is null) as ungrouped
from (select key, case disp when 'view' then 0 when 'click' then 0 when 'purchase' then 1 when 'error' then 2 end as grp from
 (select *, row_number() over (partition by key order by date desc, insp_no desc, visit desc) as rn from fx_visit where date <= date '2024-01-28') where rn=1) l
 left join customer on key=c_custkey left join nation on c_nationkey=n_nationkey left join region on n_regionkey=r_regionkey group by r_name"""
