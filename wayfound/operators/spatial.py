"""Distance and containment joins on grid cells."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import cell, cell_sizes, neighbor_cells, planar_m
from .scale import top_rows


DENSE = 1 << 16             # rows of one side in one cell that a single task meets


def _cell_join(l: DataFrame, r: DataFrame, keys: list[tuple[str, str]], most: int) -> DataFrame:
    """Inner join on pairs of (left, right) cell columns. Cells are counted on both sides; where a side has more than ``most`` rows it is cut into slices by a hash
    of the row and the other side's rows go to each of them, so no task meets more than about ``most`` rows of either side for one cell. Rows that are equal
    in every column share a slice. Columns named ``_cell*`` are used inside."""
    def counted(df, cols, n):
        return df.groupBy(*[F.col(c).alias(f"_cell{i}") for i, c in enumerate(cols)]).agg(F.count("*").alias("_n")).filter(F.col("_n") > most) \
            .select(*[f"_cell{i}" for i in range(len(cols))], F.ceil(F.col("_n") / F.lit(most)).alias(n))
    names = [f"_cell{i}" for i in range(len(keys))]
    dense = counted(l, [a for a, _ in keys], "_cell_l").join(counted(r, [b for _, b in keys], "_cell_r"), names, "full")

    def sliced(df, cols, own, other):
        spread = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
        known = [F.col(c) == F.col(n) for c, n in zip(cols, names)]
        mine = df.withColumn("_cell_h", spread).join(dense, known, "left").drop(*names)
        mine = mine.withColumn("_cell_own", F.coalesce(F.pmod("_cell_h", own), F.lit(0)))
        return mine.withColumn("_cell_other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)) - 1))).drop("_cell_h", "_cell_l", "_cell_r")
    a = sliced(l, [x for x, _ in keys], "_cell_l", "_cell_r").withColumnsRenamed({"_cell_own": "_cell_a", "_cell_other": "_cell_b"})
    b = sliced(r, [x for _, x in keys], "_cell_r", "_cell_l").withColumnsRenamed({"_cell_own": "_cell_d", "_cell_other": "_cell_c"})
    on = [F.col(x) == F.col(y) for x, y in keys] + [F.col("_cell_a") == F.col("_cell_c"), F.col("_cell_b") == F.col("_cell_d")]
    # few bytes, many pairs: an explicit repartition keeps adaptive execution from merging cells into a few tasks
    n = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = a.repartition(n, *[F.col(x) for x, _ in keys], "_cell_a", "_cell_b")
    b = b.repartition(n, *[F.col(y) for _, y in keys], "_cell_c", "_cell_d")
    return a.join(b, on).drop("_cell_a", "_cell_b", "_cell_c", "_cell_d")


def proximity_join(left: DataFrame, right: DataFrame, *, radius_m: float, lat="lat", lon="lon", block=(), most: int = DENSE) -> DataFrame:
    """All pairs within the radius as (l_*, r_*, dist_m). The right side is laid on its nine cells and met by an equal-cell join, so only
    rows of touching cells are compared. ``block`` adds columns that must be equal too; the more selective, the fewer comparisons. Cells with more than
    ``most`` rows are met in slices."""
    h, w = cell_sizes(radius_m)
    l = left.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*[F.col(c).alias("l_" + c) for c in left.columns])
    l = l.withColumn("_cy", cell("l_" + lat, h)).withColumn("_cx", cell("l_" + lon, w))
    r = right.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*[F.col(c).alias("r_" + c) for c in right.columns],
                                                                            F.explode(neighbor_cells(lat, lon, radius_m)).alias("_c")).select("*", "_c.cy", "_c.cx").drop("_c")
    d = planar_m("l_" + lat, "l_" + lon, "r_" + lat, "r_" + lon)
    met = _cell_join(l, r, [("_cy", "cy"), ("_cx", "cx"), *[("l_" + b, "r_" + b) for b in block]], most)
    return met.withColumn("dist_m", d).filter(F.col("dist_m") <= radius_m).drop("_cy", "_cx", "cy", "cx")


def box_join(left: DataFrame, right: DataFrame, *, dlat: float, dlon: float, lat="lat", lon="lon", most: int = DENSE) -> DataFrame:
    """All pairs with |dlat| and |dlon| strictly inside the box; dense cells as in ``proximity_join``."""
    l = left.select(*[F.col(c).alias("l_" + c) for c in left.columns]).withColumn("_cy", cell("l_" + lat, dlat)).withColumn("_cx", cell("l_" + lon, dlon))
    cy, cx = cell(lat, dlat), cell(lon, dlon)
    around = F.array(*[F.struct((cy + i).alias("cy"), (cx + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r = right.select(*[F.col(c).alias("r_" + c) for c in right.columns], F.explode(around).alias("_c")).select("*", "_c.cy", "_c.cx").drop("_c")
    close = (F.abs(F.col("l_" + lat) - F.col("r_" + lat)) < dlat) & (F.abs(F.col("l_" + lon) - F.col("r_" + lon)) < dlon)
    return _cell_join(l, r, [("_cy", "cy"), ("_cx", "cx")], most).filter(close).drop("_cy", "_cx", "cy", "cx")


def _inside(lat, lon, ring):
    """Ray casting over the ring's edges."""
    n = F.size(ring)
    crossings = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(
        ((F.get(ring, i)["y"] > lat) != (F.get(ring, F.pmod(i + 1, n))["y"] > lat))
        & (lon < (F.get(ring, F.pmod(i + 1, n))["x"] - F.get(ring, i)["x"]) * (lat - F.get(ring, i)["y"])
           / F.nullif(F.get(ring, F.pmod(i + 1, n))["y"] - F.get(ring, i)["y"], F.lit(0.0)) + F.get(ring, i)["x"]), 1).otherwise(0))
    return crossings % 2 == 1


def polygons_holding(points: DataFrame, tiers: list[DataFrame], *, id="id", lat="lat", lon="lon", grid: float = 0.25) -> DataFrame:
    """(id, tier, name) of every polygon that holds a point. Each tier is a DataFrame(name, ring array<struct<x,y>>). Outlines and points meet on coarse
    grid cells; unplaced points get no row."""
    parts = []
    for no, rings in enumerate(tiers):
        ys, xs = F.transform("ring", lambda p: p["y"]), F.transform("ring", lambda p: p["x"])
        box = rings.select("name", "ring", F.lit(no).alias("tier"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"))
        span = lambda a, b: F.sequence(F.floor(F.col(a) / grid), F.floor(F.col(b) / grid))
        parts.append(box.withColumn("gy", F.explode(span("y0", "y1"))).withColumn("gx", F.explode(span("x0", "x1"))))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    pts = points.filter(F.col(lat).isNotNull()).select(F.col(id), F.col(lat).alias("_la"), F.col(lon).alias("_lo")) \
        .withColumn("_gy", F.floor(F.col("_la") / grid)).withColumn("_gx", F.floor(F.col("_lo") / grid))
    hit = pts.join(cells, (F.col("_gy") == F.col("gy")) & (F.col("_gx") == F.col("gx"))
                   & F.col("_la").between(F.col("y0"), F.col("y1")) & F.col("_lo").between(F.col("x0"), F.col("x1")))
    return hit.filter(_inside(F.col("_la"), F.col("_lo"), F.col("ring"))).select(id, "tier", "name")


def point_in_polygon(points: DataFrame, tiers: list[DataFrame], *, id="id", lat="lat", lon="lon", grid: float = 0.25) -> DataFrame:
    """(id, name) of the polygon holding each point; later tiers (wider outlines) only count for points no earlier tier holds."""
    hit = polygons_holding(points, tiers, id=id, lat=lat, lon=lon, grid=grid)
    return hit.groupBy(id).agg(F.min(F.struct("tier", "name")).alias("m")).select(id, F.col("m.name").alias("name"))


def flag_outside(points: DataFrame, tiers, *, id="id", out="outside") -> DataFrame:
    """Adds whether a point lies in none of the polygons."""
    hits = point_in_polygon(points, tiers, id=id).select(F.col(id).alias("_pid"))
    return points.join(hits, F.col(id) == F.col("_pid"), "left").withColumn(out, F.col("_pid").isNull()).drop("_pid")


def nearest_unique_borrow(needy: DataFrame, donors: DataFrame, *, id: str, donor_id: str, value: str, box: float = 0.0004) -> DataFrame:
    """(id, value): the value of the only donor within the box, null when there is none or more than one. Donors at one point are counted
    together first, so a crowded spot is one row."""
    spots = donors.groupBy("lat", "lon").agg(F.count("*").alias("k"), F.min(value).alias("val"))
    near = box_join(needy.select(id, "lat", "lon"), spots.select("lat", "lon", "k"), dlat=box, dlon=box)
    # numbers only while pairs are counted; a row with one donor has one spot, which gives the value afterwards
    one = near.groupBy(F.col("l_" + id).alias("_id")).agg(F.sum("r_k").alias("n"), F.min("r_lat").alias("_la"), F.min("r_lon").alias("_lo")).filter(F.col("n") == 1)
    one = one.join(spots, (F.col("_la") == F.col("lat")) & (F.col("_lo") == F.col("lon"))).select("_id", F.col("val").alias("_v"))
    return needy.select(id).join(one, F.col(id) == F.col("_id"), "left").select(id, F.col("_v").alias(value))


def nearest(df: DataFrame, by, order, n: int) -> DataFrame:
    return top_rows(df, by, order, n)
