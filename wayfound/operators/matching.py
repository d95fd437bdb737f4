"""Record matching: candidate pairs by name, address and place, one-to-one assignment, ranked duplicate suppression.

Equal rows (same name, same spot, ...) form one *class* before pairs are made; a class of a million copies costs one row in every join, and
its members are handed out afterwards by rank. Results equal the row-by-row rules.
"""
from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.address import core_street, street_compat
from ..functions.geo import cell, cell_sizes, neighbor_cells
from ..functions.similarity import close_words, name_sim, real_share, same_business, same_key, sim_ratio, sim_token_set
from ..functions.text import kind_conflict, name_stems
from .fuzzy import near_text_pairs
from .scale import components, cut_lineage, keep_first, on_distinct, ranked, top_rows
from .spatial import DENSE, _cell_join, proximity_join


def classes(df: DataFrame, keys, id: str) -> tuple[DataFrame, DataFrame]:
    """(class table: keys, cls = smallest id, n), (membership: id, cls)."""
    table = df.groupBy(*keys).agg(F.min(id).alias("cls"), F.count("*").alias("n"))
    t = table.select(*[F.col(k).alias("_" + k) for k in keys], "cls")
    member = df.join(t, [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]).select(id, "cls")
    return table, member


# --- chains ------------------------------------------------------------------------------------------------------------------------
def settle(nodes: DataFrame) -> DataFrame:
    """(key, v) of every node that hangs on a settled one through any number of others. Nodes are (key, at, sign, shift, lo, hi): with ``at``
    null the value is ``shift`` (= lo = hi, sign 0), else it is ``sign * value of at + shift``, held between lo and hi. Nodes that hang on a
    key that is not in the table stay out.

    The table is read several times: write it before. Such steps compose to steps of the same form, so pointers double: a chain of n nodes takes about log2 n joins."""
    cols = ["key", "at", "sign", "shift", "lo", "hi"]
    now = nodes.select(*cols)
    settled, hanging = now.filter(F.col("at").isNull()), now.filter(F.col("at").isNotNull())
    hold = lambda v: F.greatest("lo", F.least("hi", v))
    while not hanging.isEmpty():
        t = settled.unionByName(hanging).select(*[F.col(c).alias("t_" + c) for c in cols])
        low = F.when(F.col("sign") < 0, F.col("shift") - F.col("t_hi")).otherwise(F.col("shift") + F.col("t_lo"))
        high = F.when(F.col("sign") < 0, F.col("shift") - F.col("t_lo")).otherwise(F.col("shift") + F.col("t_hi"))
        step = hanging.join(t, F.col("at") == F.col("t_key")).select(
            "key", F.col("t_at").alias("at"), (F.col("sign") * F.col("t_sign")).alias("sign"),
            (F.col("sign") * F.col("t_shift") + F.col("shift")).alias("shift"), hold(low).alias("lo"), hold(high).alias("hi"))
        step = cut_lineage(step)
        settled, hanging = settled.unionByName(step.filter(F.col("at").isNull())), step.filter(F.col("at").isNotNull())
    return settled.select("key", F.col("lo").alias("v"))


# --- one-to-one assignment ----------------------------------------------------------------------------------------------------
def _assign_rounds(edges: DataFrame) -> DataFrame | None:
    """``_assign`` in rounds over all edges. Each round settles every edge that is the best left at both its ends, and every
    edge with one better edge at its ends, as far as the chain of such edges leads to a best one: it takes what the better one leaves. A
    chain takes one round, not one round an edge. Accepted edges carry how many places of each end came before."""
    cols = ["lid", "rid", "score", "nl", "nr", "lu", "ru"]
    zero = F.lit(0).cast("bigint")
    rest = cut_lineage(edges.withColumn("lu", zero).withColumn("ru", zero).select(*cols))
    done = None
    while not rest.isEmpty():
        at_l = top_rows(rest, ["lid"], [F.desc("score"), F.asc("rid")], 2, rank="il").withColumn("brid", F.lag("rid").over(W.partitionBy("lid").orderBy("il")))
        at_r = top_rows(rest, ["rid"], [F.desc("score"), F.asc("lid")], 2, rank="ir").withColumn("blid", F.lag("lid").over(W.partitionBy("rid").orderBy("ir")))
        top = at_l.join(at_r.select("lid", "rid", "ir", "blid"), ["lid", "rid"]).filter(F.col("il") + F.col("ir") <= 3)
        left_l, left_r = F.col("nl") - F.col("lu"), F.col("nr") - F.col("ru")
        best, both = F.col("il") + F.col("ir") == 2, F.least(left_l, left_r)
        shared, other = F.when(F.col("il") == 2, left_l).otherwise(left_r), F.when(F.col("il") == 2, left_r).otherwise(left_l)
        at = F.when(F.col("il") == 2, F.struct("lid", F.col("brid").alias("rid"))).when(F.col("ir") == 2, F.struct(F.col("blid").alias("lid"), "rid"))
        top = cut_lineage(top.select(*cols, F.struct("lid", "rid").alias("key"), at.alias("at"), (F.col("il") == 2).alias("by_l"), F.when(best, 0).otherwise(-1).alias("sign"),
                                     F.when(best, both).otherwise(shared).alias("shift"), F.when(best, both).otherwise(zero).alias("lo"), F.when(best, both).otherwise(other).alias("hi")))
        got = settle(top)
        before = got.select(F.col("key").alias("b_key"), F.col("v").alias("b_v"))
        take = top.join(got, "key").join(before, F.col("at") == F.col("b_key"), "left")
        ahead = lambda here: F.when(here, F.coalesce("b_v", zero)).otherwise(zero)
        take = cut_lineage(take.select("lid", "rid", "score", (F.col("lu") + ahead(F.col("by_l"))).alias("l0"), (F.col("ru") + ahead(~F.col("by_l"))).alias("r0"), F.col("v").alias("k")))
        accepted = take.filter("k > 0")
        done = accepted if done is None else done.unionByName(accepted)
        used_l, used_r = accepted.groupBy("lid").agg(F.sum("k").alias("kl")), accepted.groupBy("rid").agg(F.sum("k").alias("kr"))
        rest = rest.join(used_l, "lid", "left").join(used_r, "rid", "left") \
            .withColumn("lu", F.col("lu") + F.coalesce("kl", zero)).withColumn("ru", F.col("ru") + F.coalesce("kr", zero)) \
            .filter((F.col("lu") < F.col("nl")) & (F.col("ru") < F.col("nr"))).join(take, ["lid", "rid"], "left_anti").select(*cols)
        rest = cut_lineage(rest)
    return done


PART = 1 << 20              # edges that hang together which a single task walks through


def _walk(batches):
    """Edges sorted by part and order, taken one after the other; what is used is remembered for one part at a time."""
    used_l, used_r, now = {}, {}, None
    for batch in batches:
        keep, l0, r0, took = [], [], [], []
        for i, (root, lid, rid, nl, nr) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "lid", "rid", "nl", "nr")))):
            if root != now:
                used_l, used_r, now = {}, {}, root
            a, b = used_l.get(lid, 0), used_r.get(rid, 0)
            k = min(nl - a, nr - b)
            if k > 0:
                used_l[lid], used_r[rid] = a + k, b + k
                keep.append(i), l0.append(a), r0.append(b), took.append(k)
        rows = batch.select(["lid", "rid", "score"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(x, pa.int64()) for x in (l0, r0, took)]], names=["lid", "rid", "score", "l0", "r0", "k"])


def _assign(edges: DataFrame) -> DataFrame | None:
    """Greedy by (score desc, lid, rid) with capacities nl, nr. Accepted edges carry how many places of each end came before (l0, r0) and how many they take (k).

    Edges that hang together through their ends are one part, and parts do not touch each other: a task walks through the sorted edges of its parts. Parts
    of more than ``PART`` edges are settled in rounds."""
    edges = cut_lineage(edges.filter(F.col("lid").isNotNull() & F.col("rid").isNotNull()).select("lid", "rid", "score", "nl", "nr"))
    if edges.isEmpty():
        return None
    node = lambda c: F.xxhash64(F.lit(c), F.col(c))           # equal hashes only join two parts
    roots = components(edges.select(node("lid").alias("a"), node("rid").alias("b")), cut_lineage)
    placed = cut_lineage(edges.withColumn("node", node("lid")).join(roots.hint("merge"), "node").drop("node"))
    large = placed.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select("root")
    kinds = dict(edges.dtypes)
    sorted_ = placed.join(large, "root", "left_anti").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root") \
        .sortWithinPartitions("root", F.desc("score"), "lid", "rid")
    done = cut_lineage(sorted_.mapInArrow(_walk, f"lid {kinds['lid']}, rid {kinds['rid']}, score double, l0 bigint, r0 bigint, k bigint"))
    rest = _assign_rounds(placed.join(large, "root", "left_semi").drop("root"))
    return done if rest is None else done.unionByName(rest.select(*done.columns))


def one_to_one(pairs: DataFrame, *, lid="lid", rid="rid", score="score") -> DataFrame:
    """Greedy one-to-one assignment in the order (score desc, left id, right id): (lid, rid, score)."""
    edges = pairs.select(F.col(lid).alias("lid"), F.col(rid).alias("rid"), F.col(score).cast("double").alias("score")) \
        .groupBy("lid", "rid").agg(F.max("score").alias("score")).withColumn("nl", F.lit(1).cast("bigint")).withColumn("nr", F.lit(1).cast("bigint"))
    got = _assign(edges)
    return edges.select("lid", "rid", "score").limit(0) if got is None else got.select("lid", "rid", "score")


def one_to_one_classes(pairs: DataFrame, l_members: DataFrame, r_members: DataFrame) -> DataFrame:
    """One-to-one assignment where copies stand as classes: ``pairs`` (lid, rid, score) hold class ids, ``*_members`` (id, cls) the rows.
    Order: score desc, then smallest left id of the class, smallest right id of the class, then ids within."""
    size = lambda m, c, n: m.groupBy(F.col("cls").alias(c)).agg(F.count("*").alias(n))
    edges = pairs.groupBy("lid", "rid").agg(F.max("score").cast("double").alias("score")).join(size(l_members, "lid", "nl"), "lid").join(size(r_members, "rid", "nr"), "rid")
    got = _assign(edges)
    if got is None:
        return edges.select("lid", "rid", "score").limit(0)
    slots = got.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    slots = slots.select(F.col("lid").alias("lc"), F.col("rid").alias("rc"), "score", (F.col("l0") + F.col("i") + 1).alias("ln"), (F.col("r0") + F.col("i") + 1).alias("rn"))
    number = lambda m, c, n, out: ranked(m, ["cls"], ["id"], n).select(F.col("cls").alias(c), F.col(n), F.col("id").alias(out))
    return slots.join(number(l_members, "lc", "ln", "lid"), ["lc", "ln"]).join(number(r_members, "rc", "rn", "rid"), ["rc", "rn"]).select("lid", "rid", "score")


# --- ranked suppression --------------------------------------------------------------------------------------------------------
def suppress(edges: DataFrame) -> DataFrame:
    """Ranked suppression over conflict edges (hi, lo, hi_rank): scanning by rank, a row goes when an already kept row conflicts with it.
    Returns (loser, survivor), the survivor being the best-ranked kept row in conflict. ``hi_rank`` orders rows, smallest first.

    Each round settles the rows without a better one in conflict, every row with a single better one as far as the chain leads to a settled
    row, and the rows in conflict with a kept one."""
    edges = cut_lineage(edges.select("hi", "lo", "hi_rank").distinct())
    rest, lost = edges, None
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    while not rest.isEmpty():
        single = rest.groupBy(F.col("lo").alias("key")).agg(F.min("hi").alias("at"), F.max("hi").alias("at_")).filter(F.col("at") == F.col("at_"))
        first = rest.select(F.col("hi").alias("key")).distinct().join(rest.select(F.col("lo").alias("key")).distinct(), "key", "left_anti")
        nodes = single.select("key", "at", F.lit(-1).alias("sign"), one.alias("shift"), zero.alias("lo"), one.alias("hi")).unionByName(
            first.select("key", F.expr("nullif(key, key)").alias("at"), F.lit(0).alias("sign"), one.alias("shift"), one.alias("lo"), one.alias("hi")))
        known = settle(cut_lineage(nodes))
        kept = known.filter("v = 1").select(F.col("key").alias("hi"))
        gone = known.filter("v = 0").select(F.col("key").alias("loser")).unionByName(rest.join(kept, "hi", "left_semi").select(F.col("lo").alias("loser"))).distinct()
        gone = cut_lineage(gone)
        lost = gone if lost is None else lost.unionByName(gone)
        rest = cut_lineage(rest.join(gone, rest["lo"] == gone["loser"], "left_anti").join(gone, rest["hi"] == gone["loser"], "left_anti"))
    if lost is not None:
        edges = edges.join(lost, edges["hi"] == lost["loser"], "left_anti")
    return edges.groupBy(F.col("lo").alias("loser")).agg(F.min(F.struct("hi_rank", "hi")).alias("m")).select("loser", F.col("m.hi").alias("survivor"))


def _conflicts(df: DataFrame, radius: float, block: str, extra: Callable | None = None) -> DataFrame:
    """Conflict edges among rows within the radius and with an equal block value, better rank first."""
    base = df.filter(F.col(block).isNotNull())
    p = proximity_join(base, base, radius_m=radius, block=[block]).filter(F.col("l_rank_no") < F.col("r_rank_no"))
    p = p.filter(extra(p)) if extra else p
    return p.select(F.col("l_id").alias("hi"), F.col("r_id").alias("lo"), F.col("l_rank_no").alias("hi_rank"))


def suppress_duplicates(df: DataFrame, *, id: str, rank_order, name: str, brand: str | None = None, license: str | None = None,
                        same_name_m=80.0, same_brand_m=150.0, license_m=150.0, similar: float | None = 92.0) -> tuple[DataFrame, DataFrame]:
    """Duplicate listings: (kept rows, (loser, survivor)). In rank order a row goes when a kept row is near with the same name, a similar
    name sharing a distinctive word, the same brand, or the same license."""
    attrs = ["name", "brand", "license", "lat", "lon"]
    no = ranked(df.select(F.col(id).alias("id"), *[o.alias(f"_o{i}") for i, o in enumerate(rank_order)], F.col(name).alias("name"),
                          (F.col(brand) if brand else F.lit(None)).cast("string").alias("brand"),
                          (F.col(license) if license else F.lit(None)).cast("string").alias("license"), "lat", "lon"),
                [], [*[f"_o{i}" for i in range(len(rank_order))], "id"], "rank_no").select("id", "rank_no", *attrs)
    no = cut_lineage(no)
    best = no.groupBy(*attrs).agg(F.min(F.struct("rank_no", "id")).alias("b"))
    best = cut_lineage(best.select(*attrs, "b.rank_no", "b.id"))
    edges = _conflicts(best, same_name_m, "name")
    if brand:
        edges = edges.unionByName(_conflicts(best, same_brand_m, "brand"))
    if license:
        edges = edges.unionByName(_conflicts(best, license_m, "license"))
    if similar is not None:
        stems = best.withColumn("stem", F.explode(F.array_distinct(name_stems("name"))))
        edges = edges.unionByName(_conflicts(stems, same_name_m, "stem", lambda p: (p["l_name"] != p["r_name"]) & (sim_token_set("l_name", "r_name") >= similar)))
    lost = suppress(edges)
    b = best.select(F.col("id").alias("top"), *[F.col(a).alias("_" + a) for a in attrs])
    to_top = no.join(b, [F.col(a).eqNullSafe(F.col("_" + a)) for a in attrs]).select("id", "top")
    pairs = to_top.join(lost, F.col("top") == F.col("loser"), "left").select(F.col("id").alias("_l"), F.coalesce("survivor", "top").alias("_s"))
    pairs = cut_lineage(pairs.filter(F.col("_l") != F.col("_s")).select(F.col("_l").alias("loser"), F.col("_s").alias("survivor")))
    return df.join(pairs, F.col(id) == F.col("loser"), "left_anti"), pairs


def merge_same_address(df: DataFrame, *, keys, rank_order, id: str) -> DataFrame:
    """One row per (name, street key, town): the better rank; rows with an incomplete key all stay."""
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return keep_first(df.filter(full), keys, [*rank_order, F.asc(id)]).unionByName(df.filter(~F.coalesce(full, F.lit(False))))


def _close_conflicts(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs (l_*, r_*) in one ``name_town`` closer than the radius, never two licensed ones."""
    p = proximity_join(left, right, radius_m=radius_m, block=["name_town"])
    return p.filter(~(F.col("l_lic") & F.col("r_lic")) & (F.col("dist_m") < radius_m))


def _close_losers(rows: DataFrame, radius_m: float) -> DataFrame:
    """(loser, survivor) of rows (id, name_town, r, lic, lat, lon), smallest (r, id) first, with every pair in conflict as an edge."""
    p = _close_conflicts(rows, rows, radius_m).filter((F.col("l_r") < F.col("r_r")) | ((F.col("l_r") == F.col("r_r")) & (F.col("l_id") < F.col("r_id"))))
    return suppress(p.select(F.col("l_id").alias("hi"), F.col("r_id").alias("lo"), F.struct(F.col("l_r").alias("r"), F.col("l_id").alias("i")).alias("hi_rank")))


FIRST_RANKS = 128           # ranks of a name in a town that are settled first; each further part is as large as all before it


def merge_same_town_close(df: DataFrame, *, id: str, name: str, town: str, rank: str, licensed: str, radius_m=400.0) -> DataFrame:
    """(loser, survivor) among rows with one name in one town closer than the radius, never two licensed ones; the better rank stays.

    Rows are settled in rank order, in parts that double: a part's kept rows first take what they suppress out of all later parts, so a row meets
    few others however dense a town is. Names whose ids repeat or are null hang together through them and are settled with all their pairs."""
    d = df.filter((F.col(name) != "") & F.col(town).isNotNull() & F.col(rank).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()) \
        .select(F.col(id).alias("id"), F.concat_ws("\u0001", name, town).alias("name_town"), (-F.col(rank)).alias("r"), F.coalesce(F.col(licensed), F.lit(True)).alias("lic"), "lat", "lon").distinct()
    d = cut_lineage(d)
    twice = d.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select(F.col("id").alias("_id"))
    knotted = cut_lineage(d.join(twice, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("name_town").alias("_nt")).distinct())
    plain = F.col("name_town") == F.col("_nt")
    lost = _close_losers(d.join(knotted, plain, "left_semi"), radius_m) if not knotted.isEmpty() else None
    d = d.join(knotted, plain, "left_anti")
    # of the rows of one spot that are all licensed or all not only the best can suppress others; it stands for them
    spot = ["name_town", "lat", "lon", "lic"]
    top = d.groupBy(*spot).agg(F.min(F.struct("r", "id")).alias("b")).select(*spot, "b.r", "b.id")
    part = F.when(F.col("no") <= FIRST_RANKS, 0).otherwise(F.ceil(F.log2(F.col("no") / F.lit(FIRST_RANKS)))).cast("int")
    rest = cut_lineage(ranked(cut_lineage(top), ["name_town"], ["r", "id"], "no").withColumn("part", part).drop("no"))
    best, at = rest, 0
    settled = None
    while not rest.isEmpty():
        mine, later = rest.filter(F.col("part") <= at), rest.filter(F.col("part") > at)
        gone = cut_lineage(_close_losers(mine, radius_m))
        settled = gone if settled is None else settled.unionByName(gone)
        if not later.isEmpty():
            kept = mine.join(gone, F.col("id") == F.col("loser"), "left_anti")
            met = _close_conflicts(later, kept, radius_m).groupBy(F.col("l_id").alias("loser")).agg(F.min(F.struct("r_r", "r_id")).alias("m"))
            gone = cut_lineage(met.select("loser", F.col("m.r_id").alias("survivor")))
            settled = settled.unionByName(gone)
            later = cut_lineage(later.join(gone, F.col("id") == F.col("loser"), "left_anti"))
        rest, at = later, at + 1
    if settled is not None:
        stands = best.select(F.col("id").alias("top"), *[F.col(c).alias("_" + c) for c in spot])
        of = d.join(stands, [F.col(c) == F.col("_" + c) for c in spot]).join(settled, F.col("top") == F.col("loser"), "left")
        by = F.coalesce("survivor", F.when((F.col("id") != F.col("top")) & ~F.col("lic"), F.col("top")))
        of = of.select(F.col("id").alias("loser"), by.alias("survivor")).filter(F.col("survivor").isNotNull())
        lost = of if lost is None else lost.unionByName(of)
    return lost if lost is not None else d.select(F.col("id").alias("loser"), F.col("id").alias("survivor")).limit(0)


def coalesce_merged(survivors: DataFrame, losers: DataFrame, pairs: DataFrame, *, id: str, flags=(), facts=(), order=None) -> DataFrame:
    """Survivors inherit flags (any) and missing facts (first by ``order``, then id) from their losers."""
    o = F.col(order) if order else F.col(id)
    lost = losers.join(pairs, F.col(id) == F.col("loser"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(o.alias("o"), F.col(id).alias("i"))))
    agg = lost.groupBy(F.col("survivor").alias("_s")).agg(*[F.bool_or(c).alias("f_" + c) for c in flags], *[first(c).alias("v_" + c) for c in facts])
    j = survivors.join(agg, F.col(id) == F.col("_s"), "left")
    cols = [(F.coalesce(F.col(c), F.lit(False)) | F.coalesce("f_" + c, F.lit(False))).alias(c) if c in flags
            else F.coalesce(c, "v_" + c).alias(c) if c in facts else F.col(c) for c in survivors.columns]
    return j.select(*cols)


# --- candidate rules -------------------------------------------------------------------------------------------------------------
def similar_name_pairs(left: DataFrame, right: DataFrame, *, block: str, town_words=None, addr_score=75.0, near_m=150.0, near_score=88.0,
                       close_m=60.0, close_score=80.0, addr_max_m=2000.0) -> DataFrame:
    """Candidate pairs (lid, rid, score, rule) of listings and registry rows in one block (a county). Left carries (lid, block, name key
    ``k``, nums, street, lat, lon), right (rid, block, keys array, nums, street, lat, lon).

    A pair counts at one street address with similar or shared distinctive names, near with near-equal names, or very close with similar and
    shared names, and only if the names can be one business.

    Names are scored once, streets judged once; rows then meet on an agreeing (address, name) or (block, name) and their cells, so rows that nothing
    speaks for are never paired and no pair is exchanged. Rows that share an id count together and are paired by ``_pairs_of_repeated``."""
    limits = dict(addr_score=addr_score, near_m=near_m, near_score=near_score, close_m=close_m, close_score=close_score, addr_max_m=addr_max_m)
    l = left.filter((F.col("k") != "") & F.col(block).isNotNull()).select("lid", F.col(block).alias("b"), F.col("k").alias("lk"), "nums", "street", "lat", "lon")
    r = right.filter(F.col(block).isNotNull()).select("rid", F.col(block).alias("b"), "keys", "nums", "street", "lat", "lon")
    l, r = cut_lineage(l.distinct()), cut_lineage(r.distinct())
    many = lambda d, id: cut_lineage(d.groupBy(id).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(id).alias("_id")))
    l_many, r_many = many(l, "lid"), many(r, "rid")
    some_l, some_r = not l_many.isEmpty(), not r_many.isEmpty()
    of = lambda d, id, ids, how: d.join(ids, F.col(id).eqNullSafe(F.col("_id")), how)
    one_l, one_r = of(l, "lid", l_many, "left_anti") if some_l else l, of(r, "rid", r_many, "left_anti") if some_r else r
    out = _pairs_of_single(one_l, one_r, town_words=town_words, **limits)
    if some_l:
        out = out.unionByName(_pairs_of_repeated(of(l, "lid", l_many, "left_semi"), r, town_words=town_words, **limits))
    return out.unionByName(_pairs_of_repeated(one_l, of(r, "rid", r_many, "left_semi"), town_words=town_words, **limits)) if some_r else out


def _rated(p: DataFrame, *, addr_score, near_m, near_score, close_m, close_score, addr_max_m) -> DataFrame:
    """(lid, rid, score, rule) of the pairs (lid, rid, s, shared, same_addr, dist) that a rule takes."""
    same_addr, s, dist = F.col("same_addr"), F.col("s"), F.col("dist")
    rule = F.when(same_addr & ((s >= addr_score) | F.col("shared")), F.lit("address")).when((dist <= near_m) & (s >= near_score), F.lit("near")) \
        .when((dist <= close_m) & (s >= close_score) & F.col("shared"), F.lit("close"))
    score = s + F.when(same_addr, F.lit(15)).otherwise(F.lit(0)) - dist / 20
    return p.select("lid", "rid", score.alias("score"), rule.alias("rule")).filter(F.col("rule").isNotNull())


def _address_core(street):
    """Core words of a street; streets without one (a bare direction or type) can only agree as whole texts."""
    return F.coalesce(core_street(street), F.concat(F.lit("="), F.col(street)))


def _pairs_of_single(l: DataFrame, r: DataFrame, *, town_words, **limits) -> DataFrame:
    """Pairs of written rows (lid, b, lk, nums, street, lat, lon) and (rid, b, keys, nums, street, lat, lon) whose ids stand once."""
    near_m, addr_max_m = float(limits["near_m"]), limits["addr_max_m"]
    far = float(max(addr_max_m, near_m, limits["close_m"]))
    at = ["b", "no", "core"]
    # rows with several numbers may meet at more than one: the least common one stands for the pair
    several = F.when(F.size(F.array_distinct("nums")) > 1, F.col("nums")).alias("nums")
    door = lambda d, *cols: d.select(*cols, "b", "street", "lat", "lon", several, F.explode(F.array_distinct("nums")).alias("no")) \
        .withColumn("core", _address_core("street")).filter(F.col("core").isNotNull() & F.col("no").isNotNull())
    la, ra = door(l, "lid", "lk"), door(r, "rid", "keys")
    met = _meet(la, ra, "lk", "keys", at).unionByName(names_met(l, r, "lk", "keys", radius_m=near_m, block="b")).distinct()
    names = cut_lineage(_named_pairs(met, town_words))
    # what is asked for and what is told at an address, each numbered once, and which of them agree
    ask, tell = [*at, "street", "lk"], [*at, "street", "keys"]
    numbered = lambda d, cols, id: cut_lineage(d.select(*cols).distinct().withColumn(id, F.monotonically_increasing_id()))
    q, t = numbered(la, ask, "qid"), numbered(ra, tell, "tid")
    fit = names.filter((F.col("s") >= min(limits["addr_score"], limits["near_score"])) | F.col("shared"))
    agree = q.withColumnRenamed("street", "l_street").join(t.withColumnRenamed("street", "r_street"), at).join(_streets_met(la, ra, at), ["l_street", "r_street"])
    agree = cut_lineage(agree.join(fit, ["lk", "keys"]).select("qid", "tid", "s", "shared"))
    asked = la.join(q, ask).select("qid", "lid", "lat", "lon", "nums", "no").join(agree, "qid").select("tid", "lid", "s", "shared", "lat", "lon", "nums", F.when(F.col("nums").isNotNull(), F.col("no")).alias("no"))
    told = ra.join(t, tell).select("tid", "rid", "lat", "lon", "nums")
    first = F.coalesce(F.col("l_no") == F.array_min(F.array_intersect("l_nums", "r_nums")), F.lit(True))

    def at_address(p, dist):
        return _rated(p.filter(first).select(F.col("l_lid").alias("lid"), F.col("r_rid").alias("rid"), F.col("l_s").alias("s"), F.col("l_shared").alias("shared"), (dist <= addr_max_m).alias("same_addr"), dist.alias("dist")), **limits)
    out = at_address(proximity_join(asked, told, radius_m=far, block=["tid"]), F.col("dist_m"))
    # rows without a place count as near their address
    no_spot = F.col("lat").isNull() | F.col("lon").isNull()
    pre = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in d.columns])
    for some_l, some_r, rows in ((asked.filter(no_spot), told, l), (asked.filter(~no_spot), told.filter(no_spot), r)):
        if not rows.filter(no_spot).isEmpty():
            out = out.unionByName(at_address(_cell_join(pre(some_l, "l_"), pre(some_r, "r_"), [("l_tid", "r_tid")], DENSE), F.lit(40.0)))
    # near rows of agreeing names that do not share the address, where they are paired already
    near = proximity_join(l.join(names.filter(F.col("s") >= min(limits["near_score"], limits["close_score"])), "lk"), r, radius_m=near_m, block=["b", "keys"])
    share = F.arrays_overlap("l_nums", "r_nums") & (_address_core("l_street") == _address_core("r_street")) & street_compat("l_street", "r_street")
    near = near.filter(~F.coalesce(share, F.lit(False)))
    near = near.select(F.col("l_lid").alias("lid"), F.col("r_rid").alias("rid"), F.col("l_s").alias("s"), F.col("l_shared").alias("shared"), F.lit(False).alias("same_addr"), F.col("dist_m").alias("dist"))
    return out.unionByName(_rated(near, **limits))


def _pairs_of_repeated(l: DataFrame, r: DataFrame, *, town_words, **limits) -> DataFrame:
    """As ``_pairs_of_single`` for ids that stand several times: all candidates are worked out and those of an id pair count together."""
    l, r = l.withColumnsRenamed({"b": "l_b", "nums": "l_nums", "street": "l_street"}), r.withColumnsRenamed({"b": "r_b", "nums": "r_nums", "street": "r_street"})
    near_m, addr_max_m, tw = limits["near_m"], limits["addr_max_m"], town_words
    cols = ["lid", "rid", "lk", "keys", "same_addr", "dist"]
    la = l.withColumn("no", F.explode("l_nums")).withColumn("l_core", core_street("l_street")).select("lid", "lk", "l_b", "no", "l_core", "l_street", F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    ra = r.withColumn("no", F.explode("r_nums")).withColumn("r_core", core_street("r_street")).select("rid", "keys", "r_b", F.col("no").alias("r_no"), "r_core", "r_street", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    d = F.sqrt(F.pow((F.col("l_lat") - F.col("r_lat")) * 111000, 2) + F.pow((F.col("l_lon") - F.col("r_lon")) * 99000, 2))
    # streets without a core word (a bare direction or type) can only agree as whole texts
    core_key_ = lambda core, street: F.coalesce(core, F.concat(F.lit("="), street))
    by_addr = la.join(ra, (F.col("l_b") == F.col("r_b")) & (F.col("no") == F.col("r_no")) & (core_key_(F.col("l_core"), F.col("l_street")) == core_key_(F.col("r_core"), F.col("r_street")))) \
        .filter(street_compat("l_street", "r_street")).withColumn("dist", F.coalesce(d, F.lit(40.0))) \
        .withColumn("same_addr", F.col("dist") <= addr_max_m).select(*cols)
    near = proximity_join(l.select("lid", "lk", F.col("l_b").alias("b"), "lat", "lon"), r.select("rid", "keys", F.col("r_b").alias("b"), "lat", "lon"), radius_m=near_m, block=["b"]) \
        .select(F.col("l_lid").alias("lid"), F.col("r_rid").alias("rid"), F.col("l_lk").alias("lk"), F.col("r_keys").alias("keys"), F.lit(False).alias("same_addr"), F.col("dist_m").alias("dist"))
    cand = by_addr.unionByName(near).groupBy("lid", "rid").agg(F.first("lk").alias("lk"), F.first("keys").alias("keys"), F.max("same_addr").alias("same_addr"), F.min("dist").alias("dist"))
    one = cand.withColumn("rk", F.explode("keys"))
    t = tw if tw is not None else F.array().cast("array<string>")
    one = on_distinct(one, ["lk", "rk"], {
        "s": name_sim("lk", "rk", F.col("_tw"), "_sl", "_sr"), "conflict": kind_conflict("lk", "rk"), "same": same_key("lk", "rk", F.col("_tw")),
        "share": real_share("_sl", "_sr", F.col("_tw")) | close_words(F.array_except("_sl", "_tw"), F.array_except("_sr", "_tw"))},
        prepare={"_tw": t, "_sl": name_stems("lk"), "_sr": name_stems("rk")})
    best = one.groupBy("lid", "rid").agg(F.max("same_addr").alias("same_addr"), F.min("dist").alias("dist"), F.max("s").alias("s"),
                                         F.bool_and("conflict").alias("all_conflict"), F.bool_or("same").alias("same"), F.bool_or("share").alias("share"))
    best = best.withColumn("shared", F.coalesce(F.col("share") & ~F.col("all_conflict"), F.lit(False)))
    return _rated(best.filter("same"), **limits)


def _named_pairs(met: DataFrame, town_words) -> DataFrame:
    """(lk, keys, s, shared) of the pairs (lk, keys) that can be one business; every pair of names is scored once."""
    t = town_words if town_words is not None else F.array().cast("array<string>")
    one = on_distinct(met.withColumn("rk", F.explode("keys")), ["lk", "rk"], {
        "s": name_sim("lk", "rk", F.col("_tw"), "_sl", "_sr"), "conflict": kind_conflict("lk", "rk"), "same": same_key("lk", "rk", F.col("_tw")),
        "share": real_share("_sl", "_sr", F.col("_tw")) | close_words(F.array_except("_sl", "_tw"), F.array_except("_sr", "_tw"))},
        prepare={"_tw": t, "_sl": name_stems("lk"), "_sr": name_stems("rk")})
    both = one.groupBy("lk", "keys").agg(F.max("s").alias("s"), F.bool_and("conflict").alias("c"), F.bool_or("same").alias("same"), F.bool_or("share").alias("share"))
    return both.filter("same").select("lk", "keys", "s", F.coalesce(F.col("share") & ~F.col("c"), F.lit(False)).alias("shared"))


def _meet(left: DataFrame, right: DataFrame, l_name: str, r_name: str, by) -> DataFrame:
    return left.select(*by, l_name).distinct().join(right.select(*by, r_name).distinct(), by).select(l_name, r_name)


def names_met(left: DataFrame, right: DataFrame, l_name: str, r_name: str, *, radius_m: float, block: str | None = None) -> DataFrame:
    """Pairs (l_name, r_name) of names, at least all that stand within the radius in one block somewhere: in a block of few names all of them, else those
    of touching cells. Pairs may repeat."""
    b = block or "_all"
    left, right = (left, right) if block else (left.withColumn(b, F.lit(0)), right.withColumn(b, F.lit(0)))
    size = lambda d, name, n: d.groupBy(b).agg(F.countDistinct(name).alias(n), F.count("*").alias(n + "_rows"))
    few = size(left, l_name, "nl").join(size(right, r_name, "nr"), b).filter("nl * nr <= 16 * (nl_rows + nr_rows)").select(b)
    h, w = cell_sizes(radius_m)
    lz = left.join(few, b, "left_anti").select(b, l_name, cell("lat", h).alias("cy"), cell("lon", w).alias("cx"))
    rz = right.join(few, b, "left_anti").select(b, r_name, F.explode(neighbor_cells("lat", "lon", radius_m)).alias("c")).select(b, r_name, "c.cy", "c.cx")
    return _meet(left.join(few, b, "left_semi"), right, l_name, r_name, [b]).unionByName(_meet(lz, rz, l_name, r_name, [b, "cy", "cx"]))


def _numbered(df: DataFrame, cols, id: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the number of their combination of ``cols``, table of the combinations); nulls are values."""
    table = cut_lineage(df.select(*cols).distinct().withColumn(id, F.monotonically_increasing_id()))
    return df.join(table.select(*[F.col(c).alias("_n_" + c) for c in cols], id), [F.col(c).eqNullSafe(F.col("_n_" + c)) for c in cols]).drop(*["_n_" + c for c in cols]), table


def near_named(left: DataFrame, right: DataFrame, score: Callable, *, radius_m: float, min_score: float) -> DataFrame:
    """Pairs (l_*, r_*, s, dist_m) of both sides (name, lat, lon, ...) within the radius whose names score ``min_score`` or more. Names that may meet are scored
    first, each pair once, and rows meet on an agreeing name and their cells: rows with other names are never paired."""
    (l, ln), (r, rn) = _numbered(left, ["name"], "ln"), _numbered(right, ["name"], "rn")
    met = names_met(l, r, "ln", "rn", radius_m=radius_m).distinct()
    met = met.join(ln.withColumnRenamed("name", "name_l"), "ln").join(rn.withColumnRenamed("name", "name_r"), "rn")
    # few bytes, much work per row: as in on_distinct
    met = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = cut_lineage(met.select("ln", "rn", score("name_l", "name_r").alias("s")).filter(F.col("s") >= min_score))
    return proximity_join(l.join(named, "ln").drop("ln"), r, radius_m=radius_m, block=["rn"]).drop("l_rn", "r_rn").withColumnRenamed("l_s", "s")


def _streets_met(la: DataFrame, ra: DataFrame, at) -> DataFrame:
    """(l_street, r_street) of the streets that meet by ``at`` and denote one street; each pair is judged once."""
    street = lambda d, name: d.select(*at, F.col("street").alias(name)).distinct()
    streets = street(la, "ls").join(street(ra, "rs"), at).select("ls", "rs").distinct().filter(street_compat("ls", "rs"))
    return cut_lineage(streets.select(F.col("ls").alias("l_street"), F.col("rs").alias("r_street")))


def match_listings(left: DataFrame, right: DataFrame, *, block: str, town_words=None, addr_score=75.0, near_m=150.0, near_score=88.0, close_m=60.0, close_score=80.0,
                   addr_max_m=2000.0) -> DataFrame:
    """(lid, rid, score, rule): the best registry row of each listing (a registry row may serve several) by the rules of ``similar_name_pairs``.
    Both sides go in as classes of equal rows, so copies neither meet copies nor are scored again; a class's registry id is its smallest.

    Names are scored once. Listings then look around in growing circles, and only as long as a name farther away could still score higher
    than what they hold, so a listing meets few rows however dense a county is."""
    lc, lm = classes(left.filter(F.col("k") != ""), [block, "k", "nums", "street", "lat", "lon"], "lid")
    l = cut_lineage(lc.select(F.col("cls").alias("lid"), F.col(block).alias("b"), F.col("k").alias("lk"), "nums", "street", "lat", "lon"))
    r = cut_lineage(right.groupBy(F.col(block).alias("b"), "keys", "nums", "street", "lat", "lon").agg(F.min("rid").alias("rid")))
    core = F.coalesce(core_street("street"), F.concat(F.lit("="), F.col("street")))     # streets without a core word can only agree as whole texts
    at = ["b", "no", "core"]
    la = l.withColumn("no", F.explode("nums")).withColumn("core", core).drop("nums").filter(F.col("core").isNotNull()).distinct()
    ra = r.withColumn("no", F.explode("nums")).withColumn("core", core).filter(F.col("core").isNotNull()).groupBy(*at, "street", "keys", "lat", "lon").agg(F.min("rid").alias("rid"))
    la, ra = cut_lineage(la), cut_lineage(ra)
    spots = cut_lineage(r.groupBy("b", "keys", "lat", "lon").agg(F.min("rid").alias("rid")))
    met = _meet(la, ra, "lk", "keys", at).unionByName(names_met(l, spots, "lk", "keys", radius_m=near_m, block="b")).distinct()
    names = cut_lineage(_named_pairs(met, town_words))
    streets = _streets_met(la, ra, at)
    same_addr, s, dist = F.col("same_addr"), F.col("s"), F.col("dist")
    rule = F.when(same_addr & ((s >= addr_score) | F.col("shared")), F.lit("address")).when((dist <= near_m) & (s >= near_score), F.lit("near")) \
        .when((dist <= close_m) & (s >= close_score) & F.col("shared"), F.lit("close"))
    score = s + F.when(same_addr, F.lit(15)).otherwise(F.lit(0)) - dist / 20
    first = lambda p, by: p.withColumn("rule", rule).filter(F.col("rule").isNotNull()).groupBy(*by).agg(F.min(F.struct((-score).alias("minus"), "rid", "rule")).alias("m"))
    better = lambda p: p.groupBy("lid").agg(F.min("m").alias("m"))
    # rows without a place count as near their address: by name and address alone
    no_spot = F.col("lat").isNull() | F.col("lon").isNull()
    pre = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in d.columns])
    ask = ["b", "no", "core", "street", "lk"]

    def unplaced(some_l, some_r):
        x, y = pre(some_l.select(*ask).distinct(), "l_"), pre(some_r.groupBy(*at, "street", "keys").agg(F.min("rid").alias("rid")), "r_")
        p = x.join(y, [F.col("l_" + c) == F.col("r_" + c) for c in at]).join(streets, ["l_street", "r_street"])
        p = p.select(*["l_" + c for c in ask], F.col("l_lk").alias("lk"), F.col("r_keys").alias("keys"), F.col("r_rid").alias("rid"), F.lit(40.0).alias("dist"), F.lit(40.0 <= addr_max_m).alias("same_addr"))
        got = first(p.join(names, ["lk", "keys"]), ["l_" + c for c in ask])
        return some_l.join(got, [F.col(c) == F.col("l_" + c) for c in ask]).select("lid", "m")
    best = cut_lineage(better(unplaced(la, ra.filter(no_spot)).unionByName(unplaced(la.filter(no_spot), ra))))
    top = names.groupBy("lk").agg(F.max("s").alias("most"))

    def rings(rows, best, reach, bonus, look):
        rows, done = rows.filter(~no_spot).join(top, "lk"), None
        for far in [x for x in (40.0, 160.0, 640.0) if x < reach] + [reach]:
            hold = best.select(F.col("lid").alias("_lid"), (-F.col("m.minus")).alias("held"))
            open_ = rows.join(hold, F.col("lid") == F.col("_lid"), "left").filter(F.col("held").isNull() | (F.col("most") + F.lit(bonus - (done or 0.0) / 20) >= F.col("held"))).drop("_lid", "held", "most")
            got = look(open_, far)
            got = got if done is None else got.filter(dist > done)
            best = cut_lineage(better(first(got, ["lid"]).select("lid", "m").unionByName(best)))
            done = far
        return best

    def at_address(rows, far):
        p = proximity_join(rows, ra.filter(~no_spot), radius_m=far, block=at).join(streets, ["l_street", "r_street"])
        return p.select(F.col("l_lid").alias("lid"), F.col("l_lk").alias("lk"), F.col("r_keys").alias("keys"), F.col("r_rid").alias("rid"), F.col("dist_m").alias("dist"), (F.col("dist_m") <= addr_max_m).alias("same_addr")) \
            .join(names, ["lk", "keys"])

    def nearby(rows, far):
        p = proximity_join(rows.join(names.filter(s >= min(near_score, close_score)), "lk"), spots, radius_m=far, block=["b", "keys"])
        return p.select(F.col("l_lid").alias("lid"), F.col("r_rid").alias("rid"), F.col("l_s").alias("s"), F.col("l_shared").alias("shared"), F.col("dist_m").alias("dist"), F.lit(False).alias("same_addr"))
    best = rings(la.select("lid", *at, "street", "lk", "lat", "lon"), best, float(max(addr_max_m, near_m, close_m)), 15.0, at_address)
    best = rings(l.select("lid", "b", "lk", "lat", "lon"), best, float(near_m), 0.0, nearby)
    best = best.select(F.col("lid").alias("cls"), F.col("m.rid").alias("rid"), (-F.col("m.minus")).alias("score"), F.col("m.rule").alias("rule"))
    return lm.join(best, "cls").select("lid", "rid", "score", "rule")


def curated_match(curated: DataFrame, places: DataFrame, *, addr_score=60.0, town_score=90.0, state_score=95.0, max_number_gap=40) -> DataFrame:
    """Researched rows to places: (cid, pid, tier). Tier 1: one street number and street, similar name, same town or zip. Tier 2: the only
    near-equal name in the town. Tier 3: the only near-equal name anywhere. Tiers 2 and 3 skip chains and rows whose own address is
    another branch's. Curated carries (cid, names array of name keys, num, nums, street, town, zip, chain), places (pid, k, num, nums,
    street, town, zip); towns are comparable keys."""
    c = curated.withColumn("ck", F.explode("names")).filter(F.col("ck") != "")
    pc = places.select(*[F.col(x).alias("p_" + x) for x in ("pid", "k", "num", "nums", "street", "town", "zip")])
    # equal names at one address meet as one row on both sides; the least place id stands for its row
    asked = ["ck", "no", "street", "town", "zip"]
    a = c.withColumn("no", F.explode("nums")).select("cid", *asked).distinct()
    a, a_rows = a.select(*asked).distinct().withColumn("core", core_street("street")), a
    b = pc.withColumn("p_no", F.explode("p_nums")).groupBy("p_k", "p_no", "p_street", "p_town", "p_zip").agg(F.min("p_pid").alias("p_pid")).withColumn("p_core", core_street("p_street"))
    here = (F.coalesce("town", F.lit("")) == "") & (F.coalesce("zip", F.lit("")) == "") | (F.col("town") == F.col("p_town")) | (F.col("zip") == F.col("p_zip"))
    t1 = a.join(b, (F.col("no") == F.col("p_no")) & (F.col("core") == F.col("p_core"))).filter(here & street_compat("street", "p_street"))
    t1 = on_distinct(t1, ["ck", "p_k"], {"score": sim_token_set("ck", "p_k")}).filter(F.col("score") >= addr_score)
    t1 = top_rows(t1, asked, [F.desc("score"), F.asc("p_pid")]).select(*[F.col(x).alias("_" + x) for x in asked], F.col("p_pid").alias("pid"), "score")
    t1 = a_rows.join(t1, [F.col(x).eqNullSafe(F.col("_" + x)) for x in asked])
    t1 = top_rows(t1, ["cid"], [F.desc("score"), F.asc("pid")]).select("cid", "pid", F.lit(1).alias("tier"))
    free = c.filter(~F.coalesce("chain", F.lit(False))).join(t1.select("cid"), "cid", "left_anti")
    near_here = near_text_pairs(free, places.withColumnRenamed("k", "pk"), "ck", "pk", town_score, block=["town"])
    near_all = near_text_pairs(free, places.withColumnRenamed("k", "pk"), "ck", "pk", state_score)
    # of the places of one name only the first and the last id and the first one's address count
    named = lambda keys: pc.groupBy(*keys).agg(F.min("p_pid").alias("p_pid"), F.max("p_pid").alias("p_max"), F.min_by(F.struct("p_num", "p_street"), "p_pid").alias("_at")) \
        .select(*keys, "p_pid", "p_max", "_at.*")
    h2 = free.join(near_here.select(F.col("town").alias("_t"), "l_text", "r_text"), (F.col("town") == F.col("_t")) & (F.col("ck") == F.col("l_text"))) \
        .join(named(["p_town", "p_k"]), (F.col("p_town") == F.col("_t")) & (F.col("p_k") == F.col("r_text"))).withColumn("tier", F.lit(2))
    h3 = free.join(near_all.select("l_text", "r_text"), F.col("ck") == F.col("l_text")).join(named(["p_k"]), F.col("p_k") == F.col("r_text")).withColumn("tier", F.lit(3))
    cols = ["cid", "tier", "p_pid", "p_max", "num", "street", "p_num", "p_street"]
    hits = h2.select(*cols).unionByName(h3.select(*cols)).groupBy("cid", "tier").agg(
        F.min("p_pid").alias("pid"), F.max("p_max").alias("pmax"), F.min_by(F.struct("num", "street", "p_num", "p_street"), "p_pid").alias("at"))
    first = top_rows(hits, ["cid"], [F.asc("tier")]).filter(F.col("pid") == F.col("pmax"))
    known = F.col("at.num").isNotNull() & F.col("at.p_num").isNotNull() & F.col("at.street").isNotNull() & F.col("at.p_street").isNotNull()
    gap = F.abs(F.col("at.num").try_cast("bigint") - F.col("at.p_num").try_cast("bigint"))
    other = known & ~(street_compat("at.street", "at.p_street") & (gap <= max_number_gap))
    return t1.unionByName(first.filter(~other).select("cid", "pid", "tier"))


def hand_checked_twin(unlicensed: DataFrame, licensed: DataFrame, *, near_m=150.0, max_number_gap=40, town_words=None) -> DataFrame:
    """(id, twin): a hand-checked row without a license and its licensed twin at the same street address or near, in one county, the same
    business by name; the closest name wins. Both carry (id, name, k, num, street, county, lat, lon).

    Names are judged once. Rows look for near twins by falling likeness of the names, in parts that double, and only until they have one, so a row meets
    few others however dense a county is."""
    l, r = (d.select("id", "name", "k", "num", "street", "county", "lat", "lon") for d in (unlicensed, licensed))
    pre = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in d.columns])
    tw = town_words if town_words is not None else F.array().cast("array<string>")
    gap = F.abs(F.col("l_num").try_cast("bigint") - F.col("r_num").try_cast("bigint"))
    fits = ~F.coalesce((gap > max_number_gap) & street_compat("l_street", "r_street"), F.lit(False))

    def judged(pairs):
        pairs = on_distinct(pairs, ["l_name", "r_name"], {"same": same_business("l_name", "r_name", F.col("_tw"))}, prepare={"_tw": tw}).filter("same")
        return on_distinct(pairs, ["l_k", "r_k"], {"s": sim_ratio("l_k", "r_k")})
    closest = lambda cand, s, by: cand.groupBy(*by).agg(F.min(F.struct((-F.col(s)).alias("s"), F.col("r_id").alias("twin"))).alias("m"))
    # at an address rows of one name meet as one row on both sides; the least id stands for the licensed ones
    attrs = ["name", "k", "num", "street", "county"]
    la = pre(l.select(*attrs).distinct(), "l_")
    ra = pre(r.groupBy(*attrs).agg(F.min(F.struct("id")).alias("m")).select(*attrs, "m.id"), "r_")
    same = (F.col("l_num") == F.col("r_num")) & (F.col("l_street") == F.col("r_street"))
    at = la.join(ra, same & (F.col("l_county") == F.col("r_county"))).unionByName(la.filter(F.col("l_county").isNull()).join(ra, same))
    at = closest(judged(at.filter(fits)), "s", ["l_" + x for x in attrs])
    out = l.join(at, [F.col(x).eqNullSafe(F.col("l_" + x)) for x in attrs]).select("id", "m")
    # near: rows of equal values are one row on both sides
    spot = [*attrs, "lat", "lon"]
    placed = lambda d: d.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    (ls, ln), (rs, rn) = _numbered(placed(l).select(*spot).distinct(), ["name", "k"], "ln"), _numbered(placed(r).groupBy(*spot).agg(F.min(F.struct("id")).alias("m")).select(*spot, "m.id"), ["name", "k"], "rn")
    ls, rs = cut_lineage(ls.withColumn("no", F.monotonically_increasing_id())), cut_lineage(rs.select("id", "rn", "num", "street", "county", "lat", "lon"))
    free = F.col("county").isNull()                      # such rows meet those of any county
    some_free = not ls.filter(free).isEmpty()
    met = names_met(ls, rs, "ln", "rn", radius_m=near_m, block="county")
    met = met.unionByName(names_met(ls.filter(free), rs, "ln", "rn", radius_m=near_m)) if some_free else met
    met = met.distinct().join(pre(ln, "l_").withColumnRenamed("l_ln", "ln"), "ln").join(pre(rn, "r_").withColumnRenamed("r_rn", "rn"), "rn")
    rank = F.rank().over(W.partitionBy("ln").orderBy(F.desc_nulls_first("s")))
    named = cut_lineage(judged(met).select("ln", "rn", "s").withColumn("part", F.ceil(F.log2(rank)).cast("int")))
    last, right_rows = named.agg(F.max("part")).first()[0], rs.count()
    open_, done = ls.select("no", "ln", "num", "street", "county", "lat", "lon"), None
    for part in range(0 if last is None else last + 1):
        now = named.filter(F.col("part") == part).select("ln", "rn", "s")
        asks = open_.groupBy("ln").agg(F.count("*").alias("n")).join(now, "ln").agg(F.sum("n")).first()[0]
        if not asks:
            continue
        ask = open_.join(now, "ln").drop("ln")

        def meet(some, block):
            if asks >= right_rows:
                return proximity_join(some, rs, radius_m=near_m, block=block)
            p = proximity_join(rs, some, radius_m=near_m, block=block)          # the smaller side is laid on its nine cells
            return p.select(*[F.col(c).alias({"l_": "r_", "r_": "l_"}.get(c[:2], c[:2]) + c[2:]) for c in p.columns])
        found = meet(ask, ["county", "rn"]).select("l_no", "l_s", "l_num", "l_street", "r_id", "r_num", "r_street")
        found = found.unionByName(meet(ask.filter(free), ["rn"]).select(*found.columns)) if some_free else found
        found = cut_lineage(closest(found.filter(fits), "l_s", ["l_no"]))
        done = found if done is None else done.unionByName(found)
        open_ = cut_lineage(open_.join(found, F.col("no") == F.col("l_no"), "left_anti"))
    if done is not None:
        near = ls.join(done, F.col("no") == F.col("l_no")).select(*[F.col(x).alias("l_" + x) for x in spot], "m")
        out = out.unionByName(l.join(near, [F.col(x).eqNullSafe(F.col("l_" + x)) for x in spot]).select("id", "m"))
    return out.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.twin")


def point_by_name_town(unplaced: DataFrame, places: DataFrame, *, min_ratio=92.0, max_spread=0.002) -> DataFrame:
    """(id, lat, lon) for unplaced rows whose near-equal names in the town lie at one spot. Both carry (town, k, num); places lat, lon."""
    p = near_text_pairs(unplaced, places.withColumnRenamed("k", "pk"), "k", "pk", min_ratio, block=["town"])
    # equal names and numbers of a town meet as one row on both sides: of the places count the first one's point and the edges, and these add up
    def merged(d, by, pid, lat, lon, low, high):
        return d.groupBy(*by).agg(F.min_by(lat, pid).alias("lat"), F.min_by(lon, pid).alias("lon"), F.min(pid).alias("pid"), F.min(low).alias("low"), F.max(high).alias("high"))
    pl = merged(places, ["town", "k", "num"], "pid", "lat", "lon", "lat", "lat").select(F.col("town").alias("p_town"), F.col("k").alias("p_k"), F.col("num").alias("p_num"), "lat", "lon", "pid", "low", "high")
    asked = unplaced.select("town", "k", "num").distinct()
    hit = asked.join(p.select(F.col("town").alias("_t"), "l_text", "r_text"), (F.col("town") == F.col("_t")) & (F.col("k") == F.col("l_text"))) \
        .join(pl, (F.col("p_town") == F.col("_t")) & (F.col("p_k") == F.col("r_text")))
    hit = hit.filter(~F.coalesce(F.col("num") != F.col("p_num"), F.lit(False)))
    hit = merged(hit, ["town", "k", "num"], "pid", "lat", "lon", "low", "high").withColumnsRenamed({"town": "_t", "k": "_k", "num": "_n"})
    found = unplaced.select("id", "town", "k", "num").join(hit, (F.col("town") == F.col("_t")) & (F.col("k") == F.col("_k")) & F.col("num").eqNullSafe(F.col("_n")))
    found = merged(found, ["id"], "pid", "lat", "lon", "low", "high")
    return found.filter(F.col("high") - F.col("low") < max_spread).select("id", "lat", "lon")


def place_unplaced(unplaced: DataFrame, places: DataFrame, cached: DataFrame, **rules) -> DataFrame:
    """(id, address, lat, lon, placed_by) for every unplaced row (id unique): the geocoder's cached point of its ``address`` comes first, then the spot of the near-equal
    names in its town (``point_by_name_town``, for rows without a cached point only), else nothing. ``cached`` carries (address, lat, lon); entries without a
    point count as absent, and of several points of an address the least stays. placed_by is 'cache', 'listing' or null."""
    known = cached.filter(F.col("address").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(F.col("address").alias("_a")) \
        .agg(F.min(F.struct("lat", "lon")).alias("_hit"))
    asked = unplaced.join(known, F.col("address") == F.col("_a"), "left").drop("_a")
    found = point_by_name_town(asked.filter(F.col("_hit").isNull()).drop("_hit", "address"), places, **rules).select(F.col("id").alias("_i"), F.struct("lat", "lon").alias("_spot"))
    by = F.when(F.col("_hit").isNotNull(), "cache").when(F.col("_spot").isNotNull(), "listing")
    at = F.coalesce("_hit", "_spot")
    return asked.join(found, F.col("id") == F.col("_i"), "left").select("id", "address", at["lat"].alias("lat"), at["lon"].alias("lon"), by.alias("placed_by"))


def geocode_todo(placed: DataFrame) -> DataFrame:
    """(address) of rows that still have no point: what the geocoder is to be asked next, each once."""
    return placed.filter(F.col("placed_by").isNull() & F.col("address").isNotNull()).select("address").distinct()


def flag_closed_twin(df: DataFrame, *, id: str, name_key: str, closed: str, bare_key: str, dlat=0.0015, dlon=0.002, min_score=90.0) -> DataFrame:
    """Adds ``closed_twin``: closed itself, or near a closed listing with (nearly) the same name. ``bare_key`` is the closed listing's name
    key without the closing words. Copies at one spot count once."""
    from .spatial import box_join
    c = df.filter(F.col(closed) & (F.col(bare_key) != "")).groupBy(F.col(bare_key).alias("bk"), "lat", "lon").agg(F.lit(1).alias("one"))
    spots = df.groupBy(F.col(name_key).alias("nk"), "lat", "lon").agg(F.lit(1).alias("one"))
    pairs = box_join(c, spots, dlat=dlat, dlon=dlon).filter(sim_token_set("l_bk", "r_nk") >= min_score)
    hit = pairs.select(F.col("r_nk").alias("_nk"), F.col("r_lat").alias("_la"), F.col("r_lon").alias("_lo")).distinct().withColumn("_hit", F.lit(True))
    j = df.join(hit, (F.col(name_key) == F.col("_nk")) & (F.col("lat") == F.col("_la")) & (F.col("lon") == F.col("_lo")), "left")
    return j.withColumn("closed_twin", F.col(closed) | F.coalesce("_hit", F.lit(False))).drop("_nk", "_la", "_lo", "_hit")

