"""Distributed numbering, medians, assignment and suppression against plain sequential twins, hot groups included."""
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wayfound.operators import enrich as E, fuzzy as Z, matching as M, numbering as N, scale as SC, spatial as SP
from test_functions import ratio


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows under one key."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 9)}", rng.choice([None, rng.randint(0, 20), rng.random() * 100])) for i in range(600)]
    rows = [(i, k, None if v is None else float(v)) for i, k, v in rows]
    return rows, spark.createDataFrame(rows, "id int, k string, v double")


def test_ranked_and_running_total(hot):
    rows, df = hot
    got = {r.id: (r.rn, r.t) for r in SC.running_total(SC.ranked(df, ["k"], ["id"], "rn"), ["k"], ["id"], "v", "t").collect()}
    seen = {}
    for i, k, v in rows:
        n, t = seen.get(k, (0, 0.0))
        seen[k] = (n + 1, t + (v or 0))
        assert got[i][0] == n + 1 and got[i][1] == pytest.approx(t + (v or 0))
    whole = sorted(r.rn for r in SC.ranked(df, [], ["k", "id"], "rn").collect())
    assert whole == list(range(1, 601))


def test_exact_median_and_mode(hot):
    rows, df = hot
    got = {r.k: r.median_v for r in SC.exact_median(df, ["k"], ["v"]).collect()}
    for k in got:
        assert got[k] == pytest.approx(statistics.median(v for _, q, v in rows if q == k and v is not None))
    m = {r.k: r.m for r in SC.mode_value(df.withColumn("w", F.floor("v")), ["k"], "w", "m").collect()}
    for k in m:
        vals = [int(v // 1) for _, q, v in rows if q == k and v is not None]
        assert m[k] == min(vals, key=lambda x: (-vals.count(x), x))


def test_pct_rank_average_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 4.0), (5, None)], "id int, v double")
    assert {r.id: r.pct for r in N.pct_rank_avg(df, "v").collect()} == {1: 25.0, 2: 62.5, 3: 62.5, 4: 100.0, 5: None}


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([(i, 26.0 + (i * 37 % 11) / 1e3 if i % 3 else None, "x" if i == 7 else None) for i in range(60)], "row bigint, lat double, note string")
    back = {r.row: r.lat for r in N.delta_decode(N.delta_encode(df, {"lat": 10000}), {"lat": 10000}).collect()}
    assert all((back[r.row] is None) == (r.lat is None) and (r.lat is None or back[r.row] == pytest.approx(r.lat, abs=1e-4)) for r in df.collect())
    cells = N.sparse_encode(df, ["note", "lat"])
    assert [tuple(r) for r in cells.collect()] == [("note", 7, "x")]
    assert [r.row for r in N.sparse_decode(df, cells, {"note": "string"}).filter("note = 'x'").collect()] == [7]


def greedy(edges):
    left, right, out = set(), set(), []
    for l, r, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if l not in left and r not in right:
            left.add(l), right.add(r), out.append((l, r))
    return sorted(out)


@pytest.fixture
def stages(monkeypatch):
    """Counts the stages an iterative rule writes."""
    seen, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: (seen.append(1), cut(df))[1])
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_to_one_equals_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randint(1, 25), rng.randint(1, 25)): rng.randint(60, 70) for _ in range(150)}.items())
    edges = [(l, r, float(s)) for (l, r), s in edges]
    got = M.one_to_one(spark.createDataFrame(edges, "lid int, rid int, score double"))
    assert sorted((r.lid, r.rid) for r in got.collect()) == greedy(edges)


def test_a_chain_is_assigned_in_few_rounds(spark, stages):
    """1,000 edges in a row, each worse than the last: every second one is taken."""
    edges = [((i + 1) // 2, i // 2, 2000.0 - i) for i in range(1000)]
    got = M.one_to_one(spark.createDataFrame(edges, "lid int, rid int, score double"))
    assert sorted((r.lid, r.rid) for r in got.collect()) == greedy(edges)
    assert len(stages) <= 20


def test_a_chain_of_classes_hands_on_what_is_left(spark):
    """Capacities along a chain of classes; the copies' order decides who gets a place."""
    rng = random.Random(9)
    nl, nr = [rng.randint(1, 4) for _ in range(13)], [rng.randint(1, 4) for _ in range(13)]
    first = lambda ns: [sum(ns[:i]) + 1 for i in range(len(ns))]
    fl, fr = first(nl), first(nr)
    chain = [((i + 1) // 2, i // 2, 90.0 - i) for i in range(24)]
    members = lambda ns, f: spark.createDataFrame([(f[c] + j, f[c]) for c, n in enumerate(ns) for j in range(n)], "id int, cls int")
    got = M.one_to_one_classes(spark.createDataFrame([(fl[a], fr[b], s) for a, b, s in chain], "lid int, rid int, score double"), members(nl, fl), members(nr, fr))
    used_l, used_r, want = [0] * 13, [0] * 13, []
    for a, b, _ in chain:
        while used_l[a] < nl[a] and used_r[b] < nr[b]:
            want.append((fl[a] + used_l[a], fr[b] + used_r[b]))
            used_l[a], used_r[b] = used_l[a] + 1, used_r[b] + 1
    assert sorted((x.lid, x.rid) for x in got.collect()) == sorted(want)


def test_a_chain_is_suppressed_in_few_rounds(spark, stages):
    """1,000 rows, each in conflict with the next: every second one goes, for the row before it."""
    pairs = M.suppress(spark.createDataFrame([(i, i + 1, i) for i in range(999)], "hi int, lo int, hi_rank int"))
    assert {r.loser: r.survivor for r in pairs.collect()} == {i: i - 1 for i in range(1, 1000, 2)}
    assert len(stages) <= 20


def test_copies_are_assigned_as_classes(spark):
    """Class assignment equals the greedy walk over all rows; a third of the left rows are copies of one."""
    rng = random.Random(4)
    lcls = [1] * 10 + [rng.choice([11, 12, 13, 14]) for _ in range(20)]
    l = {i + 1: None for i in range(30)}
    for c in set(lcls):
        ids = [i + 1 for i, x in enumerate(lcls) if x == c]
        for i in ids:
            l[i] = min(ids)
    r = {i: (i + 2) // 3 * 3 - 2 for i in range(1, 25)}
    pairs = {(a, b): float(rng.randint(70, 80)) for a in set(l.values()) for b in set(r.values()) if rng.random() < 0.5}
    full = [(a, b, pairs[(l[a], r[b])]) for a in l for b in r if (l[a], r[b]) in pairs]
    left, right, want = set(), set(), []
    for a, b, s in sorted(full, key=lambda e: (-e[2], l[e[0]], r[e[1]], e[0], e[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.append((a, b))
    mk = lambda d: spark.createDataFrame(list(d.items()), "id int, cls int")
    got = M.one_to_one_classes(spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "lid int, rid int, score double"), mk(l), mk(r))
    assert sorted((x.lid, x.rid) for x in got.collect()) == sorted(want)


def test_suppression_equals_ranked_scan(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1, 121):
        rows.append((i, rng.choice(["GULL", "ROCK", "SUN", "GULL ROCK"]), rng.choice([None, "B1", "B2"]), rng.choice([None, None, f"L{rng.randint(1, 30)}"]), 26.0 + rng.randint(0, 30) * 1e-4, -81.0 + rng.randint(0, 30) * 1e-4, float(rng.randint(0, 5))))
    rows += [(200 + k, "COPY", "B3", None, 26.5, -81.5, 3.0) for k in range(60)]          # a third are copies at one spot
    df = spark.createDataFrame(rows, "id int, name string, brand string, lic string, lat double, lon double, rank double")
    kept, pairs = M.suppress_duplicates(df, id="id", rank_order=[-F.col("rank")], name="name", brand="brand", license="lic")
    want, out = [], {}
    dist = lambda a, b: ((a[4] - b[4]) ** 2 * 111000 ** 2 + (a[5] - b[5]) ** 2 * 99000 ** 2) ** 0.5

    def clash(a, b):
        d, stems = dist(a, b), set(a[1].split()) & set(b[1].split())
        return (d <= 80 and (a[1] == b[1] or (stems and (not set(a[1].split()) - set(b[1].split()) or not set(b[1].split()) - set(a[1].split()))))) or (d <= 150 and a[2] and a[2] == b[2]) or (d <= 150 and a[3] and a[3] == b[3])
    for row in sorted(rows, key=lambda r: (-r[6], r[0])):
        hit = next((k for k in want if clash(row, k)), None)
        if hit is None:
            want.append(row)
        else:
            out[row[0]] = hit[0]
    assert sorted(r.id for r in kept.collect()) == sorted(r[0] for r in want)
    assert {r.loser: r.survivor for r in pairs.collect()} == out


def test_proximity_join_equals_all_pairs(spark):
    rng = random.Random(8)
    pts = [(i, 26 + rng.random() * 0.02, -81 + rng.random() * 0.02) for i in range(200)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {(r.l_id, r.r_id) for r in SP.proximity_join(df, df, radius_m=150.0).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if ((a[1] - b[1]) ** 2 * 111000 ** 2 + (a[2] - b[2]) ** 2 * 99000 ** 2) ** 0.5 <= 150}
    assert got == want


def test_point_in_an_l_shape(spark):
    ring = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    poly = spark.createDataFrame([("L", [{"x": float(x), "y": float(y)} for x, y in ring])], "name string, ring array<struct<x:double,y:double>>")
    wide = spark.createDataFrame([("W", [{"x": float(x), "y": float(y)} for x, y in [(-1, -1), (3, -1), (3, 3), (-1, 3)]])], "name string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 0.5, 3.0), (2, 2.0, 2.0), (3, 3.0, 0.5), (4, 9.0, 9.0), (5, None, None)], "id int, lat double, lon double")
    assert {r.id: r.name for r in SP.point_in_polygon(pts, [poly, wide], grid=0.5).collect()} == {1: "L", 2: "W", 3: "L"}


@pytest.mark.parametrize("t", [75.0, 90.0, 95.0])
def test_near_text_pairs_are_complete(spark, t):
    rng = random.Random(9)
    base = ["".join(rng.choice("ABCDE ") for _ in range(rng.randint(3, 22))) for _ in range(60)]

    def typo(s):
        s = list(s)
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(s) + 1)
            s[p:p + rng.randint(0, 1)] = rng.choice(["", "A", "E"])
        return "".join(s)
    left, right = base, [typo(b) for b in base] + base[:20]
    got = {(r.l_text, r.r_text) for r in Z.near_text_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b", t).collect()}
    assert got == {(a, b) for a in set(left) for b in set(right) if a and b and ratio(a, b) >= t}


def test_similar_name_pairs_rules(spark):
    l = spark.createDataFrame([(1, "X", "GULL ROCK", ["12"], "MAIN ST", 26.0, -81.0), (2, "X", "HARBOR SUN", ["40"], "OAK AVE", 26.0, -81.0), (3, "X", "GULL ROCK", ["99"], "ELM ST", 27.0, -81.0)], "lid int, c string, k string, nums array<string>, street string, lat double, lon double")
    r = spark.createDataFrame([(10, "X", ["GULL ROCK"], ["12"], "MAIN AVE", 26.0005, -81.0), (11, "X", ["BLUE MOON"], ["40"], "OAK AVE", 26.0, -81.0), (12, "Y", ["GULL ROCK"], ["12"], "MAIN ST", 26.0, -81.0)], "rid int, c string, keys array<string>, nums array<string>, street string, lat double, lon double")
    got = M.similar_name_pairs(l, r, block="c").collect()
    assert [(x.lid, x.rid, x.rule) for x in got] == [(1, 10, "address")]
    copies = l.unionByName(l.filter("lid = 1").withColumn("lid", F.lit(7))).unionByName(l.filter("lid = 1").withColumn("lid", F.lit(8)))
    assert sorted((x.lid, x.rid) for x in M.match_listings(copies, r, block="c").collect()) == [(1, 10), (7, 10), (8, 10)]


def test_curated_match_tiers(spark):
    places = spark.createDataFrame([(1, "GULL ROCK GRILL", "12", ["12"], "MAIN ST", "naples", "34102"), (2, "HARBOR SUN", "40", ["40"], "OAK AVE", "tampa", "33601"), (3, "BLUE MOON TAVERN", "7", ["7"], "ELM ST", "ocala", "1"), (4, "TWICE", "1", ["1"], "A ST", "x", "1"), (5, "TWICE", "2", ["2"], "B ST", "y", "2")],
                                   "pid int, k string, num string, nums array<string>, street string, town string, zip string")
    cur = spark.createDataFrame([(100, ["GULL ROCK"], "12", ["12"], "MAIN AVE", "naples", None, False), (101, ["HARBORS SUN"], None, [], None, "tampa", None, False), (102, ["BLUE MOON TAVERN"], None, [], None, "elsewhere", None, False), (103, ["BLUE MOON TAVERN"], "900", ["900"], "PINE RD", "ocala", None, False),
                                 (104, ["TWICE"], None, [], None, "z", None, False)], "cid int, names array<string>, num string, nums array<string>, street string, town string, zip string, chain boolean")
    assert sorted((r.cid, r.pid, r.tier) for r in M.curated_match(cur, places).collect()) == [(100, 1, 1), (101, 2, 2), (102, 3, 3)]


def test_snap_rare_spelling(spark):
    rows = [("Kissimmee", "1")] * 6 + [("Hialeah", "2")] * 5 + [("Kissimee", "1"), ("Hialeah, Fl, Us", "2"), ("Hialeahh", "9"), ("Bellview", "9"), ("Somewhere", "9")]
    got = {r.town: r.snapped for r in E.snap_rare_spelling(spark.createDataFrame(rows, "town string, zip string"), value="town", zip="zip").collect()}
    assert got == {"Kissimee": "Kissimmee", "Hialeah, Fl, Us": "Hialeah", "Hialeahh": "Hialeah"}


def test_no_checkpoint_folder_off_local(spark, monkeypatch):
    class Fake:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:                     # noqa: N801
            sparkContext = Fake()

            class conf:                         # noqa: N801
                get = staticmethod(lambda *_: None)
    with pytest.raises(RuntimeError):
        SC.cut_lineage(Frame())


def test_rule_table_of_any_length(spark):
    """Many lists of rules; the least priority wins across lists, copies and nulls keep their rows."""
    from wayfound.operators.classify import apply_rule_table
    rules = spark.range(250).select((250 - F.col("id")).cast("int").alias("priority"), F.concat(F.lit("L"), F.col("id")).alias("label"), F.concat(F.lit("^n"), F.col("id") % 50, F.lit("$")).alias("pattern"))
    df = spark.createDataFrame([(1, "n7"), (2, "n7"), (3, "n49"), (4, "other"), (5, None)], "id int, name string")
    want = {1: "L207", 2: "L207", 3: "L249", 4: None, 5: None}
    assert {r.id: r.label for r in apply_rule_table(df, "name", rules, "label", at_once=20).collect()} == want
    assert {r.label for r in apply_rule_table(df, "name", rules.limit(0), "label").collect()} == {None}
