"""One-to-one assignment by parts that hang together, and pairs of agreeing names."""
import random

from wayfound.operators import matching as M


def test_one_to_one_parts_and_rounds_agree(spark, monkeypatch):
    """Edges that hang together are walked through by one task, larger parts go in rounds; both take the same, also with many places at each end."""
    rng = random.Random(8)
    edges = [(a, b, float(rng.randint(1, 9))) for a in range(40) for b in range(40) if a // 8 == b // 8 and rng.random() < 0.5]
    nl, nr = [rng.randint(1, 3) for _ in range(40)], [rng.randint(1, 3) for _ in range(40)]
    df = spark.createDataFrame([(a, b, s, nl[a], nr[b]) for a, b, s in edges] + [(None, 1, 5.0, 1, 1)], "lid long, rid long, score double, nl long, nr long").repartition(3)
    used_l, used_r, want = [0] * 40, [0] * 40, []
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        k = min(nl[a] - used_l[a], nr[b] - used_r[b])
        if k:
            want.append((a, b, s, used_l[a], used_r[b], k))
            used_l[a], used_r[b] = used_l[a] + k, used_r[b] + k
    for part in (1 << 20, 30):
        monkeypatch.setattr(M, "PART", part)
        assert sorted(tuple(x[c] for c in ("lid", "rid", "score", "l0", "r0", "k")) for x in M._assign(df).collect()) == sorted(want)


def test_near_named_pairs_equal_all_pairs_and_never_meet_other_names(spark, monkeypatch):
    rng = random.Random(2)
    names = ["OLD RING", "COLD RING", "BLUE ROD", "RED GEAR", None]
    rows = lambda n, first: spark.createDataFrame([(first + i, rng.choice(names), 26.0 + rng.randint(0, 30) * 4e-4, -80.0 + rng.randint(0, 5) * 4e-4) for i in range(n)], "id long, name string, lat double, lon double")
    l, r = rows(60, 0), rows(60, 100)
    want = M.proximity_join(l, r, radius_m=200.0).filter(M.sim_token_set("l_name", "r_name") >= 75)
    seen, plain = [], M.proximity_join
    monkeypatch.setattr(M, "proximity_join", lambda *a, **k: (seen.append(k["block"]), plain(*a, **k))[1])
    got = M.near_named(l, r, M.sim_token_set, radius_m=200.0, min_score=75.0)
    assert sorted((x["l_id"], x["r_id"]) for x in got.collect()) == sorted((x["l_id"], x["r_id"]) for x in want.collect()) and seen == [["rn"]]
