"""Periods in force, chains, grouping sets, merged facts, the cuisine cascade, quarantine, published files and keyed streams against plain versions."""
import collections
import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from wayfound.operators import classify as K, scale, snapshots as S, stats, timeline as T
from wayfound.sources import readers as R
from wayfound.streaming import keyed, streams as ST

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice("abcdefg")
    spans = []
    for _ in range(300):
        a = rng.randint(0, 200)
        spans.append((key(), DAY(a), None if rng.random() < 0.1 else DAY(a + rng.randint(0, 25)), rng.choice("PQRS")))
    spans += [("a", None, DAY(5), "P"), (None, DAY(1), None, "P"), spans[0]]
    probes = [(i, key(), DAY(rng.randint(-5, 230)), "s") for i in range(900)] + [(1000, None, DAY(3), "s"), (1001, "a", None, "s"), (1002, "zz", DAY(3), "s"), (1002, "zz", DAY(3), "s")]
    return probes, spans


def test_status_is_that_of_the_last_period_begun(spark, records):
    probes, spans = records
    p = spark.createDataFrame(probes, "id long, key string, day date, _value string").repartition(5)
    s = spark.createDataFrame(spans, "key string, start date, end date, status string")
    got = T.status_at(p, s, key="key", time="day")
    assert got.columns == ["id", "key", "day", "_value", "status"]

    def plain(k, d):
        begun = [x for x in spans if k is not None and d is not None and x[0] == k and x[1] is not None and x[1] <= d]
        if not begun:
            return None
        _, _, end, status = max(begun, key=lambda x: (x[1], x[2] is None, x[2] or dt.date.min, x[3]))
        return status if end is None or d < end else None
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((*r, plain(r[1], r[2])) for r in probes)
    assert T.status_at(p, s.limit(0), key="key", time="day").filter("status is not null").count() == 0
    assert T.status_at(p.limit(0), s, key="key", time="day").count() == 0


def test_spans_at_meets_every_period(spark, records):
    probes, spans = records
    p = spark.createDataFrame(probes, "id long, key string, day date, x string")
    s = spark.createDataFrame(spans, "key string, start date, end date, status string")
    got = collections.Counter((r["id"], r["span_start"], r["span_end"], r["status"]) for r in T.spans_at(p, s, key="key", time="day", days=9).collect())
    want = collections.Counter((i, a, b, st) for i, k, d, _ in probes for k2, a, b, st in spans if k is not None and k == k2 and d and a and a <= d and (b is None or d < b))
    assert got == want


def test_carried_spreads_a_hot_key(spark):
    rows = [(i, "k", i if i % 97 == 0 else None) for i in range(1, 4000)]
    df = scale.cut_lineage(spark.createDataFrame(rows, "at int, key string, v int").repartition(4))
    got = {r["at"]: r["last"] for r in scale.carried(df, ["key"], ["at"], "v", "last").collect()}
    assert got == {i: i // 97 * 97 or None for i in range(1, 4000)}
    assert scale.in_ranges(df, ["key", "at"]).select("_range").distinct().count() > 2


def test_chains_and_days_before(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", at(h), h % 2 == 0) for h in (0, 5, 9, 40, 44, 100)] + [("b", at(7), True), ("b", at(7), True)]
    v = spark.createDataFrame(rows, "key string, t timestamp, bad boolean")
    got = {(r["key"], r["first"], r["last"], r["visits"], r["found"]) for r in T.visit_chains(v, key="key", time="t", gap="10 hours", found=F.col("bad")).collect()}
    assert got == {("a", at(0), at(9), 3, 1), ("a", at(40), at(44), 2, 2), ("a", at(100), at(100), 1, 1), ("b", at(7), at(7), 2, 2)}
    days = spark.createDataFrame([("a", DAY(n), n > 5) for n in (0, 0, 3, 6, 370)] + [("a", None, True)], "key string, day date, bad boolean")
    got = {(r["day"], r["n"], r["bad"]) for r in T.counts_before(days, key="key", day="day", counted={"bad": F.col("bad")}).collect()}
    assert got == {(DAY(0), 2, 0), (DAY(3), 3, 0), (DAY(6), 4, 1), (DAY(370), 2, 2)}


def test_total_and_unknown_are_apart(spark):
    d = spark.createDataFrame([("n", None, 1), ("n", "x", 2), (None, "x", 4)], "region string, county string, v int")
    got = {(r["region"], r["county"], r["level"], r["s"]) for r in stats.grouped_report(d, ["region", "county"], {"s": F.sum("v")}).collect()}
    assert got == {("n", "unknown", 0, 1), ("n", "x", 0, 2), ("unknown", "x", 0, 4), ("n", "all", 1, 3), ("unknown", "all", 1, 4), ("all", "unknown", 2, 1), ("all", "x", 2, 6), ("all", "all", 3, 7)}


def test_facts_of_a_hot_key_stay_small(spark):
    rows = [("hot", i, f"v{i:05d}", i % 7) for i in range(5000)] + [("b", 1, None, 3), (None, 2, "x", 1)]
    d = spark.createDataFrame(rows, "k string, id int, v string, w int").repartition(6)
    got = {r["k"]: r for r in stats.merge_facts(d, ["k"], least=["id"], best={"w": ["w", "id"]}, lists={"v": 3}).collect()}
    assert (got["hot"]["id"], got["hot"]["w"], got["hot"]["v"], got["hot"]["v_n"]) == (0, 6, ["v00000", "v00001", "v00002"], 5000)
    assert (got["b"]["v"], got["b"]["v_n"], got[None]["v"], got[None]["v_n"]) == ([], 0, ["x"], 1)
    first = stats.ordered_distinct(d, "k", "id", "v", "vs", 4).filter("k = 'hot'").first()["vs"]
    rest = [r["v"] for r in stats.ordered_rest(d, "k", "id", "v", 4).filter("k = 'hot'").orderBy("place").collect()]
    assert first + rest == [f"v{i:05d}" for i in range(5000)]


def test_cascade_stages_and_overrides(spark):
    cols = "id int, k string, raw string, label string, cats array<string>, kind string, brand string"
    rows = [(1, "RING HOUSE", "x", "cafe", ["Bar"], "bar", None), (2, "HOUSE", "x", "ramen_shop", ["Deli"], "", None), (3, "A PUB", "x", None, ["Deli"], "", None), (4, "HOUSE", "x", None, ["None", "Deli place"], "", None),
            (5, "HOUSE", "Le Café", None, [], "", None), (6, "HOUSE", "Le Café", None, ["None"], "", None), (7, "HOUSE", "Cafés", None, None, "bar", None), (8, "HOUSE", "x", "cafe", ["Deli"], "", None),
            (9, "HOUSE", "x", "cafe", ["Coffee bar"], "", None), (10, "HOUSE", "x", None, [""], "cafe", None), (11, "A RING", "x", None, None, "", "B"), (12, "HOUSE", "x", None, None, "", "B"), (13, "HOUSE", "x", None, None, "", "C"),
            (14, "HOUSE", "x", None, None, "", "D"), (15, "A PUB", "x", "cafe", ["Deli"], "", None)]
    taxonomy = spark.createDataFrame([("ramen_shop", "noodles"), ("noodles", "asian"), ("asian", None), ("loop", "pool"), ("pool", "loop")], "label string, parent string")
    named = spark.createDataFrame([("asian", "Noodles"), ("cafe", "Café")], "label string, cuisine string")
    out = K.cuisine_cascade(spark.createDataFrame(rows, cols), id="id", name_key="k", raw_name="raw", label="label", categories="cats", kind="kind", brand="brand", name_rules=[("Rings", r"\bRING\b"), ("Bar", r"\bPUB\b")],
                            category_rules=[("Bar", "Bar$"), ("Deli", "Deli")], label_cuisine=named, taxonomy=taxonomy, cafe_labels=["cafe"], cafe="Café", cafe_categories="Coffee", kind_cuisine={"bar": "Bar", "cafe": "Café"},
                            chain_cuisine={"C": "Subs"}, weak=["Bar"], other="Other")
    assert {r["id"]: (r["cuisine"], r["stage"]) for r in out.collect()} == {
        1: ("Rings", "name"), 2: ("Noodles", "taxonomy"), 3: ("Bar", "weak name"), 4: ("Deli", "category"), 5: ("Café", "word"), 6: ("Other", "none"), 7: ("Bar", "kind"), 8: ("Deli", "category"),
        9: ("Café", "taxonomy"), 10: ("Café", "kind"), 11: ("Rings", "brand"), 12: ("Rings", "brand"), 13: ("Subs", "brand"), 14: ("Other", "brand"), 15: ("Bar", "name")}
    pairs = {tuple(r) for r in K.label_closure(taxonomy).collect()}
    assert ("ramen_shop", "asian", 2) in pairs and ("asian", "asian", 0) in pairs and ("loop", "loop", 0) in pairs and len([p for p in pairs if p[0] == "loop"]) == 2


def test_every_record_is_on_one_side(spark, tmp_path):
    files = {"a": '[{"id": 1, "name": "x"}, {"id": "no", "name": "y"}, 5, {"id": 3}]', "b": '{"other": 1, "places": [{"id": 4, "name": "z"}]}', "c": '{"restaurants": []}', "d": "[broken", "e": '{"rows": []}', "f": "  \n", "g": '"text"'}
    for n, t in files.items():
        (tmp_path / f"{n}.json").write_text(t)
    items, bad = R.scan_json_quarantine(spark, str(tmp_path), "id bigint, name string", required=["name"])
    name = lambda r: r["file"].rsplit("/", 1)[1][0]
    assert {(name(r), r["row"], r["id"], r["name"]) for r in items.collect()} == {("a", 0, 1, "x"), ("b", 0, 4, "z")}
    assert {(name(r), r["row"], r["reason"]) for r in bad.collect()} == {("a", 1, "a field has another type"), ("a", 2, "not an object"), ("a", 3, "without name"), ("d", None, "not JSON"),
                                                                        ("e", None, "neither list nor wrapped list"), ("f", None, "empty"), ("g", None, "neither list nor wrapped list")}


def published(folder, day="2024-06-30"):
    entries = []
    for name, rows in (("places", [1, 2, 3]), ("detail-a", [4]), ("detail-b", [])):
        body = json.dumps({"generated": day, "rows": rows})
        sha = hashlib.sha256(body.encode()).hexdigest()
        path = f"{name}-{sha[:12]}.json"
        (folder / path).write_text(body)
        entries.append((name, path, sha, len(body), len(rows)))
    old = '{"rows": [9]}'
    old_path = f"places-{hashlib.sha256(old.encode()).hexdigest()[:12]}.json"
    (folder / old_path).write_text(old)
    (folder / "manifest.json").write_text("{}")
    return entries, [("places", old_path)]


def test_published_files_hold_what_the_manifest_says(spark, tmp_path):
    entries, previous = published(tmp_path)
    cols = "name string, path string, sha256 string, bytes long, rows long"

    def problems(head=(1, "2024-06-30.2", "2024-06-30", 1), entries=entries, previous=previous):
        h = spark.createDataFrame([head], "schema int, version string, records_through string, min_build int")
        out = S.verify_published(h, spark.createDataFrame(entries, cols), S.file_digests(spark, str(tmp_path)), spark.createDataFrame(previous, "name string, path string"), schema=1)
        return {(r["file"], r["problem"]) for r in out.collect()}
    assert problems() == set()
    assert problems(head=(2, "2024-06-30.0", "2024-06-30", 0)) == {("manifest", "unknown schema"), ("manifest", "version is not <day>.<n>"), ("manifest", "least build is below 1")}
    assert ("manifest", "records_through is no day") in problems(head=(1, "2024-02-31.1", "2024-02-31", 1))
    p = [e[1] for e in entries]
    tree = {tuple(r) for r in S.digest_tree(S.file_digests(spark, str(tmp_path)).filter("file <> 'manifest.json'")).collect()}
    wrong = [("Bad Name", *entries[1][1:]), (entries[2][0], "detail-b.json", *entries[2][2:]), (entries[0][0], p[0], entries[0][2], 1, 7)]
    assert problems(entries=wrong) == {(p[1], "bad name"), ("detail-b.json", "path does not carry the digest"), (p[0], "bytes differ"), (p[0], "rows differ"), (p[2], "no manifest names it")}
    flipped = (tmp_path / p[1]).read_text().replace("4", "5")
    (tmp_path / p[1]).write_text(flipped)                                  # one changed byte
    (tmp_path / previous[0][1]).write_text('{"rows": [8]}')
    (tmp_path / "stray.json").write_text("{}")
    assert problems(previous=previous + [("detail-a", "detail-a-0123456789ab.json")]) == {
        (p[1], "digest differs"), (previous[0][1], "the previous copy's content is not its name's"), ("detail-a-0123456789ab.json", "the previous copy's file is missing"), ("stray.json", "no manifest names it")}
    (tmp_path / "stray.json").write_text("{")
    after = {tuple(r) for r in S.digest_tree(S.file_digests(spark, str(tmp_path)).filter("file <> 'manifest.json'")).collect()}
    assert {r for r in tree if r[0] == 1} != {r for r in after if r[0] == 1} and len(tree - after) <= 3


def batches(spark, folder, rows, schema, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_keyed_state_over_batches_restarts_and_late_rows(spark, tmp_path):
    keyed.use_keyed_state(spark)
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, None]), f"{rng.randint(0, 999):04d}-{i:04d}", rng.choice(["ok", "ok", "bad"])) for i in range(120)]
    schema = "key long, pos string, kind string"

    def go():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = keyed.latest_state(s, key="key", order=F.col("pos"), ok=F.col("kind") != "bad", field="kind")
        ST.run_to_table(out, str(tmp_path / "table"), str(tmp_path / "check"))
    batches(spark, tmp_path / "in", rows[:60], schema, 2)
    go()
    batches(spark, tmp_path / "in", rows[60:], schema, 1)                   # goes on from the checkpoint; earlier rows are not read again
    go()
    got = {r["key"]: (r["kind"], r["visits"], r["in_era"]) for r in ST.read_latest(spark, str(tmp_path / "table"), ["key"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == k)
        want[k] = (mine[-1][1], len(mine), mine[-1][1] != "bad")
    assert got == want


def test_verdicts_expire_by_the_streams_own_time(spark, tmp_path):
    keyed.use_keyed_state(spark)
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    schema = "url string, ok boolean, v int, at timestamp"

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ST.run_to_table(keyed.expiring_verdicts(s, rules=3, days=10), str(tmp_path / "table"), str(tmp_path / "check"))
        return {r["url"]: (r["ok"], r["state"]) for r in ST.read_latest(spark, str(tmp_path / "table"), ["url"]).collect()}
    assert go([("a", True, 3, at(0)), ("b", True, 3, at(8)), ("c", False, 2, at(8))]) == {"a": (True, "fresh"), "b": (True, "fresh"), "c": (False, "expired")}
    assert go([("d", True, 3, at(12)), ("b", False, 3, at(11))]) == {"a": (True, "expired"), "b": (False, "fresh"), "c": (False, "expired"), "d": (True, "fresh")}
    got = go([("e", True, 3, at(21.5))])
    assert (got["b"], got["d"], got["e"]) == ((False, "expired"), (True, "fresh"), (True, "fresh"))
