"""Page rules on labelled pages, robots cases, blocklists, checks that must be able to fail, snapshots."""
import pytest
from pyspark.sql import functions as F

from wayfound.operators import pages as P, quality as Q, snapshots as S

HOME = "<!doctype html><html><head><title>Lantern Wharf</title></head><body><main>Lantern Wharf, lunch from noon.</main>{}</body></html>"
LINK = '<a href="https://{}.example/">{}</a>'
BAND = LINK.format("village-band", "band")
# per rule: a page that breaks it, and one close to it that breaks no rule at all
PAGES = {
    "spam-text": ("<p>sbobet every night</p>", "<p>The juke box has a coin slot; tables online.</p>"),
    "betting-words": ("<p>Sportsbook upstairs.</p><p>A deposit bonus for you.</p>", "<p>We are next to the sportsbook in Reno.</p>"),
    "injected": ("<p>darmowe spiny dla nowych</p>", "<p>Spin the wheel for a free dessert.</p>"),
    "adult-link": (LINK.format("stripchat-rooms", "rooms"), LINK.format("sextant-charts", "charts")),
    "pharma-link": (LINK.format("buy-pills-now", "shop"), LINK.format("riverside-clinic", "clinic")),
    "lottery-link": (LINK.format("angka4d", "results"), LINK.format("cinema-4dx", "4DX hall")),
    "farm-link-text": (LINK.format("quickwords", "write my paper"), LINK.format("quickwords", "the paper wrote about us")),
    "gambling-link": (LINK.format("melbet-line", "more"), LINK.format("alphabet-books", "more")),
    "foreign-gambling-text": ("<p>오늘의 카지노 순위</p>", "<p>오늘의 점심 메뉴</p>"),
    "keyword-spam": ("<p>最安値 保証</p><p>販売店 一覧</p>", "<p>販売店 一覧</p>"),
    "spam-title": ("<title>Kasyno noc</title>", "<title>Kasha and cream</title>"),
    "hidden-anchor": ('<a style="position:absolute; top:-2400px" href="https://village-band.example/">band</a>', '<a style="position:absolute; top:12px" href="https://village-band.example/">band</a>'),
    "cjk-gambling": ("<p>六合彩 今日</p>", "<p>彩色 今日</p>"),
    "indonesian-gaming": ("<p>spaceman slot malam ini</p>", "<p>Spaceman menu for kids</p>"),
    "lottery-4d": ("<p>toto macau malam</p>", "<p>Toto the dog likes Macau egg tarts</p>"),
    "pharma-text": ("<p>sildenafil here</p><p>tadalafil there</p>", "<p>Our cook once worked at an online pharmacy.</p>"),
    "adult-text": ("<p>nude cams tonight</p><p>sex chat tonight</p>", "<p>A hookup site for camper vans.</p>"),
    "hidden-block": ('<section style="font-size:0px">' + LINK.format("mostbet-mirror", "m") + "</section>", '<ul style="display:none"><li>' + BAND + "</li></ul>"),
    "hidden-noscript": ("<noscript>" + LINK.format("parimatch-x", "p") + "</noscript>", "<noscript>" + BAND + "</noscript>"),
    "offpage-link": ('<p style="left:-5000px">' + BAND + "</p>", '<p style="left:-50px">' + BAND + "</p>")}


def rules_of(spark, pages):
    df = spark.createDataFrame([(k, "https://lanternwharf.example/", HOME.format(h), "Lantern Wharf") for k, h in pages.items()], "page_id string, url string, html string, name string")
    fired = {k: set() for k in pages}
    for r in P.page_spam_reasons(df, name="name").collect():
        fired[r.page_id].add(r.rule)
    return fired


def test_each_rule_fires_and_spares(spark):
    fired = rules_of(spark, {f"{rule}/{i}": h for rule, pair in PAGES.items() for i, h in enumerate(pair)})
    assert set(PAGES) == set(P.RULE_ORDER)
    assert not {rule: fired[f"{rule}/0"] for rule in PAGES if rule not in fired[f"{rule}/0"]}
    assert not {rule: fired[f"{rule}/1"] for rule in PAGES if fired[f"{rule}/1"]}


def test_hidden_blocks_have_no_length_limit(spark):
    """The link stands behind 30,000 characters of nested elements; what follows the block is not part of it."""
    long = '<div style="font-size:0"><div>' + "<div>soup</div>" * 2000 + "</div>" + BAND + LINK.format("second", "b") + LINK.format("third", "c") + "</div>"
    fired = rules_of(spark, {"inside": long, "after": '<div style="font-size:0"><div>' + "<div>soup</div>" * 2000 + "</div></div>" + BAND + LINK.format("second", "b") + LINK.format("third", "c"), "open": long[:-6]})
    assert fired == {"inside": {"hidden-block"}, "after": set(), "open": {"hidden-block"}}
    df = spark.createDataFrame([(1, long), (2, '<P STYLE="width:0">a<p style="height:1px">b</p>c</P>d'), (3, None), (4, "")], "i int, html string")
    got = {r.i: [b.html for b in r.b] for r in df.select("i", P.hidden_blocks(F.coalesce("html", F.lit(""))).alias("b")).collect()}
    assert got[1][0] == long[len('<div style="font-size:0">'):-6] and got[2] == ['a<p style="height:1px">b</p>c', "b"] and got[3] == got[4] == []


def test_real_casinos_are_exempt(spark):
    body = HOME.format('<div style="display:none"><a href="https://wharf-casino.example/">casino online</a></div>')
    df = spark.createDataFrame([("own", "https://www.caesars.com/dining", body, "Steakhouse", False), ("given", "https://lanternwharf.example/", body, "Lantern Wharf", True), ("none", "https://lanternwharf.example/", body, "Lantern Wharf", False)], "page_id string, url string, html string, name string, c boolean")
    assert {r.page_id for r in P.page_spam_reasons(df, name="name", casino=F.col("c")).collect()} == {"none"}


def test_parked(spark):
    rows = [("sale", "<h1>This domain is for sale!</h1>", "https://x.example/"), ("host", "<p>hi</p>", "https://www.sedo.com/x"), ("panel", '<META HTTP-EQUIV="refresh" CONTENT="0;URL=/cgi-sys/defaultwebpage.cgi">', "https://x.example/"),
            ("offer", "<p>Make an offer</p>", "https://x.example/"), ("long", "<p>Make an offer</p>" + "<p>menu item</p>" * 2000, "https://x.example/"), ("clean", HOME.format(""), "https://x.example/"), ("late", "<p>menu item</p>" * 9000 + "domain has expired", "https://x.example/")]
    df = spark.createDataFrame(rows, "id string, html string, final string")
    assert {r.id: r.rule for r in df.select("id", P.parked_rule("html", "final").alias("rule")).collect()} == {"sale": "parked-words", "host": "parking-host", "panel": "hosting-placeholder", "offer": "parked", "long": None, "clean": None, "late": "parked-words"}


OWN_GROUP = "User-agent: harborbot\nDisallow: /private\n\nUser-agent: *\nDisallow: /"
ROBOTS = [("User-agent: *\nDisallow: /kitchen/", "/kitchen/plan", False), ("User-agent: *\nDisallow: /kitchen/", "/kitchen", True), ("User-agent: *\nDisallow: /kitchen\nAllow: /kitchen/tour", "/kitchen/tour/1", True),
          ("User-agent: *\nDisallow: /*/draft$", "/menus/draft", False), ("User-agent: *\nDisallow: /*/draft$", "/menus/draft/2", True), (OWN_GROUP, "/open", True), (OWN_GROUP, "/private/x", False),
          ("User-agent: *\nDisallow: /\n\nUser-agent: somebody\nAllow: /", "/open", False), ("Disallow: /x\nUser-agent: *\nDisallow:", "/x", True), ("# nothing here", "/a", True),
          ("User-agent: one\nUser-agent: HarborBot # both\nDisallow: /both", "/both", False), ("User-agent: *\nAllow: /same\nDisallow: /same", "/same", True)]


def test_robots(spark):
    robots = spark.createDataFrame([(f"h{i}.example", t) for i, (t, _, _) in enumerate(ROBOTS)], "host string, rules string")
    urls = spark.createDataFrame([(i, f"https://h{i}.example{p}", f"h{i}.example") for i, (_, p, _) in enumerate(ROBOTS)] + [(99, "https://none.example/", "none.example")], "i int, url string, host string")
    got = {r.i: r.allowed for r in P.robots_verdict(urls, robots, "HarborBot").collect()}
    assert [got[i] for i in range(len(ROBOTS))] == [w for *_, w in ROBOTS] and got[99] is True


def test_blocklist(spark):
    df = spark.createDataFrame([(1, "https://www.bad.example/x"), (2, "http://shop.bad.example"), (3, "https://notbad.example"), (4, "https://ok.example/page/"), (5, "https://ok.example/page/2"), (6, None)], "id int, w string")
    block = spark.createDataFrame([("domain", "https://bad.example/"), ("url", "http://ok.example/page")], "match string, value string")
    assert {r.id: r.w is not None for r in P.blocklist_filter(df, ["w"], block).collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_checks_can_fail(spark):
    """Every check is silent on good rows and fires on a broken copy."""
    core = spark.createDataFrame([(1, "A", "Gull Rock"), (2, "B", "Harbor Sun")], "id int, shard string, name string")
    assert Q.duplicate_ids(core, "id").isEmpty() and not Q.duplicate_ids(core.union(core.limit(1)), "id").isEmpty()
    assert Q.orphan_details(core, core, "id", "shard").isEmpty()
    assert Q.orphan_details(core.withColumn("shard", F.lit("A")), core, "id", "shard").first().problem == "in the wrong shard"
    assert Q.guards(core, Q.name_guards(), id="id").isEmpty() and Q.guards(core.withColumn("name", F.concat("name", F.lit(" LLC"))), Q.name_guards(), id="id").count() == 2
    assert Q.forbidden_columns(core, ["rating"]) == [] and Q.forbidden_columns(core.withColumn("rating", F.lit(1)), ["rating"]) == ["rating"]
    num = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert Q.non_finite(num.limit(1), ["x"]).isEmpty() and Q.non_finite(num, ["x"]).first().n == 2
    texts = spark.createDataFrame([(1, "Try the Gull Rock tonight"), (2, "Gull by the rock")], "t int, body string")
    assert [r.t for r in Q.bad_names_in_text(texts, core, text_id="t", body="body").collect()] == [1]
    n = core.groupBy("shard").count().withColumnRenamed("count", "n")
    assert Q.expected_hits(n, n, key="shard").isEmpty() and Q.expected_hits(n, n.filter("shard='A'"), key="shard").count() == 1
    assert Q.list_membership(core.select("id"), core, id="id", tag_ok=F.lit(True)).isEmpty()


def test_snapshots(spark):
    base = spark.createDataFrame([(i, f"s{i % 3}", f"text {i}", "d1") for i in range(30)], "id int, shard string, body string, day string")
    m = lambda df: S.manifest(df, shard="shard", columns=["id", "body", "day"], dated=["day"])
    old = m(base)
    assert {r.status for r in S.diff(old, m(base.repartition(3))).collect()} == {"unchanged"} and S.verify(old, m(base)).isEmpty()
    new = base.withColumn("day", F.when(F.col("shard") == "s1", "d2").otherwise(F.col("day"))).withColumn("body", F.when(F.col("id") == 2, "changed").otherwise(F.col("body"))).filter("shard <> 's0'").union(base.filter("id = 0").withColumn("shard", F.lit("s9")))
    assert {r.shard: r.status for r in S.diff(old, m(new)).collect()} == {"s0": "removed", "s1": "date only", "s2": "changed", "s9": "added"}
    assert {(r.shard, r.problem) for r in S.verify(old, m(new)).collect()} >= {("s0", "missing"), ("s9", "not in the manifest"), ("s1", "hash differs"), ("s2", "bytes differ")}
    assert {r.shard for r in S.swing_guard(old, m(new)).collect()} == {"s0", "s9"} and S.swing_guard(old, old).isEmpty()
    v = lambda *xs: S.next_version(spark.createDataFrame([(x,) for x in xs], "version string"), "2026-02-01").first().version
    assert (v("2026-01-31.4"), v("2026-02-01.1", "2026-02-01.2"), v("2026-02-02.1")) == ("2026-02-01.1", "2026-02-01.3", None)
    builds = [S.build_version(x).first().build for x in (old, m(base.orderBy(F.desc("id"))), m(new))]
    assert builds[0] == builds[1] != builds[2] and len(builds[0]) == 12


@pytest.mark.parametrize("body,want", [("<p>Naples, Florida</p>", "town"), ("<p>FL 34102</p>", "zip"), ("<p>(239) 555-0100</p>", "phone"), ("<p>12 N Main Street</p>", "street"), ("<p>nothing</p>", None)])
def test_locates(spark, body, want):
    arr = lambda v: F.array(F.lit(v))
    got = spark.createDataFrame([(body, "https://gullrock.example/")], "html string, final string").select(
        P.page_locates("html", "final", towns=arr("Naples"), zips=arr("34102"), phones=arr("239-555-0100"), streets=arr("12 Main St")).alias("w")).first().w
    assert got == want
