"""Page and link quality over a table of crawled pages. All rules are row-local expressions over the whole page: one pass, no shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import page_rules as P
from ..functions._col import col, let, one_of, text, words
from ..functions.text import search_normalize
from ..functions.urls import registrable_domain, url_host, url_key
from ..functions.vocab import CC_SECOND_LEVEL
from .scale import keep_first

_LINK = r"""(?is)<a\b[^>]*\bhref=["'](https?://[^"']+)["'][^>]*>(.*?)</a>"""
_MAY_HIDE = "div|span|p|section|ul|ol|li|font|aside|marquee|small"          # elements whose inline style is looked at
_MARK = rf"(?is)(.*?)(</?(?:{_MAY_HIDE})\b[^>]*>|\z)"
_STYLE = r"""(?is)\bstyle\s*=\s*(["'])(.*?)\1"""
_NOSCRIPT = r"(?is)<noscript\b[^>]*>(.*?)</noscript>"
_TITLE, _DESCRIPTION = r"(?s)<title[^>]*>(.*?)</title>", r"(?s)<meta[^>]+name=.description.[^>]+content=\"([^\"]*)"
_STYLED_LINK = r"""(?is)<a\b([^>]*\bhref=["']https?://[^"']+["'][^>]*)>"""


def domain_of(url) -> Column:
    return registrable_domain(url_host(url), CC_SECOND_LEVEL)


def page_links(html, own: Column) -> Column:
    """array<struct<href, text, host, domain, away>> of the absolute links; ``own`` is the array of the site's own domains."""
    h, t = F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(_LINK), F.lit(2))
    parts = F.transform(F.arrays_zip(h.alias("href"), t.alias("text")), lambda x: F.struct(
        x["href"].alias("href"), F.regexp_replace(x["text"], "<[^>]+>", " ").alias("text"), url_host(x["href"]).alias("host")))
    named = F.transform(parts, lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"), x["host"].alias("host"),
                                                  F.coalesce(registrable_domain(x["host"], CC_SECOND_LEVEL), F.lit("")).alias("domain")))
    return F.transform(named, lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"), x["host"].alias("host"), x["domain"].alias("domain"),
                                                 (~F.array_contains(own, x["domain"])).alias("away")))


def _judged(links) -> Column:
    """Links away with what their host and text say, each tested once."""
    flags = {"exempt": ("host", (P.CASINO_HOSTS_OK, P.REAL_CASINO_PLACE)), "bet_host": ("host", (P.GAMBLING_HOST,)), "bet_text": ("text", (P.BETTING,)), "casino_word": ("text", (P.FOREIGN_CASINO,)),
             "casino_link": ("text", (P.FOREIGN_CASINO_LINK,)), "adult_host": ("host", (P.ADULT_HOST,)), "adult_text": ("text", (P.ADULT_TEXT,)), "pharma_host": ("host", (P.PHARMA_HOST,)),
             "pharma_text": ("text", (P.PHARMA_TEXT,)), "farm": ("text", (P.FARM_TEXT,)), "lot_host": ("host", (P.HOST_4D,)), "lot_text": ("text", (P.CJK_GAMBLING, P.INDO_GAMING)), "benign": ("host", (P.BENIGN_HOST,))}

    def judge(l):
        test = lambda field, rxs: F.greatest(*[l[field].rlike(rx) for rx in rxs]) if len(rxs) > 1 else l[field].rlike(rxs[0])
        said = F.concat(l["href"], F.lit(" :: "), F.trim(F.regexp_replace(l["text"], r"\s+", " ")))
        return F.struct(l["href"].alias("href"), l["domain"].alias("domain"), said.alias("said"), *[test(f, rxs).alias(n) for n, (f, rxs) in flags.items()])
    return F.transform(F.filter(links, lambda l: l["away"]), judge)


def extract_links(pages: DataFrame, *, id="page_id", url="url", html="html") -> DataFrame:
    """(page_id, href, text, host, away): every absolute link of every page."""
    d = pages.select(id, F.explode(page_links(F.col(html), F.array(F.coalesce(domain_of(url), F.lit(""))))).alias("l"))
    return d.select(id, "l.*")


def page_text(html) -> Column:
    """Whole page in lower case without long encoded blobs."""
    return F.lower(F.regexp_replace(text(html), P.BLOBS, " "))


def _visible_of(t) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"(?s)<script\b.*?</script>|<style\b.*?</style>", " "), "<[^>]+>", " ")


def visible_text(html) -> Column:
    """Lower-case text without scripts, styles and tags."""
    return _visible_of(page_text(html))


def _head_of(t) -> Column:
    return F.concat_ws(" ", F.regexp_extract_all(t, F.lit(_TITLE), F.lit(1)), F.regexp_extract_all(t, F.lit(_DESCRIPTION), F.lit(1)))


def page_head(html) -> Column:
    """Titles and descriptions in lower case."""
    return _head_of(page_text(html))


def _marks(html) -> Column:
    """The page cut at its open and close marks: array<struct<p, m, tag, d, style>>, p the html before mark m, d the depth it adds to its tag."""
    cut = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(_MARK), F.lit(n)).alias(c) for n, c in ((1, "p"), (2, "m"))])
    depth = lambda m: F.when(F.startswith(m, F.lit("</")), -1).when((m == "") | F.endswith(m, F.lit("/>")), 0).otherwise(1)
    return F.transform(cut, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), F.lower(F.regexp_extract(x["m"], "^</?([A-Za-z]+)", 1)).alias("tag"), depth(x["m"]).alias("d"),
                                               F.regexp_extract(x["m"], _STYLE, 2).alias("style")))


def _element_body(marks, i) -> Column:
    """Inner html of the element that mark ``i`` opens, nesting of the same tag respected; an element left open reaches the end of the page."""
    def step(acc, x):
        return F.when(acc["depth"] == 0, acc).otherwise(F.struct((acc["depth"] + F.when(x["tag"] == marks[i]["tag"], x["d"]).otherwise(0)).alias("depth"), (acc["n"] + 1).alias("n")))

    def joined(rest):
        walked = F.aggregate(rest, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)
        return let(walked, lambda w: F.concat(F.array_join(F.transform(F.slice(rest, F.lit(1), F.greatest(w["n"] - 1, F.lit(0))), lambda x: F.concat(x["p"], x["m"])), ""),
                                              F.coalesce(F.get(rest, w["n"] - 1)["p"], F.lit("")), F.when(w["depth"] == 0, F.lit("")).otherwise(F.coalesce(F.get(rest, w["n"] - 1)["m"], F.lit("")))))
    return let(F.slice(marks, i + 2, F.size(marks)), joined)


def hidden_blocks(html) -> Column:
    """array<struct<kind, html>>: inline-hidden elements ('style:...' off-page, 'ui:...' menus and the like) and noscript blocks."""
    hides = lambda style: style.rlike(P.HIDE_STYLE) | style.rlike(P.UI_HIDE)
    block = lambda marks, i: let(marks[i]["style"], lambda style: F.struct(
        F.concat(F.when(style.rlike(P.HIDE_STYLE), F.lit("style:")).otherwise(F.lit("ui:")), F.trim(F.regexp_replace(style, r"\s+", " "))).alias("kind"), _element_body(marks, i).alias("html")))
    opens = lambda marks: F.filter(F.sequence(F.lit(0), F.size(marks) - 1), lambda i: ~F.startswith(marks[i]["m"], F.lit("</")) & hides(marks[i]["style"]))
    quiet = F.transform(F.regexp_extract_all(html, F.lit(_NOSCRIPT), F.lit(1)), lambda b: F.struct(F.lit("noscript").alias("kind"), b.alias("html")))
    # only pages with a hiding style are cut at their marks
    any_ = F.exists(F.regexp_extract_all(html, F.lit(_STYLE), F.lit(2)), hides)
    styled = F.when(any_, let(_marks(html), lambda marks: F.transform(opens(marks), lambda i: block(marks, i))))
    return F.concat(F.coalesce(styled, F.array().cast("array<struct<kind:string,html:string>>")), quiet)


def hidden_block_rows(pages: DataFrame, *, id="page_id", url="url", html="html") -> DataFrame:
    """(page_id, kind, links): hidden blocks with the links inside that lead away."""
    own = F.array(F.coalesce(domain_of(url), F.lit("")))
    d = pages.select(id, own.alias("own"), F.explode(hidden_blocks(F.col(html))).alias("b"))
    return d.select(id, "b.kind", F.transform(F.filter(page_links(F.col("b.html"), F.col("own")), lambda l: l["away"]), lambda l: l["href"]).alias("links"))


def _low(pattern: str) -> str:
    """The pattern for text that is lower case already (much cheaper than ignoring case)."""
    return pattern[4:] if pattern.startswith("(?i)") else pattern


def _around(hay, hit, width=150) -> Column:
    """The hit with some text on both sides; null without a hit."""
    return F.trim(F.regexp_replace(F.substring(hay, F.greatest(F.call_function("locate", hit, hay) - width, F.lit(1)), F.length(hit) + 2 * width), r"\s+", " "))


def _rule(name, fires, evidence) -> Column:
    return F.when(F.coalesce(fires, F.lit(False)), F.struct(F.lit(name).alias("rule"), evidence.alias("evidence")))


RULE_ORDER = ("spam-text", "betting-words", "injected", "adult-link", "pharma-link", "lottery-link", "farm-link-text", "gambling-link", "foreign-gambling-text", "keyword-spam", "spam-title",
              "hidden-anchor", "cjk-gambling", "indonesian-gaming", "lottery-4d", "pharma-text", "adult-text", "hidden-block", "hidden-noscript", "offpage-link")


def page_spam_reasons(pages: DataFrame, *, id="page_id", url="url", html="html", final: str | None = None, name: str | None = None, casino: Column | None = None) -> DataFrame:
    """(page_id, rule, evidence): every rule a page breaks, one row per rule with its first evidence. A clean page has no row."""
    p = pages.select(F.col(id), F.col(url).alias("u"), F.coalesce(F.col(final or url), F.col(url)).alias("f"), text(html).alias("html"), (text(name) if name else F.lit("")).alias("name"),
                     (casino if casino is not None else F.lit(False)).alias("given"))
    p = p.withColumn("own", F.array(F.coalesce(domain_of("u"), F.lit("")), F.coalesce(domain_of("f"), F.lit("")))).withColumn("t", page_text("html")).withColumn("h", url_host("u"))
    p = p.withColumn("head", _head_of(F.col("t"))).withColumn("vis", _visible_of(F.col("t"))).withColumn("links", _judged(page_links(F.col("html"), F.col("own"))))
    p = p.withColumn("ok", ~(F.coalesce(F.col("given"), F.lit(False)) | F.col("name").rlike(P.CASINO_PLACE) | F.col("h").rlike(P.CASINO_HOSTS_OK) | F.col("h").rlike(P.REAL_CASINO_PLACE)))
    t, head, vis, ok = F.col("t"), F.col("head"), F.col("vis"), F.col("ok")
    # hidden blocks with links away, each judged once
    p = p.withColumn("blocks", F.filter(F.transform(hidden_blocks(F.col("html")), lambda b: F.struct(b["kind"].alias("kind"), _judged(page_links(b["html"], F.col("own"))).alias("links"))), lambda b: F.size(b["links"]) > 0))
    spammy = lambda l: (((l["bet_host"] | l["bet_text"]) & ok) | ((l["adult_host"] | l["pharma_host"] | l["casino_link"] | l["adult_text"] | l["pharma_text"] | l["farm"]) & (ok | ~(l["bet_host"] | l["bet_text"]))))

    def weigh(b):
        open_ui = F.startswith(b["kind"], F.lit("ui:")) | (b["kind"] == "noscript")
        odd = F.filter(b["links"], lambda l: ~l["benign"])
        farm = (F.size(F.array_distinct(F.transform(odd, lambda l: l["domain"]))) >= 3) & ~open_ui
        told = F.concat(F.lit("["), b["kind"], F.lit("] "), F.array_join(F.transform(b["links"], lambda l: l["said"]), "; "))
        return F.struct(b["kind"].alias("kind"), told.alias("told"), (F.exists(b["links"], spammy) | farm).alias("bad"), ((F.size(odd) > 0) & ~open_ui & b["kind"].rlike(P.OFFSCREEN_FAR)).alias("far"))
    p = p.withColumn("blocks", F.transform("blocks", weigh))
    # links that are themselves hidden off the page
    styled = F.transform(F.regexp_extract_all("html", F.lit(_STYLED_LINK), F.lit(1)), lambda a: F.struct(
        F.regexp_extract(a, r"""(?is)\bstyle\s*=\s*(["'])(.*?)\1""", 2).alias("style"), F.regexp_extract(a, r"""(?i)\bhref=["'](https?://[^"']+)["']""", 1).alias("href")))
    p = p.withColumn("anchors", F.filter(styled, lambda a: a["style"].rlike(P.OFFSCREEN_POS) & ~F.array_contains(F.col("own"), F.coalesce(domain_of(a["href"]), F.lit(""))) & ~url_host(a["href"]).rlike(P.BENIGN_HOST)))
    firsts = {"adult-link": (None, lambda l: l["adult_host"] | l["adult_text"]), "pharma-link": (None, lambda l: l["pharma_host"] | l["pharma_text"]), "lottery-link": (ok, lambda l: l["lot_host"] | l["lot_text"]),
              "farm-link-text": (None, lambda l: l["farm"] & ~l["benign"]), "gambling-link": (ok, lambda l: ~l["exempt"] & (l["bet_host"] | l["bet_text"] | l["casino_link"])),
              "injected": (ok, lambda l: ~l["exempt"] & (l["bet_host"] | l["bet_text"] | l["casino_word"]))}
    p = p.withColumn("first", F.struct(*[F.get(F.filter("links", cond), 0)["said"].alias(n) for n, (_, cond) in firsts.items()],
                                       *[F.get(F.filter("blocks", cond), 0)["told"].alias(n) for n, cond in {"hidden-block": lambda b: b["bad"] & (b["kind"] != "noscript"), "hidden-noscript": lambda b: b["bad"] & (b["kind"] == "noscript"),
                                                                                                        "offpage-link": lambda b: ~b["bad"] & b["far"]}.items()]))
    # words of the page, each pattern tried once
    hits = {"spam": (t, P.SPAM), "foreign": (t, P.FOREIGN_CASINO), "betting": (t, P.BETTING), "ext": (vis, P.FOREIGN_EXT), "jp": (vis, P.JP_SPAM), "cjk": (vis, P.CJK_GAMBLING), "indo": (vis, P.INDO_GAMING),
            "lot": (vis, P.LOTTERY_4D), "pharma": (vis, P.PHARMA_TEXT), "adult": (vis, P.ADULT_TEXT)}
    p = p.withColumn("hit", F.struct(*[F.regexp_substr(hay, F.lit(_low(rx))).alias(n) for n, (hay, rx) in hits.items()]))
    p = p.withColumn("head_hit", F.struct(*[head.rlike(_low(rx)).alias(n) for n, rx in {"spam": P.SPAM, "betting": P.BETTING, "prose": P.BETTING_PROSE, "foreign": P.FOREIGN_CASINO, "ext": P.FOREIGN_EXT, "cjk": P.CJK_GAMBLING,
                                                                                        "pharma": P.PHARMA_TEXT, "jp": P.JP_SPAM, "indo": P.INDO_GAMING, "lot": P.LOTTERY_4D}.items()]))
    hit, hh, first = (lambda n: F.col("hit." + n)), (lambda n: F.col("head_hit." + n)), (lambda n: F.col("first.`" + n + "`"))
    ctx = lambda hay, n: _around(hay, hit(n))
    title = head
    twice = lambda n, hay, rx: hit(n).isNotNull() & (F.regexp_count(hay, F.lit(_low(rx))) >= 2)
    link_rule = lambda n: _rule(n, first(n).isNotNull() if firsts[n][0] is None else firsts[n][0] & first(n).isNotNull(), first(n))
    block_rule = lambda n: _rule(n, first(n).isNotNull(), first(n))
    rules = {
        "spam-text": _rule("spam-text", hit("spam").isNotNull() | F.col("f").rlike(P.SPAM), F.coalesce(ctx(t, "spam"), F.col("f"))),
        "betting-words": _rule("betting-words", ok & (hh("betting") | (hit("betting").isNotNull() & (F.regexp_count(t, F.lit(_low(P.BETTING_PROSE))) >= 2))), F.coalesce(ctx(t, "betting"), title)),
        "injected": _rule("injected", ok & (first("injected").isNotNull() | hit("foreign").isNotNull()), F.coalesce(first("injected"), ctx(t, "foreign"))),
        "adult-link": link_rule("adult-link"), "pharma-link": link_rule("pharma-link"), "lottery-link": link_rule("lottery-link"), "farm-link-text": link_rule("farm-link-text"), "gambling-link": link_rule("gambling-link"),
        "foreign-gambling-text": _rule("foreign-gambling-text", ok & hit("ext").isNotNull(), ctx(vis, "ext")),
        "keyword-spam": _rule("keyword-spam", twice("jp", vis, P.JP_SPAM), ctx(vis, "jp")),
        "spam-title": _rule("spam-title", ok & F.greatest(*[hh(n) for n in ("spam", "prose", "foreign", "ext", "cjk", "pharma", "jp")]), title),
        "hidden-anchor": _rule("hidden-anchor", F.size("anchors") > 0, F.concat(F.lit("["), F.get("anchors", 0)["style"], F.lit("] "), F.get("anchors", 0)["href"])),
        "cjk-gambling": _rule("cjk-gambling", ok & (hh("cjk") | hit("cjk").isNotNull()), F.coalesce(ctx(vis, "cjk"), title)),
        "indonesian-gaming": _rule("indonesian-gaming", ok & (hh("indo") | hit("indo").isNotNull()), F.coalesce(ctx(vis, "indo"), title)),
        "lottery-4d": _rule("lottery-4d", ok & (hh("lot") | hit("lot").isNotNull()), F.coalesce(ctx(vis, "lot"), title)),
        "pharma-text": _rule("pharma-text", twice("pharma", vis, P.PHARMA_TEXT), ctx(vis, "pharma")), "adult-text": _rule("adult-text", twice("adult", vis, P.ADULT_TEXT), ctx(vis, "adult")),
        "hidden-block": block_rule("hidden-block"), "hidden-noscript": block_rule("hidden-noscript"), "offpage-link": block_rule("offpage-link")}
    return p.select(id, F.explode(F.array_compact(F.array(*[rules[n] for n in RULE_ORDER]))).alias("r")).select(id, "r.rule", "r.evidence")


def obfuscated_script(html) -> Column:
    """A script that evaluates decoded text (a flag only; its payload is not decoded)."""
    return text(html).rlike(P.OBFUSCATED)


def parked_rule(html, final, short: int = 8000) -> Column:
    """Name of the rule when the page is parked, for sale, expired, a default server page or a builder's 'not found'; else null. Weak words count only on
    pages with less visible text than ``short`` characters: a full page may say them in passing."""
    t = page_text(html)
    vis = F.regexp_replace(_visible_of(t), r"\s+", " ")
    return F.when(url_host(final).rlike(P.PARKING_HOSTS), "parking-host").when(t.rlike(P.HOSTING_PLACEHOLDER), "hosting-placeholder") \
        .when(t.rlike(_low(P.PARKED)), "parked-words").when((F.length(vis) < short) & vis.rlike(_low(P.PARKED_EXTRA)), "parked")


def page_norm(c) -> Column:
    """Letters and digits only, accents folded, single spaces."""
    return F.trim(F.regexp_replace(F.translate(search_normalize(c), "ßøđł", "sodl"), "[^a-z0-9]+", " "))


def distinctive_words(name) -> Column:
    return F.filter(words(page_norm(name)), lambda w: (F.length(w) >= 4) & ~one_of(w, P.PAGE_GENERIC))


def _site_name(final) -> Column:
    return F.regexp_replace(F.regexp_replace(url_host(final), r"\.[^.]*$", ""), "[^a-z0-9]", "")


def page_mentions(name, html, final, letters: int = 12) -> Column:
    """A distinctive word of the name on the page or in the domain; of a name without one, the domain must spell the first ``letters`` letters."""
    page = F.concat(F.lit(" "), page_norm(F.regexp_replace(text(html), r"(?is)<script.*?</script>|<style.*?</style>", " ")), F.lit(" "), page_norm(final), F.lit(" "))
    rest = F.filter(words(page_norm(name)), lambda w: ~w.isin("the", "and", "of", "a"))
    by_word = lambda ws: let(F.struct(page.alias("p"), _site_name(final).alias("d")), lambda x: F.exists(ws, lambda w: x["p"].contains(F.concat(F.lit(" "), w, F.lit(" "))) | x["d"].contains(w)))
    return let(distinctive_words(name), lambda ws: F.when(F.size(ws) > 0, by_word(ws)).otherwise((F.size(rest) > 0) & _site_name(final).contains(F.substring(F.array_join(rest, ""), 1, letters))))


def page_locates(html, final, *, towns, zips, phones, streets, common_towns=()) -> Column:
    """Which of town, zip, phone or street the page shows for the place; null when none."""
    hay = F.concat(F.lit(" "), page_norm(F.regexp_replace(text(html), P.BLOBS, " ")), F.lit(" "), page_norm(final), F.lit(" "))
    has = lambda h, v: h.contains(F.concat(F.lit(" "), v, F.lit(" ")))
    empty = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(col(c), empty)
    digits = lambda h: F.transform(F.regexp_extract_all(h, F.lit(r"(\d{3} ?\d{3} ?\d{4})"), F.lit(1)), lambda m: F.replace(m, F.lit(" "), F.lit("")))
    town_ok = lambda v: (F.length(v) >= 4) & (~v.isin(*common_towns) if common_towns else F.lit(True))

    def street_hit(h, s):
        n, core = F.regexp_extract(s, r"^(\d+) ", 1), F.get(F.filter(F.slice(F.split(s, " "), F.lit(2), F.size(F.split(s, " "))), lambda w: (F.length(w) >= 3) & ~one_of(w, P.STREET_WORDS)), 0)
        return (n != "") & core.isNotNull() & F.call_function("rlike", h, F.concat(F.lit(r"\b"), n, F.lit(r"\s+(?:\w+\s+){0,2}"), core, F.lit(r"\b")))
    return let(hay, lambda h: F.when(F.exists(F.transform(arr(towns), page_norm), lambda v: town_ok(v) & has(h, v)), "town")
               .when(F.exists(arr(zips), lambda z: has(h, F.substring(z, 1, 5))), "zip")
               .when(F.exists(arr(phones), lambda ph: let(F.right(F.regexp_replace(ph, r"\D", ""), F.lit(10)), lambda d: (F.length(d) == 10) & F.array_contains(digits(h), d))), "phone")
               .when(F.exists(F.transform(arr(streets), page_norm), lambda s: F.coalesce(street_hit(h, s), F.lit(False))), "street"))


def listed_host(url, hosts) -> Column:
    """Does the url fall under an entry: a domain (with subdomains), a 'label.' prefix, a host/path, or a bare query word?"""
    host, path = url_host(url), F.regexp_extract(F.lower(text(url)), r"^(?:[a-z]+://)?[^/?#]*/?([^?#]*)", 1)
    out = F.lit(False)
    for h in hosts:
        if "/" in h:
            hb, _, pb = h.partition("/")
            out = out | (((host == hb) | F.endswith(host, F.lit("." + hb))) & F.startswith(path, F.lit(pb)))
        elif h.endswith("."):
            out = out | F.startswith(host, F.lit(h)) | host.contains("." + h)
        elif "." in h:
            out = out | (host == h) | F.endswith(host, F.lit("." + h))
        else:
            out = out | F.lower(text(url)).contains(h)
    return out


def link_verdict(pages: DataFrame, spam: DataFrame, *, id="page_id", directories=(), news=(), aliases: dict | None = None, common_towns=()) -> DataFrame:
    """(page_id, ok, why, ship, where_): ordered verdict of a crawled link. Pages carry (page_id, url, final, status, error, html, name, towns, zips,
    phones, streets); ``spam`` is the result of :func:`page_spam_reasons` for the same pages."""
    first = keep_first(spam, [id], [F.array_position(F.array(*[F.lit(r) for r in RULE_ORDER]), F.col("rule")).asc()]).select(F.col(id).alias("_s"), F.col("rule").alias("spam_rule"))
    p = pages.join(first, F.col(id) == F.col("_s"), "left")
    url_d, fin_d = domain_of("url"), domain_of("final")
    is_news = lambda c: (domain_of(c).isin(*news) if news else F.lit(False)) | F.regexp_replace(F.col(c), r"^(?:[a-z]+://)?[^/?#]*", "").rlike(P.ARTICLE)
    # every refresh of the page counts, wherever it stands
    hops = F.concat(*[F.regexp_extract_all(text("html"), F.lit(P.REFRESH), F.lit(n)) for n in (1, 2, 3)])
    leaves = F.exists(hops, lambda to: to.rlike("(?i)^http") & ~F.coalesce(domain_of(to).isin(url_d, fin_d), F.lit(False)))
    alias = F.try_element_at(F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv]), url_d)
    same = (fin_d == url_d) | F.coalesce(fin_d == alias, F.lit(False))
    in_domain = F.exists(distinctive_words("name"), lambda w: _site_name(F.col("final")).contains(w))
    where = page_locates("html", "final", towns="towns", zips="zips", phones="phones", streets="streets", common_towns=common_towns)
    p = p.withColumn("where_", where)
    why = F.when(listed_host("url", directories), "directory or map link").when(is_news("url"), "news story or article").when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")) \
        .when((F.col("status") < 200) | (F.col("status") >= 300), F.concat(F.lit("http "), F.col("status").cast("string"))) \
        .when(F.col("spam_rule").isin("spam-text", "betting-words"), "gambling or adult content").when(F.col("spam_rule").isNotNull(), F.concat(F.lit("hacked: "), "spam_rule")) \
        .when(parked_rule("html", "final").isNotNull(), "parked, expired or coming soon").when(listed_host("final", directories), "redirects to a directory") \
        .when(is_news("final"), "news story or article").when(F.coalesce(leaves, F.lit(False)), "redirects to another site").when(~page_mentions("name", "html", "final"), "page doesn't mention the place") \
        .when(~same & ~in_domain, "moved to another domain").when(F.col("where_").isNull(), "page doesn't show the place's town, address or phone").otherwise("ok")
    upgrade = F.col("final").startswith("https://") & ~F.col("url").startswith("https://") & (fin_d == url_d)
    ship = F.when(upgrade, F.concat(F.lit("https://"), F.regexp_replace("url", "^(?:https?://)?", ""))).otherwise(F.col("url"))
    v = p.select(id, why.alias("why"), ship.alias("ship"), "where_")
    return v.select(id, (F.col("why") == "ok").alias("ok"), "why", F.when(F.col("why") == "ok", F.col("ship")).alias("ship"), F.when(F.col("why") == "ok", F.col("where_")).alias("where_"))


def verdict_cache_refresh(cached: DataFrame, links: DataFrame, *, rules: int, today: str, max_age=45, recheck=r"^(?:chain domain|brand's own|hacked|moved to another domain$|gambling or adult content$)",
                          now_listed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts still trusted, links to check): same rules version, young enough, not of a kind that is always checked again. Host rules
    apply to kept verdicts at once."""
    age = F.datediff(F.lit(today).cast("date"), F.col("at"))
    keep = cached.filter((F.col("v") == rules) & (age <= max_age) & ~F.coalesce(F.col("why").rlike(recheck), F.lit(False)))
    if now_listed is not None:
        hit = F.col("ok") & now_listed
        keep = keep.withColumn("why", F.when(hit, "redirects to a directory").otherwise(F.col("why"))).withColumn("ok", F.col("ok") & ~now_listed)
    return keep, links.join(keep.select("url"), "url", "left_anti")


def drop_reason_counts(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Links not shipped, by reason; unchecked ones wait under their own reason."""
    j = links.join(verdicts.select(F.col("url").alias("_u"), "ok", "why"), F.col("url") == F.col("_u"), "left")
    return j.filter(~F.coalesce("ok", F.lit(False))).groupBy(F.coalesce("why", F.lit("not checked yet")).alias("why")).agg(F.count("*").alias("n"))


def host_suffixes(url) -> Column:
    """The host and every parent domain of it."""
    parts = F.split(url_host(url), r"\.")
    n = F.size(parts)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array(url_host(url)))


def blocked_links(df: DataFrame, url: str, blocklist: DataFrame) -> DataFrame:
    """(url): distinct links covered by the blocklist (domain entries with their subdomains, url entries exactly). ``blocklist``: match, value."""
    u = df.filter(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct()
    dom = blocklist.filter(F.col("match") == "domain").select(F.regexp_replace(F.regexp_replace(F.lower("value"), r"^[a-z]+://", ""), r"^www\.|/.*$", "").alias("d")).distinct()
    page = blocklist.filter(F.col("match") == "url").select(url_key(F.regexp_replace("value", r"[?#].*$", "")).alias("k")).distinct()
    a = u.withColumn("d", F.explode(host_suffixes("url"))).join(dom, "d", "left_semi").select("url")
    b = u.withColumn("k", url_key(F.regexp_replace("url", r"[?#].*$", ""))).join(page, "k", "left_semi").select("url")
    return a.unionByName(b).distinct()


def blocklist_filter(df: DataFrame, columns, blocklist: DataFrame) -> DataFrame:
    """Null out every listed link in the given text columns."""
    out = df
    for c in columns:
        bad = blocked_links(out, c, blocklist).select(F.col("url").alias("_bad"))
        out = out.join(bad, F.col(c) == F.col("_bad"), "left").withColumn(c, F.when(F.col("_bad").isNull(), F.col(c))).drop("_bad")
    return out


# --- robots rules -------------------------------------------------------------------------------------------------------------------
def robots_rules(robots: DataFrame, agent: str, *, host="host", body="rules") -> DataFrame:
    """(host, rules array<struct<len, allow, rx>>): the rules that apply to the agent: its own groups, else '*'."""
    line = F.trim(F.regexp_replace(F.col("_l"), "#.*$", ""))
    l = robots.select(F.col(host), F.posexplode(F.split(text(body), r"\r\n|\n|\r")).alias("no", "_l")).select(
        host, "no", F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("v"))
    l = l.filter(F.col("k").isin("user-agent", "allow", "disallow"))
    from pyspark.sql import Window as W
    w = W.partitionBy(host).orderBy("no")            # one robots file per host
    l = l.withColumn("start", (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")).withColumn("grp", F.sum(F.col("start").cast("int")).over(w))
    ua = F.lower("v")
    g = l.groupBy(host, "grp").agg(F.bool_or((F.col("k") == "user-agent") & (ua != "*") & (F.length(ua) > 0) & F.contains(F.lit(agent.lower()), ua)).alias("mine"),
                                   F.bool_or((F.col("k") == "user-agent") & (ua == "*")).alias("any_agent"),
                                   F.collect_list(F.when((F.col("k") != "user-agent") & (F.col("v") != ""), F.struct((F.col("k") == "allow").alias("allow"), F.col("v").alias("p")))).alias("r"))
    h = g.groupBy(host).agg(F.bool_or("mine").alias("own"), F.flatten(F.collect_list(F.when(F.col("mine"), F.col("r")))).alias("a"), F.flatten(F.collect_list(F.when(F.col("any_agent"), F.col("r")))).alias("b"))
    body_ = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\$+$", ""), r"([\\.+?^(){}|\[\]$])", r"\\$1"), r"\*", ".*")
    rx = lambda p: F.concat(F.lit("^"), body_(p), F.when(p.endswith("$"), F.lit("$")).otherwise(F.lit("")))
    return h.select(host, F.transform(F.when(F.col("own"), F.col("a")).otherwise(F.col("b")), lambda x: F.struct(F.length(x["p"]).alias("len"), x["allow"].alias("allow"), rx(x["p"]).alias("rx"))).alias("rules"))


def robots_verdict(urls: DataFrame, robots: DataFrame, agent: str, *, url="url", host="host") -> DataFrame:
    """urls with ``allowed`` and ``reason``: the longest matching rule wins, allow wins ties, no rule allows. ``urls`` carry their host."""
    r = robots_rules(robots, agent, host=host).withColumnRenamed(host, "_h")
    j = urls.join(r, F.col(host) == F.col("_h"), "left")
    path = F.regexp_replace(F.regexp_replace(F.col(url), r"^(?:[a-zA-Z]+://)?[^/?#]*", ""), "#.*$", "")
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    hits = F.filter(F.coalesce(F.col("rules"), F.array().cast("array<struct<len:int,allow:boolean,rx:string>>")), lambda x: F.call_function("rlike", path, x["rx"]))
    best = F.array_max(F.transform(hits, lambda x: F.struct(x["len"].alias("len"), x["allow"].alias("allow"))))
    allowed = F.coalesce(best["allow"], F.lit(True))
    return j.withColumn("allowed", allowed).withColumn("reason", F.when(~F.col("allowed"), F.lit(f"robots.txt disallows {agent}"))).drop("_h", "rules")
