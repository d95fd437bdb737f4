"""Links: registrable domain, tracking parameters, safe form, comparison key."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab as V
from ._col import col, let, one_of, text


def url_host(c) -> Column:
    """Lower-case host without user, port and www; '' when there is none."""
    s = F.trim(text(c))
    full = F.when(s.contains("://"), s).otherwise(F.concat(F.lit("http://"), s))
    host = F.regexp_extract(F.lower(full), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\d?\.", "")


def registrable_domain(host, second_level=V.CC_SECOND_LEVEL) -> Column:
    """Last two labels of a host, three for names like x.co.uk; null without a dot."""
    def last(parts):
        n = F.size(parts)
        wide = (n >= 3) & F.try_element_at(parts, F.lit(-2)).isin(*second_level) & (F.length(F.try_element_at(parts, F.lit(-1))) == 2)
        return F.when(n >= 2, F.array_join(F.slice(parts, n - F.when(wide, 2).otherwise(1), F.lit(3)), "."))
    return let(F.split(host, r"\."), last)


def url_registrable_domain(c, aggregators=V.AGGREGATORS, second_level=()) -> Column:
    """Own domain of a link, null for hosting and directory domains. Without ``second_level`` always the last two labels."""
    host = url_host(c)
    if second_level:
        dom = registrable_domain(host, second_level)
    else:
        parts = F.split(host, r"\.")
        dom = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "."))
    return F.when(~one_of(dom, aggregators), dom)


def _is_tracking(pair) -> Column:
    key = F.trim(F.try_url_decode(F.regexp_extract(pair, "^([^=]*)", 1)))
    val = F.trim(F.coalesce(F.try_url_decode(F.regexp_extract(pair, "^[^=]*=(.*)$", 1)), F.lit("")))
    hit = key.rlike(V.TRACKING_NAMES)
    for name, rx in V.TRACKING_VALUES.items():
        hit = hit | ((F.lower(key) == name) & val.rlike(rx))
    return F.coalesce(hit, F.lit(False))


def _kept(params) -> Column:
    """The parameters without tracking pairs; unchanged text when none is tracking."""
    parts = F.split(params, "&")
    keep = F.filter(parts, lambda p: ~_is_tracking(p))
    return F.when(F.size(keep) == F.size(parts), params).otherwise(F.array_join(F.filter(keep, lambda p: p != ""), "&"))


def url_strip_tracking(c) -> Column:
    """The link without tracking parameters in query, fragment and path; everything else and its order unchanged."""
    s = F.trim(col(c))
    rx = r"^([^?#]*)(\?[^#]*)?(#.*)?$"
    path = F.regexp_extract(s, rx, 1)
    query = F.substr(F.regexp_extract(s, rx, 2), F.lit(2))
    frag = F.substr(F.regexp_extract(s, rx, 3), F.lit(2))
    query2 = _kept(query)
    head, tail = F.regexp_extract(frag, r"^(.*)\?([^?]*)$", 1), F.regexp_extract(frag, r"^(.*)\?([^?]*)$", 2)
    routed = frag.contains("?")
    part = F.when(routed, tail).otherwise(frag)
    part2 = _kept(part)
    frag2 = F.when(~frag.contains("=") | (part2 == part), frag) \
             .when(part2 != "", F.concat(F.when(routed, F.concat(head, F.lit("?"))).otherwise(F.lit("")), part2)).otherwise(F.when(routed, head).otherwise(F.lit("")))
    segs = F.split(path, "/")
    n = F.size(segs)
    cleaned = F.transform(segs, lambda g, i: F.struct(F.when(g.contains("="), _kept(g)).otherwise(g).alias("s"), (g != "").alias("had"), (i == n - 1).alias("last")))
    path2 = F.array_join(F.transform(F.filter(cleaned, lambda x: (x["s"] != "") | ~x["had"] | x["last"]), lambda x: x["s"]), "/")
    path2 = F.when(path.contains("="), path2).otherwise(path)
    clean = F.concat(path2, F.when(query2 != "", F.concat(F.lit("?"), query2)).otherwise(F.lit("")),
                     F.when(frag2 != "", F.concat(F.lit("#"), frag2)).otherwise(F.lit("")))
    same = (path2 == path) & (query2 == query) & (frag2 == frag)
    return F.when(same, col(c)).otherwise(clean)


def tracked_links(c) -> Column:
    """Links inside any text (JSON and HTML escapes undone) that still carry a tracking parameter."""
    t = F.replace(F.replace(text(c), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    links = F.regexp_extract_all(t, F.lit(r"""(?i)(https?://[^\s"'<>\\]+|(?<![\w/.:@-])(?:[a-z0-9-]+\.)+[a-z]{2,}/[^\s"'<>\\]*)"""), F.lit(1))
    return F.filter(links, lambda u: url_strip_tracking(u) != u)


def url_safe(c) -> Column:
    """Only http(s) links; a bare host gets https; anything else is null."""
    s = F.trim(col(c))
    return F.when(s.rlike(r"(?i)^https?://[^\s/?#]+\.[^\s]+$"), s) \
            .when(s.rlike(r"(?i)^(?:[a-z0-9-]+\.)+[a-z]{2,}(?:[/?#]\S*)?$"), F.concat(F.lit("https://"), s))


def url_key(c) -> Column:
    """Comparison key: no scheme, no www, no trailing slash, lower case."""
    s = F.regexp_replace(F.lower(F.trim(text(c))), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_replace(s, r"^www\.", ""), "/+$", "")
