"""Word-start search over places for a table of queries.

A query becomes needles (word starts). An inverted index with posting counts tells the rarest part of each query; its postings are the candidates and
the full test runs on those only, so neither side is crossed with the other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions._col import lookup, one_of
from ..functions.text import SEARCH_SYNONYMS, TYPE_SYNONYMS, search_normalize, search_normalize_address
from .directory import Filters, RANKED_GUIDES, TAG_BITS, guide_filter, in_order, sort_keys, with_sort_columns
from .scale import cut_lineage, top_rows

ASKED = ("tag", "tag_stem", "town", "town_needle", "tokens")
# fixed values: phrases that name a guide, in the order they are looked for; words that carry no meaning
TAG_PHRASES = (("cuban sandwiches", "cuban"), ("cuban sandwich", "cuban"), ("cubanos", "cuban"), ("cubano", "cuban"), ("cafecito", "cuban"),
               ("ventanita", "cuban"), ("stone crabs", "stonecrab"), ("stone crab", "stonecrab"), ("grouper sandwiches", "grouper"),
               ("grouper sandwich", "grouper"), ("oyster bars", "oyster"), ("oyster bar", "oyster"), ("raw bars", "oyster"), ("raw bar", "oyster"),
               ("fish camps", "fishcamp"), ("fish camp", "fishcamp"))
STOP_WORDS = ("the", "and", "of", "a", "in", "near", "me")


def town_lookup(places: DataFrame, town="city") -> DataFrame:
    """(town_key, town): the biggest town wins a shared spelling."""
    counts = places.filter(F.col(town).isNotNull()).groupBy(F.col(town).alias("town")).agg(F.count("*").alias("n")) \
        .withColumn("town_key", search_normalize_address("town"))
    return top_rows(counts, ["town_key"], [F.desc("n"), F.asc("town")]).select("town_key", "town")


def town_picker(towns: DataFrame, typed: str, town="town") -> DataFrame:
    """Towns one of whose (abbreviated) words starts with the typed text."""
    return towns.filter(F.concat(F.lit(" "), search_normalize_address(town)).contains(F.concat(F.lit(" "), search_normalize_address(F.lit(typed)))))


def _without(arr, at, n) -> Column:
    """Array without ``n`` items from 0-based position ``at``."""
    return F.concat(F.slice(arr, F.lit(1), at), F.slice(arr, at + n + 1, F.size(arr)))


def _words_before(text_, phrase) -> Column:
    """0-based word position of a space-delimited phrase inside ' a b c '."""
    return F.size(F.split(F.substring(text_, F.lit(1), F.locate(phrase, text_) if isinstance(phrase, str) else F.call_function("locate", phrase, text_)), " ")) - 2


def parse_queries(queries: DataFrame, towns: DataFrame, **rules) -> DataFrame:
    """What each typed text asks for (see ``asked``), as a stage of its own, so the searches that use it do not parse again."""
    return cut_lineage(asked(queries, towns, **rules))


def asked(queries: DataFrame, towns: DataFrame, *, phrases=TAG_PHRASES, synonyms=None, types=None, stop=STOP_WORDS) -> DataFrame:
    """(query_id, text, tag, tag_stem, town, town_needle, tokens array<array<string>>, typed): what each typed text asks for."""
    syn = SEARCH_SYNONYMS if synonyms is None else synonyms
    typ = TYPE_SYNONYMS if types is None else types
    type_abbr, abbr = sorted(set(typ.values())), sorted(set(syn.values()))
    q = queries.withColumn("raw", F.filter(F.split(search_normalize("text"), " "), lambda w: w != ""))
    q = q.withColumn("mapped", F.transform("raw", lambda w: lookup(syn, w, w)))
    # guide phrase: the first of the list that occurs
    q = q.withColumn("_t", F.concat(F.lit(" "), F.array_join("mapped", " "), F.lit(" ")))
    which = F.coalesce(*[F.when(F.col("_t").contains(f" {p} "), F.struct(F.lit(p).alias("p"), F.lit(t).alias("tag"), F.lit(len(p.split())).alias("n"))) for p, t in phrases])
    q = q.withColumn("_ph", which).withColumn("tag", F.col("_ph.tag"))
    q = q.withColumn("_at", F.when(F.col("_ph").isNotNull(), _words_before(F.col("_t"), F.concat(F.lit(" "), F.col("_ph.p"), F.lit(" ")))))
    q = q.withColumn("tag_stem", F.when(F.col("_ph").isNotNull(), F.concat(F.lit(" "), F.regexp_replace(F.array_join(F.slice("raw", F.col("_at") + 1, F.col("_ph.n")), " "), "s$", ""))))
    q = q.withColumn("raw", F.when(F.col("_ph").isNull(), F.col("raw")).otherwise(_without("raw", F.col("_at"), F.col("_ph.n")))) \
         .withColumn("mapped", F.when(F.col("_ph").isNull(), F.col("mapped")).otherwise(_without("mapped", F.col("_at"), F.col("_ph.n"))))
    # town: the longest one named, unless a street type follows it
    n = F.size("mapped")
    q = q.withColumn("_most", towns.agg(F.max(F.size(F.split("town_key", " ")))).scalar())       # words of the longest town
    grams = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.col("_most"), n - i)), lambda k: F.struct(
            i.alias("i"), k.alias("k"), F.array_join(F.slice("mapped", i + 1, k), " ").alias("g"), F.coalesce(F.get("mapped", i + k), F.lit("")).alias("next")))))
    g = q.filter(n > 0).select("query_id", F.explode(grams).alias("x")).select("query_id", "x.*").filter(~one_of("next", type_abbr))
    hit = g.join(towns, F.col("g") == F.col("town_key"))
    best = top_rows(hit, ["query_id"], [F.desc(F.length("g")), F.asc("g"), F.asc("i")]).select(F.col("query_id").alias("_q"), "town", "i", "k")
    q = q.join(best, F.col("query_id") == F.col("_q"), "left").drop("_q")
    q = q.withColumn("town_needle", F.when(F.col("town").isNotNull(), F.concat(F.lit(" "), F.array_join(F.slice("raw", F.col("i") + 1, F.col("k")), " ")))) \
         .withColumn("raw", F.when(F.col("town").isNull(), F.col("raw")).otherwise(_without("raw", F.col("i"), F.col("k")))) \
         .withColumn("mapped", F.when(F.col("town").isNull(), F.col("mapped")).otherwise(_without("mapped", F.col("i"), F.col("k"))))
    # the rest: stop words go unless they are all there is
    pairs = F.arrays_zip(F.col("raw").alias("raw"), F.col("mapped").alias("mapped"))
    keep = F.filter(pairs, lambda w: ~one_of(w["mapped"], stop))
    q = q.withColumn("_w", F.when(F.col("tag").isNotNull() | F.col("town").isNotNull() | (F.size(keep) > 0), keep).otherwise(pairs))
    m = F.size("_w")

    def needles(w, i):
        token, last = w["raw"], i == m - 1
        whole = (one_of(token, abbr) & (~last | (F.length(token) > 1))) | ((F.length(token) <= 2) & ~last)
        plain = F.concat(F.lit(" "), token, F.when(whole, F.lit(" ")).otherwise(F.lit("")))
        finish = F.filter(F.array(*[F.when(last & (F.length(token) >= 3) & (token != word) & F.startswith(F.lit(word), token), F.lit(f" {short} ")) for word, short in typ.items()]),
                          lambda x: x.isNotNull())
        return F.when(one_of(token, syn), F.array(F.concat(F.lit(" "), lookup(syn, token), F.lit(" ")), F.concat(F.lit(" "), token))).otherwise(F.concat(F.array(plain), finish))
    tokens = F.transform("_w", needles)
    a, b = F.get("_w", m - 2), F.get("_w", m - 1)
    glue = F.array(F.concat(F.lit(" "), a["mapped"], F.lit(" "), b["mapped"], F.lit(" ")), F.concat(F.lit(" "), a["raw"], F.lit(" "), b["raw"]))
    q = q.withColumn("tokens", F.when((m >= 2) & one_of(b["mapped"], type_abbr), F.concat(F.slice(tokens, F.lit(1), m - 2), F.array(glue))).otherwise(tokens))
    return q.select("query_id", "text", "tag", "tag_stem", "town", "town_needle", "tokens", (F.trim("text") != "").alias("typed"))


def nothing_searchable(parsed: DataFrame) -> DataFrame:
    """Typed texts that hold nothing to search for: they find nothing, not everything."""
    return parsed.filter(F.col("typed") & (F.size("tokens") == 0) & F.col("town").isNull() & F.col("tag").isNull())


def _all_in(tokens, hay) -> Column:
    """Every part of ``tokens`` has a needle in ``hay``; parts of none are met. The length names ``hay`` outside the lambda too: a join condition that
    names it only inside can be pushed to the side without it."""
    toks = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(toks) == 0, True).when(F.length(hay) >= 0, F.forall(toks, lambda needles: F.exists(needles, lambda x: hay.contains(x))))


def _answers(q: dict[str, Column]) -> Column:
    """Whether a place answers a parsed text, all of it tested."""
    bit = lookup({t: 1 << b for t, b in TAG_BITS.items()}, q["tag"], 0)
    named = lambda c: F.coalesce(F.col("name_text").contains(c), F.lit(False))
    ok_tag = q["tag"].isNull() | (F.coalesce(F.col("tags"), F.lit(0)).bitwiseAND(bit) != 0) | named(q["tag_stem"])
    ok_town = q["town"].isNull() | F.coalesce(F.col("city") == q["town"], F.lit(False)) | named(q["town_needle"])
    return ok_tag & ok_town & _all_in(q["tokens"], F.col("search_text"))


def search_index(places: DataFrame) -> DataFrame:
    """Postings (key, place_id): ``w:`` words of the search text, ``c:`` the town, ``g:`` guides. Slim, built once for any number of searches."""
    words = F.transform(F.filter(F.split("search_text", " "), lambda w: w != ""), lambda w: F.concat(F.lit("w:"), w))
    tags = F.array_compact(F.array(*[F.when(F.coalesce(F.col("tags"), F.lit(0)).bitwiseAND(F.lit(1 << b)) != 0, F.lit("g:" + t)) for t, b in TAG_BITS.items()]))
    city = F.array_compact(F.array(F.concat(F.lit("c:"), F.col("city"))))
    keys = F.concat(F.coalesce(words, F.array().cast("array<string>")), tags, city)
    return places.select(F.col("id").alias("place_id"), F.explode(F.array_distinct(keys)).alias("key"))


def _needles(parsed: DataFrame) -> DataFrame:
    """(query_id, part, needle, whole): what a place must hold, by parts of the text that must all be met and ways to meet a part."""
    def word(c):
        t = F.trim(c)
        return F.struct(F.concat(F.lit("w:"), F.element_at(F.split(t, " "), 1)).alias("needle"), (F.endswith(c, F.lit(" ")) | t.contains(" ")).alias("whole"))
    exact = lambda kind, c: F.struct(F.concat(F.lit(kind), c).alias("needle"), F.lit(True).alias("whole"))
    side = lambda kind, c, text: F.when(F.col(c).isNotNull(), F.array_compact(F.array(exact(kind, F.col(c)), F.when(F.col(text).isNotNull(), word(F.col(text))))))
    parts = F.concat(F.transform("tokens", lambda t: F.transform(t, word)), F.array_compact(F.array(side("c:", "town", "town_needle"), side("g:", "tag", "tag_stem"))))
    return parsed.select("query_id", F.posexplode(parts).alias("part", "ways")).select("query_id", "part", F.explode("ways").alias("w")).select("query_id", "part", "w.*").distinct()


def search_match(places: DataFrame, parsed: DataFrame, index: DataFrame | None = None, most: int = 1 << 16) -> DataFrame:
    """(query_id, place_id, name_hit) for every query that asks for something. Places carry id (unique), city, tags, search_text, name_text.

    The words of the index are counted; each query is sent to the postings of its rarest part only, and texts are joined back for those candidates, so a query
    costs at most the places that hold its rarest part. Postings of a word with more than ``most`` places are met in slices of about that many."""
    index = cut_lineage(search_index(places)) if index is None else index
    words = index.groupBy(F.col("key").alias("word")).agg(F.count("*").alias("n"))
    asked_for = cut_lineage(_needles(parsed))
    starts = asked_for.filter(~F.col("whole")).select("needle").distinct()
    longest = F.coalesce(starts.agg(F.max(F.length("needle"))).scalar(), F.lit(3))
    begun = words.filter(F.startswith("word", F.lit("w:"))).withColumn("most", longest) \
        .withColumn("k", F.explode(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.length("word"), "most"))))) \
        .select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("needle"))
    found = words.select(F.col("word").alias("needle"), F.lit(True).alias("whole"), "word", "n") \
        .unionByName(begun.join(starts, "needle", "left_semi").select("needle", F.lit(False).alias("whole"), "word", "n"))
    held = found.groupBy("needle", "whole").agg(F.sum("n").alias("n"))
    cost = asked_for.join(held, ["needle", "whole"], "left").groupBy("query_id", "part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rarest = cost.groupBy("query_id").agg(F.min(F.struct("n", "part")).alias("m")).select("query_id", "m.part")
    slices = F.floor(F.col("n") / F.lit(most)) + 1
    probes = asked_for.join(rarest, ["query_id", "part"]).join(found, ["needle", "whole"]).select("query_id", "word", "n").distinct() \
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    often = words.filter(F.col("n") > most).select(F.col("word").alias("key"), slices.alias("slices"))
    posts = index.join(often, "key", "left").select("place_id", F.col("key").alias("word"), F.coalesce(F.pmod(F.xxhash64("place_id"), "slices"), F.lit(0)).alias("slice"))
    # each candidate once, ids alone; the aggregate also keeps the test of the texts out of the reordering of the joins below it
    hit = probes.join(posts, ["word", "slice"]).select("query_id", "place_id").distinct().repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place_id")
    texts = places.select(F.col("id").alias("place_id"), "city", "tags", "search_text", "name_text")
    hit = hit.join(texts, "place_id").join(parsed.select("query_id", *ASKED), "query_id").filter(_answers({c: F.col(c) for c in ASKED}))
    return hit.select("query_id", "place_id", ((F.size("tokens") > 0) & _all_in("tokens", F.col("name_text"))).alias("name_hit"))


def name_first(hits: DataFrame) -> DataFrame:
    """Adds ``lead``: 0 for rows shown first. Name matches lead only when they are some but not all of a query's rows."""
    n = hits.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias("n"), F.count_if("name_hit").alias("named"))
    lead = F.when((F.col("named") > 0) & (F.col("named") < F.col("n")) & F.col("name_hit"), 0).otherwise(1)
    return hits.join(n, F.col("query_id") == F.col("_q")).withColumn("lead", lead).drop("_q", "n", "named")


def guide_query(places: DataFrame, guide: str, filters: Filters, text: str, order: str, here=None, towns: DataFrame | None = None, limit: int | None = None,
                position: str | None = None) -> DataFrame:
    """The composed directory query: guide, filters, search, sort, name matches first. The one typed text is parsed first, and
    places are tested row by row: one scan without an exchange before the order. ``position`` names a column for the place in it."""
    base = places.filter(guide_filter(guide) & filters.condition())
    if guide == "nearme" and here is None:
        base = base.limit(0)
    base = with_sort_columns(base, here)
    keys = sort_keys(order, here)
    if not text.strip():
        return in_order(base, keys, limit, position)
    typed = places.sparkSession.range(1).select(F.lit(1).alias("query_id"), F.lit(text).alias("text"))
    row = asked(typed, towns if towns is not None else town_lookup(places)).first()                # one row, as long as the typed text
    if not (row["tokens"] or row["town"] is not None or row["tag"] is not None):
        return in_order(base.limit(0), keys, limit, position)
    q = {c: F.lit(row[c]).cast("string") for c in ASKED if c != "tokens"}
    q["tokens"] = F.array(*[F.array(*[F.lit(n) for n in needles]) for needles in row["tokens"]]).cast("array<array<string>>")
    found = base.filter(_answers(q)).withColumn("_named", _all_in(q["tokens"], F.col("name_text")) if row["tokens"] else F.lit(False))
    if position is not None and limit is None:
        found = cut_lineage(found)                      # numbering the whole list reads it three times
    if guide in RANKED_GUIDES:
        return in_order(found, keys, limit, position).drop("_named")
    # name matches lead only when they are some but not all of the rows
    some = found.agg(((F.count_if("_named") > 0) & (F.count_if("_named") < F.count("*"))).alias("some")).scalar()
    found = found.withColumn("_lead", ~(F.col("_named") & some))
    return in_order(found, [F.col("_lead"), *keys], limit, position).drop("_named", "_lead")


def elsewhere_count(places: DataFrame, guide: str, filters: Filters, hits: DataFrame, few: int = 5) -> DataFrame:
    """(query_id, here, elsewhere): matches outside the guide, 0 unless the guide's own matches are few and there are more elsewhere."""
    p = places.filter(filters.condition()).select("id", guide_filter(guide).alias("in_guide"))
    n = hits.join(p, F.col("place_id") == F.col("id")).groupBy("query_id").agg(F.count_if("in_guide").alias("here"), F.count("*").alias("everywhere"))
    return n.select("query_id", "here", F.when((F.col("here") < few) & (F.col("everywhere") > F.col("here")) & F.lit(guide != "all"), F.col("everywhere")).otherwise(0).alias("elsewhere"))


def find_by_id(places: DataFrame, id) -> DataFrame:
    return places.filter(F.col("id") == id)


def saved_places(places: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved places in A-Z order."""
    return with_sort_columns(places.join(saved, "id", "left_semi")).orderBy("sort_key", "id")


