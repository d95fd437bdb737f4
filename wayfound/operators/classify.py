"""Rules tables, flags, tiers, labels and keep decisions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions._col import col, lookup, text
from ..functions.similarity import sim_token_set
from .scale import cut_lineage, top_rows
from .spatial import proximity_join
from .stats import group_mode


def first_rule(c, rules, default=None) -> Column:
    """Label of the first rule (label, pattern) that the text matches. Rules are a short ordered list of fixed patterns."""
    s = text(c)
    hits = [F.when(s.rlike(rx), F.lit(label)) for label, rx in rules]
    return F.coalesce(*hits, F.lit(default).cast("string"))


def apply_rule_table(df: DataFrame, column: str, rules: DataFrame, out: str, at_once: int = 1000) -> DataFrame:
    """First matching rule of a rules table (priority, label, pattern). Rules are dealt into lists of about ``at_once``; every distinct text meets every
    list, and the least priority found stays, so that any number of rules fits and copies of a text are tested once."""
    lists = rules.agg(F.greatest(F.ceil(F.count("*") / at_once), F.lit(1)).cast("int")).scalar()
    dealt = rules.select(F.struct("priority", "label", "pattern").alias("r")).withColumn("_list", F.pmod(F.xxhash64("r.priority", "r.label", "r.pattern"), lists).cast("int")) \
        .groupBy("_list").agg(F.array_sort(F.collect_list("r")).alias("_rules"))
    texts = df.select(text(column).alias("_text")).distinct().withColumn("_at", F.explode(F.sequence(F.lit(0), lists - 1)))
    found = F.get(F.filter("_rules", lambda r: F.call_function("rlike", F.col("_text"), r["pattern"])), 0)
    hit = texts.join(dealt, F.col("_at") == F.col("_list")).select("_text", found.alias("_hit")).filter(F.col("_hit").isNotNull()).groupBy("_text").agg(F.min("_hit").alias("_hit"))
    return df.join(hit, text(column) == F.col("_text"), "left").withColumn(out, F.col("_hit.label")).drop("_text", "_hit")


def brand_by_rules(name_key, rules, anywhere=()) -> Column:
    """Brand of a name key: start rules on the key, then on its '/' parts, then the rules that count anywhere in the name."""
    k = text(name_key)
    part = lambda i: F.trim(F.coalesce(F.get(F.split(k, "/"), i), F.lit("")))
    return F.coalesce(first_rule(k, rules), *[F.when(k.contains("/"), first_rule(part(i), rules)) for i in range(3)], *([first_rule(k, anywhere)] if anywhere else []))


def label_closure(taxonomy: DataFrame) -> DataFrame:
    """(label, ancestor, steps) of a taxonomy (label, parent): every label with itself (0 steps) and all labels above it, in rounds that double the steps followed. Rounds end
    when nothing is added; a circle in the parents is followed once around."""
    edges = taxonomy.filter("parent is not null and label <> parent").select("label", F.col("parent").alias("ancestor")).distinct()
    labels = taxonomy.select("label").unionByName(taxonomy.select(F.col("parent").alias("label"))).filter("label is not null").distinct()
    pairs = cut_lineage(labels.select("label", F.col("label").alias("ancestor"), F.lit(0).alias("steps")).unionByName(edges.withColumn("steps", F.lit(1))))
    size = -1
    while size != (size := pairs.count()):
        up = pairs.select(F.col("label").alias("_l"), F.col("ancestor").alias("_a"), F.col("steps").alias("_s"))
        longer = pairs.join(up, F.col("ancestor") == F.col("_l")).select("label", F.col("_a").alias("ancestor"), (F.col("steps") + F.col("_s")).alias("steps"))
        pairs = cut_lineage(longer.groupBy("label", "ancestor").agg(F.min("steps").alias("steps")))
    return pairs


def cuisine_cascade(df: DataFrame, *, id: str, name_key: str, raw_name: str, label: str, categories: str, kind: str, brand: str, name_rules, category_rules, label_cuisine: DataFrame,
                    taxonomy: DataFrame | None = None, cafe_labels=(), cafe_word: str = "CAF[EÉ]", cafe="Coffee & Café", cafe_categories: str = "Coffee|Cafe", kind_cuisine: dict | None = None,
                    chain_cuisine: dict | None = None, weak=("Bar & Pub",), other="American & Other") -> DataFrame:
    """(id, cuisine, stage): the kind of food of every place, decided by the first stage that can tell.

    1 name: the first name rule (label, pattern) on the name key, rules for the cuisines in ``weak`` left out; 2 taxonomy: the cuisine of the place's taxonomy label, or of its nearest ancestor in
    ``taxonomy`` (label, parent) that ``label_cuisine`` (label, cuisine) names; 3 weak name rules; 4 categories (an array, in order): the first category that a category
    rule matches decides, by its first rule; 5 the word for a café in the raw name of a place without categories; else ``other``. Then the overrides: a label of
    ``cafe_labels`` doesn't make a café where the first category is something else (decided again without label and raw name); a place left at ``other`` takes the
    cuisine of its ``kind``; places of a brand take the brand's stated cuisine or else its commonest one, ``other`` counting only where there is no more (ties: the
    first by name). Patterns are short lists that are parameters; label, brand and rule joins are by equal keys."""
    strong, weaker = [r for r in name_rules if r[0] not in weak], [r for r in name_rules if r[0] in weak]
    known = label_cuisine.select(F.col("label").alias("ancestor"), F.col("cuisine").alias("_c"))
    if taxonomy is not None:
        near = label_closure(taxonomy).join(known, "ancestor")
        known_at = near.groupBy(F.col("label").alias("_label")).agg(F.min_by("_c", F.struct("steps", "ancestor")).alias("_by_label"))
        stated = known.select(F.col("ancestor").alias("_label"), F.col("_c").alias("_own"))
        by_label = known_at.join(stated, "_label", "full").select("_label", F.coalesce("_own", "_by_label").alias("_by_label"))
    else:
        by_label = known.select(F.col("ancestor").alias("_label"), F.col("_c").alias("_by_label"))
    j = df.join(by_label, F.col(label) == F.col("_label"), "left")
    cats = F.filter(F.coalesce(F.col(categories), F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    of_category = lambda x: F.coalesce(*[F.when(x.rlike(rx), F.lit(c)) for c, rx in category_rules], F.lit(None).cast("string"))
    by_category = F.get(F.filter(F.transform(cats, of_category), lambda x: x.isNotNull()), 0)
    none = F.lit(None).cast("string")
    by_name, by_weak = first_rule(name_key, strong) if strong else none, first_rule(name_key, weaker) if weaker else none
    by_word = F.when((F.size(cats) == 0) & F.upper(text(raw_name)).rlike(rf"(?<![\p{{L}}\p{{N}}_]){cafe_word}(?![\p{{L}}\p{{N}}_])"), F.lit(cafe))
    stages = [("name", by_name), ("taxonomy", F.col("_by_label")), ("weak name", by_weak), ("category", by_category), ("word", by_word), ("none", F.lit(other))]
    pick = lambda parts: F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("cuisine"), F.lit(n).alias("stage"))) for n, c in parts])
    first = F.get(cats, 0)
    again = F.col(label).isin(*cafe_labels) & (F.col("_p.cuisine") == cafe) & first.isNotNull() & ~first.rlike(cafe_categories) if cafe_labels else F.lit(False)
    j = j.withColumn("_p", pick(stages))
    j = j.withColumn("_p", F.when(again, pick([s for s in (("name", first_rule(name_key, name_rules)), stages[3], stages[5])])).otherwise(F.col("_p")))
    by_kind = lookup(kind_cuisine, kind) if kind_cuisine else none
    j = j.withColumn("_p", F.when((F.col("_p.cuisine") == other) & by_kind.isNotNull(), F.struct(by_kind.alias("cuisine"), F.lit("kind").alias("stage"))).otherwise(F.col("_p")))
    slim = j.select(id, F.col(brand).alias("_brand"), F.col("_p.cuisine").alias("cuisine"), F.col("_p.stage").alias("stage"))
    chains = group_mode(slim.filter(F.col("_brand").isNotNull()), ["_brand"], "cuisine", "_chain", ignore=F.col("cuisine") == other).withColumnRenamed("_brand", "_b")
    stated = lookup(chain_cuisine, "_brand") if chain_cuisine else none
    out = slim.join(chains, F.col("_brand") == F.col("_b"), "left").withColumn("_to", F.coalesce(stated, "_chain"))
    return out.select(id, F.coalesce("_to", "cuisine").alias("cuisine"), F.when(F.col("_to").isNotNull(), F.lit("brand")).otherwise(F.col("stage")).alias("stage"))


def brand_validate(*, brand, brand_key, name_key, label_key, source, own_domain, domain, cuisine, brand_cuisine, known_cuisine, name_brand, core_ratio, partial, label_set,
                   label_partial, family: dict, feeds=("AllThePlaces", "DAC")) -> Column:
    """The brand when the row really is one of its places, else null: by feed, name relation, own domain, exact core name, and cuisine family.
    Similarities are passed as columns."""
    feed = col(source).isin(*feeds)
    label = (text(label_key) != "") & (label_set >= 80)
    related = feed | (partial >= 60) | (label & (label_partial >= 60))
    exact = (core_ratio >= 90) | ((F.length(col(brand_key)) >= 6) & ((col(name_key) == col(brand_key)) | F.startswith(col(name_key), F.concat(col(brand_key), F.lit(" ")))))
    own = F.coalesce(col(domain) == col(own_domain), F.lit(False))
    fa, fb = lookup(family, cuisine), lookup(family, brand_cuisine)
    foreign_site = col(domain).isNotNull() & col(own_domain).isNotNull() & (col(source) != "BrightQuery")
    wrong_family = col(known_cuisine) & fa.isNotNull() & fb.isNotNull() & (fa != fb)
    ok = F.when(~feed & ~F.coalesce(col(name_brand) == col(brand), F.lit(False)), F.lit(False)).when(~related, F.lit(False)) \
        .when(exact | own | (label & feed) | (col(source) == "official"), F.lit(True)).when(foreign_site, F.lit(False)).otherwise(~F.coalesce(wrong_family, F.lit(False)))
    return F.when(col(brand).isNotNull() & ok, col(brand))


# fixed values: words of a listing that is no place to eat, and of a closed one
NOT_FOOD = (r"(?i)\b(?:radiator|auto (?:repair|body|parts|sales)|tires?|insurance|barber|dental|chiropractic|plumbing|realty|food pantry|distribution cent(?:er|re)|"
            r"bakery warehouse|restaurant equipment|wholesale (?:distributor|supply|foods?)|meal program|soup kitchen|church|parish|funeral|daycare|day care|salon|"
            r"storage|apartments?|condominiums?|operations)\b")
CLOSED_NAME = (r"(?i)\b(?:permanently|temporarily)\s+closed\b|\bclosed\s+(?:permanently|for business|at\b)|coming soon|\bnow closed\b|[-–(|]\s*['\"]?closed['\"]?\s*\)?\s*$|"
               r"^closed\s*[-–:]")
GENERIC_ALONE = ("kitchen", "bar", "pub", "tavern", "grill", "deli", "pizza", "bakery", "coffee", "diner", "restaurant", "cafe", "café")


def flag_junk_listing(name, zip5, street, not_food=NOT_FOOD) -> Column:
    n, z = text(name), F.substring(F.trim(text(zip5)), 1, 5)
    return n.rlike(r"^[\d\s#-]+$") | n.rlike(not_food) | ((z != "") & ~z.rlike(r"^3[234]\d{3}$")) | text(street).rlike("[^\u0000-ɏ]")


def flag_nowhere(street, zip5) -> Column:
    return (F.trim(text(street)) == "") & (F.trim(text(zip5)) == "")


def flag_closed_name(name, pattern=CLOSED_NAME) -> Column:
    return text(name).rlike(pattern)


def flag_junk_display(name, *, is_town: Column, brand, official) -> Column:
    """Address as name, a closed tail, a town as name, a civic name, a single generic word, or no letter at all."""
    n = text(name)
    address = n.rlike(r"(?i)^\d+\s+(?:[NSEW]{1,2}\.?\s+)?[\w.' ]+?\b(?:St|Street|Ave|Avenue|Dr|Drive|Rd|Road|Blvd|Ln|Lane|Way|Ct|Pl|Hwy|Pkwy|Trl|Ter)\b\.?(?:\s*#\s*\w+)?(?:\s*,.*|\s+[A-Z][a-z]+,\s*FL\b.*)?$")
    return address | n.rlike(r"(?i)(?:\bclosed|\bretired)\s*\)?\s*$") | (is_town & col(brand).isNull() & ~F.coalesce(col(official), F.lit(False))) \
        | n.rlike(r"(?i)^(?:village|city|town) of ") | F.lower(F.trim(n)).isin(*GENERIC_ALONE) | ~n.rlike("[A-Za-z]")


def non_restaurant(name_key, *, store: str, hard: str, soft: str, real_food: str, busy: Column, plain_food: Column, license_only: Column, license_words: str, exempt: Column) -> Column:
    """Store, hard venue, soft venue (unless busy or plainly food) or a license-only venue; hand-checked and honored rows are exempt."""
    k = text(name_key)
    food = plain_food | k.rlike(real_food)
    club = k.rlike(r"\bCLUB\b") & ~k.rlike(r"NIGHT ?CLUB|CLUB HOUSE GRILL|SANDWICH|SUPPER CLUB")
    venue = k.rlike(hard) | (k.rlike(soft) & ~(busy | food)) | (license_only & (k.rlike(license_words) | club) & ~busy & ~k.rlike(real_food))
    return (k.rlike(store) | venue) & ~F.coalesce(exempt, F.lit(False))


def flag_listed_venue(df: DataFrame, *, id: str, name: str, web: str, license: str, pattern: str, web_pattern: str, licenses: DataFrame, listed: DataFrame, points: DataFrame,
                      exempt: Column, min_score=85.0, radius_m=45.0) -> DataFrame:
    """Adds ``listed_venue``: by name or web words, a checked license list, a checked (town, number, name) list, or a known point nearby with a
    similar name. ``df`` carries name_key, town, num, lat, lon; ``listed`` (town, num, name_key); ``points`` (name_key, lat, lon)."""
    by_word = text(name).rlike(pattern) | text(web).rlike(web_pattern)
    lic = licenses.select(F.col("license").alias("_lic")).distinct().withColumn("_by_lic", F.lit(True))
    a = df.select(F.col(id).alias("_id"), "name_key", "town", "num").join(listed.select(F.col("town").alias("_t"), F.col("num").alias("_n"), F.col("name_key").alias("_k")),
                                                                         (F.col("town") == F.col("_t")) & (F.col("num") == F.col("_n"))).filter(sim_token_set("name_key", "_k") >= min_score).select("_id")
    near = proximity_join(df.select(F.col(id).alias("pid"), "name_key", "lat", "lon"), points.select("name_key", "lat", "lon"), radius_m=radius_m)
    b = near.filter(sim_token_set("l_name_key", "r_name_key") >= min_score).select(F.col("l_pid").alias("_id"))
    hit = a.unionByName(b).distinct().withColumn("_hit", F.lit(True))
    j = df.join(lic, F.col(license) == F.col("_lic"), "left").join(hit, F.col(id) == F.col("_id"), "left")
    return j.withColumn("listed_venue", (by_word | F.coalesce("_by_lic", F.lit(False)) | F.coalesce("_hit", F.lit(False))) & ~F.coalesce(exempt, F.lit(False))).drop("_lic", "_by_lic", "_id", "_hit")


def keep_rule(*, base_ok: Column, lapsed: Column, official: Column, verified: Column, kind_ok: Column, source, confidence, in_snapshot: Column, closed_snapshot: Column, app: bool,
              feeds=("AllThePlaces", "DAC"), min_confidence=0.95) -> Column:
    """Keep a listing: usable, not lapsed, and official, verified or trusted by its source. App mode ignores the old snapshot."""
    no = F.lit(False)
    meta, feed, sure = col(source) == "meta", col(source).isin(*feeds), F.coalesce(col(confidence), F.lit(0)) >= min_confidence
    rule = kind_ok & ((meta & sure) | feed) if app else kind_ok & ((meta & (in_snapshot | sure)) | (feed & in_snapshot)) & ~F.coalesce(closed_snapshot, no)
    return base_ok & ~F.coalesce(lapsed, no) & (F.coalesce(official, no) | F.coalesce(verified, no) | F.coalesce(rule, no))


def flag_operator(legal_name, pattern: str) -> Column:
    return F.upper(text(legal_name)).rlike(pattern)


def usable_sources(df: DataFrame, *, id: str, sources: str, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows with their allowed sources, waiting rows without any). ``verdicts`` (source, allowed); unknown sources are allowed."""
    long = df.select(F.col(id).alias("_id"), F.posexplode(F.coalesce(F.col(sources), F.array().cast("array<string>"))).alias("pos", "source"))
    ok = long.join(verdicts, "source", "left").filter(F.coalesce("allowed", F.lit(True)))
    arr = ok.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("_s"))
    j = df.join(arr, F.col(id) == F.col("_id"), "left")
    return j.filter(F.col("_s").isNotNull()).withColumn(sources, F.col("_s")).drop("_id", "_s"), j.filter(F.col("_s").isNull()).drop("_id", "_s")


def geocode_agreement(*, status, kind, matched, zip, town, state: str = "FL") -> Column:
    """Accept an outside geocode only when matched, in the state, and agreeing on zip or town."""
    m = F.upper(text(matched))
    agrees = ((text(zip) != "") & F.endswith(F.trim(m), text(zip))) | ((text(town) != "") & m.contains(F.concat(F.lit(", "), F.upper(text(town)), F.lit(f", {state}"))))
    return (text(status) == "Match") & text(kind).isin("Exact", "Non_Exact") & m.contains(f", {state},") & agrees


def tier_and_rank(*, official, confirmed, in_snapshot, source, confidence, good=("meta", "AllThePlaces", "DAC")) -> Column:
    """struct(tier, rank): tier by evidence, and the preference rank used when duplicates compete."""
    one = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(float(w))).otherwise(F.lit(0.0))
    return F.struct(F.when(col(official), "official").when(col(confirmed), "both").otherwise("listing").alias("tier"),
                    (one(col(official), 8) + one(col(in_snapshot), 4) + one(col(source).isin(*good), 2) + F.coalesce(col(confidence), F.lit(0.0))).alias("rank"))


def guide_tags(labels, *, hand_checked: Column, patterns: dict[str, str], strong: dict[str, Column] | None = None) -> dict[str, Column]:
    """Tag columns: hand-checked rows whose label matches, or (web mode) strongly mentioned ones."""
    s = F.lower(text(labels))
    return {t: (F.coalesce(hand_checked, F.lit(False)) & s.rlike(rx)) | F.coalesce((strong or {}).get(t, F.lit(False)), F.lit(False)) for t, rx in patterns.items()}


def source_group(*, closed: Column, source, confidence, has_web: Column, feeds=("AllThePlaces", "DAC")) -> Column:
    """Ordered source group label of a listing (app labels)."""
    s, c = F.coalesce(col(source), F.lit("none")), F.coalesce(col(confidence), F.lit(0))
    return F.when(closed, "closed per listing/name").when((s == "meta") & (c >= 0.95), "meta_high").when((s == "meta") & (c >= 0.9) & has_web, "meta_mid_web") \
        .when((s == "meta") & (c >= 0.9), "meta_mid_noweb").when(s.isin(*feeds), "brand_feed").when((s == "BrightQuery") & (c >= 0.95), "bq_high") \
        .when((s == "Microsoft") & (c >= 0.95), "ms_high").when(s == "meta", "meta_low").otherwise("other_sources")


def source_group_web(*, closed_snapshot: Column, closed: Column, source, in_snapshot: Column, feeds=("AllThePlaces", "DAC")) -> Column:
    """Ordered source group label of a listing (web labels)."""
    s, snap = F.coalesce(col(source), F.lit("none")), F.coalesce(in_snapshot, F.lit(False))
    return F.when(closed_snapshot, "snapshot says closed").when(closed, "listing says closed").when((s == "meta") & snap, "meta + open in snapshot").when(s == "meta", "meta only") \
        .when(s.isin(*feeds) & snap, "brand feed + snapshot").when(s.isin(*feeds), "brand feed only").when(snap, "other source + snapshot") \
        .when(s == "Foursquare", "Foursquare only").when(s == "BrightQuery", "BrightQuery only").when(s == "Microsoft", "Microsoft only").otherwise("other")


def match_provenance(steps: list[tuple[str, DataFrame]], *, id: str) -> DataFrame:
    """(id, match, via): the first step that matched each row. Each step is DataFrame(id, match)."""
    rows = None
    for no, (label, df) in enumerate(steps):
        part = df.select(F.col(id), "match", F.lit(label).alias("via"), F.lit(no).alias("_no"))
        rows = part if rows is None else rows.unionByName(part)
    return top_rows(rows, [id], [F.asc("_no"), F.asc("match")]).select(id, "match", "via")


