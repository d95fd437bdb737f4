"""Street addresses as comparable keys. Column in, Column out."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab as V
from ._col import chain, let, lookup, one_of, squeeze, text, words

# fixed values: units, house numbers
_UNIT = (r"\s(?:(?:STE|SUITE|UNIT|APT|PMB|DEPT|TRLR)\b|#|(?:BLDG|BLD|BUILDING|SPACE|SP|SPC|BAY|LOT|KIOSK|FLOOR|FL|FLR|RM|ROOM|STALL|"
         r"SHOP|BOOTH)\s*#?\s*[A-Z]?-?\d).*$")
_NUMBERED = r"^(\d+)[A-Z]?(?:\s*-\s*\d+[A-Z]?)?(?:\s+1/2)?\s+(.+)$"
_US = "|".join(str(n) for n in V.US_ROUTE_NUMBERS)
# fixed values: spellings of numbered roads and compound names
ROAD_STEPS = (
    (r"\bU\.?\s?S\.?(?=\s|-)", "US"), (r"\b(US|SR|CR|FL|I)-(\w)", "$1 $2"), (r"\bUS\s+(?:HIGHWAY|HWY|ROUTE|RTE|RT)\b", "US"),
    (r"\b(?:STATE\s+(?:ROAD|RD|HIGHWAY|HWY|ROUTE|RT|RTE)|ST\s+RD|FL\s+(?:HWY|HIGHWAY|STATE ROAD)|FLORIDA\s+(?:HWY|HIGHWAY|STATE ROAD)|"
     r"FL(?=\s+\d)|SR)\b", "SR"),
    (r"\b(?:COUNTY\s+(?:ROAD|RD|HIGHWAY|HWY|ROUTE)|CO\s+(?:RD|ROAD|HWY)|CTY\s+(?:RD|ROAD|HWY)|CR)\b", "CR"),
    (r"\b(?:HIGHWAY|HWY|SR|STATE ROAD)\s+A\s?1\s?A\b|\bA\s1\sA\b", "A1A"), (r"\bINTERSTATE\b", "I"),
    (rf"(?<!US )(?<!SR )(?<!CR )\b(?:HWY|HIGHWAY)\s+(?=(?:{_US})\b)", "US "),
    (r"(?<!US )(?<!SR )(?<!CR )(?<!I )\b(?:HWY|HIGHWAY)\s+(?=\d)", "SR "),
    (r"\b(OCEAN|BAY|LAKE|SEA|RIVER|GULF|CREEK|HARBOR|PALM)\s+(SHORE|SHORES|VIEW|BREEZE|SIDE|FRONT|WAY)\b", "$1$2"))


def road_norm(c) -> Column:
    """One spelling for numbered roads and compound road names."""
    return chain(F.upper(text(c)), ROAD_STEPS)


def split_house_number(c) -> Column:
    """struct(num, street): leading house number and the rest without its unit; both null when there is no number."""
    s = F.trim(F.regexp_replace(F.concat(F.lit(" "), squeeze(F.upper(text(c)))), _UNIT, ""))
    num, rest = F.regexp_extract(s, _NUMBERED, 1), F.regexp_extract(s, _NUMBERED, 2)
    return F.struct(F.when(num != "", num).alias("num"), F.when(num != "", rest).alias("street"))


def _street_words(street) -> Column:
    s = chain(road_norm(street), [(r"\bN\.W\.", "NW"), (r"\bN\.E\.", "NE"), (r"\bS\.W\.", "SW"), (r"\bS\.E\.", "SE"),
                                  ("[.,]", " "), ("[^A-Z0-9 /&-]", " ")])
    table = {**V.ORDINALS, **V.STREET_TYPE_WORDS, **V.DIRECTION_WORDS}
    return F.transform(words(squeeze(s)), lambda w: F.regexp_replace(lookup(table, w, w), r"^(\d+)(?:ST|ND|RD|TH)$", "$1"))


def _cut_after_type(w) -> Column:
    """Street words up to the first street type that is not the first word, with one direction after it; at most six."""
    def cut(at):
        after = F.try_element_at(w, at + 1)
        keep = F.when(at.isNull(), F.size(w)).when(one_of(after, V.DIRECTIONS), at + 1).otherwise(at)
        return F.array_join(F.slice(w, F.lit(1), F.greatest(F.least(keep, F.lit(6)), F.lit(0))), " ")
    return let(F.array_min(F.filter(F.transform(w, lambda x, i: F.when(one_of(x, V.STREET_TYPES) & (i > 0), i + 1)), lambda i: i.isNotNull())), cut)


def street_key(c) -> Column:
    """struct(num, street): house number and normalised street, cut after the street type (one trailing direction kept)."""
    return let(split_house_number(c), lambda base: F.struct(base["num"].alias("num"), F.when(base["num"].isNotNull(), F.nullif(
        let(_street_words(base["street"]), _cut_after_type), F.lit(""))).alias("street")))


def _core(street) -> Column:
    return F.filter(words(street), lambda w: ~one_of(w, V.DIRECTIONS) & ~one_of(w, V.STREET_TYPES))


def core_street(street) -> Column:
    """Street key without directions and types; null when nothing is left."""
    s = F.array_join(_core(street), " ")
    return F.when(s != "", s)


def core_key(c) -> Column:
    """struct(num, street) with the core street."""
    return let(street_key(c), lambda k: F.struct(F.when(k["street"].isNotNull(), k["num"]).alias("num"), core_street(k["street"]).alias("street")))


def street_number_range(c) -> Column:
    """All house numbers of "157-159 Main St" as strings: step two for equal parity, at most a span of twelve, "1500-02" completed."""
    s = F.concat(F.upper(text(c)), F.lit(" "))
    rx = r"^\s*(\d+)[A-Z]?(?:\s*-\s*(\d+)[A-Z]?)?\s"
    lo_t, hi_t = F.regexp_extract(s, rx, 1), F.regexp_extract(s, rx, 2)
    lo = F.expr("0").cast("bigint") + lo_t.try_cast("bigint")
    hi0 = F.coalesce(hi_t.try_cast("bigint"), lo)
    short = F.concat(F.substring(lo_t, F.lit(1), F.greatest(F.length(lo_t) - F.length(hi_t), F.lit(0))), hi_t).try_cast("bigint")
    hi = F.when(hi0 < lo, F.coalesce(short, lo)).otherwise(hi0)
    span = hi - lo
    fits = span.between(0, 12)
    seq = F.sequence(lo, F.when(fits, hi).otherwise(lo), F.when(span % 2 == 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint"))
    return F.when(lo.isNotNull(), F.transform(seq, lambda n: n.cast("string"))).otherwise(F.array().cast("array<string>"))


def street_compat(a, b) -> Column:
    """Do two street keys denote one street: equal, or the same core words with no contradicting direction or type."""
    a, b = text(a), text(b)
    pick = lambda s, values: F.filter(words(s), lambda w: w.isin(*values))
    ca, cb = _core(a), _core(b)
    da, db, ta, tb = pick(a, V.DIRECTIONS), pick(b, V.DIRECTIONS), pick(a, V.STREET_TYPES), pick(b, V.STREET_TYPES)
    clash = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    numbered = F.coalesce(F.try_element_at(ca, F.lit(-1)).rlike(r"^\d+$"), F.lit(False))
    return F.when((a == "") | (b == ""), F.lit(False)).when(a == b, F.lit(True)) \
            .otherwise((F.size(ca) > 0) & (F.array_join(ca, " ") == F.array_join(cb, " ")) & ~clash(da, db) & ~(clash(ta, tb) & numbered))


# fixed values: free words around an address, and the address itself
_FREE = r"(?i)located in|please|between|next to|inside|back door|entrance|across from"
_ADDRESS = (r"(?i)((?:\d+[A-Z]?)\s+(?:[NSEW]\.?\s+)?[\w.' ]+?\b(?:St|Street|Ave|Avenue|Dr|Drive|Rd|Road|Blvd|Ln|Lane|Way|Ct|Pl|Hwy|Pkwy|"
            r"Trl|Pike|Cir|Ter)\b\.?(?:\s*(?:#|Ste|Suite|Unit)\s*\w+)?)")
TOWN_TAIL = r",\s*([A-Za-z .']+?),\s*(?:FL|Fl|Florida)\b.*$"


def tidy_street(c) -> Column:
    """struct(street, town): the street address inside free-text directions, and the town of a trailing ", Town, FL"."""
    s = text(c)
    hits = F.regexp_extract_all(s, F.lit(_ADDRESS), F.lit(1))
    s = F.when(s.rlike(_FREE) & (F.size(hits) > 0), F.trim(F.try_element_at(hits, F.lit(-1)))).otherwise(s)
    town = F.regexp_extract(s, TOWN_TAIL, 1)
    return F.struct(F.regexp_replace(s, TOWN_TAIL, "").alias("street"), F.when(town != "", town).alias("town"))
