"""License, visit and honor fields."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from . import vocab as V
from ._col import col, lookup, text


def license_number(c) -> Column:
    """Bare number of a prefixed license id; other ids unchanged."""
    s = text(c)
    n = F.regexp_extract(s, r"^[A-Z]{3}(\d+)$", 1)
    return F.when(n != "", n).otherwise(s)


def code_lookup(c, table: dict) -> Column:
    """Code to label; a code outside the table is null, never 'other'."""
    return lookup(table, c)


def county_name(c, fixes=V.COUNTY_FIXES) -> Column:
    s = F.replace(F.initcap(F.lower(F.trim(text(c)))), F.lit(" County"), F.lit(""))
    return F.when(F.trim(text(c)) != "", lookup(fixes, s, s))


def sparse_counts(values: dict[int, Column], skip=range(45, 50)) -> Column:
    """Wide count columns to "cat:n" text, without zeros and the reporting-only categories."""
    items = [F.when(F.coalesce(v.try_cast("int"), F.lit(0)) != 0, F.concat(F.lit(f"{k}:"), v.try_cast("int").cast("string")))
             for k, v in sorted(values.items()) if k not in skip]
    return F.array_join(F.array_compact(F.array(*items)), ",")


def sparse_counts_map(c) -> Column:
    """"cat:n" text as map<int,int>."""
    parts = F.filter(F.split(text(c), ","), lambda p: p.contains(":"))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(
        F.element_at(F.split(p, ":"), 1).try_cast("int").alias("key"), F.element_at(F.split(p, ":"), 2).try_cast("int").alias("value"))))


def license_active(status, expires, fetched, grace_days=V.GRACE_DAYS) -> Column:
    """Current, or delinquent for at most the grace days before the fetch day."""
    day = F.try_to_date(F.trim(text(expires)), "MM/dd/yyyy")
    late = F.datediff(F.lit(fetched).cast("date") if isinstance(fetched, (str, dt.date)) else fetched, day)
    return F.coalesce((col(status) == "20") | ((col(status) == "45") & late.between(0, grace_days)), F.lit(False))


def stable_id_source(license_no, name_key, lat, lon) -> Column:
    """License number, else name key and a ~100 m cell."""
    r = lambda c: F.format_number(F.bround(col(c), 3), "0.000")
    return F.coalesce(col(license_no), F.concat_ws("|", col(name_key), r(lat), r(lon)))


def stable_id(source) -> Column:
    return F.substring(F.md5(text(source)), 1, 12)


def tag_bitmask(*flags) -> Column:
    """Booleans to a bit mask, first flag lowest."""
    out = F.lit(0)
    for i, f in enumerate(flags):
        out = out + F.when(F.coalesce(col(f), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
    return out


def has_tag(mask, bit: int) -> Column:
    return col(mask).bitwiseAND(F.lit(1 << bit)) != 0


def own_honors(c) -> Column:
    """Honor lines about the place itself; lines about the owner's group are left out."""
    return F.array_join(F.filter(F.split(text(c), "; "), lambda h: ~h.contains("Restaurateur")), "; ")


def honor_flags(honors, oldest) -> Column:
    """1 classic, 2 winner, 4 finalist, 8 semifinalist, 16 oldest."""
    own = own_honors(honors)
    return tag_bitmask(own.contains("America's Classic"), own.rlike(r"\bwinner\b"), own.rlike("(?<!semi)finalist"),
                       own.contains("semifinalist"), col(oldest))


def zip_valid(c, pattern=r"^3[234]\d{3}") -> Column:
    """First five characters of a valid zip, else null."""
    s = F.trim(text(c))
    return F.when(s.rlike(pattern), F.substring(s, 1, 5))


def day_number(c, epoch="2000-01-01") -> Column:
    return F.datediff(col(c), F.lit(epoch).cast("date"))


def day_text(c) -> Column:
    return F.date_format(col(c), "MMMM d, yyyy")


def iso_day(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


HONOR_LEVEL = {"Recommended": 1, "Bib Gourmand": 2, "1 Star": 3, "2 Stars": 4, "3 Stars": 5}   # fixed values
TIER_CODE = {"listing": 0, "both": 1, "official": 2}                                            # fixed values


def distance_text(miles) -> Column:
    m = col(miles)
    return F.when(m < 0.1, F.lit("Here")).when(m < 10, F.concat(F.format_number(m, 1), F.lit(" mi"))).otherwise(
        F.concat(F.format_number(m, 0), F.lit(" mi")))


def tier_label(tier, licensed) -> Column:
    return F.when(col(licensed), F.lit("Licensed")).when(col(tier) == 1, F.lit("Confirmed listing")).otherwise(F.lit("Map listing"))


# fixed values: what the labels of a place say
HONOR_LABELS = ((1, "America's Classic"), (2, "James Beard winner"), (4, "James Beard finalist"), (8, "James Beard semifinalist"))
GROUP_HONOR = "James Beard (restaurateur)"
AWARD_LABELS = ("MICHELIN Recommended", "Bib Gourmand", "1 MICHELIN Star", "2 MICHELIN Stars", "3 MICHELIN Stars")
GUIDE_CHIPS = ((1, "Cuban & cafecito"), (2, "Stone crab"), (4, "Grouper & seafood"), (8, "Keys classic"), (16, "Oyster bar"), (32, "Fish camp"), (64, "Latin & Caribbean"))
OLDEST_BIT, CHAIN_MIN = 128, 5
KNOWN_BY = {"research": "On our hand-checked list (checked against a 2025 or 2026 source). The open map data didn't list it as a place to eat, so it's placed from its own map listing or street address.",
            "official": "From Florida's list of current food service licenses (DBPR). The open map data didn't have it, so its location comes from the license's street address.",
            "matched": "Matched to a current Florida DBPR food service license.",
            "confirmed": "A high-confidence listing in Overture's open map data.",
            "listing": "A single listing in Overture's open map data, so it may be closed or misfiled.",
            "rate": " Checked against Florida's restaurant licenses statewide, listings like this matched a current license %s of the time.",
            "checked": " It's also on our hand-checked list, checked against a 2025 or 2026 source."}


def honor_label(flags, honors=None) -> Column:
    """The best honor of ``flags`` (see ``honor_flags``); with ``honors`` the group honor where the place has no own one. Null: none."""
    own = F.coalesce(*[F.when(col(flags).bitwiseAND(F.lit(bit)) != 0, F.lit(label)) for bit, label in HONOR_LABELS])
    return own if honors is None else F.coalesce(own, F.when(col(honors).isNotNull(), F.lit(GROUP_HONOR)))


def place_chips(*, award, flags, honors, hand_checked, tags, founded, chain_n, tier, partner=None, most: int | None = None) -> Column:
    """Chips of a place in the order they are shown: award, honor, guides and founding year of hand-checked places, ``partner`` text, chain, bare listing."""
    has = lambda c: F.coalesce(col(c), F.lit(0))
    checked = F.coalesce(col(hand_checked), F.lit(False))
    bit = lambda b: has(tags).bitwiseAND(F.lit(b)) != 0
    bare = (col(tier) == 0) & (has(flags) == 0) & (has(award) == 0) & ~checked
    chips = [F.when(has(award).between(1, len(AWARD_LABELS)), F.get(F.array(*[F.lit(x) for x in AWARD_LABELS]), has(award).cast("int") - 1)), honor_label(has(flags), honors),
             *[F.when(checked & bit(b), F.lit(label)) for b, label in GUIDE_CHIPS],
             F.when(checked & bit(OLDEST_BIT), F.concat(F.lit("Since "), col(founded).cast("string"))), partner if partner is not None else F.lit(None).cast("string"),
             F.when(has(chain_n) >= CHAIN_MIN, F.concat(F.lit("Chain · "), col(chain_n).cast("string"))), F.when(bare, F.lit("Listing only"))]
    shown = F.array_compact(F.array(*chips))
    return shown if most is None else F.slice(shown, 1, most)


def how_we_know(source, tier, hand_checked, rate_text, texts=None) -> Column:
    """What a place rests on. ``tier`` 2 licensed, 1 confirmed, 0 listing; ``rate_text`` the measured match rate of listings like it, null where unknown."""
    t = {k: F.lit(v) for k, v in (texts or KNOWN_BY).items()}
    before, after = (texts or KNOWN_BY)["rate"].split("%s")
    rate = F.coalesce(F.concat(F.lit(before), col(rate_text), F.lit(after)), F.lit(""))
    listed = F.concat(F.when(col(tier) == 1, t["confirmed"]).otherwise(t["listing"]), rate, F.when(col(hand_checked), t["checked"]).otherwise(""))
    src = F.coalesce(col(source), F.lit(""))
    return F.when(src == "research", t["research"]).when((col(tier) == 2) & (src == "official"), t["official"]).when(col(tier) == 2, t["matched"]).otherwise(listed)
