"""Names and places as comparable text. Every function takes and returns a Column."""
from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import vocab as V
from ._col import any_word, chain, col, let, lookup, one_of, squeeze, steps, text, words

ACCENTS, PLAIN = "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ", "AAAAEEEEIIIIOOOOUUUUNC"


def fix_encoding(c) -> Column:
    """Stray inverted question marks and curly quotes to plain quotes, whitespace collapsed. Null stays null."""
    s = chain(c, [(r"(?<=[A-Za-z])\s?¿\s?(?=[A-Za-z])", "'"), ("¿", "'")])
    return squeeze(F.translate(s, "’‘´“”", "'''\"\""))


def norm_name(c, stop=V.STOP) -> Column:
    """Name key: upper case, plain letters and digits, no store numbers, no stop words. Null gives ''."""
    s = F.regexp_replace(F.upper(text(c)), "&", " AND ")
    s = F.regexp_replace(s, "['’¿]S", "S")
    s = F.regexp_replace(F.translate(s, ACCENTS, PLAIN), "[^A-Z0-9 ]", " ")
    return squeeze(F.regexp_replace(s, rf"\b(?:{any_word(stop)}|\d\d+)\b", " "))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def _relatin(c) -> Column:
    """UTF-8 bytes that were read as Latin-1, read again as UTF-8 where that is possible."""
    c = col(c)
    again = F.encode(c, "ISO-8859-1").cast("string")
    fits = c.rlike("[ÃÂ][\u0080-¿]") & c.rlike("^[\u0000-ÿ]*$")
    return F.when(fits, F.when(F.is_valid_utf8(again), again).otherwise(c)).otherwise(c)


def repair_mojibake(c) -> Column:
    """Listing name as meant: encoding repaired, entities decoded, keyword tails, former names and corporate suffixes cut."""
    cuts = lambda s: chain(s, [(r"\s*\|.*$", ""), (r"(?i)\s+f/?k/?a\s+.*$", "")])
    trade = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, r"(?i)\bd/?b/?a\.?\s+(.+)$", 1), F.lit("")), s)
    tails = lambda s: squeeze(chain(s, [(r"(?i)(?:,?\s+(?:Inc|LLC|L\.L\.C|Corp|Corporation|Ltd)\.?)+\s*$", ""),
                                        (r"(?<![&\s])(?<!\b[Aa]nd)(?<!\bAND),?\s+Co\.?\s*$", "")]))
    return steps(_unescape(_relatin(c)), cuts, trade, tails)


def _capital(w) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))


def _rejoin_capitals(t) -> Column:
    """Letters after - ( . & start upper case again."""
    parts = F.regexp_extract_all(t, F.lit(r"(^[^-(.&]+|[-(.&][^-(.&]*)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(
        p.rlike(r"^[-(.&][a-z]"),
        F.concat(F.substring(p, 1, 1), F.upper(F.substring(p, 2, 1)), F.substr(p, F.lit(3)))).otherwise(p)), "")


def _case_word(w, first, addr: bool) -> Column:
    return let(F.struct(F.lower(w).alias("low"), F.regexp_replace(F.lower(w), "[^a-z']", "").alias("core")),
               lambda p: _cased(w, p["low"], p["core"], first, addr))


def _cased(w, low, core, first, addr: bool) -> Column:
    always = (r"^(?:bbq|ii|iii|iv|usa|jj|kfc|ihop|tgi|atm|llc|bp|dj|pb|vfw|amvets|ymca|uf|fsu|ucf|usf|fiu|fau|[a-z])$")
    out = F.when(w == "", w)
    if not addr:
        out = out.when(~first & one_of(low, V.SMALL_WORDS), low)
    out = out.when(low == "bj's", F.lit("BJ's")).when(low.isin("a1a", "i-95", "i-4", "i-75", "i-10"), F.upper(w)) \
             .when(core.rlike(always), F.upper(w))
    if addr:
        out = out.when(core.rlike("^(?:ne|nw|se|sw|us|sr|cr)$"), F.upper(w))
    out = out.when(core.rlike("^(?:dj|bj|jj)'s$"), F.concat(F.upper(F.substring(core, 1, 2)), F.substr(core, F.lit(3))))
    if not addr:
        out = out.when(~one_of(core, V.NOT_ACRONYM) & core.rlike("^[b-df-hj-np-tv-xz]{2,4}$") & ~core.rlike(r"(.)\1\1"), F.upper(w))
    return out.when(low.rlike("^mc[a-z]{3}"), F.concat(F.lit("Mc"), _capital(F.substr(low, F.lit(3))))) \
              .when(low.rlike("^o'[a-z]{2}"), F.concat(F.lit("O'"), _capital(F.substr(low, F.lit(3))))) \
              .otherwise(_rejoin_capitals(_capital(low)))


def _without_unit(s) -> Column:
    """The address up to its street type when only a unit follows."""
    def cut(h):
        rest = F.substr(s, F.length(h) + 1)
        unit = rest.rlike(r"(?i)(\s+(BLDG|BLD|STE|SUITE|FL|FLR|FLOOR|UNIT|RM|LOWER LEVEL|LL|APT|SPACE|SP|BAY|STALL|KIOSK|#)\b.*$)|"
                          r"(\s+#?\d+[A-Z]?\s*$)")
        numbered = h.rlike(r"(?i)\b(?:HWY|HIGHWAY|US|SR|CR|RTE|ROUTE|ROAD|RD)\s*$") & rest.rlike(r"^\s*\d")
        return F.when((h != "") & unit & ~numbered, h).otherwise(s)
    return let(F.regexp_extract(s, r"(?i)^(\d+[A-Z]?(?:\s*-\s*\d+)?\s+.+?\b(?:ST|AVE|BLVD|DR|RD|PL|CT|PKWY|TER|WAY|LN|HWY|PLZ|SQ|CIR|"
                                   r"TRL|CSWY|PIKE|LOOP)\b(?:\s+(?:N|S|E|W|NE|NW|SE|SW)\b)?)", 1), cut)


def nice_case(c, addr: bool = False) -> Column:
    """Display casing of an all-capitals name, or (``addr``) of a street address without its dangling unit."""
    s = chain(squeeze(text(c)), [(r"(?i)\b(\w+)IES'S\b", "$1IE'S"), (r"(?i)'S\s+'S\b", "'S"), (r"(?i)\bMC\s+([A-Z]{2,})", "MC$1")])
    if addr:
        s = chain(s, [(r"[\s,]+$", ""), (r"(?i)\b(\w{3,})\s+\1\b", "$1"),
                      (r"(?i)(?<=\S)\s+(?:STE|SUITE|UNIT|APT|#)\s*[\w-]*$", "")])
        s = let(s, _without_unit)

    def spaced(w, i):
        pieces = F.regexp_extract_all(w, F.lit("([^/@&]+|[/@&])"), F.lit(1))
        return F.array_join(F.transform(pieces, lambda p, j: F.when(p.isin("/", "@", "&"), p)
                                        .otherwise(_case_word(p, (i == 0) & (j == 0), addr))), "")
    s = F.array_join(F.transform(F.split(s, " "), spaced), " ")
    s = F.replace(s, F.lit("Chick-Fil-A"), F.lit("Chick-fil-A"))
    if addr:
        for suffix in ("St", "Nd", "Rd", "Th"):
            s = F.regexp_replace(s, rf"\b(\d+){suffix}\b", "$1" + suffix.lower())
    return s


def canon_city(c, fixes=V.TOWN_FIXES) -> Column:
    """One spelling per town; null for empty text."""
    s = F.trim(F.regexp_replace(F.trim(text(c)), "^,+|,+$", ""))
    s = chain(s, [(r"(?i),?\s*(?:FL|Fla\.?|Florida)(?:\s+\d{5}(?:-\d{4})?)?$", ""), (r"(?i)^\s*(?:City|Town|Village)\s+of\s+", "")])
    u = squeeze(F.regexp_replace(F.upper(s), r"\.", ". "))
    u = chain(u, V.TOWN_ABBREVIATIONS)
    u = chain(u, [(r"^N\.?\s+", "NORTH "), (r"^S\.?\s+", "SOUTH "), (r"^E\.?\s+", "EAST "), (r"^W\.?\s+", "WEST "),
                  (r"\b(?:SAINT|ST)\b\.?\s*", "ST. ")])
    u = squeeze(u)

    def cased(w, i):
        low = F.lower(w)
        pieces = F.regexp_extract_all(low, F.lit("(^[^-']+|[-'][^-']*)"), F.lit(1))
        up = F.array_join(F.transform(pieces, lambda p: F.when(
            p.rlike("^[-'][a-z]"), F.concat(F.substring(p, 1, 1), _capital(F.substr(p, F.lit(2))))).otherwise(_capital(p))), "")
        return F.when((i > 0) & low.isin("of", "the", "by", "in", "on", "de", "del", "la"), low).when(w == "ST.", F.lit("St.")).otherwise(up)
    town = let(u, lambda v: F.coalesce(lookup(fixes, F.regexp_replace(v, "[^A-Z]", "")), F.array_join(F.transform(F.split(v, " "), cased), " ")))
    return F.when(F.trim(text(c)) != "", town)


def town_key(c) -> Column:
    """Letters-only key for comparing town spellings."""
    s = F.replace(F.lower(text(c)), F.lit("."), F.lit(" "))
    s = chain(s, [(r"^e\s+", "east "), (r"^n\s+", "north "), (r"^s\s+", "south "), (r"^w\s+", "west "), (r"\bmt\b", "mount"),
                  (r"\bhts\b", "heights"), (r"\bft\b", "fort"), (r"\bpt\b", "port"), (r"\bbch\b", "beach"), (r"\bsaint\b", "st")])
    return F.regexp_replace(s, "[^a-z]", "")


def name_stems(key, generic=V.GENERIC) -> Column:
    """Distinctive words of a name key: no generic words, plural S dropped from longer words."""
    own = F.filter(words(key), lambda w: ~one_of(w, generic))
    stems = F.transform(own, lambda w: F.when((F.length(w) > 3) & w.endswith("S"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.filter(stems, lambda w: ~one_of(w, generic)))


def name_kinds(key, kinds=V.KINDS) -> Column:
    """Labels of what the name says the place serves."""
    return F.array_distinct(F.filter(F.transform(words(key), lambda w: lookup(kinds, w)), lambda k: k.isNotNull()))


def kind_conflict(a, b, kinds=V.KINDS) -> Column:
    ka, kb = name_kinds(a, kinds), name_kinds(b, kinds)
    return (F.size(ka) > 0) & (F.size(kb) > 0) & ~F.arrays_overlap(ka, kb)


# --- P16-P20, P36-P38 ------------------------------------------------------------------------------------------------------
def _quoted(c) -> Column:
    """The text as a literal inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.regexp_replace(text(c), r"\\E", ""), F.lit(r"\E"))


def clean_listing_name(name, city, brand, is_town=None) -> Column:
    """Name without its town/state tail. ``is_town(column)`` tells whether a lower-case text is a town's name. Only chains drop a bare
    town; a name that is only a town gives way to the brand, else null."""
    is_town = is_town or (lambda c: F.lit(False))
    n0, town = F.trim(text(name)), F.trim(text(city))
    has_town, chain_ = town != "", F.coalesce(F.trim(col(brand)) != "", F.lit(False))
    cut = lambda n, head, tail: F.regexp_replace(n, F.concat(F.lit(head), _quoted(town), F.lit(tail)), F.lit(""))

    def bare_town(n):
        bare = F.call_function("regexp_extract", n, F.concat(F.lit(r"(?i)^(.*\S)\s+"), _quoted(town), F.lit("$")), F.lit(1))
        return let(bare, lambda b: F.when((b != "") & ~b.rlike(r"(?i)\b(?:of|in|at|de|del|la|el|the|and|&|du|on)$")
                                          & (F.size(name_stems(norm_name(b))) > 0) & chain_, b).otherwise(n))
    own_town = steps(cut(cut(n0, r"(?i)(?:\s*[-–|,:]\s*|\s(?:of|in|at)\s+|\s|^)", r",?\s*(?:FL|Florida)\.?\s*$"), r"(?i)\s*[-–|:]\s*", r"\s*$"), bare_town,
                     lambda n: F.when(F.lower(F.trim(n)) == F.lower(town), F.lit("")).otherwise(n))
    n = steps(F.when(has_town, own_town).otherwise(n0), lambda n: F.when(is_town(F.lower(F.trim(n))), F.lit("")).otherwise(n),
              lambda n: chain(n, [(r"\s*(?:[-–|,:]\s*|\s(?:of|in|at)\s+)[A-Z][A-Za-z.' ]{1,30},\s*(?:FL|Florida)\.?\s*$", ""), (r"^[ \-–|,]+|[ \-–|,]+$", "")]))
    only_town = F.regexp_extract(n0, r"^([A-Za-z.' ]+),\s*(?:FL|Florida)$", 1)
    nothing = (only_town != "") & is_town(F.lower(F.trim(only_town)))
    return let(n, lambda v: F.when((v == "") | nothing, F.when(chain_, col(brand))).otherwise(v))


def split_trade_names(*cols) -> Column:
    """Ordered distinct name keys from business, trade and legal names, each split at '/', DBA and AKA."""
    def keys(c):
        parts = F.split(text(c), r"(?i)\s*/\s*|\s+\bd/?b/?a\b\.?\s+|\s+\bAKA\b\s+")
        return F.transform(parts, lambda p: norm_name(F.regexp_replace(
            p, r"(?i)\b(?:LLC|L L C|INC|CORP|CORPORATION|LTD|CO|PA|LLP|LP|PLLC)\b\.?", "")))
    return F.array_distinct(F.filter(F.flatten(F.array(*[keys(c) for c in cols])), lambda k: k != ""))


# fixed values: legal and holder words
LEGAL_END = r"(?i)\b(?:INC|LLC|L L C|CORP|CORPORATION|LTD|LLP|LP|PA|PLLC|CO)\b\.?\s*$"
LEGALISH = (r"(?i)\b(?:HOLDINGS?|ENTERPRISES?|GROUP|MANAGEMENT|VENTURES?|PARTNERS|PARTNERSHIP|INVESTMENTS?|PROPERTIES|OPERATIONS|"
            r"OPERATING|DEVELOPMENT|ASSOCIATES|CAPITAL|SERVICES|SOLUTIONS|FRANCHISE|FRANCHISING|CONCEPTS|HOSPITALITY|"
            r"OF FLORIDA|OF FL|OF AMERICA|USA|INTERNATIONAL|DEVEL|PRTNRS|PTNRS)\b")
HOLDER = (r"(?i)\b(?:INN|HOTEL|RESORT|SUITES|MOTEL|LODGE|HILTON|MARRIOTT|HYATT|COURTYARD|SHERATON|WYNDHAM|ALOFT|TEMPLE|CHURCH|HOSPITAL|"
          r"MEDICAL|SCHOOL|UNIVERSITY|COLLEGE|ACADEMY|ASSOCIATION|LEGION|ELKS|MOOSE|SHRINE|SODEXO|ARAMARK|EUREST|MORRISON)\b")
FOODISH = (r"(?i)\b(?:restaurant|cafe|café|grill|kitchen|pizza|bar|pub|tavern|bistro|diner|deli|bakery|coffee|seafood|sushi|taco|burger|bbq|"
           r"cantina|eatery|steak|wings|subs|sandwich|cuban|oyster|crab|fish|chicken|thai|chinese|mexican|italian|indian|"
           r"juice|smoothie|ice cream|donut|bagel|tea|boba|pho|ramen|noodle|buffet|lounge|saloon|brewing|brewery|cuisine|cocina|comida)\b")


def legal_flags(c) -> Column:
    """struct(is_legal, legalish, holder, foodish) of one name."""
    s = text(c)
    return F.struct(s.rlike(LEGAL_END).alias("is_legal"), s.rlike(LEGALISH).alias("legalish"), s.rlike(HOLDER).alias("holder"),
                    s.rlike(FOODISH).alias("foodish"))


def strip_official(c) -> Column:
    """Business name without store numbers, corporate suffixes and notes."""
    x = F.element_at(F.split(text(c), r"\s*;\s*"), 1)
    x = chain(x, [(r"(?i)\s*\((?:MOBILE|CATERING|CP|INSIDE [^)]*|AT [^)]*)\)\s*$", ""),
                  (r"\s*#\s*\d+\w*.*$|\s*\(#?[A-Z]?\d+\)|\s+(?:STORE|UNIT|NO\.?)\s*\d+\s*$|\s+\d{3,}\s*$", ""),
                  (r"(?i)(?:(?:,?\s+|\.)(?:INC|LLC|L\.L\.C|L L C|CORP|CORPORATION|LTD|LLP|PLLC|P\.A)\.?)+\s*$", "")])
    def place(x):
        civic = F.regexp_replace(x, r"(?i)^(?:THE\s+)?(?:CITY|TOWN|COUNTY|VILLAGE) OF\s+.*$", "")
        return F.coalesce(F.nullif(civic, F.lit("")), x)

    def trade(x):
        legal_head = x.contains("/") & F.element_at(F.split(x, "/"), 1).rlike(r"(?i)\b(?:INC|LLC|CORP)\b")
        return F.when(legal_head, F.element_at(F.split(x, r"\s*/\s*"), -1)).otherwise(x)
    x = steps(x, place, lambda v: F.regexp_replace(v, r"(?i)\s+DBA\s+", " / "), trade)
    return F.regexp_replace(x, r"^[ \-,&/.]+|[ \-,&/.]+$", "")


def clean_official_name(name, trade_names, brand=None) -> Column:
    """Name to show for a registered business; a legal-entity name yields to the first plain trade name, else to the brand."""
    brand = F.lit(None).cast("string") if brand is None else col(brand)
    plain = F.filter(F.transform(F.coalesce(col(trade_names), F.array().cast("array<string>")),
                                 lambda d: F.struct(strip_official(d).alias("s"), d.rlike(LEGAL_END).alias("legal"))),
                     lambda d: (d["s"] != "") & ~d["legal"] & ~d["s"].rlike(LEGALISH) & (norm_name(d["s"]) != ""))
    weak = lambda n: (n == "") | text(name).rlike(LEGAL_END) | n.rlike(LEGALISH)
    by_trade = lambda n: F.when(weak(n), F.coalesce(F.get(plain, 0)["s"], n)).otherwise(n)
    by_brand = lambda n: F.when(brand.isNotNull() & ((n == "") | n.rlike(LEGALISH) | F.startswith(norm_name(n), norm_name(brand))), brand).otherwise(n)
    cased = lambda n: F.when(((n == F.upper(n)) | (n == F.lower(n))) & n.rlike("[A-Za-z]"), nice_case(n)).otherwise(n)
    return steps(strip_official(name), by_trade, by_brand, cased)


# fixed values: marketing tails and scripts
_CJK = "[぀-ヿ㐀-鿿가-힣豈-﫿＀-￯]"
_EMOJI = "[\\x{1F000}-\\x{1FAFF}☀-➿️‍]+"
_TAIL = (r"(?i)^(?:best|award|voted|magazine|official|order|delivery|takeout|take out|catering|now open|open|to go|curbside|franchise|"
         r"inside .*|(?:(?:ice cream|chocolates?|fudge|coffee|cafe|café|restaurant|bar|grill|pizza|shawarma|hookah lounge|juicy seafood|"
         r"latin tavern|bakery|deli|sandwiches|tacos|gifts?|shopping|treats|sweets|full bar|food|game room|drinks|spirits|live music|"
         r"events|patio|lodging|rooms|resort|motel|campground|cocktails|beer|wine|burgers|wings|craft beer|sports bar|seafood|raw bar|"
         r"tiki bar|waterfront|beachfront|dock ?side|and|&|,|-|\s)+))$")


def tidy_display_name(name, brand=None) -> Column:
    """Name as shown: NFKC, no emoji, no second script, no LLC in the middle, no marketing or notes at the end."""
    def one_script(n):
        latin = F.regexp_replace(n, _CJK + "+", " ")
        return F.when(latin.rlike("[A-Za-z]{3,}") & n.rlike(_CJK), F.regexp_replace(latin, r"\(\s*\)", "")).otherwise(n)

    def legal_middle(n):
        llc = r"(?i)^(.*?)[,\s]+(?:LLC|Inc)\.?\s*-{1,2}\s*(.+)$"
        head, tail = F.regexp_extract(n, llc, 1), F.regexp_extract(n, llc, 2)
        pick = F.when((F.size(words(squeeze(tail))) >= 2) & (F.size(words(squeeze(head))) <= 2), tail).otherwise(head)
        return F.regexp_replace(F.when(n.rlike(llc), pick).otherwise(n), r"(?i)[,\s.]+(?:LLC|L\.L\.C|LLP|L\.L\.P|Inc|Corp)\.?(?=\s|$|,)", "")

    def unless_empty(pattern, replacement=""):
        def rule(n):
            cut = F.regexp_replace(n, pattern, replacement)
            return F.when(F.trim(cut) != "", cut).otherwise(n)
        return rule

    def no_promo(n):
        parts = F.split(n, r"\s+[-–]{1,2}\s+|--")
        rest = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ")
        promo = F.trim(rest).rlike(_TAIL) | rest.rlike(r"\b(?:Best|Award|Magazine|Voted|20\d\d)\b")
        return F.when((F.size(parts) > 1) & promo, F.element_at(parts, 1)).otherwise(n)

    rules = [_relatin, lambda n: chain(n, [(_EMOJI, ""), ("[®™©℠]", "")]),
             lambda n: F.when(F.regexp_replace(n, _CJK, "").rlike("[A-Za-z]{3,}"), F.regexp_replace(n, rf"\s*\([^()]*{_CJK}[^()]*\)", "")).otherwise(n),
             one_script, legal_middle, unless_empty(r"\s*\([^()]*\)\s*$"), lambda n: F.regexp_replace(n, r",?\s+(?:FL|Fla\.?|Florida)\s*$", ""), no_promo]
    if brand is not None:
        rules.append(lambda n: F.when(col(brand).isNotNull(), F.regexp_replace(n, r"\s*#\s*\d+\s*$", "")).otherwise(n))
    rules += [squeeze, unless_empty(r"^[ \-–,]+|[ \-–,]+$"), lambda n: F.regexp_replace(n, r"^(.+?),?\s+(?:THE|The|the)$", "The $1"),
              unless_empty(r"(?:\s+(?:of|OF|Of|and|AND|And|&|at|AT|At|de|DE|De|the|THE))+$"),
              lambda n: F.when((n == F.upper(n)) & n.rlike("[A-Z]") & (F.length(n) > 4), nice_case(n)).otherwise(n)]
    return steps(_nfkc(text(name)), *rules)


# --- P26, P27, P31 -----------------------------------------------------------------------------------------------------------
# fixed values: search spellings of street words
TYPE_SYNONYMS = {"avenue": "ave", "av": "ave", "street": "st", "boulevard": "blvd", "road": "rd", "drive": "dr", "place": "pl", "court": "ct",
                 "parkway": "pkwy", "highway": "hwy", "lane": "ln", "trail": "trl", "circle": "cir", "terrace": "ter"}
SEARCH_SYNONYMS = {**TYPE_SYNONYMS, "north": "n", "south": "s", "east": "e", "west": "w", "northwest": "nw", "northeast": "ne",
                   "southwest": "sw", "southeast": "se", "saint": "st", "mount": "mt", "fort": "ft"}
_FOLD_FROM = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ"
_FOLD_TO = "aaaaaaaeeeeeiiiiioooooouuuuuncyy"


def search_normalize(c) -> Column:
    """Search form: lower case, accents and apostrophes gone, '&' as and (B&B as bb), the rest single spaces."""
    s = F.translate(F.lower(text(c)), _FOLD_FROM, _FOLD_TO)
    s = F.regexp_replace(s, r"\b([a-z0-9])\s*&\s*([a-z0-9])\b", "$1$2")
    s = chain(s, [("&", " and "), ("['’`]", ""), (r"[^\p{L}\p{N}]+", " ")])
    return F.trim(s)


def search_normalize_address(c, synonyms=None) -> Column:
    syn = SEARCH_SYNONYMS if synonyms is None else synonyms
    return F.array_join(F.transform(F.split(search_normalize(c), " "), lambda w: lookup(syn, w, w)), " ")


def search_text(*cols, address=None) -> Column:
    """Space-padded searchable text; the address joins in its abbreviated form."""
    own = F.concat(F.lit(" "), search_normalize(F.concat_ws(" ", *[col(c) for c in cols])), F.lit(" "))
    return own if address is None else F.concat(own, search_normalize_address(address), F.lit(" "))


def slug(c) -> Column:
    s = F.translate(F.lower(text(c)), _FOLD_FROM, _FOLD_TO)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "['’]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def label_to_brand(name, brand, source, similarity, feeds=("AllThePlaces", "DAC"), below=70) -> Column:
    """A feed's store label gives way to the brand when the two names have little in common."""
    use = (F.trim(text(brand)) != "") & col(source).isin(*feeds) & (similarity < below)
    return F.when(use, col(brand)).otherwise(col(name))


def first_real_source(arr, ignore=("Overture", "Overture-signals")) -> Column:
    return F.try_element_at(F.filter(col(arr), lambda s: ~s.isin(*ignore)), F.lit(1))


def brand_display_name(name, brand, similarity) -> Column:
    """The brand's own spelling when the name is nearly the brand, is hardly longer, or starts with it."""
    nk, bk = norm_name(name), norm_name(brand)
    near = (similarity >= 80) | (F.length(nk) <= F.length(bk) + 2) | (F.startswith(nk, bk) & (F.length(bk) >= 3))
    out = F.when(col(brand).isNotNull() & near, col(brand)).otherwise(col(name))
    return chain(out, [(r"(?i)\btcby\b", "TCBY"), (r"(?i)\bihop\b", "IHOP"), (r"(?i)\bbj'?s\b", "BJ's")])
