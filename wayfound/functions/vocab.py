"""Default word lists and lookup tables. Every function that uses one takes it as a parameter."""

# --- fixed values: name keys -------------------------------------------------------------------------------------------------
STOP = ("THE", "INC", "LLC", "CO", "CORP", "RESTAURANT", "RESTAURANTS", "AND", "OF", "LTD", "CAFE")
FILLER = ("RESTAURANT", "RESTAURANTS", "CAFE", "CO", "INC", "LLC", "CORP", "AND")
GENERIC = tuple(dict.fromkeys("""
PIZZA PIZZERIA PHO TACO TACOS TAQUERIA GRILL GRILLE KITCHEN EXPRESS HOUSE COFFEE BAR PUB TAVERN FOOD FOODS STORE SHOP MARKET
DELI BAKERY CHICKEN FISH BBQ SUSHI THAI CHINESE MEXICAN INDIAN ITALIAN GYROS BURGER BURGERS WINGS DONUTS DONUT BEEF TEA JUICE
NORTH SOUTH EAST WEST PARK SQUARE STATION UNION TOWN VILLAGE STREET AVE AVENUE CENTER PLAZA LAKE LAKES RIVER BAY
NEW OLD BEST GOLDEN LITTLE BIG KING STAR ORIGINAL FAMOUS FRESH HOT GRAND LA EL LOS LAS DE DEL ON THE Y AT OF LOUNGE SNACK SNACKS
NOODLE NOODLES ASIAN SHRIMP PATIO CLUB INN LODGE SALOON RESORT BREWING BREWERY COMPANY BREW HALL FROZEN CHEESE
FRY BAKE CAFETERIA CORNER SPOT STOP PLACE ROOM SPORTS FAMILY STEAKHOUSE STEAK DINER CREAMERY ICE CREAM
HUT WOK MEAL FUSION BUFFET CUISINE EATS EATERY BISTRO TAPROOM TAPHOUSE DEN TRADING POST
FLORIDA FLA KEY KEYS BEACH BEACHES OCEAN OCEANFRONT TROPICAL TROPICS ISLAND ISLANDS PALM PALMS SUNSHINE GULF COAST COASTAL BAYSIDE
MARINA DOCK DOCKSIDE HARBOR HARBOUR SUNSET SUNRISE PIER CRAB CRABS OYSTER OYSTERS STONE SEAFOOD RAW CUBAN CUBANA LATIN LATINO
CARIBBEAN SANDWICH SANDWICHES SUBS CANTINA RESTAURANTE COCINA PANADERIA FRITANGA VENTANITA SABOR SABORES CASA MI TU SU MAR SOL
LUNA HOGAR TIPICO TIPICA CRIOLLA""".split()))
KINDS = {
    "PIZZA": "pizza", "PIZZERIA": "pizza", "SUSHI": "japanese", "JAPANESE": "japanese", "HIBACHI": "japanese", "RAMEN": "japanese",
    "TEA": "tea", "BOBA": "tea", "FISH": "seafood", "SEAFOOD": "seafood", "OYSTER": "seafood", "OYSTERS": "seafood",
    "CRAB": "seafood", "CRABS": "seafood", "SHRIMP": "seafood", "TACO": "mexican", "TACOS": "mexican", "TAQUERIA": "mexican",
    "MEXICAN": "mexican", "CANTINA": "mexican", "CHINESE": "chinese", "WOK": "chinese", "THAI": "thai", "INDIAN": "indian",
    "ITALIAN": "italian", "BBQ": "bbq", "PHO": "vietnamese", "GYROS": "greek", "BURGER": "burger", "BURGERS": "burger",
    "CHICKEN": "chicken", "WINGS": "chicken", "DONUT": "donut", "DONUTS": "donut", "BAKERY": "bakery", "PANADERIA": "bakery",
    "STEAKHOUSE": "steak", "STEAK": "steak", "CREAMERY": "icecream", "FROZEN": "icecream", "YOGURT": "icecream",
    "JUICE": "juice", "COFFEE": "coffee",
}
TOWN_WORD_EXTRAS = tuple("""
AMELIA SIESTA CAPTIVA LONGBOAT BRICKELL WYNWOOD YBOR KENDALL COCONUT DOWNTOWN MIDTOWN UPTOWN SOBE OLAS ANNA MARIA HUTCHINSON
PERDIDO OKALOOSA SANTA ROSA DESTIN WALTON BAYSHORE WPB JAX KERNAN BEACHES FTL TERMINAL CONCOURSE GATE AIRPORT TYRONE ST""".split())

# --- fixed values: display case ----------------------------------------------------------------------------------------------
SMALL_WORDS = ("of", "and", "the", "on", "at", "in", "de", "la", "el", "y", "du", "del", "da", "di", "los", "las", "by")
NOT_ACRONYM = ("mr", "mrs", "ms", "st", "dr", "jr", "sr", "pl", "ct", "rd", "ln", "blvd", "pkwy", "hwy", "sq", "cr", "th", "nd", "mc",
               "cty", "trl", "cir", "ste", "fl", "wy", "rr", "rt", "ne", "nw", "se", "sw", "bch", "pk", "pt", "ft", "mt")

# --- fixed values: towns -----------------------------------------------------------------------------------------------------
TOWN_ABBREVIATIONS = (
    (r"\bBCH\b", "BEACH"), (r"\bBCHS\b", "BEACHES"), (r"\bSPGS?\b|\bSPRGS?\b", "SPRINGS"), (r"\bGDNS?\b|\bGARDEN\b(?=$)", "GARDENS"),
    (r"\bHTS\b", "HEIGHTS"), (r"\bLK\b", "LAKE"), (r"\bPK\b", "PARK"), (r"\bPT\b", "PORT"), (r"\bFT\b", "FORT"), (r"\bMT\b", "MOUNT"),
    (r"\bVLG\b", "VILLAGE"), (r"\bSHRS\b", "SHORES"), (r"\bIS\b|\bISL\b", "ISLAND"), (r"\bCV\b", "COVE"), (r"\bPNTE\b", "PONTE"),
    (r"\bVDRA\b", "VEDRA"), (r"\bJAX\b", "JACKSONVILLE"))
TOWN_FIXES = {
    "STPETE": "St. Petersburg", "STPETERSBURG": "St. Petersburg", "STPETESBURG": "St. Petersburg", "STPETETRSBURG": "St. Petersburg",
    "STPETEBEACH": "St. Pete Beach", "STPETERSBURGBEACH": "St. Pete Beach", "STJOHNS": "St. Johns", "STJOHNSCOUNTY": "St. Johns",
    "STAUGUSTINE": "St. Augustine", "STAUGUSTINEBEACH": "St. Augustine Beach", "PORTSTLUCIE": "Port St. Lucie",
    "PORTSTJOE": "Port St. Joe", "PORTSTJOHN": "Port St. John", "DEFUNIAKSPRINGS": "DeFuniak Springs", "DELAND": "DeLand",
    "DEBARY": "DeBary", "LABELLE": "LaBelle", "MCINTOSH": "McIntosh", "MIAMIDADE": "Miami", "HALLANDALE": "Hallandale Beach",
    "SUNNYISLES": "Sunny Isles Beach", "LAUDERDALEBYTHESEA": "Lauderdale-by-the-Sea", "LAUDERDALEBYSEA": "Lauderdale-by-the-Sea",
    "PONTEVEDRE": "Ponte Vedra", "PONTEVEDREBEACH": "Ponte Vedra Beach", "INDIANHARBORBEACH": "Indian Harbour Beach",
    "TOWNNCOUNTRY": "Town 'n' Country", "TOWNANDCOUNTRY": "Town 'n' Country", "FORTWALTON": "Fort Walton Beach",
    "DAYTONABEACHSHORES": "Daytona Beach Shores", "OPALOCKA": "Opa-locka", "OPALOCKS": "Opa-locka",
    "HOWEYINTHEHILLS": "Howey-in-the-Hills", "CAPECANAVERAL": "Cape Canaveral", "LAKEBUENAVISTA": "Lake Buena Vista",
    "ALTAMONTESPRINGS": "Altamonte Springs", "STTEAUGUSTINE": "St. Augustine", "WESTPALMBEACH": "West Palm Beach",
    "NORTHPALMBEACH": "North Palm Beach", "PALMBEACHGARDENS": "Palm Beach Gardens", "MIAMIBEACH": "Miami Beach",
    "NORTHMIAMIBEACH": "North Miami Beach", "FORTLAUDERDALE": "Fort Lauderdale", "FORTMYERS": "Fort Myers",
    "FORTMYERSBEACH": "Fort Myers Beach", "NORTHFORTMYERS": "North Fort Myers", "FORTPIERCE": "Fort Pierce",
    "FORTWALTONBEACH": "Fort Walton Beach", "FORTMEADE": "Fort Meade", "WINTERGARDENS": "Winter Garden", "KISSIMEE": "Kissimmee",
    "HIALIAH": "Hialeah", "FORTWHITE": "Fort White", "KEYWEST": "Key West", "KEYLARGO": "Key Largo", "KEYBISCAYNE": "Key Biscayne",
    "DANIA": "Dania Beach", "LAUDERDALEBYTHESE": "Lauderdale-by-the-Sea", "STAUGUSTINEBEAC": "St. Augustine Beach",
    "STPETERSABURG": "St. Petersburg", "BELLVIEW": "Bellview", "STGEORGEISLAND": "St. George Island", "PENSACOLABEACH": "Pensacola Beach",
}

# --- fixed values: street addresses ------------------------------------------------------------------------------------------
DIRECTION_WORDS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHWEST": "NW", "NORTHEAST": "NE", "SOUTHWEST": "SW",
                   "SOUTHEAST": "SE"}
DIRECTIONS = ("N", "S", "E", "W", "NW", "NE", "SW", "SE")
STREET_TYPE_WORDS = {
    "STREET": "ST", "STR": "ST", "AVENUE": "AVE", "AV": "AVE", "AVN": "AVE", "BOULEVARD": "BLVD", "BLV": "BLVD", "BL": "BLVD",
    "ROAD": "RD", "DRIVE": "DR", "DRV": "DR", "LANE": "LN", "COURT": "CT", "PLACE": "PL", "PARKWAY": "PKWY", "PKY": "PKWY",
    "PKWAY": "PKWY", "TERRACE": "TER", "TERR": "TER", "TRAIL": "TRL", "TR": "TRL", "HIGHWAY": "HWY", "HWAY": "HWY", "CIRCLE": "CIR",
    "CAUSEWAY": "CSWY", "PLAZA": "PLZ", "PZ": "PLZ", "SQUARE": "SQ", "EXPRESSWAY": "EXPY", "TURNPIKE": "TPKE", "CROSSING": "XING",
    "POINT": "PT", "PIKE": "PIKE", "LOOP": "LOOP", "WAY": "WAY", "ROW": "ROW", "RUN": "RUN", "PASS": "PASS", "PATH": "PATH",
    "WALK": "WALK", "MALL": "MALL", "CENTER": "CTR", "CENTRE": "CTR", "CTR": "CTR", "ISLE": "ISLE", "KEY": "KEY", "COVE": "CV",
    "BEND": "BND", "ALLEY": "ALY", "HARBOR": "HBR", "LANDING": "LNDG", "ESTATES": "ESTS", "PROMENADE": "PROM", "BYPASS": "BYP",
    "EXTENSION": "EXT"}
STREET_TYPES = tuple(dict.fromkeys(list(STREET_TYPE_WORDS.values()) + ["RD", "LN", "XING"]))
ORDINALS = {"FIRST": "1", "SECOND": "2", "THIRD": "3", "FOURTH": "4", "FIFTH": "5", "SIXTH": "6", "SEVENTH": "7", "EIGHTH": "8",
            "NINTH": "9", "TENTH": "10", "ELEVENTH": "11", "TWELFTH": "12"}
US_ROUTE_NUMBERS = (1, 17, 19, 27, 29, 41, 90, 92, 98, 129, 221, 231, 301, 319, 331, 441)

# --- fixed values: links -----------------------------------------------------------------------------------------------------
AGGREGATORS = tuple("""
facebook.com business.site grubhub.com doordash.com ubereats.com yelp.com toasttab.com square.site order.online google.com
instagram.com menufy.com chownow.com clover.com wixsite.com godaddysites.com squarespace.com weebly.com linktr.ee slicelife.com
beyondmenu.com seamless.com co.uk wordpress.com tripadvisor.com orderonline.com spoton.com popmenu.com bentobox.com
places.singleplatform.com chamberofcommerce.com hub.biz restaurantji.com menupix.com allmenus.com zmenu.com opentable.com resy.com
exploretock.com wix.com site123.me webs.com yellowpages.com mapquest.com foursquare.com tumblr.com blogspot.com carrd.co square.com
toast.site hungerrush.com gloriafood.com mobilebytes.com orderspoon.com revelup.com wordpress.org godaddy.com myshopify.com
linkedin.com twitter.com x.com""".split())
TRACKING_NAMES = (r"(?i)^(?:utm[_-].*|gclid|gbraid|wbraid|dclid|fbclid|msclkid|mc_cid|mc_eid|_ga|_gl|_kx|igsh|igshid|mibextid|srsltid|"
                  r"cn_channel|y_source|rwg_token|olonwp|ost_redirect_attribution|cmpid|yext_?.*)$")
TRACKING_VALUES = {"ref": r"(?i)^(?:google|gmb|gbp|yext|bookmarks)\b", "referrer": r"(?i)^google",
                   "source": r"(?i)^(?:google|gmb|gbp|yext)\b", "cid": r"(?i)^RF:YXT", "cmp": r"(?i)^OKC-"}
CC_SECOND_LEVEL = ("co", "com", "org", "net")

# --- fixed values: records ---------------------------------------------------------------------------------------------------
DISPOSITION_GROUP = {
    "Inspection Completed - No Further Action": "met", "Call Back - Complied": "met", "Admin. Complaint Callback Complied": "met",
    "Emergency Order Callback Complied": "met", "Warning Issued": "followup", "Call Back - Extension given, pending": "followup",
    "Call Back - Admin. complaint recommended": "followup", "Administrative complaint recommended": "followup",
    "Admin. Complaint Callback Not Complied": "followup", "Administrative Complaint Time Extension": "followup",
    "Emergency Order Callback Time Extension": "followup", "Emergency order recommended": "closed",
    "Administrative determination recommended": "closed", "Emergency Order Callback Not Complied": "closed"}
RANK_KIND = {"SEAT": "restaurant", "NOST": "nonseating", "CATR": "catering", "PARK": "park"}
COUNTY_FIXES = {"Dade": "Miami-Dade", "Desoto": "DeSoto", "St Johns": "St. Johns", "St Lucie": "St. Lucie",
                "Saint Johns": "St. Johns", "Saint Lucie": "St. Lucie"}
GRACE_DAYS = 90
