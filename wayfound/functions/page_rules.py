"""Patterns of page, link and host rules. Functions take them as defaults."""

SPAM = (r"(?i)slot ?gacor|situs (?:slot|judi|togel)|slot online|\bslot ?88\b|\btogel\b|judi (?:online|bola|slot|qq|poker)|perjudian|"
        r"bandar ?(?:slot|qq|togel)|\bmaxwin\b|\brtp slot|\bsbobet\b|\bbahis|casino siteleri|\b1win\b|watch porn|free porn|"
        r"porn videos?|\bpornhub\b|\bxvideos\b|\bxnxx\b|escort service|adult dating|sex cam|camgirl")
BLOBS = r"[A-Za-z0-9+/=_-]{100,}"
BETTING = r"(?i)online casino|casino online|deposit bonus|sportsbook|\bbaccarat\b|bet365|no deposit"
BETTING_PROSE = r"(?i)online casino|casino online|deposit bonus|sportsbook|bet365|no deposit"
GAMBLING_HOST = (r"(?i)casino|kasyno|kasino|kazino|(?:^|[.-])slots?(?:[.-]|$)|slot(?:88|gacor|online)|togel|gacor|bahis|1xbet|"
                 r"mostbet|melbet|parimatch|22bet|bet365|betway|(?:^|[.-])bet(?:[.-]|$)|bukmacher")
FOREIGN_CASINO = r"(?i)\bkasyn|казино|bukmacher|zakłady bukmacherskie|darmow\w* spin|apuestas deportivas|casino en l[ií]nea|spielautomat|\bgokken\b|free spins"
FOREIGN_CASINO_LINK = FOREIGN_CASINO + "|scommesse"
CASINO_PLACE = r"(?i)casino|gaming|potawatomi|ho-?chunk|oneida|menominee|mohican|north ?star|lake of the torches|st\.? ?croix|bad river|legendary waters|isle vista|grindstone"
REAL_CASINO_PLACE = CASINO_PLACE.replace("casino|gaming|", "")
CASINO_HOSTS_OK = (r"(?i)mohegansun|foxwoods|seminolehardrock|hardrock|seminole|miccosukee|coeurdalene|cdacasino|kootenai|tulalip|snoqualmie|muckleshoot|"
                   r"emeraldqueen|angelofthewinds|clearwatercasino|sevenfeathers|pechanga|morongo|sycuan|viejas|barona|harrahs|caesars|mgm|ameristar|"
                   r"isleofcapri|blackhawk|monarchcasino|thelodgecasino|turningstone|resortsworld|empirecitycasino|delawarenorth|oxfordcasino|"
                   r"hollywoodcasino|riverscasino|dellagoresort|tiogadowns|bataviadowns|pennentertainment|wynn|venetian|sands|seneca|delmonte|"
                   r"rivercree|ute|skyute|sleepingute|ignacio|potawatomi|hochunk|oneida|menominee|mohican|northstar|molelake|sokaogon|ho-chunk|"
                   r"northernlights|stcroix|lakeofthetorches|badriver|legendarywaters|grindstone|isle-?vista|menomineecasino|northstarcasino|oneidacasino|carter")
ADULT_HOST = (r"(?i)porn|xvideos|xnxx|xhamster|redtube|youporn|onlyfans|chaturbate|stripchat|bongacams|livejasmin|camsoda|brazzers|"
              r"(?:^|[.-])sex(?:[.-]|$)|sexcam|sexchat|sexdating|hookup|adultfriend|escorts?(?:[.-]|$)|xxx(?!root)")
_PHARMA = (r"viagra|cialis|levitra|kamagra|tadalafil|sildenafil|vardenafil|propecia|finasteride|tramadol|xanax|alprazolam|valium|"
           r"diazepam|ambien(?!t)|zolpidem|oxycodone|oxycontin|hydrocodone|modafinil|phentermine|clomid|accutane|isotretinoin")
PHARMA_HOST = (r"(?i)(?:^|[.-]|buy|cheap|generic|order|get|best|discount)(?:" + _PHARMA + r")|online-?pharmacy|pharmacy-?online|canadian-?pharmacy|"
               r"rx-?pills|buy-?pills|cheap-?(?:pills|meds)|apotheke|apteka|farmacia|roidshop|steroids?(?:shop|store|online|forsale)|(?:buy|cheap)-?steroids?")
PHARMA_TEXT = (r"(?i)\b(?:" + _PHARMA + r")\b|online pharmacy|without (?:a )?prescription|cheap pills|erectile dysfunction|anabolic steroids?|"
               r"steroids? (?:shop|store|drugs|for sale|online)|buy steroids?")
ADULT_TEXT = (r"(?i)(?<!food )(?<!food-)(?<!ski )(?<!ski-)(?<!surf )(?<!surf-)\bporn(?! ?star martini)\w*|\bxxx (?:videos?|movies?|sex)|"
              r"\bsex (?:videos?|chat|dating|tube|cams?)|\bescorts? (?:in|service)|\bhookups? (?:site|app)|\bnude (?:girls|cams?|videos?)|\bonlyfans\b|\bcam ?girls?\b")
FARM_TEXT = (r"(?i)payday loans?|title loans?|essay (?:writing|writer|service)|write my (?:essay|paper)|buy (?:essays?|followers)|"
             r"replica (?:watches|handbags|rolex)|cheap (?:jerseys|ugg|nfl)|crypto ?casino|bitcoin casino|betting (?:sites?|tips|odds)|"
             r"slot (?:machines?|sites?|demo)|mail.order brides?|\bjudi\b|\bslot\b|\bpoker online\b")
CJK_GAMBLING = "体彩|彩票|时时彩|六合彩|飞艇|北京赛车|幸运赛车|开奖|博彩|赌场|赌博|百家乐|老虎机|棋牌|真人娱乐|娛樂城|博弈|賭場|彩票網"
LOTTERY_4D = r"(?i)\b(?:situs|link) (?:toto|4d)\b|\btoto (?:macau|4d|sgp|hk)\b"
HOST_4D = r"(?i)(?:^|[.-])[a-z]{3,}4d\d*(?:[.-]|$)"
INDO_GAMING = (r"(?i)gampang menang|pragmatic play|\bsitus link\b|spaceman slot|slot spaceman|\bslot gacor\b|\bgacor\b.{0,40}\bslot|"
               r"\bmaxwin\b|\blink alternatif\b|\bdaftar (?:slot|akun)\b")
FOREIGN_EXT = (r"(?i)สล็อต|บาคาร่า|แทงบอล|เว็บพนัน|nhà cái|cá cược|nổ hũ|카지노|토토사이트|바카라|博彩|娱乐城|百家乐|赌场|老虎机|オンラインカジノ|カジノ|cassino online|"
               r"apostas esportivas|casa de apostas|tragamonedas|deneme bonusu|canlı casino|كازينو|ставки на спорт|букмекер|онлайн казино|игровые автоматы|"
               r"situs judi|slot gacor|link alternatif|体彩|彩票|飞艇|时时彩|六合彩|北京赛车|开奖记录|网投|\bkemenangan\b")
JP_SPAM = "スーパーコピー|激安|送料無料|通販|楽天市場|新品未使用|ブランドコピー|偽物|格安|最安値|販売店|人気商品"
UI_HIDE = (r"(?i)display\s*:\s*none|visibility\s*:\s*hidden|(?<![\w-])opacity\s*:\s*0(?:\.0+)?\s*(?:;|$|!)|(?<![\w-])(?:max-)?height\s*:\s*0(?:px)?\s*(?:;|$|!)")
OFFSCREEN_FAR = r"(?i)(?<![\w-])(?:left|right|top|text-indent)\s*:\s*-\d{4,}(?:px|em|rem)"
OFFSCREEN_POS = (r"(?i)(?<![\w-])(?:left|right|top)\s*:\s*-\d{4,}(?:px|em|rem)|(?<![\w-])(?:left|right|top)\s*:\s*-\d{3,}(?:px|em|rem)[^\"']*position\s*:\s*absolute|"
                 r"position\s*:\s*absolute[^\"']*(?<![\w-])(?:left|right|top)\s*:\s*-\d{3,}(?:px|em|rem)")
HIDE_STYLE = (r"(?i)(?<![\w-])width\s*:\s*[01](?:px)?\s*(?:;|$|!)|(?<![\w-])height\s*:\s*1px\s*(?:;|$|!)|font-size\s*:\s*0(?:px|em|rem|pt)?\s*(?:;|$|!)|"
              r"clip\s*:\s*rect\(\s*0|(?<![\w-])(?:left|right|top|text-indent)\s*:\s*-\d{4,}(?:px|em|rem)|"
              r"(?<![\w-])(?:left|right|top)\s*:\s*-\d{4,}(?:px|em|rem)|(?<![\w-])(?:left|right|top)\s*:\s*-\d{3,}(?:px|em|rem)[^\"']*position\s*:\s*absolute|"
              r"position\s*:\s*absolute[^\"']*(?<![\w-])(?:left|right|top)\s*:\s*-\d{3,}(?:px|em|rem)")
OBFUSCATED = r"(?i)eval\s*\(\s*(?:String\.fromCharCode|atob|unescape|decodeURIComponent|function\s*\(\s*p\s*,\s*a\s*,\s*c\s*,\s*k)"
BENIGN_HOST = (r"(?i)(?:^|\.)(?:facebook|fb|instagram|twitter|x|tiktok|youtube|youtu|pinterest|linkedin|yelp|tripadvisor|google|goo|googleapis|gstatic|"
               r"googletagmanager|apple|doordash|grubhub|ubereats|uber|postmates|seamless|slicelife|toasttab|toast|square|squareup|squarespace|wix|wixsite|weebly|"
               r"godaddy|wordpress|wp|shopify|clover|chownow|menufy|beyondmenu|opentable|resy|exploretock|tock|sevenrooms|yelpreservations|bentobox|getbento|"
               r"popmenu|spothopperapp|spothopper|untappd|eventbrite|mailchimp|list-manage|constantcontact|paypal|venmo|giftup|giftfly|vagaro|linktr|linktree|"
               r"w3|schema|cloudflare|jquery|bootstrapcdn|fontawesome|typekit|adobe|microsoft|bing|mapquest|openstreetmap|waze|indeed|ziprecruiter|workstream|"
               r"harri|order(?:online|food)?|ezcater|catering|olo|dine|menu|zmenu|allmenus|menupages|thanx|punchh|paytronix|spoton|heartland|revelsystems|"
               r"lightspeed|foursquare|snapchat|threads|vimeo|soundcloud|spotify|addtoany|sharethis|addthis|browsehappy|enable-javascript|whatismybrowser|"
               r"mozilla|getfirefox|chrome|outlook|gmail|zendesk|hubspot|intuit|4sq|recaptcha|hcaptcha|cookiebot|onetrust|termly|iubenda|accessibe|userway|"
               r"audioeye|w3c)\.[a-z.]+$")
PARKED = (r"(?i)domain (?:is|may be) for sale|buy this domain|this domain is parked|parked free|sedoparking|hugedomains|afternic|domain has expired|"
          r"this domain name has expired|account (?:has been )?suspended|website coming soon|site (?:is )?coming soon|future home of|launching soon|"
          r"godaddy\.com/domainsearch|(?<![\w.-])dan\.com")
PARKING_HOSTS = (r"(?i)(?:^|\.)(?:sedo|sedoparking|parkingcrew|bodis|above|hugedomains|afternic|dan|godaddy|domainmarket|undeveloped|buydomains|namebright|"
                 r"uniregistry|epik|domainnameshop|parklogic|perfectdomain|brandbucket|squadhelp|atom|efty|sav|spaceship|porkbun|namecheap|dynadot|"
                 r"domain-for-sale|domainlore|domainagents|smartname|fabulous|trafficz|voodoo|skenzo|searchhounds|expired|suspendedpage)\.[a-z.]+$")
PARKED_EXTRA = (r"(?i)this domain (?:name )?(?:is|may be) (?:for sale|available)|is for sale!?|make an offer|inquire about this domain|related searches|domain parking|"
                r"parked domain|this page is parked|the domain .{0,60} (?:has expired|is not configured)|renew (?:now|your domain)|site not found|domain not found|"
                r"no such app|there isn't a github pages site here|this site can.t be reached|default web site page|apache2 (?:ubuntu|debian) default page|"
                r"welcome to nginx|apache.{0,80}\bit works!|^\s*it works!|index of /|website is (?:under construction|suspended)|this account has been suspended|"
                r"account suspended|bandwidth limit exceeded|site is currently unavailable|wix\.com.{0,40}(?:error|connect your domain)|"
                r"looks like this domain isn.t connected|this site is not published|squarespace.{0,40}(?:expired|website expired)|website expired|"
                r"this website has expired|get your own website|domain .{0,40} is parked free")
HOSTING_PLACEHOLDER = r"/cgi-sys/(?:defaultwebpage|suspendedpage)\.cgi"
ARTICLE = r"(?i)/20\d\d/\d{1,2}/|/ci_\d+|[-/]\d{7,}(?:[/?#]|$)|/(?:news|story|stories|article|articles|blog/20\d\d)/|[?&]p=\d+"
REFRESH = (r"(?i)<meta[^>]+http-equiv=[\"']?refresh[^>]+url=([^\"'>\s;]+)|(?:window\.)?location(?:\.href)?\s*=\s*[\"'](https?://[^\"']+)|location\.replace\(\s*[\"'](https?://[^\"']+)")
PAGE_GENERIC = tuple("""the and of a an at on in restaurant restaurants bar bars grill grille cafe caffe coffee pizza pizzeria pub tavern house
inn lounge kitchen bistro eatery diner bakery deli market express food foods co company inc llc ltd corp florida fl
miami tampa orlando beach key keys springs family original new old north south east west st saint mt sports place spot shop shoppe taproom brewing brewery
tap taps bbq barbecue burger burgers chicken subs sub sandwich sandwiches tacos taco mexican chinese thai sushi asian italian american cuisine catering events""".split())
STREET_WORDS = tuple("""st street ave avenue blvd boulevard rd road dr drive ln lane way pkwy parkway hwy highway us co state route ct court pl place cir circle
ter trl trail sq unit ste suite north south east west n s e w ne nw se sw""".split())
