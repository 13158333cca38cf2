"""Default word lists and patterns of the detectors and gates. All are parameters elsewhere."""

from __future__ import annotations

# Emotive words.
EMOTIVE = (
    "galit", "outraged", "ipinagkanulo", "ipinagkakanulo", "balasubas", "tarantado", "duwag", "patay-gutom", "nakakahiya", "nakakadiri",
    "kasuklam-suklam", "kahiya-hiya", "scandalo", "iskandalo", "lintik", "putang", "demonyo", "salbahe", "trapo", "epal", "manloloko",
    "magnanakaw", "kurakot", "betrayed", "shocking", "horrific", "disgusting", "appalling", "scandal", "exposed", "destroyed", "crushed",
    "evil", "monster", "traitor", "thief", "liar", "corrupt", "scumbag", "disgrace", "shameful", "shameless", "atrocious", "vile",
    "abomination", "nightmare",
)

# Phrases that press for haste.
URGENT = (
    "ngayon na", "bago mahuli", "i-share na", "ipakalat", "wag mong", "huwag mong", "sa lalong madaling panahon", "mabilisan", "agad-agad",
    "kaagad", "share now", "before it's deleted", "before its deleted", "act now", "urgent", "breaking", "emergency", "must read",
    "must share", "spread the word", "wake up", "open your eyes", "do not delay", "share before", "delete before",
)

# Detector patterns by code. They are matched without regard to case.
PATTERNS = {
    "ANON": (
        r"\bsources?\s+say(s)?\b", r"\baccording to\s+(?:insiders?|sources?|witnesses?|experts?)\b",
        r"\binsiders?\s+(?:reveal(?:ed)?|claim(?:ed)?|told)\b", r"\b(?:a|some|certain)\s+(?:insider|witness|expert|official)\s+",
        r"\bdaw\b(?!\s+(?:po|opo))", r"\branong\b", r"\bbalita\s+(?:diumano|umano|raw)\b", r"\b(?:diumano|umano)\b",
        r"\banonymous\s+(?:source|tip|caller|leaker)\b", r"\bunnamed\s+(?:source|official|insider)\b",
    ),
    "POL": (
        r"\breal\s+filipinos?\b\s+(?:vs|versus|laban\s+sa)", r"\btrue\s+(?:patriots?|pinoy|pinoys?|citizens?)\b",
        r"\btraitor(s)?\s+to\s+the\s+(?:nation|country|flag)\b",
        r"\b(?:dilawan|dilaw|kakampink|kakam-pink|bbm|marcos\s+loyalist)s?\b", r"\bdayuhan(g\s+kaaway)?\b",
        r"\benemy\s+of\s+the\s+(?:state|people|nation)\b", r"\bus\s+(?:vs|versus|against)\s+them\b",
        r"\bmga\s+(?:tunay|totoo)ng\s+pilipino\b",
    ),
    "CONS": (
        r"\bthey\s+don'?t\s+want\s+you\s+to\s+know\b", r"\bayaw\s+nilang\s+malaman\b", r"\bhidden\s+(?:agenda|truth|plan|cabal)\b",
        r"\bcover[- ]?up\b", r"\bsikretong\b", r"\b(?:secret|hidden)\s+(?:society|government|elite|cabal)\b", r"\bdeep\s+state\b",
        r"\bnew\s+world\s+order\b", r"\bconspiracy\b", r"\bbinubura\s+ng\b", r"\bsinusupil\s+ng\b",
    ),
    "DISC": (
        r"\bcommunist\s+sympath(?:y|izer)\b", r"\bnpa[-\s]+supporter\b", r"\bnpa\s+(?:funder|fund-raiser|recruit(?:er|or)?)\b",
        r"\bred[-\s]+tag(?:ged)?\b", r"\bterrorist\s+sympath\w+\b", r"\bka\s+(?:josephine|joma|juana)\b",
        r"\bpuppet\s+of\s+(?:china|america|us|the\s+west)\b", r"\b(?:tuta|alipin)\s+ng\b", r"\b(?:bayaran|bayad)\s+(?:lang|na|ng)\b",
    ),
    "IMP": (
        r"\b(?:abs[-\s]?cbn|gma|inquirer|rappler|cnn|bbc|reuters|ap)\.[a-z]{2,4}(?!\.ph|\.com|\.net|\.org)\b",
        r"\b(?:abs-cbn|gma|inquirer|rappler|reuters)\s+breaking\s+news\b", r"\bofficial\s+statement\s+from\b.*\(?(?:fake|leaked)\)?",
    ),
    "REV": (
        r"\bgolden\s+age\b", r"\bgintong\s+(?:panahon|taon)\b", r"\bedad\s+de\s+oro\b",
        r"\b(?:walang|no)\s+(?:martial\s+law\s+abuses?|human\s+rights\s+violations?)\b", r"\bmas\s+maganda\s+noon\b",
        r"\b(?:7|seven|pito)\s+thousand\s+ng\s+infrastructure\b", r"\brichest\s+country\s+in\s+asia\b", r"\bnumber\s+one\s+sa\s+asya\s+noong\b",
    ),
    "ENDO": (
        r"\b\d{2,3}\s*%\s+of\s+(?:filipinos?|voters?|pinoys?)\s+(?:already\s+)?support\b",
        r"\bsurvey\s+says?\s+\d{2,3}\s*%\b(?!.*(?:sws|pulse\s+asia|stratbase|octa|laylo|publicus|nuvoli))",
        r"\bnumber\s+one\s+choice\s+ng\s+(?:masa|sambayanan)\b", r"\b(?:hollywood|kpop|world)\s+star\s+endorses\b",
        r"\bunanimous\s+endorsement\s+from\b",
    ),
    "RECF": (
        r"\bnobel\s+(?:peace\s+)?prize\s+winner\b",
        r"\bharvard|stanford|oxford|mit\s+(?:graduate|alumnus|alumna)\b(?!.*(?:not|never|fake))",
        r"\bphd\s+from\s+(?:harvard|stanford|yale|oxford|cambridge)\b",
        r"\bbuilt\s+\d{2,4}\s+(?:hospitals?|schools?|bridges?)\s+single[-\s]?handedly\b", r"\bawarded\s+by\s+(?:un|united\s+nations|world\s+bank)\b",
    ),
}
# Score of one match and evidence kept, by code.
WEIGHTS = {"ANON": (0.4, 5), "POL": (0.5, 5), "CONS": (0.5, 5), "DISC": (0.5, 5), "IMP": (1.0, 3), "REV": (0.6, 3), "ENDO": (0.6, 3), "RECF": (0.6, 3)}
# Detector order.
CODES = ("EMO", "URG", "ANON", "MISS", "FAB", "POL", "CONS", "DISC", "IMP", "REV", "ENDO", "RECF")

# The technique family of each code.
FAMILIES = {
    "EMO": "Emotion", "URG": "Emotion+Trolling", "ANON": "Impersonation", "MISS": "Composite (no source / no link)", "FAB": "Impersonation",
    "POL": "Polarization", "CONS": "Conspiracy", "DISC": "Discrediting", "IMP": "Impersonation", "REV": "Filipino-specific (Arugay & Baquisal 2022)",
    "ENDO": "Filipino-specific (manufactured surveys/endorsements)", "RECF": "Filipino-specific (candidate-record fabrication)",
}

# Words on the theme, and words that speak against it.
ON_THEME = (
    "halalan", "eleksyon", "kandidato", "balota", "boto", "bumoto", "presidente", "bise presidente", "vice president", "senador", "kongresista",
    "gobernador", "mayor", "konsehal", "konseho", "partido", "campaign", "kampanya", "comelec", "pulitika", "pulitiko", "platform",
    "platapormang", "manifesto", "election", "candidate", "voter", "ballot", "vote", "polling", "primary", "policy", "incumbent", "challenger",
    "opponent", "constituency", "district", "house representative", "senator", "governor", "councilor", "rally", "endorsement", "debate",
    "running mate", "C-RM", "C-IB", "C-JS", "Marquez", "Bantayan", "Salonga", "Bagong Sigla", "Tahanan ng Bayan", "Para sa Masa",
    "Candidate A", "Candidate B", "Candidate C", "C-A", "C-B", "C-C",
)
OFF_THEME = (
    "grab", "lyft", "uber", "fare", "fare hike", "transport strike", "tnvs", "taxi", "jeepney modernization", "meralco", "electric bill",
    "electricity rate", "kuryente", "ercb", "doe", "department of energy", "petron", "shell", "kpop", "k-pop", "blackpink", "bts", "nba", "pba",
    "uaap", "ncaa", "boxing", "manny pacquiao boxing", "boksingero", "lightweight", "heavyweight", "featherweight", "mgm", "split decision",
    "fighter", "knockout", "ko win", "championship", "kampeonato", "tournament", "world cup", "fifa", "olympics", "olympiad", "olympic", "puntos",
    "iskor sa loob", "round", "ikaapat na round", "ikalimang round", "panalo sa laban", "first round ko", "aktres", "aktor", "actress", "showbiz",
    "host", "love team", "tv host", "kapamilya", "kapuso", "starstruck", "abs-cbn drama", "gma drama", "concert tour", "typhoon update",
    "bagyo update", "lpa", "pagasa weather", "medical mission", "outreach concert", "wrestling",
)

# Words that cannot end a sentence.
DANGLERS = ("at", "ng", "sa", "and", "the", "of", "with", "by", "for", "to", "or", "but", "ay", "kay", "mga", "ang", "a", "an")
CANONICAL_NAMES = ("Candidate A", "Candidate B", "Candidate C")
PLACEHOLDER = r"(?<![A-Za-z0-9_])(?:Candidate|Entity|Person)\s+[A-Z]{1,3}(?![A-Za-z0-9_])"

# Pools of place pseudonyms, and the sets that decide a place's kind.
PLACE_POOLS = {
    "city": ("City W", "City X", "City Y", "City Z", "City V", "City U", "City T", "City S", "City R", "City Q"),
    "province": ("Province L", "Province M", "Province N", "Province O", "Province P", "Province K", "Province J", "Province I"),
    "region": ("Region I", "Region II", "Region III", "Region IV", "Region V", "Region VI", "Region VII", "Region VIII", "Region IX", "Region X", "Region XI", "Region XII"),
    "island_group": ("Island Group 1", "Island Group 2", "Island Group 3"),
}
PLACE_CONSTANTS = {"landmark": "[Landmark]", "metropolitan_area": "Capital Metro Area"}
PLACE_SETS = {
    "region": ("ilocos region", "cagayan valley", "central luzon", "calabarzon", "mimaropa", "bicol region", "western visayas", "central visayas",
               "eastern visayas", "zamboanga peninsula", "northern mindanao", "davao region", "soccsksargen", "caraga", "bangsamoro",
               "cordillera administrative region", "national capital region"),
    "metropolitan_area": ("metro manila", "metropolitan manila"),
    "landmark": ("malacanang", "malacañang", "malacanang palace", "malacañang palace", "batasan", "batasan complex", "batasang pambansa", "edsa",
                 "mendiola", "intramuros", "fort bonifacio", "bonifacio global city", "bgc", "ortigas", "ortigas center", "poblacion", "binondo",
                 "divisoria", "quiapo", "escolta", "makati cbd", "ayala avenue", "roxas boulevard", "manila bay", "laguna de bay", "pasig river",
                 "luneta", "rizal park"),
    "island_group": ("luzon", "visayas", "mindanao", "visayan", "mindanaoan", "luzonian"),
}
KNOWN_CITIES = (
    "manila", "quezon city", "caloocan", "las pinas", "las piñas", "makati", "malabon", "mandaluyong", "marikina", "muntinlupa", "navotas",
    "paranaque", "parañaque", "pasay", "pasig", "pateros", "san juan", "taguig", "valenzuela", "olongapo", "baguio", "dagupan", "lucena",
    "naga city", "naga", "legazpi", "ligao", "tabaco", "iloilo city", "bacolod", "cebu city", "danao", "mandaue", "ormoc", "tacloban", "maasin",
    "calbayog", "catbalogan", "borongan", "dapitan", "dipolog", "pagadian", "zamboanga", "cagayan de oro", "gingoog", "iligan", "malaybalay",
    "oroquieta", "ozamiz", "ozamis", "tangub", "valencia", "davao city", "digos", "mati", "panabo", "samal", "tagum", "general santos", "gensan",
    "kidapawan", "koronadal", "tacurong", "butuan", "bayugan", "bislig", "cabadbaran", "tandag", "marawi", "lamitan", "isabela city", "lapu-lapu",
)

# Order in which explanations take codes, at most three.
PRIORITY = ("EMO", "URG", "ANON", "MISS", "FAB", "REV", "ENDO", "RECF", "POL", "CONS", "DISC", "IMP")

# Cues of the three archetypes.
ARCHETYPES = {
    "DYNASTIC": (
        r"\b(?:dynasty|dinastiya|pamilya|family\s+legacy|three\s+generations?)\b", r"\b(?:martial\s+law|marcos[-\s]?era|gintong\s+panahon|golden\s+age)\b",
        r"\b(?:traditional|establishment|veteran)\s+(?:politician|senator|leader)\b", r"\b(?:law[-\s]?and[-\s]?order|discipline|peace\s+and\s+order)\b",
        r"\b(?:infrastructure|build[-\s]?build[-\s]?build)\b", r"\bnational\s+unity\b",
    ),
    "REFORMIST": (
        r"\b(?:reform(?:ist)?|anti[-\s]?corruption|good\s+governance)\b", r"\b(?:transparency|accountability|open\s+data)\b",
        r"\b(?:lawyer|abogada|abogado|public\s+defender)\b", r"\b(?:vice[-\s]?mayor|local\s+executive|councilor)\b",
        r"\b(?:climate|education|kababaihan)\b", r"\bred[-\s]?tag(?:ged|ging)?\b", r"\b(?:dilawan|kakampink|dilaw)\b",
    ),
    "POPULIST": (
        r"\b(?:masa|mahirap|sambayanan|bayan|ordinary\s+filipino)\b", r"\b(?:celebrity|tv\s+host|aktor|aktres|host)\b",
        r"\b(?:OFW|overseas\s+filipino|remittance|remit)\b", r"\b(?:cash\s+transfer|4Ps|ayuda|libre|libreng)\b",
        r"\b(?:against\s+the\s+elite|laban\s+sa\s+oligarch)\b", r"\b(?:viral|trending|million\s+views?)\b",
    ),
}
