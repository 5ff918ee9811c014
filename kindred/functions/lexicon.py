"""Word lists and tables of the normalisers.

Fixed values: results are right only with exactly these entries.
"""

from __future__ import annotations

#: Abbreviations in names.
NAME_ABBREVIATIONS = {
    "pvt": "private", "pte": "private", "ltd": "limited", "lmtd": "limited", "corp": "corporation", "co": "company", "inc": "incorporated",
    "intl": "international", "mfg": "manufacturing", "svc": "service", "svcs": "services", "bros": "brothers", "assoc": "associates",
    "mgmt": "management", "ste": "societe", "cie": "compagnie",
}
#: Legal forms, spelled out, abbreviated, and transliterated.
LEGAL = [
    "private", "limited", "incorporated", "corporation", "company", "llc", "llp", "plc", "lp", "pllc", "pc", "opc", "gmbh", "sarl", "sas", "sasu",
    "sa", "eurl", "sci", "snc", "selarl", "societe", "compagnie", "praivet", "piraivet", "praivrr", "praibhet", "limitet", "limirrd", "limtid",
    "kmpni", "pra", "li",
]
#: Words that say little about who a business is, and words that say nothing.
GENERIC = [
    "holdings", "holding", "group", "partners", "partner", "services", "service", "enterprises", "enterprise", "ventures", "associates",
]
STOP = [
    "the", "and", "of", "a", "le", "la", "les", "l", "de", "des", "du", "d", "et", "www", "com", "net", "org",
]
#: Short forms of address words.
ADDRESS_FORMS = {
    "road": "rd", "street": "st", "str": "st", "saint": "st", "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd", "lane": "ln",
    "drive": "dr", "court": "ct", "highway": "hwy", "parkway": "pkwy", "square": "sq", "building": "bldg", "floor": "fl", "flr": "fl", "near": "nr",
    "opposite": "opp", "opp": "opp", "ngr": "nagar", "market": "mkt", "district": "dist", "distt": "dist", "village": "vill", "faubourg": "fbg",
    "route": "rte", "chemin": "chem", "impasse": "imp", "place": "pl", "rue": "r", "allee": "all", "passage": "pas", "quai": "qu", "cours": "crs",
    "residence": "res", "res": "res", "lotissement": "lot", "ch": "chem", "bangalore": "bengaluru", "bombay": "mumbai", "gurgaon": "gurugram",
    "calcutta": "kolkata", "madras": "chennai", "poona": "pune", "pondicherry": "puducherry",
}
#: first..twentieth as 1..20, then three tens.
ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth",
    "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
]
ADDRESS_FORMS |= {w: str(i) for i, w in enumerate(ORDINALS, 1)} | {"thirtieth": "30", "fortieth": "40", "fiftieth": "50"}
#: Address words that are dropped.
ADDRESS_FILLERS = [
    "no", "door", "plot", "flat", "house", "shop", "unit", "apt", "apartment", "suite", "ste", "number", "num", "n", "bis", "ter", "quater", "de",
    "du", "des", "le", "les", "null",
]
#: States of India and of the USA.
STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj",
    "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh",
    "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj",
    "sikkim": "sk", "tamil nadu": "tn", "telangana": "tg", "ts": "tg", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk",
    "west bengal": "wb", "delhi": "dl", "nct of delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la", "puducherry": "py", "chandigarh": "ch",
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
#: French regions and departments, which addresses mix and which are removed.
FRENCH_AREAS = [
    "auvergne rhone alpes", "bourgogne franche comte", "bretagne", "centre val de loire", "corse", "grand est", "hauts de france", "ile de france",
    "normandie", "nouvelle aquitaine", "occitanie", "pays de la loire", "provence alpes cote d azur", "provence alpes cote dazur", "aisne", "nord",
    "oise", "pas de calais", "somme", "charente maritime", "charente", "correze", "creuse", "dordogne", "gironde", "landes", "lot et garonne",
    "pyrenees atlantiques", "deux sevres", "haute vienne", "loire atlantique", "maine et loire", "mayenne", "sarthe", "vendee", "seine et marne",
    "yvelines", "essonne", "hauts de seine", "seine saint denis", "val de marne", "val d oise", "val doise",
]
#: Web addresses: the label before one of these endings is what a name keeps.
URL = r"(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:com|net|org|biz|info|co|in|fr|us|io)(?:\.[a-z]{2})?\b"
#: Digits that stand for letters inside words.
LEET_DIGITS, LEET_LETTERS = "013457", "oleast"
#: Replacements of the sound key, in order, and the letters it drops.
SOUNDS = [("ph", "f"), ("h", ""), ("c", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("v", "w"), ("d", "t"), ("j", "g")]
VOWELS = "aeiouy"
