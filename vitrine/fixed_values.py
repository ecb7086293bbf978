"""Fixed values of the catalog domain.

Everything here is a value that decides results (word lists, lookup tables, limits, regular
expressions, output formats). They are kept together and in natural order; the logic that uses
them lives in ``functions``, ``sources`` and ``operators``.
"""

# --- text ---------------------------------------------------------------------------------------
# The characters Python's ``\s`` matches in str patterns, as a class Java and RE2 both understand.
WHITESPACE = (
    r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)
# The same characters for Java, which asks the first set first: most characters are not in it.
JAVA_WHITESPACE = f"[[^!-~]&&{WHITESPACE}]"

# --- listing defaults applied when a parsed record leaves a field out ---------------------------
DEFAULT_AVAILABILITY = "unknown"
DEFAULT_CURRENCY = "CAD"
DEFAULT_CONFIDENCE = 0.4
DEFAULT_INGEST_TYPE = "refresh"
ITEM_NUMBER_FORMAT = "MCM-%06d"
ITEM_NUMBER_PATTERN = r"^(?:MCM-)?([0-9]+)$"

# --- browse -------------------------------------------------------------------------------------
AVAILABILITY_FILTERS = ("available", "sold_out", "all")
SORTS = ("curated", "newest", "recent_check", "price_low", "price_high", "recent_source")
PAGE_SIZE = 48
ADMIN_PAGE_SIZE = 40
FACET_LIMIT = 30
DESIGNER_FACET_LIMIT = 24
DESIGNER_FACET_BUSY = 30
EVENTS_PER_LISTING = 12
FAILURE_LIMIT = 20
SITEMAP_FILE_URLS = 50_000  # what one sitemap file may hold
DUPLICATE_WINDOW = 11
DUPLICATE_THRESHOLD = 0.72
DUPLICATE_LIMIT = 12

#: a word of a search query
QUERY_WORD = r"[\p{L}\p{N}_À-ÿ']+"
SEARCH_SYNONYM_GROUPS = (
    ("teak", "teck"),
    ("rosewood", "palissandre"),
    ("walnut", "noyer"),
    ("sideboard", "sideboards", "buffet", "buffets", "credenza", "credenzas", "enfilade"),
    ("dresser", "dressers", "commode", "commodes"),
    ("chair", "chairs", "chaise", "chaises", "fauteuil", "fauteuils"),
    ("lamp", "lamps", "lampe", "lampes"),
    ("table", "tables"),
    ("dining", "diner", "manger"),
    ("storage", "rangement"),
    ("shelf", "shelves", "etagere", "etageres", "étagère", "étagères"),
)
# Field -> score weight. The six searched fields are the keys.
SEARCH_WEIGHTS = {
    "title": 16,
    "designer": 12,
    "maker": 12,
    "effective_category": 10,
    "materials": 8,
    "source_description": 3,
}

# --- designer / maker names ---------------------------------------------------------------------
DESIGNER_ALIASES = {
    "arne hovmand olsen": "Arne Hovmand-Olsen",
    "axel christiansen": "Axel Christensen",
    "borge mogensen": "Børge Mogensen",
    "charles and ray eames": "Charles & Ray Eames",
    "design hans j wegner": "Hans J. Wegner",
    "grethe jalk": "Grete Jalk",
    "hans j wegner of denmark": "Hans J. Wegner",
    "hans wegner": "Hans J. Wegner",
    "henning kjaernulf": "Henning Kjærnulf",
    "henning norgaard": "Henning Nørgaard",
    "ib kofod larsen": "Ib Kofod-Larsen",
    "ib kofodlarsen": "Ib Kofod-Larsen",
    "lella and massimo vignelli": "Lella & Massimo Vignelli",
    "massimo and lella vignelli": "Lella & Massimo Vignelli",
    "massimo lella vignelli": "Lella & Massimo Vignelli",
    "michel ducaroy": "Michel Ducaroy",
    "niels koefoed": "Niels Koefoed",
    "neils koefoed": "Niels Koefoed",
    "orla molgaard nielsen": "Orla Mølgaard-Nielsen",
    "orla molgaardnielsen": "Orla Mølgaard-Nielsen",
    "orla mølgaard nielsen": "Orla Mølgaard-Nielsen",
    "poul m volther": "Poul Volther",
}
DESIGNER_BOILERPLATE = (
    "available",
    "based on",
    "checkout",
    "contactez nous",
    "current production",
    "details",
    "dimensions",
    "frais s appliques",
    "features",
    "final sale",
    "lead time",
    "les details",
    "materials",
    "more information",
    "on order",
    "policies",
    "shipping",
    "store policies",
)
DESIGNER_PLACES = ("canada", "montreal", "ottawa")
DESIGNER_DECADE_PATTERN = r"\b(40s|50s|60s|70s|80s|90s|19\d0s|20\d0s)\b"
DESIGNER_MAX_CHARS = 60
DESIGNER_MAX_WORDS = 6
ENTITY_TYPES = ("creator", "designer", "maker", "brand")
EVIDENCE_ROLES = ("designer", "maker", "creator")
CANDIDATE_ROLES = ("designer", "maker")
REVIEW_STATUSES = ("approved", "rejected")
CANDIDATE_LIMIT = 20
ENTITY_INDEX_LIMIT = 100

MAKER_BOILERPLATE_PATTERN = (
    r"\b(contactez-nous|contactez nous|details|détails|frais s’appliques|more information"
    r"|checkout|shipping|policies)\b"
)
MAKER_PLACE_PATTERN = r"\b(canada|montreal|montréal|ottawa)\b"
PERSON_NAME_PATTERN = (
    r"\b[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’.-]+(?:\s+[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’.-]+)+"
)
POUR_PATTERN = r"(.+?)\s+pour\s+(.+?)(?:$|,|\||\.)"
BY_PATTERN = r"\bby\s+(.+?)(?:\s+for\s+(.+?))?$"
DESIGNED_BY_PATTERN = r"\bdesigned\s+by\s+(.+?)(?:,|\s+for\s+(.+?))?$"

# --- attribute keywords -------------------------------------------------------------------------
MATERIALS = (
    ("teak", ("teck", "teak")),
    ("rosewood", ("palissandre", "rosewood")),
    ("walnut", ("noyer", "walnut")),
    ("glass", ("verre", "glass")),
    ("chrome", ("chrome",)),
    ("aluminum", ("aluminium", "aluminum")),
    ("leather", ("cuir", "leather")),
    ("sherpa", ("sherpa",)),
    ("wood", ("bois", "wood")),
    ("metal", ("metal", "métal")),
)
CONDITIONS = (
    ("Restored", ("restaur", "restored")),
    ("Reupholstered", ("recouvrement", "reupholstered")),
    ("Refinished", ("refinished",)),
)
CATEGORIES = (
    ("sideboards / credenzas", ("sideboard", "buffet", "credenza")),
    ("dressers / commodes", ("dresser", "commode", "wardrobe")),
    ("dining tables", ("dining table", "table a manger", "table en teck")),
    ("dining chairs", ("dining chair", "chair", "chaises", "stool", "tabouret")),
    ("lounge chairs", ("armchair", "fauteuil", "lounge chair")),
    ("sofas", ("sofa", "canape")),
    (
        "coffee tables",
        ("coffee table", "table basse", "table de salon", "tables de salon", "table d'appoint"),
    ),
    ("desks", ("desk", "bureau", "pupitre")),
    (
        "bookshelves / wall units",
        ("bookcase", "bibliotheque", "unite murale", "wall unit", "etagere", "étagère"),
    ),
    ("nightstands", ("bedside", "chevet", "side table", "table d’appoint", "table d'appoint")),
    ("beds / bedroom storage", ("bed", "lit")),
    ("lighting", ("lamp", "lampe", "luminaire", "suspension")),
)
DEFAULT_CATEGORY = "furniture"
LAUNCH_CATEGORIES = tuple(name for name, _ in CATEGORIES) + (DEFAULT_CATEGORY,)

FURNITURE_TERMS = (
    "armoire", "banc", "bar", "bibliotheque", "buffet", "bureau", "cabinet", "canape", "chaise",
    "chaises", "chevet", "commode", "console", "desserte", "etagere", "fauteuil", "lampe",
    "lampes", "lit", "luminaire", "meuble", "miroir", "sofa", "table", "tables",
)
ANNOUNCEMENT_TERMS = (
    "joyeuses paques", "joyeux noel", "bonne annee", "horaire", "ouvert", "ferme", "fermee",
    "closed", "open",
)
INVENTORY_TERMS = (
    "buffet", "table", "chaises", "chaise", "sofa", "fauteuil", "biblio", "bibliotheque", "lit",
    "commode", "lampe", "luminaire", "teck", "noyer", "palissandre", "rosewood", "danmark",
    "denmark", "norway", "canada", "modele", "model",
)
SOLD_OUT_PAGE_TERMS = (
    "en rupture de stock", "rupture de stock", "article non disponible", "sold out",
    "out of stock",
)
SOLD_MARKER = "vendu"
GIFT_CARD_TITLE = "gift card"
CURRENT_PRODUCTION = "current production"
SECTION_LABELS = (
    "materials", "materiaux", "dimensions", "features", "lead time", "condition", "designer",
    "maker", "made in", "provenance",
)
MATERIAL_LABELS = ("materials", "materiaux", "matériaux")
DIMENSION_LABELS = ("dimensions",)

# --- prices and eras ----------------------------------------------------------------------------
PRICE_CAD_PATTERN = r"\$[\d,]+(?:\.\d{2})?\s*CAD"
PRICE_DOLLAR_PATTERN = r"\$[\d,]+(?:\.\d{2})?"
PRICE_FRENCH_PATTERN = r"(\d[\d\s]*(?:[.,]\d{2})?)\s*\$"
PRICE_TITLE_PATTERN = r"(\d[\d\s,]*(?:\.\d{2})?)\s*\$"
PRICE_TITLE_SUFFIX_PATTERN = r"\s+-\s+\d[\d\s,]*(?:\.\d{2})?\s*\$.*$"
PRICE_LINE_PATTERN = r"\d+\s*\$"
TITLE_STOP_PATTERN = r"\d+(\.\d+)?\s*(?:''|po|cm|h\\b|l\\b|p\\b|w\\b|x)"
ERA_DECADE_PATTERN = r"(?<!\w)(19[4-9]0[’']?s|20[0-2]0[’']?s|[’']\d0s)(?!\w)"
ERA_FRENCH_PATTERN = r"\bann[ée]es?\s+([4-9]0)\b"
PRICE_CONTACT = "Contact for price"
PRICE_CONTACT_FRENCH = "Contactez nous pour les details"
PRICE_SOLD_FRENCH = "Vendu"
PRICE_OUT_OF_STOCK_FRENCH = "Rupture de stock"

# --- dimensions ---------------------------------------------------------------------------------
DIM_NUMBER = r"\d+(?:[.,]\d+)?"
DIM_SIGNAL_PATTERN = r"(cm|in|\"|''|”|″|[WLDHPØ])"
DIM_FRENCH_LABELS = {"largeur": "L", "longueur": "L", "profondeur": "P", "hauteur": "H"}
DIM_ENGLISH_LABELS = {"length": "L", "width": "W", "depth": "D", "height": "H"}
DIM_PREFIXES = ("fauteuil", "ottoman")
DIM_SKIPPED_CONTEXT = r"\b(assise|dossier|abat-jour|mur)\b"
DIM_SEAT_CONTEXT = r"\b(seat|back|assise|dossier)\b"
DIM_BARE_PATTERN = r"\d+(?:\.\d+)?\s*[WLDH]\s*x?\s*\d+(?:\.\d+)?"
DIM_MAX_CM = 1000
# Each pattern whole, as it is matched.
# L x P x H with optional units and letters
DIM_CROSS_PATTERN = (
    r"(\d+(?:[.,]\d+)?\s*(?:(?:(?:cm|in|\"|''|”|″))\s*)?[WLDHP]?\s*[xX]\s*\d+(?:[.,]\d+)?\s*(?:(?:"
    r"(?:cm|in|\"|''|”|″))\s*)?[WLDHP]?(?:\s*[xX]\s*\d+(?:[.,]\d+)?\s*(?:(?:(?:cm|in|\"|''|”|″))"
    r"\s*)?[WLDHP]?)?)"
)
# the same with notes in brackets
DIM_CROSS_NOTED_PATTERN = (
    r"(\d+(?:[.,]\d+)?\s*(?:(?:(?:cm|in|\"|''|”|″))\s*)?[WLDHP]?(?:\s*\([^)]{1,32}\))?)\s*[xX×]\s*"
    r"(\d+(?:[.,]\d+)?\s*(?:(?:(?:cm|in|\"|''|”|″))\s*)?[WLDHP]?(?:\s*\([^)]{1,32}\))?)(?:\s*[xX×]"
    r"\s*(\d+(?:[.,]\d+)?\s*(?:(?:(?:cm|in|\"|''|”|″))\s*)?[WLDHP]?(?:\s*\([^)]{1,32}\))?))?"
)
# a number and its unit
DIM_MEASURE_PATTERN = r"(\d+(?:[.,]\d+)?)\s*((?:cm|in|\"|''|”|″))?"
# width, depth and height in a run
DIM_FRENCH_RUN_PATTERN = (
    r"\b(?:largeur|longueur)\s*:?\s*(\d+(?:[.,]\d+)?)\s*((?:cm|in|\"|''|”|″))?.{0,32}?\bprofondeur"
    r"\s*:?\s*(\d+(?:[.,]\d+)?)\s*((?:cm|in|\"|''|”|″))?.{0,32}?\bhauteur\s*:?\s*(\d+(?:[.,]\d+)?)"
    r"\s*((?:cm|in|\"|''|”|″))?"
)
# diameter and height
DIM_ROUND_PATTERN = (
    r"(\d+(?:[.,]\d+)?\s*(?:(?:cm|in|\"|''|”|″))?\s*Ø)\s*[xX×]\s*(\d+(?:[.,]\d+)?\s*(?:"
    r"(?:cm|in|\"|''|”|″))?\s*[HP])"
)
# label, context and the text up to the next label
DIM_FRENCH_SEGMENT_PATTERN = (
    r"\b(largeur|longueur|profondeur|hauteur)(\s*(?:\([^)]*\)|totale?)?)\s*:(.*?)(?=\b"
    r"(?:largeur|longueur|profondeur|hauteur)(?:\s*(?:\([^)]*\)|totale?)?)\s*:|$)"
)
# a piece and the text up to the next one
DIM_PREFIX_SEGMENT_PATTERN = r"\b(fauteuil|ottoman)\s*:(.*?)(?=\b(?:fauteuil|ottoman)\s*:|$)"
# letter labels (W 20 cm) or word labels (width: 20 cm), not shortly after seat or back
DIM_LABELLED_PATTERN = (
    r"(?=[HWLDP])(?:(?<![A-Z])([HWLDP])(?![A-Z])\.?\s*:?\s*(?:approx(?:imately)?\.?\s*)?|(?<!"
    r"(?:seat|back).{0,8})\b(length|width|depth|height)\s*(?::|approx(?:imately)?\.?)?\s*)(\d+"
    r"(?:[.,]\d+)?(?:\s*[-/]\s*\d+(?:[.,]\d+)?)?)\s*(cm|in|\"|''|”|″)?"
)
# one measure with its letter; twenty characters on either side as groups 1 and 3
DIM_SINGLE_PATTERN = (
    r"(?=\d)(?<=(^.{0,19}|.{20}))(\d+(?:[.,]\d+)?\s*(?:cm|in|\"|''|”|″)\s*(?:Ø|[HWDLP])\b)(?="
    r"(.{0,20}))"
)

# --- feeds --------------------------------------------------------------------------------------
FEED_LIMIT = 200
FEED_LIMIT_BULK = 600
FEED_LIMIT_LEGACY = 120
LINK_LIMIT = 200  # over a whole source
FALLBACK_CONFIDENCE = 0.45
FALLBACK_TYPE = "seed_fallback"
LIVE_TYPE = "live_fetch"
FEED_CONFIDENCE = {
    "collection": 0.86,
    "store": 0.82,
    "storefront": 0.84,
    "gallery": 0.9,
    "gallery_pages": 0.78,
    "embedded": 0.9,
    "product_page": 0.82,
    "meta_page": 0.66,
}
EMBEDDED_PRODUCTS_PATTERN = r'(?s)"productsWithMetaData":\{"list":(\[.*?\]),"totalCount":\d+\}'
EMBEDDED_STATE_PATTERN = r"(?s)window\.__PRELOADED_STATE__=(.*?)</script>"
GALLERY_MEDIA_URL = "https://static.wixstatic.com/media/"
GALLERY_PAGES_MEDIA_URL = "https://freight.cargo.site/w/1200/i/"
GALLERY_COMPONENT = "Masonry"

# --- traffic ------------------------------------------------------------------------------------
TRACKED_LANGS = ("en", "fr")
PAGE_EXACT = {"/": "home", "/shops": "shops", "/favourites": "favourites"}
PAGE_PREFIXES = {"/listing/": "listing", "/shops/": "shop", "/categories/": "category"}
BLOCKED_PREFIXES = (
    "/admin", "/analytics", "/cron", "/healthz", "/internal", "/readyz", "/static",
)
BLOCKED_PATHS = ("/manifest.webmanifest", "/robots.txt", "/service-worker.js", "/sitemap.xml")
TRAFFIC_DAYS = 14
DAILY_LIMIT = 30
PAGE_TYPE_LIMIT = 20
TOP_PATH_LIMIT = 20

# --- monitoring ---------------------------------------------------------------------------------
STALE_MINUTES = 90
HIDDEN_SPIKE_COUNT = 50
HIDDEN_SPIKE_RATIO = 0.25
AUDIT_RUNNING_LIMIT = 50
AUDIT_NON_SUCCESS_LIMIT = 100
AUDIT_ERROR_CHARS = 160

# --- display labels -----------------------------------------------------------------------------
# kind, value, language -> label
LABELS = {
    "status": {
        "en": {"available": "Available", "sold_out": "Sold out", "unknown": "Unknown",
               "removed": "Removed"},
        "fr": {"available": "Disponible", "sold_out": "Vendu", "unknown": "Inconnu",
               "removed": "Retiré"},
    },
    "category": {
        "en": {},
        "fr": {
            "sideboards / credenzas": "buffets / crédences",
            "dressers / commodes": "commodes",
            "dining tables": "tables à manger",
            "dining chairs": "chaises de salle à manger",
            "lounge chairs": "fauteuils",
            "sofas": "sofas",
            "coffee tables": "tables basses",
            "desks": "bureaux",
            "bookshelves / wall units": "bibliothèques / unités murales",
            "nightstands": "tables de chevet",
            "beds / bedroom storage": "lits / rangement de chambre",
            "lighting": "luminaires",
            "furniture": "mobilier",
        },
    },
    "material": {
        "en": {"teak": "teak", "rosewood": "rosewood", "walnut": "walnut",
               "cherry wood": "cherry wood", "wood": "wood", "glass": "glass",
               "chrome": "chrome", "aluminum": "aluminum", "leather": "leather",
               "metal": "metal", "upholstery": "upholstery", "wool": "wool", "steel": "steel",
               "ceramic": "ceramic", "sherpa": "sherpa"},
        "fr": {"teak": "teck", "rosewood": "palissandre", "walnut": "noyer",
               "cherry wood": "bois de cerisier", "wood": "bois", "glass": "verre",
               "chrome": "chrome", "aluminum": "aluminium", "leather": "cuir",
               "metal": "métal", "upholstery": "revêtement", "wool": "laine", "steel": "acier",
               "ceramic": "céramique", "sherpa": "sherpa"},
    },
    "condition": {
        "en": {"Restored": "Restored", "Reupholstered": "Reupholstered",
               "Refinished": "Refinished"},
        "fr": {"Restored": "Restauré", "Reupholstered": "Retapissé", "Refinished": "Refini"},
    },
}
ERA_LABEL = {"en": "%ss", "fr": "années %s"}
ERA_PATTERN = r"^((?:19|20)\d0)s$"
FRESHNESS = {
    "en": ("checked today", "checked this week", "needs refresh"),
    "fr": ("vérifié aujourd’hui", "vérifié cette semaine", "à rafraîchir"),
}
QUOTE_REQUIRED = {"en": "Contact us for details", "fr": "Contactez-nous pour les détails"}
LISTING_COUNT = {"en": ("1 listing", "%d listings"), "fr": ("1 annonce", "%d annonces")}
PRICE_SUFFIX = {
    "en": {"count": " for set of ", "pair": " for pair", "each": " each", "set": " for the set"},
    "fr": {"count": " pour l’ensemble de ", "pair": " pour la paire", "each": " chaque",
           "set": " pour l’ensemble"},
}
PRICE_SET_COUNT_PATTERN = r"/\s*([0-9]+)\b"
PRICE_PAIR_PATTERN = r"/\s*(paire|pair)\b"
PRICE_EACH_PATTERN = r"(?:^|[\s/])(ch\.?|chaque|each)(?:\s|$)"
PRICE_WHOLE_SET_PATTERN = r"/\s*(l['’]ens\.?|ensemble|set)\b"
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August",
           "September", "October", "November", "December"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
           "septembre", "octobre", "novembre", "décembre"),
}
DIRECTIONS_URL = "https://www.google.com/maps/search/?api=1&query="
APPLE_MAPS_URL = "https://maps.apple.com/?q="
STATIC_PATHS = ("/", "/shops", "/about")
SAVED_SEARCH_NAME_CHARS = 120
SAVED_SEARCH_DEFAULT_NAME = "Default browse"
