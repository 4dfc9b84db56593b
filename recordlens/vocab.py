"""Word lists, thresholds and patterns the results depend on."""

# --- fixed values: warning register ---------------------------------------
HAZARD_NAMES = {
    "EQ": "earthquake",
    "TC": "tropical cyclone",
    "FL": "flood",
    "DR": "drought",
    "WF": "wildfire",
}
OPEN = "OPEN"
CLOSED_BY_SOURCE = "CLOSED_BY_SOURCE"
DISSIPATED = "DISSIPATED"
STATUSES = (OPEN, CLOSED_BY_SOURCE, DISSIPATED)
HISTORY_EVENTS = (
    "NOTARIZED", "REVISED", "CORRECTED", "REAPPEARED", "CLOSED_BY_SOURCE", "DISSIPATED",
)
VERDICTS = ("EPISODE_ENDED", "MATERIALIZED_AS_ALERT", "NO_ALERT_MATCH")
TOP_OF_LADDER = ("Red", "Extreme")
STORM_STOPWORDS = (
    "TROPICAL", "CYCLONE", "HURRICANE", "STORM", "TYPHOON",
    "DEPRESSION", "POTENTIAL", "SUBTROPICAL", "SUPER",
)
VTEC_CLOSING_ACTIONS = ("CAN", "EXP", "UPG")
PRODUCT_SUFFIXES = (" Warning", " Watch", " Advisory", " Statement")

# --- fixed values: reaction axis --------------------------------------------
EXPORT_COLUMNS = 58
EXPORT_MENTIONS = 31
EXPORT_ARTICLES = 33
EXPORT_COUNTRY = 51
BASELINE_DAYS = 28
RATE_NIGHTS_REQUIRED = 3
RATE_LOW = 0.25
RATE_HIGH = 0.50
RATE_JUMP = 0.10
LATENCY_NIGHTS_REQUIRED = 5

# --- fixed values: grid -----------------------------------------------------
LON_WEST, LON_EAST = 9.0, 30.0
LAT_SOUTH, LAT_NORTH = 53.5, 66.0
CELL_DEG = 0.5
# Minutes by which a declared sample may miss the scheduled time.
SAMPLE_TOLERANCE_MIN = 90
DRIFT_FIELDS = ("online", "eviction_date", "modification_date", "checksums")

# --- fixed values: page gate ------------------------------------------------
GATE_MIN_TOKENS = 60
GATE_MIN_PROSE = 3
GATE_CONSENT_TOKENS = 400
GATE_CONSENT_MARKERS = 2
CHALLENGE_MARKERS = (
    "verifying your browser",
    "incident id",
    "attention required",
    "just a moment",
    "checking your browser",
    "enable javascript and cookies to continue",
    "please enable cookies",
    "ray id",
    "access denied",
    "request unsuccessful",
    "bot detection",
    "ihre anfrage konnte nicht verarbeitet werden",
    "zugriff verweigert",
)
CONSENT_MARKERS = (
    "cookie",
    "cookies",
    "consent",
    "einwilligung",
    "datenschutzerklärung",
    "privacy policy",
    "matomo",
    "google analytics",
    "tracking",
    "opt-out",
    "opt out",
    "notwendige",
    "essenziell",
    "third-party",
)
SKIPPED_TAGS = (
    "script", "style", "nav", "header", "footer", "aside", "noscript",
    "title", "head", "svg", "form",
)

# --- fixed values: prose predicate ------------------------------------------
PROSE_MIN_TOKENS = 5
PROSE_MAX_TOKENS = 60
PROSE_MIN_STOP_SHARE = 0.18
STOPWORDS = (
    # English
    "the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "with", "as",
    "by", "that", "this", "is", "are", "was", "were", "be", "been", "has",
    "have", "had", "it", "its", "their", "they", "we", "you", "at", "from",
    "which", "who", "will", "not", "no", "but", "than", "into", "under",
    "over", "between", "about", "can", "may", "should", "would", "these",
    "those", "our", "your", "how",
    # German
    "der", "die", "das", "und", "oder", "zu", "im", "auf", "für", "mit",
    "als", "von", "dem", "den", "des", "ein", "eine", "einer", "ist", "sind",
    "war", "waren", "sein", "hat", "haben", "es", "sie", "wir", "an", "aus",
    "durch", "über", "unter", "zwischen", "nicht", "kein", "keine", "aber",
    "dass", "wird", "werden", "soll", "sollen", "muss", "diese", "dieser",
    "ihre", "unser", "wie",
)

# --- fixed values: weight of a passage --------------------------------------
SIGNAL_WEIGHTS = {
    "number": 2,
    "date": 2,
    "named_entity": 1,
    "negation": 2,
    "commitment_verb": 3,
}
SIGNAL_CAP = 5
NUMBER_UNITS = (
    "%", "percent", "prozent", "mio", "million", "millionen", "mrd", "billion", "bn",
)
DATE_MONTHS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "januar", "februar", "märz", "mai", "juni", "juli", "oktober", "dezember",
)
NEGATIONS = (
    "no", "not", "never", "none", "kein", "keine", "keinen", "nicht", "niemals",
)
COMMITMENTS = (
    "will", "shall", "must", "commit", "commits", "committed", "pledge", "pledged", "pledges",
    "wird", "werden", "muss", "müssen", "soll", "sollen", "verpflichtet",
)

# --- fixed values: text events ----------------------------------------------
ALIGN_FLOOR = 0.5
EVENT_TYPES = (
    "number_revised", "date_shifted", "negation_flipped",
    "commitment_removed", "attribution_removed",
)
# Texts of the rules, as results carry them.
YEAR_REWRITTEN = "year rewritten in place"
FIGURE_REWRITTEN = "figure rewritten in place"
MONTH_DROPPED = "month name dropped from the sentence"
NEGATION_CHANGED = "negation count changed"
COMMITMENT_DROPPED = "commitment verb dropped in rewrite"
ASCRIPTION_DROPPED = "ascription dropped in rewrite"
COMMITMENT_REMOVED = "sentence with commitment verb removed"
ASCRIPTION_REMOVED = "sentence with an ascription removed"
ANSWER_TYPES = EVENT_TYPES + ("none",)
VERDICT_TYPES = EVENT_TYPES + ("none_of_these",)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december", "januar", "februar", "märz", "mai", "juni", "juli",
    "august", "september", "oktober", "november", "dezember",
)
ATTRIBUTIONS = (
    "according to", "as stated by", "said", "says", "stated", "told", "announced by",
    "spokesperson", "spokeswoman", "spokesman", "director", "minister", "president",
    "commissioner", "chairman", "chairwoman", "chair of", "head of",
    "laut", "zufolge", "sagte", "sagt", "erklärte", "betonte", "teilte mit", "nach angaben",
    "sprecher", "sprecherin", "präsident", "präsidentin", "minister", "ministerin",
    "staatssekretär", "direktor", "direktorin", "leiter", "leiterin", "vorstand",
)
# Titles end in a dot, so they count only when a word character follows directly.
ATTRIBUTION_TITLES = ("dr", "prof")

# --- fixed values: live look, sampling, caps --------------------------------
LIVE_CLASSES = (
    "ok", "gone_404", "gone_410", "legal_451", "botwall", "server_error", "unreachable", "other",
)
LIVE_GONE = ("gone_404", "gone_410")
LIVE_EXCLUDED = ("botwall", "server_error", "unreachable")
SAMPLE_PER_INSTITUTION = 5
MOMENT_LIMIT = 100
CATEGORIES = ("A", "B", "C", "D", "E")
STRATEGIES = ("domain", "prefix", "single_url")
MIN_CONTROLS = 15
#: Event types that count as the loss of a passage.
LOSS_TYPES = ("commitment_removed", "attribution_removed", "negation_flipped")
