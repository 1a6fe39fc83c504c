"""Fixed values. They decide results, so they are data to be matched and not to be tuned."""

# Unit word -> (canonical unit, factor).
UNIT_FACTORS = {
    "gr": ("G", 1),
    "g": ("G", 1),
    "kg": ("G", 1000),
    "ml": ("ML", 1),
    "cc": ("ML", 1),
    "lt": ("ML", 1000),
    "l": ("ML", 1000),
}
COUNT_UNIT = "ADET"
COUNT_SUFFIXES = ("li", "lı", "lu", "lü", "adet")

# Patterns of sizes in titles: pack count before the size, size alone, count alone.
SIZE_NUMBER = r"(\d+[.,]?\d*)"
SIZE_UNIT = "(" + "|".join(UNIT_FACTORS) + r")\b"
SIZE_FLAGS = "(?iuU)"
PACK_FIRST = rf"{SIZE_FLAGS}(\d+)\s*x\s*{SIZE_NUMBER}\s*{SIZE_UNIT}"
SIZE_ONLY = rf"{SIZE_FLAGS}{SIZE_NUMBER}\s*{SIZE_UNIT}"
COUNT_ONLY = rf"{SIZE_FLAGS}(\d+)\s*'?\s*(?:{'|'.join(COUNT_SUFFIXES)})\b"

# Words dropped from a product title before comparing.
UNIT_WORDS = ("ml", "lt", "l", "g", "gr", "kg", "adet", "cc", "pet")
FILLER_WORDS = ("pet", "sise", "su", "dogal", "kaynak", "sade")

# Whole word -> words that replace it.
TITLE_ALIASES = {"kalem": "penne rigate"}

# Turkish letters and their plain forms.
FOLD_FROM = "ığüşöç"
FOLD_TO = "igusoc"

UNKNOWN_BRAND = "Unknown"
MATCH_THRESHOLD = 0.70
CATEGORY_ACCEPT = 0.85
CATEGORY_REVIEW = 0.40
OUTLIER_FACTOR = 3
RUN_PERIOD = "6 hours"

PENDING, APPROVED, REJECTED = "Pending", "Approved", "Rejected"
WEIGHT_OR_VOLUME, COUNT_FAMILY = "weight_or_volume", "count"
