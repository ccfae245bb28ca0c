"""Fixed values of the container format and of OOXML. They must equal the documented ones for right results."""

SIMILARITY_THRESHOLD = 0.7
PREVIEW_LENGTH = 50
HASH_PREFIX_LENGTH = 16
ERROR_LENGTH = 150
MAX_IMAGE_BYTES = 10 * 1024 * 1024
MAX_ASSET_BYTES = 50 * 1024 * 1024
MAX_TABLE_ROWS = 1000
MAX_TABLE_COLS = 100
MAX_TABLE_LINES = 2000
EMUS_PER_INCH = 914400
MAX_BORDER_WIDTH = 96
CORE_FILES = ["content.md", "styles.json"]
TRACKING_FILES = ["structure.json", "manifest.json"]
ALL_FILES = CORE_FILES + TRACKING_FILES
CHART_PREFIX = "Chart"
DEFAULT_STYLE = {"font_name": "Calibri", "font_size": 11, "alignment": "left"}
FORMAT_VERSION = "1.0.0"

# Border styles that are kept.
BORDER_STYLES = [
    "single", "double", "dashed", "dotted", "thick", "hairline", "dashSmallGap", "dotDash", "dotDotDash", "triple",
    "thinThickSmallGap", "thickThinSmallGap", "thinThickThinSmallGap", "thinThickMediumGap", "thickThinMediumGap",
    "thinThickThinMediumGap", "thinThickLargeGap", "thickThinLargeGap", "thinThickThinLargeGap", "wave", "doubleWave",
    "dashDotStroked", "threeDEmboss", "threeDEngrave", "outset", "inset", "nil", "none",
]

# Pattern fills that are kept.
PATTERN_FILLS = [
    "horzStripe", "vertStripe", "diagStripe", "reverseDiagStripe", "horzCross", "diagCross", "thinHorzStripe", "thinVertStripe",
    "thinDiagStripe", "thinReverseDiagStripe", "thinHorzCross", "thinDiagCross", "pct5", "pct10", "pct12", "pct15", "pct20", "pct25",
    "pct30", "pct35", "pct37", "pct40", "pct45", "pct50", "pct55", "pct60", "pct62", "pct65", "pct70", "pct75", "pct80", "pct85",
    "pct87", "pct90", "pct95",
]

HEX_COLOR = "^[0-9A-Fa-f]{6}$"

# Prices per 1000 tokens and per page.
INPUT_PRICE, OUTPUT_PRICE, PAGE_PRICE = 0.003, 0.015, 0.01
