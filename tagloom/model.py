"""Schemas and constants."""

from __future__ import annotations

POI_SCHEMA = "id bigint, tags map<string,string>, geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, lod_level int"
EVAL_SCHEMA = "lens string, tag_id string, primitive string, num double, dist array<double>, model string, at timestamp, schema_version int"
SCHEMA_VERSION = 2

# Limits and margins.
VIEWPORT_CAP, COUNT_CAP = 30_000, 2_000_000
RESOLUTION_MARGIN = 0.999
LENS_MIN_ZOOM = 13
MAX_SAFE_INTEGER = 2**53 - 1
EXPAND_MAX_DISTINCT, TOP_VALUES = 20_000, 50
ALLOW_MIN, ALLOW_MIN_REGION = 100, 20
REGION = (122.0, 20.0, 154.0, 46.0)  # lon, lat, lon, lat
BUDGET_CHARS, MAX_QUESTIONS, MAX_BATCHES = 34 * 1024, 190, 8
BACKOFF_MS, MAX_ATTEMPTS, TIMEOUT_S = (300, 700, 1500, 3000, 6000), 6, 30
RADIUS_MIN, RADIUS_BASE, RADIUS_MAX = 1.5, 3.0, 6.0
OPACITY_BASE, OPACITY_MIN, OPACITY_RAISED = 0.75, 0.3, 0.9
NEUTRAL = 2.0

# Enumerations, in order.
PRIMITIVES = ("noul", "score", "choice")
CHOICES = ("主役", "脇役", "背景", "妨げ", "無関係")
FAILURES = ("rate_limit", "overloaded", "server", "timeout", "network", "invalid", "auth")
RETRYABLE = ("rate_limit", "overloaded", "server", "timeout", "network")
PALETTE = ("#D55E00", "#E69F00", "#009E73", "#0072B2", "#999999")
UNEVALUATED = "#333333"

# The roles of tag keys.
CATEGORY_KEYS = (
    "amenity", "shop", "tourism", "leisure", "historic", "healthcare", "office", "craft", "man_made", "natural", "public_transport", "railway",
    "aeroway", "emergency", "attraction", "club", "place", "highway", "building", "landuse",
)
REFINE_KEYS = (
    "cuisine", "religion", "denomination", "information", "vending", "sport", "artwork_type", "memorial", "archaeological_site",
    "historic:civilization", "board_type", "shelter_type", "parking", "bicycle_parking", "recycling_type", "social_facility", "social_facility:for",
    "healthcare:speciality", "waste", "clothes", "swimming_pool",
)
BRAND_KEYS = ["brand"]
UNKNOWN_VALUES = ["yes", "no"]
ROLES = {k: role for role, keys in (("category", CATEGORY_KEYS), ("refine", REFINE_KEYS), ("brand", BRAND_KEYS)) for k in keys}
# The keys counted as primary features of a row.
PRIMARY_KEYS = (
    "amenity", "shop", "tourism", "leisure", "historic", "office", "craft", "healthcare", "emergency", "public_transport", "railway", "aeroway",
    "man_made", "natural", "building", "highway", "landuse", "place", "sport", "attraction", "club",
)
