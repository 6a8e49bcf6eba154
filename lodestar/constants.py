"""Domain values every operator shares."""

from __future__ import annotations

# --- Fixed values: results depend on these exact numbers, names and texts. ---

EVENT_TYPES = [
    "view_full",
    "view_scroll_past",
    "click",
    "dwell",
    "share",
    "save",
    "skip",
    "report",
    "hide",
]

SIGNAL_WEIGHTS = {
    "view_full": 1.0,
    "view_scroll_past": -0.25,
    "click": 1.5,
    "dwell": 1.25,
    "share": 3.0,
    "save": 3.0,
    "skip": -1.0,
    "report": -3.0,
    "hide": -3.0,
}

NEGATIVE_EVENTS = ["view_scroll_past", "skip", "report", "hide"]
IMPRESSION_EVENTS = ["view_full", "view_scroll_past", "click"]
SUPPRESSING_EVENTS = ["report", "hide"]

CATEGORIES = [
    "news",
    "sports",
    "tech",
    "music",
    "gaming",
    "food",
    "travel",
    "fashion",
    "finance",
    "comedy",
]
DEVICES = ["ios", "android", "web", "tv"]

RANKING_FEATURES = [
    "user_item_dot_product",
    "item_freshness_score",
    "user_item_category_affinity",
    "time_decay",
    "diversity_score",
    "historical_ctr",
    "popularity_score",
]

EXPLANATIONS = {
    "user_item_dot_product": "you viewed similar content recently",
    "item_freshness_score": "it's new and trending right now",
    "user_item_category_affinity": "you engage a lot with this category",
    "time_decay": "it matches what you usually browse at this time of day",
    "diversity_score": "it broadens your feed with something different",
    "historical_ctr": "other users like it a lot",
    "popularity_score": "it's currently popular across the platform",
}
DEFAULT_EXPLANATION = "it matches your personalization profile"

USER_COLD_START_INTERACTIONS = 10
ITEM_COLD_START_IMPRESSIONS = 100

MAX_CLOCK_SKEW_SECONDS = 300
MAX_EVENT_AGE_SECONDS = 7 * 86400
DEDUPE_TTL_SECONDS = 3600

FRESHNESS_HALF_LIFE_HOURS = 48.0
FRESHNESS_WEIGHT = 0.3
FORCED_EXPLORATION_RATE = 0.05

TRENDING_Z_THRESHOLD = 3.0
TRENDING_POOL = 1000
TRENDING_MIN_ITEMS = 5
TRENDING_HORIZON_SECONDS = 3600

RECENT_ITEMS_LIMIT = 50
RECENT_ITEMS_TTL_SECONDS = 86400
EMBEDDING_TTL_SECONDS = 3600
ITEM_SCORE_TTL_SECONDS = 300
EXPERIMENT_TTL_SECONDS = 604800
SESSION_GAP_SECONDS = 900

ANN_K = 1000
FEED_SIZE = 20
SIMILAR_ITEMS = 10
EXPLORATION_CANDIDATES = 5
TRENDING_CANDIDATES = 10

SEEN_PENALTY = 0.5
FRESHNESS_BOOST = 1.10
NEW_ITEM_HOURS = 24
MMR_LAMBDA = 0.7
CATEGORY_FRACTION = 0.4

BANDIT_EPSILON = 0.10
HOLDBACK_FRACTION = 0.05
EXPERIMENT_BUCKETS = 100
HOLDBACK_RESOLUTION = 10000
HOLDBACK_KEY = "__global_holdback__"
VARIANTS = ["control", "treatment", "holdback"]

SRM_P_THRESHOLD = 0.001
ALPHA = 0.05
POWER = 0.8
RELATIVE_MDE = 0.02

RATE_LIMIT = 100
RATE_WINDOW_SECONDS = 1
ERROR_RATE_ALERT = 5.0
REJECTION_RATE_ALERT = 50.0
LAG_ALERT_SECONDS = 1800
CANARY_CTR_DROP = -0.05
CANARY_LATENCY_DELTA_MS = 10.0
CANARY_LATENCY_RATIO = 1.2
CANARY_CTR_RATIO = 0.95

NEGATIVES_PER_POSITIVE = 4
SEQUENCE_LENGTH = 50
VALIDATION_FRACTION = 0.1
ONLINE_LEARNING_RATE = 1e-4
CF_FACTORS = 32

LATENCY_BUCKETS = [0.001, 0.002, 0.005, 0.008, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.25, 0.5, 1.0]
SCORE_BUCKETS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]

# --- End of fixed values. ---
