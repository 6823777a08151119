"""Column lists, formats and model defaults."""

# --- activity log -----------------------------------------------------------
LOG_COLUMNS = [
    "id", "date", "user", "pc", "to", "cc", "bcc", "from",
    "activity", "size", "attachments", "content",
]
RECIPIENT_COLUMNS = ["to", "cc", "bcc"]
LOG_TIME_FORMAT = "M/d/yyyy H:mm:ss"
LOG_TIME_TEXT = "MM/dd/yyyy HH:mm:ss"
INDEX_TIME_FORMAT = "M/d/yyyy H:mm:ss"
INTERNAL_DOMAIN = "dtaa.com"
RELEASE = "6.2"
WORKDAY_START_HOUR = 7
WORKDAY_END_HOUR = 18

# --- text style check -------------------------------------------------------
STOPWORDS = ["the", "is", "and", "of", "to", "in", "a", "was", "were"]
SNIPPET_CHARS = 160
SNIPPETS = 5

# --- static anomaly model ---------------------------------------------------
NUMERIC_FEATURES = [
    "size", "attachment_count", "n_recipients_internal",
    "n_recipients_external", "semantic_deviation",
]
RARITY_FEATURES = ["has_external_recipient", "is_after_hours", "is_weekend"]
LOG_SCALED = [
    "size", "attachment_count", "n_recipients_internal", "n_recipients_external",
]
MIN_HISTORY = 30
VARIANCE_FLOOR = 1e-3
RATE_FLOOR = 1e-3
MAX_Z = 6.0
RARITY_WEIGHT = 0.5
BUDGETS = (0.001, 0.005, 0.01)

# --- contextual bandit ------------------------------------------------------
BASE_CONTEXT = [
    "size", "attachment_count", "n_recipients_internal",
    "n_recipients_external", "semantic_deviation", "hour_of_day",
    "is_after_hours", "is_weekend", "has_external_recipient",
]
SCALER_FLOOR = 1e-6
TRUE_POSITIVE_REWARD = 10.0
REVIEW_COST = 1.0
POLICY_GRID = [
    ("low_exploration", 0.25, 10.0),
    ("default", 1.0, 10.0),
    ("high_exploration", 2.0, 10.0),
    ("high_threat_value", 1.0, 100.0),
]
PCA_COMPONENTS = 32
ENCODER_BATCH = 256
