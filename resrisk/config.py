"""Feature lists, cost model, tiers, gates and fold settings."""

# Schema of the booking-time features, in model order.
CATEGORICAL_FEATURES = [
    "hotel", "arrival_date_month", "meal", "country", "market_segment", "distribution_channel",
    "reserved_room_type", "deposit_type", "agent", "customer_type",
]
FEATURES = [
    "hotel", "lead_time", "arrival_date_year", "arrival_date_month", "arrival_date_day_of_month",
    "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children", "babies", "meal",
    "country", "market_segment", "distribution_channel", "is_repeated_guest",
    "previous_cancellations", "previous_bookings_not_canceled", "reserved_room_type",
    "deposit_type", "agent", "customer_type", "adr", "required_car_parking_spaces",
    "total_of_special_requests", "had_company", "total_stay", "total_guests", "adr_per_person",
    "is_weekend_heavy", "revenue_at_risk", "month_sin", "month_cos", "is_late_window",
]
NUMERIC_FEATURES = [c for c in FEATURES if c not in CATEGORICAL_FEATURES]
PMS_FEATURES = [
    "lead_time", "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children", "babies",
    "adr", "reserved_room_type", "deposit_type", "total_of_special_requests", "month_sin",
    "month_cos", "total_stay", "total_guests", "adr_per_person", "is_weekend_heavy",
    "revenue_at_risk", "is_late_window",
]
TARGET = "is_canceled"
NON_NEGATIVE = [
    "lead_time", "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children", "babies",
    "adr", "total_stay", "total_guests", "adr_per_person", "revenue_at_risk",
]

# Months in calendar order.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
NULL_TOKENS = ["NULL", "null", "", " "]

# Cleaning, cost model, tiers.
ADR_MAX_VALID = 50_000.0
FP_COST = 15.0
RECOVERY_NIGHTS = 1.0
TIER_MEDIUM = 0.40
TIER_HIGH = 0.70
LATE_WINDOW_DAYS = 3
DEFAULT_THRESHOLD = 0.5
MIN_POSITIVE_RATE = 0.05
MIN_RECALL = 0.20

# Splits and folds.
TRAIN_RATIO = 0.80
VAL_RATIO = 0.10
ROLLING_CUTOFFS = [0.60, 0.70, 0.80]
ROLLING_VAL_RATIO = 0.10
ROLLING_MIN_TRAIN = 1500
ROLLING_MIN_VAL = 500
WIDE_CUTOFFS = [0.50, 0.58, 0.66, 0.74, 0.82]
PMS_CUTOFFS = [0.40, 0.55, 0.70, 0.85]
LEARNING_FRACTIONS = [0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0]

# Quality gates as (policy, metric, minimum).
METRIC_GATES = [
    ("max_f1", "roc_auc", 0.84), ("max_f1", "pr_auc", 0.74), ("max_f1", "f1", 0.71),
    ("max_f1", "recall", 0.82), ("high_precision", "precision", 0.98),
    ("high_precision", "recall", 0.07),
]
SEGMENT_GATES = [("roc_auc", 0.75), ("pr_auc", 0.42), ("f1", 0.43)]
SEGMENT_DIMENSIONS = {
    "hotel": 10, "market_segment": 10, "distribution_channel": 10, "arrival_date_month": 12,
}
SEGMENT_MIN_ROWS = 500

# Drift cut-offs and smoothing.
PSI_STABLE, PSI_MONITOR = 0.10, 0.25
PSI_WARN, PSI_ALERT = 0.10, 0.20
PSI_COUNT_EPS, PSI_SHARE_EPS = 1e-4, 1e-6

# Model sizes. Early stopping usually ends a boosted fit well before its rounds.
BOOST_ROUNDS, BOOST_DEPTH = 100, 5
# The two challengers have the same capacity, the first family a smaller one.
FAMILY_SIZES = {
    "gradient_boosting": {"rounds": 100, "depth": 5, "step": 0.1},
    "boosting_subsampled": {"rounds": 300, "depth": 7, "step": 0.05},
    "boosting_small_steps": {"rounds": 300, "depth": 7, "step": 0.05},
}
# The family taken where too few rows allow no comparison.
FALLBACK_FAMILY = "gradient_boosting"
ADR_ROUNDS = 50
BOOTSTRAP_REPLICATES = 2000
