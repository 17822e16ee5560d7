"""Fixed values that results depend on: names, codes, schedules and limits."""

# The twenty window features in their contract order.
WINDOW_FEATURES = [
    "sig_mean", "sig_std", "sig_p2p", "sig_skew", "sig_kurt",
    "beats", "beats_per_min",
    "mean_rr", "sdnn", "rmssd", "pnn50", "mean_hr", "rr_cv", "rr_sampen", "rr_apen", "rr_dfa_alpha",
    "pow_lf", "pow_mf", "pow_hf", "pow_hf_ratio",
]

# Category of each window feature.
FEATURE_CATEGORY = {
    "MORPHOLOGY": ["sig_mean", "sig_std", "sig_p2p"],
    "SIGNAL_QUALITY": ["sig_skew", "sig_kurt"],
    "HR_DYNAMICS": ["beats", "beats_per_min", "mean_hr", "rr_cv"],
    "TIME": ["mean_rr", "sdnn", "rmssd", "pnn50"],
    "NONLINEAR": ["rr_sampen", "rr_apen", "rr_dfa_alpha"],
    "FREQUENCY": ["pow_lf", "pow_mf", "pow_hf", "pow_hf_ratio"],
}

# Features computed from the intervals between peaks.
INTERVAL_FEATURES = [
    "mean_rr", "sdnn", "rmssd", "pnn50", "mean_hr", "rr_cv", "rr_sampen", "rr_apen", "rr_dfa_alpha",
]

# Entity statistics of each window feature.
ENTITY_STATS = ["mean", "std", "p10", "p50", "p90"]

# Window status names.
SUCCESS = "SUCCESS"
OUTSIDE_RECORD = "OUTSIDE_RECORD"
READ_ERROR = "READ_ERROR"
EMPTY_SIGNAL = "EMPTY_SIGNAL"
SHORT_READ = "SHORT_READ"
FEATURE_ERROR = "FEATURE_ERROR"

# Window quality reasons.
AF_INCOMPATIBLE_HRV = "AF_INCOMPATIBLE_HRV"
INSUFFICIENT_VALID_NN = "INSUFFICIENT_VALID_NN"
INVALID_RR_RATIO = "INVALID_RR_RATIO"

# Schedules and limits.
FULL_SCHEDULE = {"first": 60, "stride": 300, "length": 300}
HOURLY_SCHEDULE = {"first": 60, "stride": 3600, "length": 120, "count": 24}
PEAK_PERCENTILE = 0.93
PEAK_SPACING_SEC = 0.25
INTERVAL_MIN_SEC = 0.30
INTERVAL_MAX_SEC = 2.00
INTERVAL_TOLERANCE = 0.20
MIN_VALID_INTERVALS = 10
MAX_REMOVED_RATIO = 0.20
BURDEN_THRESHOLD = 0.20

# Outcome horizons in days and outcome states.
HORIZONS = [90, 180, 365, 730]
STATES = ["POSITIVE", "NEGATIVE", "CENSORED", "COMPETING_EVENT", "UNKNOWN"]

# Source codes and their labels.
CAUSE_LABELS = {0: "SURVIVOR", 1: "NON_CARDIAC_DEATH", 3: "SCD", 6: "PUMP_FAILURE_DEATH", 7: "PUMP_FAILURE_DEATH"}
EVENT_TYPES = {"0": "NO_SCD_RECORDED", "1": "NON_CARDIAC_DEATH", "3": "SCD", "6": "PUMP_FAILURE_DEATH", "7": "PUMP_FAILURE_DEATH"}
EXIT_LABELS = {0: "SURVIVOR", 1: "LOST_TO_FOLLOWUP", 2: "CARDIAC_TRANSPLANTATION", 3: "DEATH"}
RHYTHM_LABELS = {0: "SINUS", 1: "PERMANENT_AF", 2: "ATRIAL_FLUTTER", 3: "PACEMAKER"}

# Eligibility reasons in priority order.
ELIGIBILITY_REASONS = ["NO_HOLTER", "PROCESSING_FAILED", "AF", "HIGH_PVC_BURDEN", "NO_QC_VALID_WINDOWS", "ELIGIBLE"]

# Text spellings of a binary label.
LABEL_TEXT = {
    "1": 1, "0": 0, "yes": 1, "no": 0, "true": 1, "false": 0,
    "high": 1, "low": 0, "positive": 1, "negative": 0,
}

# Metric names and repeated-run statistics.
METRICS = ["AUC", "AP", "Brier", "Sens", "Spec", "F1", "PPV", "NPV"]
RUN_STATISTICS = ["mean", "std", "median", "min", "max", "p2.5", "p25", "p75", "p97.5"]

# Model search grids.
L2_GRID = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
ELASTIC_C_GRID = [0.001, 0.01, 0.1, 1.0, 3.0]
ELASTIC_L1_GRID = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
BALANCED_C_GRID = [0.01, 0.1, 1.0, 3.0, 10.0]
SCREEN_C = 0.1
SCREEN_L1_RATIO = 0.5
MAX_RECIPE_INPUTS = 24
TREE_GRID = {
    "n_estimators": [400, 800, 1200, 1600],
    "max_depth": [None, 4, 6, 8, 10, 14],
    "min_samples_split": [2, 4, 6, 8, 10],
    "min_samples_leaf": [1, 2, 3, 4],
    "max_features": ["sqrt", "log2", 0.5, 0.7],
    "class_weight": ["balanced", "1:2", "1:3"],
}
