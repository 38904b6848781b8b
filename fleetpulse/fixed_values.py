"""They must equal the published ones for results to agree."""

from __future__ import annotations

# Raw attribute columns a daily log may carry.
RAW_ATTRIBUTES = [
    "r_5", "r_9", "r_12", "r_173", "r_174", "r_175", "r_177", "r_180", "r_181", "r_182",
    "r_183", "r_184", "r_187", "r_195", "r_197", "r_199", "r_233", "r_241", "r_242",
]

# Attributes kept per device model (the others are mostly null for it).
MODEL_ATTRIBUTES = {
    "MA1": ["r_5", "r_9", "r_12", "r_173", "r_174", "r_175", "r_180", "r_184", "r_187", "r_195", "r_197", "r_199"],
    "MA2": ["r_5", "r_9", "r_12", "r_174", "r_175", "r_183", "r_184", "r_187", "r_197", "r_199", "r_233", "r_241", "r_242"],
    "MB1": ["r_5", "r_9", "r_12", "r_177", "r_180", "r_181", "r_182", "r_183", "r_184", "r_187", "r_195", "r_197", "r_199", "r_241", "r_242"],
    "MB2": ["r_5", "r_9", "r_12", "r_177", "r_180", "r_181", "r_182", "r_183", "r_184", "r_187", "r_195", "r_197", "r_199", "r_241", "r_242"],
    "MC1": ["r_5", "r_9", "r_12", "r_173", "r_174", "r_180", "r_183", "r_184", "r_187", "r_195", "r_197", "r_199"],
    "MC2": ["r_5", "r_9", "r_12", "r_173", "r_174", "r_180", "r_183", "r_184", "r_187", "r_195", "r_197", "r_199"],
}

# Days whose attributes are all null.
SKIPPED_DAY_FILES = ["20180101.csv", "20180102.csv"]

# Windowing, sampling and clustering sizes.
WINDOW_DAYS = 30
HORIZON_DAYS = 30
PATCH_DAYS = 5
HEALTHY_PER_FAILED = 23.0
SAMPLE_SEED = 2026
ATTR_PROTOTYPES = 16
CROSS_PROTOTYPES = 8
MAX_FALSE_ALARM = 0.05
NOVELTY_QUANTILES = [i * ((0.995 - 0.90) / 11) + 0.90 for i in range(12)]
FALLBACK_QUANTILE = 0.95
THRESHOLD_GRID = [i * ((0.95 - 0.05) / 18) + 0.05 for i in range(19)]
HISTOGRAM_BINS = 50
SEQUENCE_SEGMENTS = 4
HISTORY_DAYS = 20
FORECAST_DAYS = 10
NEIGHBOURS = 5
RECENT_DAYS = 7
SCALER_EPS = 1e-6
MIN_RANGE = 1e-6
SENSITIVITY_WINDOWS = [10, 20, 30, 40, 50]
SENSITIVITY_PATCHES = [2, 4, 5, 10, 15]

# Label columns, in order of preference.
LABEL_COLUMNS = ["y", "labels", "y_fail", "label", "status", "y_status"]

# Time-to-failure buckets and their midpoints in days.
TTF_BUCKETS = ["<7", "7-30", ">30"]
TTF_MIDPOINTS = {"<7": 3.5, "7-30": 18.5, ">30": 45.0}

# Attribute roles used by the triage rules.
ERROR_ATTRIBUTES = ["r_5", "r_181", "r_182", "r_183", "r_184", "r_187", "r_195", "r_197", "r_199", "r_180", "r_177"]

# Words that count as a mention of an attribute.
ATTRIBUTE_WORDS = {
    "r_5": ["r_5", "reallocated sector", "re-allocated sector"],
    "r_187": ["r_187", "reported uncorrectable", "uncorrectable error"],
    "r_197": ["r_197", "current pending sector", "pending sector"],
}

# Name fragments that put an attribute in a group, tested in this order.
GROUP_WORDS = {
    "error": ["error", "err", "uncorr", "uncorrect", "realloc", "re-alloc", "reallocated", "pending", "crc",
              "timeout", "fail", "failure", "bad_block", "bad block", "media_error"],
    "wear": ["wear", "erase", "erases", "erase_count", "pe_cycle", "lifetime", "life", "program", "nand_wr",
             "nand writes"],
    "workload": ["read", "write", "throughput", "iops", "bandwidth", "util", "queue", "qdepth", "latency"],
}

# Series label -> phrase.
ATTR_PHRASES = {
    "UNUSED_PROTO": "prototype rarely activated in training windows",
    "ZERO_OR_NEAR_ZERO": "always zero or near zero throughout the patch",
    "LOW_STABLE": "roughly constant over the patch",
    "HIGH_STABLE": "stays at a high but stable level",
    "SLOW_RISE": "slowly increasing over the patch",
    "SLOW_DECAY": "slowly decreasing over the patch",
    "FAST_RISE": "rapidly increasing over the patch",
    "FAST_DECAY": "rapidly decreasing over the patch",
    "SATURATING_RISE": "rises and then levels off near saturation",
    "SATURATING_DECAY": "drops and then levels off at a lower plateau",
    "STEP_UP": "sudden jump to a higher stable level",
    "STEP_DOWN": "sudden drop to a lower stable level",
    "SINGLE_SPIKE_EARLY": "a single sharp spike early in the patch",
    "SINGLE_SPIKE_MID": "a single sharp spike in the middle of the patch",
    "SINGLE_SPIKE_LATE": "a single sharp spike late in the patch",
    "REPEATED_BURSTS": "multiple bursts within the patch",
    "LOW_RATE_BURSTS": "occasional small bursts on top of a stable baseline",
    "HIGH_RATE_BURSTS": "frequent bursts across most of the patch",
    "NOISY_FLUCTUATIONS": "noisy up-and-down fluctuations",
    "DRIFT_WITH_NOISE": "slow drift with moderate noise around the trend",
    "U_SHAPED": "drops and then rises, forming a U-shaped pattern",
    "HUMP_SHAPED": "rises and then falls, forming a hill-shaped pattern",
}

# Cross-attribute label -> phrase.
CROSS_PHRASES = {
    "UNUSED_PROTO": "prototype rarely activated in training windows",
    "ALL_STABLE": "all monitored attributes stay stable in this patch",
    "WORKLOAD_SPIKE_NO_ERRORS": "workload or throughput counters spike but error counters stay flat",
    "WEAROUT_NO_ERRORS": "wear or usage attributes increase steadily while error counters stay near zero",
    "WEAROUT_WITH_ERRORS": "wear or usage attributes increase and one or more error counters also drift up",
    "FEW_ERROR_BURSTS": "a few attributes show bursts while most remain stable",
    "MULTI_ERROR_BURSTS": "many attributes show bursts or spikes together",
    "ERROR_BURST_ISOLATED": "a short-lived burst in one or two error attributes with little change elsewhere",
    "ERROR_BURST_WIDESPREAD": "coordinated bursts across many error and reliability attributes",
    "MULTI_ATTR_TRENDS": "several attributes show gradual trends but no sharp bursts",
    "TREND_PLUS_BURSTS": "gradual trends accompanied by bursts on a subset of attributes",
    "MIXED_PATTERN": "a mix of stable, trending, and spiky attributes",
    "RESET_OR_WRAP": "one or more counters drop sharply, suggesting a reset or wrap-around",
}
UNKNOWN_PHRASE = "unclassified pattern"
UNKNOWN_CROSS_PHRASE = "unclassified cross-attribute pattern"

# Series label -> role inside a cross-attribute pattern.
LABEL_ROLES = {
    "stable": ["ZERO_OR_NEAR_ZERO", "LOW_STABLE", "HIGH_STABLE", "UNUSED_PROTO"],
    "trend": ["SLOW_RISE", "SLOW_DECAY", "FAST_RISE", "FAST_DECAY", "SATURATING_RISE", "SATURATING_DECAY",
              "DRIFT_WITH_NOISE"],
    "spiky": ["SINGLE_SPIKE_EARLY", "SINGLE_SPIKE_MID", "SINGLE_SPIKE_LATE", "REPEATED_BURSTS", "LOW_RATE_BURSTS",
              "HIGH_RATE_BURSTS", "STEP_UP", "STEP_DOWN", "U_SHAPED", "HUMP_SHAPED"],
}

# Names of the confusion sources in derived tables.
SOURCE_RECONSTRUCTED = "published_table_sampled_support_reconstruction"
SOURCE_ZERO_ROW = "published_table_zero_row_visible_fpr_fallback"
SOURCE_TARGETS = "published_table_fallback_from_targets"
SOURCE_PREDICTIONS = "prediction_jsonl_filtered_to_sampled_indices"
ZERO_ROW_FPR = 0.01
