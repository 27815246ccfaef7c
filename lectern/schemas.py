"""Fixed values of the domain: tags, weights, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tag codes of each step and what they mean.
TAGS = {
    "S1": {
        "L": "Leading whitespace",
        "T": "Trailing whitespace",
        "W": "Multiple / unexpected internal whitespace",
        "SP": "Space before punctuation",
        "C": "Suspicious / invisible Unicode character",
        "P": "Repeated or excessive punctuation",
        "G": "Non-Latin or unexpected glyph",
        "M": "Malformed or stray character",
        "MP": "Mixed punctuation inside word",
    },
    "S2": {
        "X": "Character misread (substitution)",
        "I": "Extra character in HTR (insertion)",
        "D": "Missing character in HTR (deletion)",
    },
    "S3": {
        "Q": "QU not followed by E or I",
        "WK": "Use of W or K",
        "DC": "Unexpected double consonants (excl. cc, ll, nn, rr)",
        "E": "Word ends in rare final consonant (C, F, K, M, P)",
        "T": "Triple letter repetition",
    },
}
#: Rule patterns in Java's syntax. (?d): only \n ends a line; (?U): Unicode classes.
STEP1_RULES = {
    "L": r"(?md)^[ \t]+",
    "T": r"(?md)[ \t]+$",
    "W": r"[ \t]{2,}",
    "SP": r"[ \t]+[.,;:!?]",
    "C": r"[\u200B\u200C\u200D\u2060\uFEFF]",
    "P": r"[.,;:!?]{2,}",
    "G": r"[^\p{IsLatin}\p{N}\p{P}\p{Zs}\n\r\t]",
    "M": r"\uFFFD",
    "MP": r"(?U)\w[.,;:!?]\w",
}
STEP3_RULES = {
    "Q": r"(?iU)\bqu(?![ei])",
    "WK": r"(?iU)[wk]",
    "DC": r"(?iU)([bdfghjkmpqstvwxyz])\1",
    "E": r"(?iU)\b\w+[cfkmp]\b",
    "T": r"(?iU)([a-z])\1\1",
}
#: Words left out of word confusions.
STOPWORDS = ("a", "al", "con", "como", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "mas", "más", "pero", "por", "que", "se", "sin", "su", "sus", "un", "una", "uno", "unos", "unas", "y")
#: Weights of the wide and of the final risk index.
WIDE_RISK_WEIGHTS = {
    "basic_anomaly_density": 0.5,
    "orthographic_violation_density": 1.0,
    "cer_norm": 2.0,
    "wer_norm": 1.0,
    "structural_drift_ratio": 1.5,
    "indel_disruption_rate": 2.0,
    "coverage_risk": 2.5,
    "continuity_risk": 2.5,
    "lasr_risk": 2.0,
    "fragmentation": 1.5,
    "window_max_cer": 1.5,
    "window_sd_cer": 1.0,
    "window_max_sdr": 1.5,
    "boundary_burden_proportion": 1.0,
    "adjusted_line_delta": 0.75,
    "unmatched_htr_blank_density": 0.75,
}
RISK_WEIGHTS = {"cer_norm": 0.35, "indel_disruption_rate": 0.30, "continuity_risk": 0.25, "adjusted_line_delta_abs": 0.10}
VERY_LOW_CONTINUITY = 0.15
HIGH_INDEL_RATE = 0.15
STATUS_OF_BAND = {"Low": "Stable", "Medium": "Review", "High": "Exclude"}
TEST_RATIO = 0.2


def tags(spark: SparkSession) -> DataFrame:
    """The tag dictionary: step, code, tag, description."""
    rows = [(step, code, step + code, text) for step, codes in TAGS.items() for code, text in codes.items()]
    return spark.createDataFrame(rows, "step string, code string, tag string, description string")


def check_rules() -> None:
    """The rules' codes must be the dictionary's."""
    for step, rules in (("S1", STEP1_RULES), ("S3", STEP3_RULES)):
        if set(rules) != set(TAGS[step]):
            raise ValueError(f"{step}: rules and tags differ: {sorted(set(rules) ^ set(TAGS[step]))}")
