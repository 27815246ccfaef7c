"""Robust risk scores, bands, document status and summaries by style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import settled, small
from ..schemas import HIGH_INDEL_RATE, RISK_WEIGHTS, STATUS_OF_BAND, VERY_LOW_CONTINUITY, WIDE_RISK_WEIGHTS
from .stats import median, order_statistics, percentile, percentile_ceil, ranked, robust_center, tercile_band, wide


def z_scores(df: DataFrame, by: str, metrics: list[str], flat: float | None, prefix: str) -> DataFrame:
    """Adds (value - median) / MAD of each metric within the group. flat: the MAD that stands for 0; none: the score is 0 then.

    The rows are settled first: they are read several times, and what makes them may be costly.
    """
    df = settled(df)
    center = robust_center(df, [by], metrics)
    rows = df.join(small(center.groupBy(by).agg(*wide(center, [by], metrics, "med", "_med_"), *wide(center, [by], metrics, "mad", "_mad_"))), by)
    for m in metrics:
        away = F.col(m).cast("double") - F.col(f"_med_{m}")
        mad = F.col(f"_mad_{m}")
        rows = rows.withColumn(f"{prefix}{m}_z", F.when(mad > 0, away / mad).otherwise(F.lit(0.0) if flat is None else away / flat))
    return rows.drop(*[f"{p}{m}" for m in metrics for p in ("_med_", "_mad_")])


def _weighted(weights: dict[str, float], prefix: str) -> Column:
    total = F.lit(0.0)
    for m, w in weights.items():
        total = total + F.col(f"{prefix}{m}_z") * F.lit(w)
    return total


def wide_risk(df: DataFrame, by: str = "style", id_: str = "pair_id", weights: dict[str, float] = WIDE_RISK_WEIGHTS) -> DataFrame:
    """Sixteen metrics; a MAD of 0 gives 0; one ranking and one set of bands over all rows."""
    rows = z_scores(df, by, list(weights), None, "").withColumn("wide_risk_score", F.round(_weighted(weights, ""), 9))
    rows = ranked(rows, [], [F.desc("wide_risk_score"), F.col(by), F.col(id_)], "wide_risk_rank", "_n")
    share = (F.col("wide_risk_rank") - 1) / F.col("_n")
    return rows.withColumn("wide_risk_band", F.when(share < 1 / 3, "High").when(share < 2 / 3, "Medium").otherwise("Low")).drop("_n")


def risk_index(df: DataFrame, by: str = "style", id_: str = "pair_id", weights: dict[str, float] = RISK_WEIGHTS) -> DataFrame:
    """The final index: a MAD of 0 counts as 1; rank and tercile band within the group, rank over all."""
    rows = z_scores(df, by, list(weights), 1.0, "risk_index_").withColumn("risk_score", F.round(_weighted(weights, "risk_index_"), 9))
    rows = ranked(rows, [by], [F.desc("risk_score"), F.col(id_)], "risk_rank_within_style", "_n")
    rows = rows.withColumn("risk_band", tercile_band(F.col("risk_rank_within_style"), F.col("_n"))).drop("_n")
    return ranked(rows, [], [F.desc("risk_score"), F.col(id_)], "risk_rank")


def governance(df: DataFrame) -> DataFrame:
    """Band to status, one level up where a structural danger flag is set."""
    flags = F.array_sort(
        F.array_compact(
            F.array(
                F.when((F.col("line_structure_band") == "Severe instability") | (F.col("line_structure_flag") == "review_line_structure"), "severe_line_instability"),
                F.when(F.col("continuity") <= VERY_LOW_CONTINUITY, "very_low_continuity"),
                F.when(F.col("indel_disruption_rate") >= HIGH_INDEL_RATE, "high_idr"),
            )
        )
    )
    base = F.coalesce(*[F.when(F.col("risk_band") == b, s) for b, s in STATUS_OF_BAND.items()], F.lit("Review"))
    rows = df.withColumn("index_derived_risk_band", F.col("risk_band")).withColumn("base_governance_status", base).withColumn("_flags", flags).withColumn("escalation_flags", F.array_join("_flags", ";"))
    up = F.when(F.col("base_governance_status") == "Stable", "Review").otherwise("Exclude")
    return rows.withColumn("governance_status", F.when(F.size("_flags") > 0, up).otherwise(F.col("base_governance_status"))).drop("_flags")


def normal_status(status: Column, band: Column) -> Column:
    """A status written in any case; without one, from the band."""
    s, b = F.lower(F.trim(status)), F.lower(F.trim(band))
    return F.when(s.isin("stable", "review", "exclude"), F.initcap(s)).when(b == "low", "Stable").when(b == "medium", "Review").when(b == "high", "Exclude").otherwise("Unassigned")


def band_summary(df: DataFrame, column: str, values: list[str], by: str = "style") -> DataFrame:
    """Documents and counts and shares of each value per group."""
    n = lambda v: F.sum(F.when(F.col(column) == v, 1).otherwise(0)).cast("long")
    docs = F.count(F.lit(1))
    return df.groupBy(by).agg(docs.alias("docs"), *[n(v).alias(v.lower()) for v in values], *[(n(v) / docs).alias(f"{v.lower()}_share") for v in values])


def escalation_summary(df: DataFrame, by: str = "style") -> DataFrame:
    """Documents per group and escalation flag; no_escalation where there is none."""
    flag = F.explode(F.split(F.when(F.col("escalation_flags") == "", "no_escalation").otherwise(F.col("escalation_flags")), ";"))
    return df.select(by, flag.alias("flag")).groupBy(by, "flag").agg(F.count(F.lit(1)).alias("docs"))


def style_rows(df: DataFrame) -> DataFrame:
    """Per style: medians, 90th percentiles, clean shares, edit shares, bands."""
    stats = order_statistics(df, ["style"], ["cer_norm", "wer_norm", "indel_disruption_rate", "continuity", "continuity_risk", "adjusted_line_delta", "basic_anomaly_density", "orthographic_violation_density", "risk_score"], med=median(), p90=percentile_ceil(0.9))
    pick = lambda m, s: F.max(F.when(F.col("metric") == m, F.col(s)))
    short = {"cer_norm": "cer", "wer_norm": "wer", "indel_disruption_rate": "idr", "continuity": "continuity", "adjusted_line_delta": "adjusted_line_delta", "basic_anomaly_density": "basic_anomaly_density", "orthographic_violation_density": "orthographic_violation_density", "risk_score": "risk_score"}
    table = stats.groupBy("style").agg(*[pick(m, "med").alias(f"median_{s}") for m, s in short.items()], *[pick(m, "p90").alias(f"p90_{short.get(m, m)}") for m in ("cer_norm", "wer_norm", "indel_disruption_rate", "continuity_risk", "adjusted_line_delta")])
    docs = F.count(F.lit(1))
    share = lambda test: F.sum(F.when(test, 1).otherwise(0)) / docs
    total = F.sum("edits")
    part = lambda c: F.when(total > 0, F.sum(c) / total).otherwise(0.0)
    sums = df.groupBy("style").agg(
        docs.alias("docs"),
        F.sum("ref_chars_norm").alias("ref_chars_norm"),
        F.sum("ref_tokens_norm").alias("tokens"),
        F.sum("line_count").alias("lines"),
        share(F.col("line_structure_band") == "Stable").alias("stable_line_structure_pct"),
        share(F.col("line_structure_band") == "Severe instability").alias("severe_line_structure_pct"),
        *[share(F.col("cer_norm") < p / 100).alias(f"clean_lt_{p}_pct") for p in (1, 2, 5)],
        part("substitutions").alias("sub_pct"),
        part("insertions").alias("ins_pct"),
        part("deletions").alias("del_pct"),
        *[F.sum(F.when(F.col("risk_band") == b, 1).otherwise(0)).alias(f"{b.lower()}_risk_docs") for b in ("High", "Medium", "Low")],
    )
    return sums.join(table, "style")


#: The metrics of the style table, and those that get a 90th percentile.
STYLE_METRICS = {"adjusted_line_delta": "adjusted_line_delta", "unmatched_htr_blank_density": "unmatched_htr_blank_density", "cer_norm": "cer", "wer_norm": "wer", "structural_drift_ratio": "sdr", "indel_disruption_rate": "idr", "coverage": "coverage", "continuity": "continuity", "wide_risk_score": "risk_score"}
STYLE_P90 = ("adjusted_line_delta", "cer_norm", "wer_norm")


def style_metrics(df: DataFrame) -> DataFrame:
    """Per style of a table with the wide risk: sizes, medians, 90th percentiles by the floor rule, documents of each band."""
    stats = order_statistics(df, ["style"], list(STYLE_METRICS), med=median(), p90=percentile(0.9))
    pick = lambda m, s: F.max(F.when(F.col("metric") == m, F.col(s)))
    table = stats.groupBy("style").agg(*[pick(m, "med").alias(f"median_{s}") for m, s in STYLE_METRICS.items()], *[pick(m, "p90").alias(f"p90_{STYLE_METRICS[m]}") for m in STYLE_P90])
    n = lambda b: F.sum(F.when(F.col("wide_risk_band") == b, 1).otherwise(0)).alias(f"{b.lower()}_risk_docs")
    sums = df.groupBy("style").agg(F.count(F.lit(1)).alias("docs"), F.sum("ref_chars_norm").alias("ref_chars_norm"), F.sum("ref_tokens_norm").alias("tokens"), F.sum("line_count").alias("lines"), n("High"), n("Medium"), n("Low"))
    return sums.join(table, "style")


#: What the summary reads; other columns needn't be worked out for it.
SUMMARY_COLUMNS = ("ref_chars_norm", "ref_tokens_norm", "line_count", "edits", "cer_norm", "wer_norm")


def corpus_summary(df: DataFrame) -> DataFrame:
    """One row: sizes, mean and median error."""
    med = order_statistics(df.withColumn("_all", F.lit(1)), ["_all"], ["cer_norm"], med=median()).select(F.col("med").alias("median_cer"))
    sums = df.agg(F.count(F.lit(1)).alias("docs"), F.sum("ref_chars_norm").alias("ref_chars_norm"), F.sum("ref_tokens_norm").alias("tokens"), F.sum("line_count").alias("lines"), F.sum("edits").alias("edits"), F.avg("cer_norm").alias("mean_cer"), F.avg("wer_norm").alias("mean_wer"))
    return sums.crossJoin(F.broadcast(med))


def top_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


#: The rankings of a style's documents, their metric, and whether the smallest come first.
STYLE_RANKINGS = {"top_risk": ("wide_risk_score", False), "top_cer": ("cer_norm", False), "top_structural_drift": ("structural_drift_ratio", False), "lowest_coverage": ("coverage", True), "lowest_continuity": ("continuity", True)}


def per_group_top(df: DataFrame, by: str, rankings: dict[str, tuple[str, bool]] | list[str], id_: str, n: int = 10) -> DataFrame:
    """For each ranking (a metric, and whether the smallest come first) the first n rows of each group: a bounded heap per task and group, then one merge."""
    named = rankings if isinstance(rankings, dict) else {m: (m, False) for m in rankings}
    each = [F.struct(F.lit(name).alias("metric"), F.col(m).cast("double").alias("value"), (F.col(m).cast("double") * (1 if up else -1)).alias("key")) for name, (m, up) in named.items()]
    long = df.select(by, id_, F.explode(F.array(*each)).alias("x")).select(by, id_, "x.metric", "x.value", "x.key")
    # Spark limits each group within every input partition before it shuffles for a filtered row_number
    rank = F.row_number().over(W.partitionBy(by, "metric").orderBy(F.asc_nulls_last("key"), id_))
    return long.withColumn("rank", rank).filter(F.col("rank") <= n).drop("key")


def line_structure_summary(shape: DataFrame) -> DataFrame:
    """Per style: median and 90th percentile of the line difference, shares of bands and of documents with stray blank lines."""
    stats = order_statistics(shape, ["style"], ["adjusted_line_delta_abs"], median_delta=median(), p90_delta=percentile_ceil(0.9)).drop("metric")
    docs = F.count(F.lit(1))
    bands = {"Stable": "stable", "Minor mismatch": "minor", "Moderate instability": "moderate", "Severe instability": "severe"}
    sums = shape.groupBy("style").agg(docs.alias("docs"), *[(F.sum(F.when(F.col("line_structure_band") == b, 1).otherwise(0)) / docs).alias(f"{s}_share") for b, s in bands.items()], (F.sum(F.when(F.col("htr_blank_preserved_unmatched_count") > 0, 1).otherwise(0)) / docs).alias("unmatched_blank_share"))
    return sums.join(stats, "style")


def line_structure_flags(shape: DataFrame) -> DataFrame:
    """Documents that are not stable or have stray blank lines."""
    return shape.filter((F.col("line_structure_band") != "Stable") | (F.col("htr_blank_preserved_unmatched_count") > 0))

