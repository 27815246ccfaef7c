"""Line structure: reference and transcription lines joined by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import blank, line_band, line_flag, lines, newlines


def line_structure(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and line numbers of blank lines, before and after blank-line handling, per pair; a null text has no lines. Columns to ``keep`` are carried on."""
    text = lambda c: lines(newlines(F.coalesce(F.col(c), F.lit(""))))
    both = pairs.withColumn("_g", text("gt")).withColumn("_h", text("htr"))
    zipped = F.transform(F.arrays_zip(F.col("_g").alias("g"), F.col("_h").alias("h")), lambda x, i: F.struct((i + 1).alias("at"), F.coalesce(blank(x["g"]), F.lit(False)).alias("g"), F.coalesce(blank(x["h"]), F.lit(False)).alias("h")))
    numbers = lambda test: F.transform(F.filter("_z", test), lambda x: x["at"])
    rows = both.withColumn("_z", zipped).select(
        "pair_id",
        "style",
        *keep,
        F.size("_g").alias("gt_original_line_count"),
        F.size("_h").alias("htr_original_line_count"),
        numbers(lambda x: x["g"]).alias("gt_blank_lines_removed"),
        numbers(lambda x: x["g"] & x["h"]).alias("htr_blank_lines_removed_because_gt_blank"),
        numbers(lambda x: ~x["g"] & x["h"]).alias("htr_blank_lines_preserved_no_matching_gt_blank"),
    )
    rows = (
        rows.withColumn("original_delta_gt_minus_htr", F.col("gt_original_line_count") - F.col("htr_original_line_count"))
        .withColumn("gt_blank_removed_count", F.size("gt_blank_lines_removed"))
        .withColumn("htr_blank_removed_matching_gt_count", F.size("htr_blank_lines_removed_because_gt_blank"))
        .withColumn("htr_blank_preserved_unmatched_count", F.size("htr_blank_lines_preserved_no_matching_gt_blank"))
        .withColumn("gt_adjusted_line_count", F.col("gt_original_line_count") - F.col("gt_blank_removed_count"))
        .withColumn("htr_adjusted_line_count", F.col("htr_original_line_count") - F.col("htr_blank_removed_matching_gt_count"))
        .withColumn("adjusted_delta_gt_minus_htr", F.col("gt_adjusted_line_count") - F.col("htr_adjusted_line_count"))
    )
    delta, unmatched = F.col("adjusted_delta_gt_minus_htr"), F.col("htr_blank_preserved_unmatched_count")
    return rows.withColumn("adjusted_line_delta_abs", F.abs(delta)).withColumn("line_structure_band", line_band(delta)).withColumn("line_structure_flag", line_flag(delta, unmatched))
