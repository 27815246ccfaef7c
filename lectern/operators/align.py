"""Per-pair alignment: Arrow-batched kernels, everything after them native."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.flat import flat
from ..functions.scalar import ratio
from ..functions.spans import Lines, Touching, compiled
from ..functions.storage import spread
from ..functions.types import row, rows
from .lines import line_structure
from .rules import RULES, finish, rule_densities

ISSUE = row("ordinal int, tag string, start int, end int, gt_text string, htr_text string, word_op string, word_gt string, word_htr string, gt_start int, gt_end int, htr_start int, htr_end int, line int, char_start int, char_end int, line_length int")
COUNTS = "matches int, substitutions int, deletions int, insertions int, ref_chars_norm int, long_spans int, longest_span int, error_runs int, window_size int, window_count int, window_max_cer double, window_sd_cer double, window_max_sdr double, wer_edits int, ref_tokens_norm int, splits int, merges int, complex_boundary int, boundary_events int, gt_tokens int, htr_tokens int"


def _tags(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.StringType()))


def _issues():
    """Kernel: the issues of a pair, with lines and the step 1 tags they touch."""
    rules = compiled(RULES["S1"], "S1")

    def found(gt: str, htr: str):
        lines, ones = Lines(htr), Touching()
        ones.add_matches(htr, rules)
        for ordinal, x in enumerate(kernels.word_issues(gt, htr)):
            code, start, end, *rest = x.values()
            yield ordinal, "S2" + code, start, end, *rest, *lines.place(start, end, wide_end=True), sorted(set(ones.tags(start, max(end, start + 1))))

    return found


def _overlaps():
    """Kernel: the step 3 spans of a pair with the tags of the step 1 and step 2 spans they touch."""
    first, third = compiled(RULES["S1"], "S1"), compiled(RULES["S3"], "S3")

    def found(gt: str, htr: str):
        ones, twos = Touching(), Touching()
        ones.add_matches(htr, first)
        twos.add([("S2" + x["code"], x["start"], x["end"]) for x in kernels.word_issues(gt, htr)])
        for tag, start, end in Touching().add_matches(htr, third):
            yield tag, start, end, ones.tags(start, end), twos.tags(start, max(end, start + 1))

    return found


def _operations():
    """Kernel: the word operations of a pair: op, both texts, words in the run."""

    def found(gt: str, htr: str):
        a, b = kernels.tokens(gt), kernels.tokens(htr)
        for op, i, j, k in kernels.align_words(a, b):
            yield op, a[i][0] if i >= 0 else None, " ".join(w for w, _, _ in b[j : j + k]) if j >= 0 else None, k

    return found


def word_operations(pairs: DataFrame) -> DataFrame:
    """pair_id, style, op, gt, htr, run: the operations of the word alignment."""
    return flat(spread(pairs, "pair_id"), ["pair_id", "style"], ["gt", "htr"], _operations, row("op string, gt string, htr string, run int"))


@F.pandas_udf(row(COUNTS))
def quality(gt: pd.Series, htr: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return pd.DataFrame([kernels.quality_counts(g or "", h or "") for g, h in zip(gt, htr, strict=True)], columns=names)


@F.pandas_udf(rows("kind string, gt string, htr string"))
def boundary_spans(gt: pd.Series, htr: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "gt", "htr"), x, strict=True)) for x in kernels.boundary_spans(g or "", h or "")] for g, h in zip(gt, htr, strict=True)])


def boundary_examples(pairs: DataFrame, n: int = 20) -> DataFrame:
    """Per style and kind of boundary event the n most frequent texts, the first in order on ties."""
    found = spread(pairs, "pair_id").select("style", F.explode(boundary_spans("gt", "htr")).alias("x")).groupBy("style", "x.kind", "x.gt", "x.htr").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("style", "kind").orderBy(F.desc("n"), "gt", "htr"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n)


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([kernels.distance(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def alignment_issues(pairs: DataFrame) -> DataFrame:
    """Step 2: fact rows of substitutions, insertions and deletions, with the step 1 tags they touch."""
    rows = spread(pairs, "pair_id").select("pair_id", "style", F.length("htr").alias("document_length"), "gt", "htr")
    rows = flat(rows, ["pair_id", "style", "document_length"], ["gt", "htr"], _issues, T.StructType([*ISSUE, _tags("overlaps_step1")]))
    basis = F.when(F.col("tag") == "S2X", "htr_substitution_span").when(F.col("tag") == "S2I", "htr_insertion_span").otherwise("htr_deletion_anchor")
    return finish(rows, basis)


def orthographic_overlaps(pairs: DataFrame) -> DataFrame:
    """Step 3 spans with the tags of the step 1 and step 2 issues they touch, one entry per touching span."""
    found = T.StructType([*row("tag string, start int, end int"), _tags("touch_s1"), _tags("touch_s2")])
    return flat(spread(pairs, "pair_id"), ["pair_id", "style"], ["gt", "htr"], _overlaps, found)


def document_metrics(pairs: DataFrame) -> DataFrame:
    """One row per row: edit counts, rates, continuity, windows, words, boundaries, anomalies and lines. Null texts count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = spread(pairs, "pair_id").withColumn("gt", text("gt")).withColumn("htr", text("htr"))
    shape = ["gt_adjusted_line_count", "htr_adjusted_line_count", "adjusted_line_delta_abs", "htr_blank_preserved_unmatched_count", "line_structure_band", "line_structure_flag"]
    rows = line_structure(rows, ("gt", "htr")).select("pair_id", "style", F.length("gt").alias("gt_chars"), rule_densities("S1").alias("s1_issues"), rule_densities("S3").alias("s3_issues"), quality("gt", "htr").alias("q"), *shape)
    rows = rows.withColumnsRenamed({"gt_adjusted_line_count": "line_count", "htr_blank_preserved_unmatched_count": "unmatched_htr_blanks"})
    lined = ["line_count", "htr_adjusted_line_count", F.col("adjusted_line_delta_abs").cast("double").alias("adjusted_line_delta"), "adjusted_line_delta_abs", "unmatched_htr_blanks", "line_structure_band", "line_structure_flag"]
    rows = rows.select("pair_id", "style", "gt_chars", "s1_issues", "s3_issues", "q.*", *lined)
    c = F.col
    edits = c("substitutions") + c("deletions") + c("insertions")
    rows = rows.withColumn("edits", edits).withColumn("aligned_total", c("matches") + c("edits"))
    n = c("ref_chars_norm")
    shifts = c("insertions") + c("deletions")
    low, high = F.least("line_count", "htr_adjusted_line_count"), F.greatest("line_count", "htr_adjusted_line_count")
    rows = rows.select(
        "*",
        ratio(c("edits"), n).alias("cer_norm"),
        ratio(shifts, c("edits")).alias("structural_drift_ratio"),
        ratio(shifts, c("aligned_total")).alias("indel_disruption_rate"),
        ratio(c("matches") + c("substitutions"), c("matches") + c("substitutions") + c("deletions")).alias("coverage"),
        ratio(c("long_spans"), n).alias("continuity"),
        ratio(c("longest_span"), n).alias("lasr"),
        (ratio(c("error_runs"), n) * 1000).alias("fragmentation"),
        ratio(c("wer_edits"), c("ref_tokens_norm")).alias("wer_norm"),
        ratio(c("boundary_events"), c("edits")).alias("boundary_burden_proportion"),
        (ratio(c("s1_issues"), n) * 1000).alias("basic_anomaly_density"),
        (ratio(c("s3_issues"), n) * 1000).alias("orthographic_violation_density"),
        ratio(low, high).alias("line_count_ratio"),
        ratio(c("unmatched_htr_blanks"), c("line_count")).alias("unmatched_htr_blank_density"),
    )
    return rows.select("*", *[(1 - c(m)).alias(f"{m}_risk") for m in ("coverage", "continuity", "lasr")])
