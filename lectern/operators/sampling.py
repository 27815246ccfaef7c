"""Review samples in three layers, reviewers, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import compound_id, folder_name, reference_file
from ..functions.storage import settled
from .risk import normal_status
from .stats import ranked


def governance_sample(df: DataFrame, target: int = 75, id_: str = "pair_id", method: str = "extreme", seed: str = "20260101") -> DataFrame:
    """Round robin over cells of style, status and band: each pass takes the next document of every cell.

    method: the order within a cell: ``extreme`` and ``even`` by falling risk (an even sample of a whole cell is all of it), ``random`` by a
    hash of seed and id.
    """
    falling = [F.desc("risk_score"), F.col(id_)]
    order = {"extreme": falling, "even": falling, "random": [F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string"))), F.col(id_)]}[method]
    rows = df.filter((F.col("governance_status") != "Unassigned") & (F.col("risk_band") != "Unassigned"))
    cell = ["style", "governance_status", "risk_band"]
    turn = F.row_number().over(W.partitionBy(*cell).orderBy(*order))
    # no cell gives more than the target, so each task hands on at most that many rows of a cell
    rows = rows.withColumn("turn", turn).filter(F.col("turn") <= target)
    return rows.orderBy("turn", *cell).limit(target).withColumn("selection_layer", F.lit("governance_validation")).withColumn("selection_reason", F.concat(F.lit("style="), "style", F.lit("; governance_status="), "governance_status", F.lit("; risk_band="), "risk_band", F.lit(f"; method={method}; target_total={target}")))


def random_control(df: DataFrame, taken: DataFrame, per_style: int = 5, seed: str = "20260101", id_: str = "pair_id") -> DataFrame:
    """Per style documents in the order of a hash of seed and id, without those already taken."""
    rest = df.join(taken.select(id_), id_, "left_anti")
    place = F.row_number().over(W.partitionBy("style").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string"))), id_))
    return rest.withColumn("turn", place).filter(F.col("turn") <= per_style).withColumn("selection_layer", F.lit("random_control")).withColumn("selection_reason", F.lit(f"style_stratified_random_control; controls_per_style={per_style}"))


def case_score() -> tuple[Column, Column]:
    """Score and reasons of a document as a diagnostic case."""
    c, low = F.col, F.least
    # Tests, points and names
    parts = [
        (c("line_structure_flag") == "review_line_structure", F.lit(5.0), "review_line_structure"),
        (c("line_structure_band") == "Severe instability", F.lit(5.0), "severe_line_instability"),
        (c("adjusted_line_delta_abs") >= 4, low(c("adjusted_line_delta_abs").cast("double"), F.lit(10.0)), "high_adjusted_line_delta"),
        (c("continuity") <= 0.15, F.lit(4.0), "very_low_continuity"),
        ((c("continuity") > 0.15) & (c("continuity") <= 0.35), F.lit(2.0), "low_continuity"),
        (c("indel_disruption_rate") >= 0.15, F.lit(3.0), "high_idr"),
        ((c("indel_disruption_rate") < 0.15) & (c("indel_disruption_rate") >= 0.08), F.lit(1.5), "elevated_idr"),
        (c("cer_norm") >= 0.35, F.lit(3.0), "high_cer"),
        (c("basic_anomaly_density") > 0, low(c("basic_anomaly_density") / 5.0, F.lit(2.0)), "surface_anomaly_density"),
        (c("orthographic_violation_density") >= 10, low(c("orthographic_violation_density") / 10.0, F.lit(2.0)), "orthographic_violation_density"),
    ]
    total = F.lit(0.0)
    for test, points, _ in parts:
        total = total + F.when(test, points).otherwise(0.0)
    return total, F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in parts])), ";")


def diagnostic_cases(df: DataFrame, taken: DataFrame, total: int = 10, id_: str = "pair_id") -> DataFrame:
    """The best case of each style first, then the best of all the rest."""
    score, reasons = case_score()
    rows = df.join(taken.select(id_), id_, "left_anti").withColumn("diagnostic_case_score", F.round(score, 4)).withColumn("selection_reason", reasons).filter("diagnostic_case_score > 0")
    place = F.row_number().over(W.partitionBy("style").orderBy(F.desc("diagnostic_case_score"), id_))
    rows = rows.withColumn("turn", place).filter(F.col("turn") <= total)
    return rows.orderBy((F.col("turn") == 1).desc(), F.desc("diagnostic_case_score"), id_).limit(total).withColumn("selection_layer", F.lit("diagnostic_case_study"))


def assign_reviewers(sample: DataFrame, reviewers: int = 3, id_: str = "pair_id") -> DataFrame:
    """Reviewers by turns, each the one with fewest rows, then fewest of the style, then the first.

    With equal loads at the start of each round every reviewer gets one row per round, so only the order within a round of
    ``reviewers`` rows depends on the past: a sample of a hundred rows or so, folded in one group.
    """
    schema = f"{id_} {sample.schema[id_].dataType.simpleString()}, style string, selection_layer string, reviewer_id string, review_order long, review_id string"

    def fold(pdf):
        import pandas as pd

        load, styles, out = [0] * reviewers, {}, []
        for r in pdf.sort_values(["selection_layer", "style", "risk_band", id_]).itertuples(index=False):
            k = min(range(reviewers), key=lambda i: (load[i], styles.get((i, r.style), 0), i))
            load[k] += 1
            styles[k, r.style] = styles.get((k, r.style), 0) + 1
            out.append((getattr(r, id_), r.style, r.selection_layer, f"reviewer_{k + 1}", load[k], f"R{k + 1:02d}-{load[k]:03d}"))
        return pd.DataFrame(out, columns=[id_, "style", "selection_layer", "reviewer_id", "review_order", "review_id"])

    return sample.select(id_, "style", "selection_layer", "risk_band").withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fold, schema)


def evenly_spaced(df: DataFrame, n: int, by: str = "style", score: str = "risk_score", id_: str = "pair_id") -> DataFrame:
    """n rows of each group at even distances in the order of their score (halves round to even)."""
    rows = ranked(df, [by], [F.desc(score), F.col(id_)], "_rank", "_size")
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_size") - 1) / F.lit(max(n - 1, 1))).cast("long"))
    wanted = F.when(F.col("_size") <= n, True).when(F.lit(n) == 1, F.col("_rank") - 1 == F.floor(F.col("_size") / 2)).otherwise(F.array_contains(steps, F.col("_rank") - 1))
    return rows.filter(wanted).drop("_rank", "_size")


def subsets(df: DataFrame) -> dict[str, DataFrame]:
    rows = df.withColumn("document_status", normal_status(F.col("governance_status"), F.col("risk_band")))
    return {s: rows.filter(F.col("document_status") == s) for s in ("Stable", "Review", "Exclude")}


def subsets_summary(df: DataFrame) -> DataFrame:
    """category, value, docs: totals by status, style and both."""
    rows = df.withColumn("status", normal_status(F.col("governance_status"), F.col("risk_band")))
    sets = rows.groupingSets([[], ["status"], ["style"], ["status", "style"]], "status", "style").agg(F.count(F.lit(1)).alias("docs"), F.grouping_id().alias("g"))
    category = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "status").when(F.col("g") == 2, "style").otherwise("status_style")
    return sets.select(category.alias("category"), F.concat_ws(":", "status", "style").alias("value"), "docs")


LAYERS = ("governance_validation", "random_control", "diagnostic_case_study")


def layers(df: DataFrame, target: int = 75, per_style: int = 5, cases: int = 10, method: str = "extreme", id_: str = "pair_id") -> DataFrame:
    """The three layers one below the other, each without the documents of those before. ``df`` is read several times: it should be settled."""
    extra = {"diagnostic_case_score": F.lit(None).cast("double")}
    one = settled(governance_sample(df, target, id_, method).drop("turn").withColumns(extra))
    two = settled(one.unionByName(random_control(df, one, per_style, id_=id_).drop("turn").withColumns(extra)))
    return settled(two.unionByName(diagnostic_cases(df, two, cases, id_).drop("turn").select(two.columns)))


def summary(sample: DataFrame) -> DataFrame:
    """dimension, value, docs: by layer, style, status, band and reviewer, and the total."""
    dims = {"layer": "selection_layer", "style": "style", "document_status": "governance_status", "risk_band": "risk_band", "reviewer": "reviewer_id"}
    rows = sample.select(F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("documents").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in dims.items()])).alias("x"))
    return rows.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("docs"))


#: Columns of the review tables, and the dimensions that reviewers fill in.
MASTER_COLUMNS = ("review_id", "reviewer_id", "doc_id", "packet_doc_id", "style", "selection_layer", "selection_reason", "review_order", "governance_status", "risk_band", "risk_score", "risk_rank_within_style", "escalation_flags", "cer_norm", "wer_norm", "indel_disruption_rate", "continuity", "adjusted_line_delta_abs", "line_structure_band", "line_structure_flag", "diagnostic_case_score")
REVIEW_DIMENSIONS = ("fiabilidad_general_transcripcion", "correspondencia_con_gt", "severidad_omisiones", "conservacion_disposicion_documento", "utilidad_academica", "confianza_revisor", "estado_revision")
WARNING_COLUMNS = ("reviewer_id", "doc_id", "packet_doc_id", "missing", "expected_htr_filename", "expected_gt_filename")


def review_tables(sample: DataFrame, reviewers: int = 3, id_: str = "pair_id", listing: DataFrame | None = None, design: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """The tables of a review packet: the whole sample, one per layer, one to fill in per reviewer, missing files, the schema of labels, a summary.

    listing: the paths of the files that exist; without one no file counts as missing.
    """
    spark = sample.sparkSession
    assigned = assign_reviewers(sample, reviewers, id_).select(id_, "selection_layer", "reviewer_id", "review_order", "review_id")
    stem, file = compound_id(F.col(id_).cast("string"))
    rows = sample.join(F.broadcast(assigned), [id_, "selection_layer"]).withColumn("doc_id", F.col(id_).cast("string")).withColumn("packet_doc_id", folder_name(F.col("doc_id")))
    every = settled(rows.select(*MASTER_COLUMNS, file.alias("expected_htr_filename"), reference_file(stem).alias("expected_gt_filename")))
    out = {"review_sample_all": every.select(*MASTER_COLUMNS)}
    out |= {f"review_sample_{'diagnostic_case_studies' if x == 'diagnostic_case_study' else x}": every.filter(F.col("selection_layer") == x).select(*MASTER_COLUMNS) for x in LAYERS}
    for k in range(1, reviewers + 1):
        own = every.filter(F.col("reviewer_id") == f"reviewer_{k}").orderBy("review_order")
        out[f"reviewer_{k}_packet"] = own.select("review_id", "doc_id", "style", *[F.lit("").alias(d) for d in REVIEW_DIMENSIONS])
    expected = every.select("reviewer_id", "doc_id", "packet_doc_id", "expected_htr_filename", "expected_gt_filename", F.explode(F.array(F.struct(F.lit("HTR").alias("missing"), F.col("expected_htr_filename").alias("name")), F.struct(F.lit("GT").alias("missing"), F.col("expected_gt_filename").alias("name")))).alias("x")).select("*", "x.*")
    there = listing.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name")).distinct() if listing is not None else None
    out["file_copy_warnings"] = (expected.join(there, "name", "left_anti") if there is not None else expected.filter(F.lit(False))).select(*WARNING_COLUMNS)
    settings = {"seed": "20260101", "reviewers": reviewers, **(design or {})}
    schema = [("review_column", c, "") for c in ("review_id", "doc_id", "style", *REVIEW_DIMENSIONS)] + [("sampling_design", k, str(v)) for k, v in settings.items()]
    out["review_label_schema"] = spark.createDataFrame(schema, "section string, name string, value string")
    warned = out["file_copy_warnings"].agg(F.count(F.lit(1)).alias("docs")).select(F.lit("file_copy_warnings").alias("dimension"), F.lit("files").alias("value"), "docs")
    out["review_sample_summary"] = summary(every).unionByName(warned)
    return out
