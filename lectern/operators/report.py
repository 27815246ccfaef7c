"""All report tables of a corpus as DataFrames, and their export.

Facts that several tables need (step 2 issues, document metrics with risk and status) are settled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import display_count, display_number, display_percent
from ..functions.storage import settled
from . import corpus, issues, risk, rules, sampling, stats
from .align import alignment_issues, boundary_examples, document_metrics, orthographic_overlaps
from .lines import line_structure

#: Columns of the document tables.
METRIC_COLUMNS = ["pair_id", "style", "ref_chars_norm", "ref_tokens_norm", "line_count", "basic_anomaly_density", "orthographic_violation_density", "cer_norm", "wer_norm", "indel_disruption_rate", "continuity", "adjusted_line_delta_abs", "line_structure_band", "line_structure_flag", "risk_score", "risk_rank_within_style", "risk_band", "escalation_flags", "governance_status"]
DISPLAY_NUMBERS = {"basic_anomaly_density": ("Basic anomaly density", 2), "orthographic_violation_density": ("Orthographic violation density", 2), "indel_disruption_rate": ("IDR", 4), "continuity": ("Continuity", 4), "risk_score": ("Risk score", 4)}
DISPLAY_RATES = {"cer_norm": "CER (%)", "wer_norm": "WER (%)"}
DISPLAY_COUNTS = {"ref_chars_norm": "ref_chars_norm", "ref_tokens_norm": "token_count", "line_count": "line_count", "adjusted_line_delta_abs": "Adjusted line delta", "risk_rank_within_style": "Risk rank within style"}
DISPLAY_NAMES = {"line_structure_band": "Line-structure band", "line_structure_flag": "Line-structure flag", "risk_band": "Risk band", "escalation_flags": "Escalation flags", "governance_status": "Document status"}
TOP_COLUMNS = ["style", "risk_rank_within_style", "pair_id", "risk_band", "risk_score", "cer_norm", "indel_disruption_rate", "continuity", "basic_anomaly_density", "orthographic_violation_density", "adjusted_line_delta_abs", "line_structure_band", "governance_status"]
QUALITY_COLUMNS = ["pair_id", "style", "risk_band", "risk_score", "risk_rank_within_style", "escalation_flags", "governance_status", "cer_norm", "wer_norm", "indel_disruption_rate", "continuity", "adjusted_line_delta_abs", "line_structure_band", "line_structure_flag", "basic_anomaly_density", "orthographic_violation_density"]


def displayed(rows: DataFrame) -> DataFrame:
    """Columns with the names and in the forms that readers see: grouped counts, rounded numbers, rates in percent."""
    out = []
    for c in rows.columns:
        if c in DISPLAY_NUMBERS:
            name, digits = DISPLAY_NUMBERS[c]
            out.append(display_number(F.col(c), digits).alias(name))
        elif c in DISPLAY_RATES:
            out.append(display_percent(F.col(c)).alias(DISPLAY_RATES[c]))
        elif c in DISPLAY_COUNTS:
            out.append(display_count(F.col(c)).alias(DISPLAY_COUNTS[c]))
        else:
            out.append(F.col(c).alias(DISPLAY_NAMES.get(c, c)))
    return rows.select(*out)


def metadata(docs: DataFrame, facts: DataFrame, assigned: DataFrame, generated: str, corpus_name: str, version: str) -> DataFrame:
    """place, key, value: what was assessed, as text. One row of sums is turned into thirteen."""
    n = lambda df, test, name: df.agg(F.sum(F.when(test, 1).otherwise(0)).alias(name)).select(F.coalesce(name, F.lit(0)).alias(name))
    one = risk.corpus_summary(docs)
    for part in (n(assigned, F.col("split") == "train", "_train"), n(assigned, F.col("split") == "test", "_test"), n(facts, F.col("tag").startswith("S1"), "_s1"), n(facts, F.col("tag").startswith("S3"), "_s3")):
        one = one.crossJoin(F.broadcast(part))
    count = lambda c: display_count(F.coalesce(F.col(c), F.lit(0)))
    values = {
        "Generated": F.lit(generated),
        "Corpus": F.lit(corpus_name),
        "Pipeline version": F.lit(version),
        "Training documents": count("_train"),
        "Test documents": count("_test"),
        "Reference characters, normalised": count("ref_chars_norm"),
        "Reference tokens, normalised": count("tokens"),
        "Reference lines": count("lines"),
        "Mean CER (%)": display_percent(F.coalesce("mean_cer", F.lit(0.0))),
        "Median CER (%)": display_percent(F.coalesce("median_cer", F.lit(0.0))),
        "Mean WER (%)": display_percent(F.coalesce("mean_wer", F.lit(0.0))),
        "Logged S1 basic transcription anomalies": count("_s1"),
        "Logged S3 orthographic violations": count("_s3"),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), v.cast("string").alias("value")) for i, (k, v) in enumerate(values.items())])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def report_tables(pairs: DataFrame, top: int = 50, generated: str = "", corpus_name: str = "", version: str = "") -> dict[str, DataFrame]:
    """Table name to rows, each in the order it is to be read in."""
    two = settled(alignment_issues(pairs).drop("review"))
    wide = settled(risk.wide_risk(document_metrics(pairs)))
    docs = settled(risk.governance(risk.risk_index(wide)))
    overlaps = settled(orthographic_overlaps(pairs))
    shape = settled(line_structure(pairs))
    keep = ["pair_id", "style", "tag"]
    facts = settled(rules.rule_issues(pairs, "S1").select(keep).unionByName(two.select(keep)).unionByName(overlaps.select(keep)))
    drift, drifting = issues.drift_report(settled(issues.alignment_diagnostics(two)))
    events = two.withColumn("op", issues.operation())
    lines = settled(issues.topology(events, pairs, "line_bin"))
    places = settled(issues.topology(events, pairs, "document_bin"))
    peaks = issues.topology_peaks(lines).withColumn("position", F.lit("line")).unionByName(issues.topology_peaks(places).withColumn("position", F.lit("document")))
    by = lambda df, *c: df.orderBy(*c)
    return {
        "metadata": by(metadata(docs, facts, corpus.split(pairs), generated, corpus_name, version), "place"),
        "training_corpus_by_style": by(corpus.distribution(pairs), "style"),
        "training_geometry_by_style": by(corpus.geometry(pairs), "style"),
        "logged_issue_stage_overview": by(issues.stage_overview(facts), "stage"),
        "logged_issues_by_style": by(issues.issue_distribution(facts, pairs), "style"),
        "issue_index": by(issues.issue_index(facts), F.desc("total_issues"), "pair_id"),
        "alignment_diagnostics": by(issues.alignment_diagnostics(two), "style", "pair_id"),
        "posthoc_summary": by(issues.posthoc(two, overlaps), "style"),
        "operational_document_metrics": by(docs.select(METRIC_COLUMNS), "style", "risk_rank_within_style"),
        "operational_document_metrics_display": displayed(by(docs.select(METRIC_COLUMNS), "style", "risk_rank_within_style")),
        "style_intelligence_overview": by(risk.style_rows(docs), F.desc("median_cer")),
        "style_metrics": by(risk.style_metrics(wide), "style"),
        "style_document_rankings": by(risk.per_group_top(wide, "style", risk.STYLE_RANKINGS, "pair_id"), "style", "metric", "rank"),
        "alignment_drift": drift,
        "alignment_drift_documents": drifting,
        "error_concentration_by_style": by(stats.concentration(docs, "style", "edits"), "style"),
        "risk_band_summary_by_style": by(risk.band_summary(docs, "risk_band", ["High", "Medium", "Low"]), "style"),
        "document_status_summary_by_style": by(risk.band_summary(docs, "governance_status", ["Stable", "Review", "Exclude"]), "style"),
        "document_status_escalation_flags": by(risk.escalation_summary(docs), "style", "flag"),
        "document_status_index": by(docs.select(*QUALITY_COLUMNS, "risk_score", "risk_rank_within_style"), "style", "governance_status", "risk_rank_within_style"),
        f"top_{top}_documents_by_simplified_risk": displayed(risk.top_by(docs.select(TOP_COLUMNS), [F.desc("risk_score"), F.col("style"), F.col("pair_id")], top)),
        "line_structure_by_style": by(risk.line_structure_summary(shape), "style"),
        "line_structure_document_flags": by(risk.line_structure_flags(shape).join(docs.select("pair_id", "risk_band", "risk_score", "risk_rank").dropDuplicates(["pair_id"]), "pair_id"), "style", F.desc("adjusted_line_delta_abs"), "risk_rank", "pair_id"),
        "rag_document_quality": docs.select(QUALITY_COLUMNS),
        "char_confusions": by(issues.char_confusions(two), "style", "rank"),
        "bigram_confusions": by(issues.bigram_confusions(two), "style", "rank"),
        "word_confusions": by(issues.word_confusions(two), "style", "rank"),
        "recurrent_confusion_contexts": by(issues.confusion_contexts(two), "style", "kind", "gt", "htr", "rank"),
        "rag_confusion_contexts": issues.confusion_contexts(two).groupBy("style", "kind", "gt", "htr").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token", "n"))), lambda x: F.struct(x["token"].alias("context"), x["n"].alias("count"))).alias("contexts")),
        "rag_style_line_structure_profiles": risk.line_structure_summary(shape),
        "rag_topology_profiles": issues.topology_profiles(lines, places),
        "confusion_matrix": by(issues.confusion_matrix(two), "style", "gt_char", "htr_char"),
        "topology_line_position_by_style": by(lines, "style", "op", "bin"),
        "topology_document_position_by_style": by(places, "style", "op", "bin"),
        "topology_summary_by_style": by(peaks, "style", "op", "position"),
        "boundary_examples": by(boundary_examples(pairs), "style", "kind", "rank"),
        "document_subsets_summary": by(sampling.subsets_summary(docs), "category", "value"),
        **{f"{s.lower()}_documents": rows.select(QUALITY_COLUMNS) for s, rows in sampling.subsets(docs).items()},
        **sampling.review_tables(sampling.layers(docs)),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table below the path: those for machines as JSON, the others as CSV."""
    from ..sources.text_corpus import write_csv, write_json

    for name, rows in tables.items():
        (write_json if name.startswith("rag_") and name != "rag_document_quality" else write_csv)(rows, f"{path}/{name}")
