import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar
from lectern.operators import align, corpus, issues, risk, rules, sampling, stats
from lectern.operators.lines import line_structure
from lectern.plans.queries import ORACLES, QUERIES
from lectern.schemas import check_rules, tags

PAIR = "pair_id string, style string, gt string, htr string"


def test_dictionary(spark):
    check_rules()
    assert tags(spark).count() == 17


def test_positions_golden(spark):
    df = spark.createDataFrame([("d", "s", "", "  hola ,, rey \nfin"), ("e", "s", "", ""), ("f", "s", "", None)], PAIR)
    row = rules.rule_issues(df, "S1").filter("tag = 'S1T'").first()
    assert (row.line_position_bin, row.document_position_bin, row.relative_document_position) == ("90-100%", "70-80%", 0.75)
    row = rules.rule_issues(df, "S1").filter("tag = 'S1L'").first()
    assert row.issue_id == "36202e401a6a"


def test_hash_split_golden(spark):
    assert round(spark.range(1).select(scalar.hash_share(F.lit("redonda"), F.lit("x"))).first()[0], 5) == 0.26112


def test_line_golden(spark):
    df = spark.createDataFrame([("p", "s", "a\n\nb", "a\n\n\nb"), ("q", "s", "", ""), ("r", "s", "a\r\nb\n", "a\nb")], PAIR)
    rows = {r.pair_id: r for r in line_structure(df).collect()}
    p = rows["p"]
    assert (p.gt_adjusted_line_count, p.htr_adjusted_line_count, p.adjusted_delta_gt_minus_htr, p.original_delta_gt_minus_htr) == (2, 3, -1, -1)
    assert (p.gt_blank_lines_removed, p.htr_blank_lines_removed_because_gt_blank, p.htr_blank_lines_preserved_no_matching_gt_blank) == ([2], [2], [3])
    assert (p.line_structure_band, p.line_structure_flag) == ("Minor mismatch", "monitor_line_structure")
    assert rows["q"].gt_original_line_count == 0 and rows["r"].adjusted_delta_gt_minus_htr == 0


def test_overlaps(spark):
    df = spark.createDataFrame([("p", "s", "rey grande de", "rey  de")], PAIR)
    got = align.alignment_issues(df).first()
    assert (got.tag, got.start, got.end, got.position_basis) == ("S2D", 5, 5, "htr_deletion_anchor")
    df = spark.createDataFrame([("p", "s", "a grande b", "a   b")], PAIR)
    assert {tuple(r.overlaps_step1) for r in align.alignment_issues(df).collect()} <= {(), ("S1W",)}


def test_risk_golden(spark):
    rows = [(f"d{i}", "s", c, 0.0, 1.0, 0, "Stable", "line_structure_ok") for i, c in enumerate((0.1, 0.2, 0.4))]
    df = spark.createDataFrame(rows, "pair_id string, style string, cer_norm double, indel_disruption_rate double, continuity double, adjusted_line_delta_abs int, line_structure_band string, line_structure_flag string").withColumn("continuity_risk", 1 - F.col("continuity"))
    got = {r.pair_id: r for r in risk.governance(risk.risk_index(df)).collect()}
    assert [round(got[f"d{i}"].risk_index_cer_norm_z, 6) for i in range(3)] == [-1, 0, 2]
    assert [round(got[f"d{i}"].risk_score, 6) for i in range(3)] == [-0.35, 0, 0.7]
    assert [got[f"d{i}"].risk_band for i in range(3)] == ["Low", "Medium", "High"]
    assert [got[f"d{i}"].risk_rank for i in range(3)] == [3, 2, 1]
    flagged = risk.governance(df.withColumn("risk_band", F.lit("Low")).withColumn("indel_disruption_rate", F.lit(0.15))).first()
    assert (flagged.escalation_flags, flagged.base_governance_status, flagged.governance_status) == ("high_idr", "Stable", "Review")


def test_statistics_goldens(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40)], "k string, v double")
    r = stats.order_statistics(df, ["k"], ["v"], p=stats.percentile(0.5), q=stats.percentile_ceil(0.9), m=stats.median()).first()
    assert (r.p, r.q, r.m) == (30, 40, 25)
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, v int")
    assert round(stats.concentration(df, "k", "v").first().gini, 5) == 0.16667


def test_prefix_golden(spark):
    gt = spark.createDataFrame([("A_B",), ("A_B_C",)], "stem string")
    htr = spark.createDataFrame([("A_B_C_m1",), ("A_BX",)], "stem string")
    pairs, no_htr, no_gt = corpus.prefix_pairs(gt, htr)
    assert sorted(map(tuple, pairs.collect())) == [("A_B", "A_B_C_m1"), ("A_B_C", "A_B_C_m1")]
    assert no_htr.count() == 0 and [r[0] for r in no_gt.collect()] == ["A_BX"]


def test_reviewers(spark):
    rows = [(f"d{i}", "s" if i % 2 else "t", "layer", "High") for i in range(7)]
    got = sampling.assign_reviewers(spark.createDataFrame(rows, "pair_id string, style string, selection_layer string, risk_band string")).collect()
    assert sorted(r.review_id for r in got) == ["R01-001", "R01-002", "R01-003", "R02-001", "R02-002", "R03-001", "R03-002"]


def test_confusions(spark):
    df = spark.createDataFrame([("p", "s", "çena çasa", "cena casa")], PAIR)
    two = align.alignment_issues(df)
    assert [(r.gt_char, r.htr_char, r.n) for r in issues.char_confusions(two).collect()] == [("ç", "c", 2)]
    assert issues.confusion_matrix(two).collect()[0].n == 2


def test_text_sources(spark, tmp_path):
    from lectern.sources import text_corpus as S

    for where, name, text in (("gt", "A_B_GT.txt", "uno\r\ndos"), ("htr", "A_B_m1_HTR.txt", "uno dos"), ("htr", "X_HTR.txt", "z")):
        (tmp_path / where / "redonda").mkdir(parents=True, exist_ok=True)
        (tmp_path / where / "redonda" / name).write_bytes(text.encode())
    pairs, no_htr, no_gt = S.read_pairs(spark, str(tmp_path / "gt"), str(tmp_path / "htr"))
    assert [tuple(r) for r in pairs.collect()] == [("A_B:A_B_m1_HTR.txt", "redonda", "uno\ndos", "uno dos")]
    assert no_htr.count() == 0 and no_gt.count() == 1
    S.write_csv(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), str(tmp_path / "csv"))
    assert S.read_csv(spark, str(tmp_path / "csv")).first().b == "1;2"


def test_stream(spark, tmp_path):
    from lectern.streaming.rule_stream import running_counts

    spark.createDataFrame([("p", "s", "a  b"), ("q", "s", "c  d  e")], "pair_id string, style string, htr string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pair_id string, style string, htr string").parquet(str(tmp_path / "in"))
    q = running_counts(stream, "S1").writeStream.outputMode("complete").format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.tag, r.n) for r in spark.table("hits").collect()] == [("S1W", 3)]


FAST = ["step1_issue_counts", "step3_issue_counts", "hash_split", "split_with_previous", "prefix_pairing", "line_structure_by_style", "corpus_geometry", "native_risk_index", "quantity_concentration", "subsets_summary", "step1_whitespace_spans"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "orders", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    assert names == sorted(want.columns)

    def plain(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    assert plain(got.select(names).collect()) == plain(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_report(spark, tmp_path):
    from lectern.operators.report import report_tables, write_report
    from lectern.sources.text_corpus import read_csv

    df = spark.createDataFrame([("p", "s", "uno españa tres\nqu", "uno  espana tres\nkk"), ("q", "s", "a", ""), ("r", "t", "", "")], PAIR)
    tables = report_tables(df)
    some = ["document_status_index", "char_confusions", "operational_document_metrics_display", "stable_documents"]
    write_report({k: tables[k] for k in some}, str(tmp_path))
    assert read_csv(spark, f"{tmp_path}/document_status_index").count() == 3
    assert read_csv(spark, f"{tmp_path}/char_confusions").first().htr_char == "n"
    assert all(t.columns for t in tables.values())


def test_names(spark):
    one = spark.createDataFrame([("A_B:x:y.txt",)], "d string")
    a, b = scalar.compound_id(F.col("d"))
    assert tuple(one.select(a, b, scalar.folder_name(F.lit("a b/c")), scalar.excel_safe(F.lit("=1"))).first()) == ("A_B", "x:y.txt", "a_b_c", "'=1")
    assert spark.range(1).select(scalar.number(F.lit("1,5x")), scalar.number(F.lit("1,234.5"))).first()[:] == (0.0, 1234.5)
