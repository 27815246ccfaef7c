"""Surface (step 1) and orthographic (step 3) rules: regex matches as issue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import flat
from ..functions.scalar import issue_id
from ..functions.spans import SPAN, rule_spans, with_positions
from ..functions.storage import spread
from ..schemas import STEP1_RULES, STEP3_RULES, TAGS, check_rules

RULES = {"S1": STEP1_RULES, "S3": STEP3_RULES}


def rule_counts(pairs: DataFrame, step: str, text: str = "htr") -> DataFrame:
    """style, tag, n: matches of each rule; only rules that match."""
    check_rules()
    hits = F.array(*[F.struct(F.lit(step + code).alias("tag"), F.regexp_count(text, F.lit(p)).cast("long").alias("n")) for code, p in RULES[step].items()])
    return pairs.select("style", F.explode(hits).alias("x")).groupBy("style", "x.tag").agg(F.sum("x.n").alias("n")).filter("n > 0").select("style", "tag", "n")


def rule_densities(step: str, text: str = "htr"):
    """The number of matches of all rules of a step, as an expression."""
    total = F.lit(0)
    for p in RULES[step].values():
        total = total + F.regexp_count(text, F.lit(p))
    return total.cast("long")


def rule_issues(pairs: DataFrame, step: str, codes: list[str] | None = None) -> DataFrame:
    """The fact rows of a step: spans with lines, positions, description and id."""
    rules = RULES[step] if codes is None else {c: RULES[step][c] for c in codes}
    rows = spread(pairs, "pair_id").select("pair_id", "style", F.length("htr").alias("document_length"), "htr")
    return finish(flat(rows, ["pair_id", "style", "document_length"], ["htr"], rule_spans(rules, step), SPAN), F.lit("htr"))


def finish(rows: DataFrame, basis) -> DataFrame:
    """Positions, description, review state and id of located issues."""
    names = F.create_map(*[x for step, codes in TAGS.items() for code, text in codes.items() for x in (F.lit(step + code), F.lit(text))])
    return with_positions(rows).withColumns({"description": names[F.col("tag")], "position_basis": basis, "review": F.struct(F.lit("unreviewed").alias("status")), "issue_id": issue_id(F.col("pair_id").cast("string"), F.col("tag"), F.col("start"), F.col("end"))})


def tag_pivot(counts: DataFrame, step: str) -> DataFrame:
    """One row per style, one column per tag of the step, zero where none."""
    tags = [step + c for c in TAGS[step]]
    return counts.groupBy("style").agg(*[F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("n"))), F.lit(0)).cast("long").alias(t) for t in tags])
