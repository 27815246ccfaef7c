"""Rules over a stream of documents: they look at one text at a time, so the batch expressions serve unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import RULES


def rule_hits(stream: DataFrame, step: str, text: str = "htr") -> DataFrame:
    """pair_id, style, tag, n of each arriving text; stateless, so any output mode works."""
    hits = F.array(*[F.struct(F.lit(step + code).alias("tag"), F.regexp_count(text, F.lit(p)).alias("n")) for code, p in RULES[step].items()])
    return stream.select("pair_id", "style", F.explode(hits).alias("x")).select("pair_id", "style", "x.tag", "x.n").filter("n > 0")


def running_counts(stream: DataFrame, step: str) -> DataFrame:
    """Totals by style and tag so far, for the complete or update output mode; state is one row per style and tag."""
    return rule_hits(stream, step).groupBy("style", "tag").agg(F.sum("n").alias("n"))
