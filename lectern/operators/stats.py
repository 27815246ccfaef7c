"""Order statistics, ranks and concentration without gathering a group into one list.

Values are first counted per group (combined on the map side); cumulative counts over distinct values then give any
order statistic. Cumulative counts and ranks come from one range-partitioned sort of all rows: what stands before a row is what stands before it in
its partition plus the sums of the partitions before, so a group that holds most rows is sorted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import FEW, numbered, settled, small


def melt(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row per row and metric."""
    return df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*by, "x.metric", "x.value")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    if not keys:
        return left.crossJoin(right)
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(right, test).drop(*[f"_right_{k}" for k in keys])


def cumulative(long: DataFrame, by: list[str], few: int = FEW) -> DataFrame:
    """Distinct values with how often they occur, how many rows are below and up to them, and how many there are.

    Up to ``few`` counted values one window per group adds them up; beyond that the sorted partitions do.
    """
    counts = settled(long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_k")))
    before, w = (W.unboundedPreceding, 0), W.partitionBy(*by)
    if counts.count() <= few:
        upto = F.sum("_k").over(w.orderBy("value").rowsBetween(*before))
        return counts.select(*by, "value", "_k", upto.alias("_upto"), (upto - F.col("_k")).alias("_before"), F.sum("_k").over(w).alias("_n"))
    rows = numbered(counts.orderBy(*by, "value"))
    own = W.partitionBy("_part", *by)
    rows = rows.withColumn("_here", F.sum("_k").over(own.orderBy("_row").rowsBetween(*before)))
    # one row per partition and group in it: fewer than partitions and groups together
    parts = rows.groupBy("_part", *by).agg(F.sum("_k").alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = small(parts.select("_part", *by, ahead.alias("_ahead"), F.sum("_sum").over(w).alias("_n")))
    upto = F.col("_ahead") + F.col("_here")
    return _same(rows, parts, ["_part", *by]).select(*by, "value", "_k", upto.alias("_upto"), (upto - F.col("_k")).alias("_before"), "_n")


def at_index(index: Column) -> Column:
    """The value at an index (from 0) of the sorted values."""
    return F.max(F.when((F.col("_before") <= index) & (index < F.col("_upto")), F.col("value")))


def percentile(p: float) -> Column:
    """sorted[min(int(n p), n - 1)]"""
    return at_index(F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1))


def percentile_ceil(p: float) -> Column:
    """sorted[min(n - 1, ceil(n p) - 1)]"""
    return at_index(F.least(F.col("_n") - 1, F.ceil(F.col("_n") * F.lit(p)) - 1))


def median() -> Column:
    return (at_index(F.floor((F.col("_n") - 1) / 2)) + at_index(F.floor(F.col("_n") / 2))) / 2


def order_statistics(df: DataFrame, by: list[str], metrics: list[str], **stats: Column) -> DataFrame:
    """by, metric and the named statistics."""
    return cumulative(melt(df, by, metrics), [*by, "metric"]).groupBy(*by, "metric").agg(*[c.alias(name) for name, c in stats.items()])


def wide(long: DataFrame, by: list[str], metrics: list[str], stat: str, prefix: str) -> list[Column]:
    return [F.max(F.when(F.col("metric") == m, F.col(stat))).alias(f"{prefix}{m}") for m in metrics]


def robust_center(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by, metric, med and mad (median of the distances from the median). The rows are read twice: they should be settled."""
    long = melt(df, by, metrics)
    med = small(cumulative(long, [*by, "metric"]).groupBy(*by, "metric").agg(median().alias("med")))
    away = _same(long, med, [*by, "metric"]).select(*by, "metric", F.abs(F.col("value") - F.col("med")).alias("value"))
    mad = cumulative(away, [*by, "metric"]).groupBy(*by, "metric").agg(median().alias("mad"))
    return _same(mad, med, [*by, "metric"]).select(*by, "metric", "med", "mad")


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Adds each row's place (from 1) within its group; an empty ``by`` ranks all rows."""
    rows = numbered(df.orderBy(*[F.col(c) for c in by], *order))
    # one row per partition: their number doesn't grow with a group
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_k")).select("_part", F.coalesce(F.sum("_k").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    placed = rows.join(small(sizes), "_part").withColumn("_place", F.col("_ahead") + F.col("_row"))
    groups = small(placed.groupBy(*by).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size")))
    out = _same(placed, groups, by).withColumn(rank, F.col("_place") - F.col("_first") + 1)
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_part", "_row", "_ahead", "_place", "_first", "_size")


def tercile_band(rank: Column, n: Column) -> Column:
    """High, Medium, Low: first third, second third (rounded up), rest; up to three rows one each."""
    small = F.when(rank == 1, "High").when(rank == 2, "Medium").otherwise("Low")
    return F.when(n <= 3, small).when(rank <= F.ceil(n / 3), "High").when(rank <= F.ceil(2 * n / 3), "Medium").otherwise("Low")


def concentration(df: DataFrame, by: str, value: str) -> DataFrame:
    """Gini coefficient and the shares of the top tenth and the top five rows, from value counts alone."""
    c = cumulative(df.select(by, F.col(value).cast("double").alias("value")), [by])
    v, k, n = F.col("value"), F.col("_k"), F.col("_n")
    # ranks of equal values are before + 1 ... upto: their sum in closed form
    weighted = F.sum(v * k * (F.col("_before") + F.col("_upto") + 1) / 2)
    top = lambda m: F.sum(v * F.greatest(F.least(k, m - (n - F.col("_upto"))), F.lit(0)))
    agg = c.groupBy(by).agg(F.max("_n").alias("docs"), F.sum(v * k).alias("total_edits"), weighted.alias("_w"), top(F.greatest(F.lit(1), F.ceil(n * F.lit(0.10)))).alias("_t10"), top(F.least(F.lit(5), n)).alias("_t5"))
    share = lambda x: F.when(F.col("total_edits") != 0, F.col(x) / F.col("total_edits")).otherwise(0.0)
    gini = F.when(F.col("total_edits") == 0, 0.0).otherwise(2 * F.col("_w") / (F.col("docs") * F.col("total_edits")) - (F.col("docs") + 1) / F.col("docs"))
    return agg.select(by, "docs", "total_edits", gini.alias("gini"), share("_t10").alias("top_10pct_docs_share"), share("_t5").alias("top_5_docs_share"))
