"""Exact dedup by content sort, with DataFrame functions only.

Sampled splitters range-partition the normalised texts, an external sort places equal ones adjacent, and the
window operator compares each full text with its neighbour; of a run of equal texts the row with the most code
points, then the smallest identifier, stays.

* The splitters are keys of at most 64 characters and a digest, so what Spark samples and broadcasts for them stays
  small; the sort then goes on to the full text, so rows are equal only if their full normalised texts are.
* A text that holds a large share of all rows would fill one range. As in a sample sort with equality buckets, texts
  that occur repeatedly in a sample go to a bucket of their own, where they are counted by a hash aggregate that
  combines on the map side (it too compares full texts). The sample grows with the number of ranges (``ROWS_PER_RANGE`` each, ``SAMPLE_ROWS`` at
  least), so a text that would fill a quarter of a range is found; at most ``sample / heavy_hits`` such texts exist, and their digests
  are broadcast: 100 bytes each. The list is written once and read by both paths, so they agree whatever rows the sample held.

* Normalised texts and their digests are made once and written, as several passes read them.

Nulls: a null text counts as empty, all empty texts are one group; a null id sorts after every other one.
Repeated rows (same text and id) are members of the group; all rows with the id that stays are kept.
An empty table gives an empty result. Other columns are ignored, whatever their types and names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textkit import written

WHITE = " \t\n\x0b\x0c\r"
SAMPLE_ROWS, ROWS_PER_RANGE = 20_000, 32


def quoted(name: str):
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def heavy_digests(keyed: DataFrame, sample_rows: int, heavy_hits: int) -> DataFrame:
    """Digests of the texts that fill at least heavy_hits of about sample_rows rows, written."""
    share = min(1.0, sample_rows / max(keyed.count(), 1))
    sampled = keyed if share == 1.0 else keyed.sample(False, share, seed=7)
    return written(sampled.groupBy(F.col("sha").alias("h_sha")).count().filter(F.col("count") >= heavy_hits).select("h_sha"), "heavy")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int | None = None, heavy_hits: int = 8, partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    sample_rows and heavy_hits only choose the path of a text, never its result.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("_text"))
    norm = rows.select("doc_id", F.char_length(F.coalesce("_text", F.lit(""))).cast("long").alias("n"), normalised(F.col("_text")).alias("norm"))
    keyed = written(norm.withColumn("sha", F.sha2("norm", 256)), "normalised")
    heavy = heavy_digests(keyed, sample_rows or max(SAMPLE_ROWS, ROWS_PER_RANGE * parts), heavy_hits)
    marked = keyed.join(F.broadcast(heavy), F.col("sha") == F.col("h_sha"), "left")

    light = marked.filter("h_sha is null").select("doc_id", "n", "norm", "sha", F.substring("norm", 1, 64).alias("head"))
    light = light.repartitionByRange(parts, "head", "sha")
    run = W.partitionBy("head", "sha", "norm")
    first = run.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))
    sorted_ = light.select("doc_id", "sha", F.first("doc_id").over(first).alias("keep_id"), F.count(F.lit(1)).over(run).alias("group_size"))

    hot = marked.filter("h_sha is not null").drop("h_sha")
    by_length = hot.groupBy("norm", "sha", "n").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("members"))
    groups = by_length.groupBy("norm", "sha").agg(F.max_by("lowest", "n").alias("keep_id"), F.sum("members").alias("group_size")).select(F.col("sha").alias("g_sha"), "keep_id", "group_size")
    bucket = hot.join(F.broadcast(groups), F.col("sha") == F.col("g_sha")).select("doc_id", "sha", "keep_id", "group_size")

    both = sorted_.unionByName(bucket)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows that stay, the one first in its other columns.

    Only ids that repeat within their group need the last comparison, so only their rows are shuffled for it.
    """
    stay = exact_dedup(df, id_col, text_col, **options).filter("kept").groupBy(F.col("doc_id").alias("__stay_id"), F.col("text_sha256").alias("__stay_sha")).agg(F.count(F.lit(1)).alias("__members"))
    rows = df.withColumn("__norm_sha", F.sha2(normalised(quoted(text_col)), 256))
    rows = rows.join(stay, quoted(id_col).eqNullSafe(F.col("__stay_id")) & (F.col("__norm_sha") == F.col("__stay_sha")))
    names = [quoted(c) for c in df.columns]
    once, more = rows.filter("__members = 1").select(*names), rows.filter("__members > 1")
    # maps have no order of their own
    order = [F.length(quoted(text_col)).desc(), *[(F.to_json(F.struct(quoted(c))) if "map<" in t or t == "variant" else quoted(c)).asc_nulls_last() for c, t in df.dtypes]]
    more = more.withColumn("__place", F.row_number().over(W.partitionBy(quoted(id_col), "__norm_sha").orderBy(*order))).filter("__place = 1").select(*names)
    return once.unionByName(more)


ORACLE = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents)
select doc_id, first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id,
       count(*) over (partition by h) as group_size,
       doc_id = first_value(doc_id) over (partition by h order by n desc, doc_id) as kept, h as text_sha256
from t
"""
