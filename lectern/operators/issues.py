"""Aggregates over the issue fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import bin_label, normalised_char
from ..functions.storage import small
from ..schemas import STOPWORDS

STAGES = ("S1", "S2", "S3")
#: Fixed value: the sign of a missing character.
GAP = "Ø"


def issue_index(issues: DataFrame) -> DataFrame:
    """Per pair: issues of each step; pairs without issues are absent."""
    each = [F.sum(F.when(F.col("tag").startswith(s), 1).otherwise(0)).cast("long").alias(s) for s in STAGES]
    return issues.groupBy("pair_id", "style").agg(F.count(F.lit(1)).alias("total_issues"), *each)


def alignment_diagnostics(issues: DataFrame, limit: float = 0.4) -> DataFrame:
    """Per pair with step 2 issues: counts and shares by kind, and a flag where insertions or deletions prevail."""
    n = lambda t: F.sum(F.when(F.col("tag") == t, 1).otherwise(0)).cast("long").alias(t)
    rows = issues.filter(F.col("tag").startswith("S2")).groupBy("pair_id", "style").agg(F.count(F.lit(1)).alias("total_s2"), n("S2X"), n("S2I"), n("S2D"))
    share = lambda c: F.col(c) / F.col("total_s2")
    flag = F.when((share("S2I") > limit) | (share("S2D") > limit), "ALIGNMENT_DRIFT").otherwise("OK")
    return rows.select("*", F.round(share("S2I"), 3).alias("insert_ratio"), F.round(share("S2D"), 3).alias("delete_ratio"), F.round(share("S2X"), 3).alias("replace_ratio"), flag.alias("flag"))


def drift_report(diagnostics: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """One row with the documents analysed, those that drift and their rate in percent; the n drifting documents with most step 2 issues."""
    drift = F.col("flag") == "ALIGNMENT_DRIFT"
    docs, flagged = F.count(F.lit(1)), F.sum(F.when(drift, 1).otherwise(0))
    rate = diagnostics.agg(docs.alias("docs"), F.coalesce(flagged, F.lit(0)).cast("long").alias("drifting"), F.when(docs > 0, F.round(flagged / docs * 100, 2)).otherwise(0.0).alias("rate"))
    return rate, diagnostics.filter(drift).orderBy(F.desc("total_s2"), "pair_id").limit(n).select("pair_id", "style", "total_s2")


def drift_histogram(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("flag").agg(F.count(F.lit(1)).alias("docs"))


def stage_overview(issues: DataFrame) -> DataFrame:
    """Issues and their share per step, and a TOTAL row."""
    rows = issues.groupBy(F.substring("tag", 1, 2).alias("stage")).agg(F.count(F.lit(1)).alias("issues"))
    total = rows.agg(F.sum("issues").alias("all"))
    out = rows.crossJoin(F.broadcast(total)).select("stage", "issues", (F.col("issues") / F.col("all")).alias("share"))
    return out.unionByName(total.select(F.lit("TOTAL").alias("stage"), F.col("all").alias("issues"), F.lit(1.0).alias("share")))


def issue_distribution(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per style: its share of issues against its share of documents, in percentage points."""
    a, b = issues.groupBy("style").agg(F.count(F.lit(1)).alias("issues")), pairs.groupBy("style").agg(F.count(F.lit(1)).alias("docs"))
    rows = a.join(b, "style", "full").fillna(0, ["issues", "docs"])
    sums = rows.agg(F.sum("issues").alias("i"), F.sum("docs").alias("d"))
    pp = F.when(F.col("i") > 0, F.col("issues") / F.col("i") * 100).otherwise(0.0) - F.when(F.col("d") > 0, F.col("docs") / F.col("d") * 100).otherwise(0.0)
    return rows.crossJoin(F.broadcast(sums)).select("style", "issues", "docs", pp.alias("weight_pp"), F.when(pp > 1, "Overweight").when(pp < -1, "Underweight").otherwise("Balanced").alias("weight"))


def tag_histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def overlap_totals(step2: DataFrame) -> DataFrame:
    """Step 2 issues that touch step 1 issues: per style and touched tag, per style, and overall (nulls)."""
    rows = step2.filter(F.size("overlaps_step1") > 0)
    tagged = rows.select("style", F.explode("overlaps_step1").alias("touched")).groupBy("style", "touched").agg(F.count(F.lit(1)).alias("n"))
    plain = rows.rollup("style").agg(F.count(F.lit(1)).alias("n")).select("style", F.lit(None).cast("string").alias("touched"), "n")
    return tagged.unionByName(plain)


def orthographic_overlap_totals(overlaps: DataFrame) -> DataFrame:
    """Per style and step 3 tag: touching step 1 and step 2 spans, each counted."""
    return overlaps.groupBy("style", "tag").agg(F.sum(F.size("touch_s1")).alias("s1_overlaps"), F.sum(F.size("touch_s2")).alias("s2_overlaps"), F.sum(F.when(F.size("touch_s1") > 0, 1).otherwise(0)).alias("with_s1"), F.sum(F.when(F.size("touch_s2") > 0, 1).otherwise(0)).alias("with_s2"))


def posthoc(step2: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Per style: how many step 2 and step 3 issues step 1 explains, rates, and what stays unexplained."""
    two = step2.groupBy("style").agg(F.count(F.lit(1)).alias("s2_total"), F.sum(F.when(F.size("overlaps_step1") > 0, 1).otherwise(0)).alias("s2_explained"))
    three = overlaps.groupBy("style").agg(F.count(F.lit(1)).alias("s3_total"), F.sum(F.when((F.size("touch_s1") > 0) | (F.size("touch_s2") > 0), 1).otherwise(0)).alias("s3_explained"))
    rows = two.join(three, "style", "full").fillna(0)
    for s in ("s2", "s3"):
        t, e = F.col(f"{s}_total"), F.col(f"{s}_explained")
        rows = rows.withColumn(f"{s}_explained_rate", F.when(t > 0, e / t).otherwise(0.0)).withColumn(f"{s}_unexplained", F.greatest(t - e, F.lit(0)))
    return rows


def char_pairs(step2: DataFrame, normalise: bool = True) -> DataFrame:
    """Aligned characters of step 2 issues, the shorter side padded with a gap sign."""
    chars = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    zipped = F.arrays_zip(chars(F.col("gt_text")).alias("g"), chars(F.col("htr_text")).alias("h"))
    rows = step2.select("pair_id", "style", "ordinal", F.posexplode(zipped).alias("place", "c")).select("pair_id", "style", "ordinal", "place", F.coalesce("c.g", F.lit(GAP)).alias("gt_char"), F.coalesce("c.h", F.lit(GAP)).alias("htr_char"))
    return rows.withColumn("gt_char", normalised_char(F.col("gt_char"))).withColumn("htr_char", normalised_char(F.col("htr_char"))) if normalise else rows


def confusion_matrix(step2: DataFrame) -> DataFrame:
    """style, gt_char, htr_char, n: the long form of the matrix."""
    return char_pairs(step2).groupBy("style", "gt_char", "htr_char").agg(F.count(F.lit(1)).alias("n"))


def column_name(char: str) -> str:
    """The name of a character's column: itself, with its code point where another character differs from it in case alone."""
    plain = len(char) != 1 or char == GAP or char.upper().lower() == char != GAP.lower()
    return char if plain else f"{char} U+{ord(char):04X}"


def dense_matrix(matrix: DataFrame) -> DataFrame:
    """The matrix with one column per transcription character and one for gaps, a row for gaps in each style, zeros filled in.

    Columns are all distinct characters of the matrix, sorted: an alphabet, not data.
    """
    chars = [*sorted(r[0] for r in matrix.select("htr_char").distinct().collect() if r[0] != GAP), GAP]
    gaps = matrix.select("style").distinct().select("style", F.lit(GAP).alias("gt_char"), F.lit(GAP).alias("htr_char"), F.lit(0).cast("long").alias("n"))
    n = [F.sum(F.when(F.col("htr_char") == c, F.col("n")).otherwise(0)).alias(column_name(c)) for c in chars]
    return matrix.unionByName(gaps).groupBy("style", "gt_char").agg(*n)


def top_confusions(rows: DataFrame, left: str, right: str, n: int = 10) -> DataFrame:
    """Per style the n most frequent (left, right), with their share of all the style's; earlier seen first on ties."""
    counts = rows.groupBy("style", left, right).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pair_id", "ordinal")).alias("seen"))
    w = W.partitionBy("style")
    # only counted pairs reach the window, not their occurrences
    placed = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "seen", left, right))).withColumn("share", F.col("n") / F.sum("n").over(w))
    return placed.filter(F.col("rank") <= n).select("style", "rank", left, right, "n", "share")


def char_confusions(step2: DataFrame, n: int = 10) -> DataFrame:
    rows = char_pairs(step2.filter(F.col("tag") == "S2X"), normalise=False).filter("gt_char <> htr_char")
    return top_confusions(rows, "gt_char", "htr_char", n)


def bigram_rows(step2: DataFrame) -> DataFrame:
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    return step2.filter(F.col("tag") == "S2X").select("*", bare(F.col("gt_text")).alias("gt_bigram"), bare(F.col("htr_text")).alias("htr_bigram")).filter("length(gt_bigram) = 2 and htr_bigram <> ''")


def bigram_confusions(step2: DataFrame, n: int = 10) -> DataFrame:
    return top_confusions(bigram_rows(step2), "gt_bigram", "htr_bigram", n)


def word_confusions(step2: DataFrame, n: int = 10, least: int = 3) -> DataFrame:
    rows = step2.filter(F.col("tag") == "S2X").select("pair_id", "style", "ordinal", F.lower(F.trim("word_gt")).alias("gt_word"), F.lower(F.trim("word_htr")).alias("htr_word"))
    rows = rows.filter((F.col("gt_word") != F.col("htr_word")) & (F.col("htr_word") != "") & ~F.col("gt_word").isin(*STOPWORDS) & (F.length("gt_word") >= least))
    return top_confusions(rows, "gt_word", "htr_word", n)


def confusion_contexts(step2: DataFrame, n: int = 10, contexts: int = 10) -> DataFrame:
    """kind, gt, htr, token, n, rank: for each of a style's top character and bigram confusions the words it occurs in most often.

    An issue counts where its whole texts are the confusion; the word is the reference's, else the transcription's, and issues without one
    don't count. The issues are read several times: they should be settled.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    filled = lambda c: F.when(text(c) != "", text(c))
    words = step2.select("*", F.coalesce(filled("word_gt"), filled("word_htr")).alias("token")).filter(F.col("token").isNotNull())
    found = []
    for kind, top, rows in (
        ("char", char_confusions(step2, n).select("style", F.trim("gt_char").alias("gt"), F.trim("htr_char").alias("htr")), words.select("*", text("gt_text").alias("gt"), text("htr_text").alias("htr"))),
        ("bigram", bigram_confusions(step2, n).select("style", F.col("gt_bigram").alias("gt"), F.col("htr_bigram").alias("htr")), bigram_rows(words).withColumnsRenamed({"gt_bigram": "gt", "htr_bigram": "htr"})),
    ):
        # at most styles x n confusions are chosen
        hits = rows.join(F.broadcast(top.filter("gt <> '' or htr <> ''")), ["style", "gt", "htr"], "left_semi")
        found.append(hits.select(F.lit(kind).alias("kind"), "style", "gt", "htr", "token", "pair_id", "ordinal"))
    counts = found[0].unionByName(found[1]).groupBy("kind", "style", "gt", "htr", "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pair_id", "ordinal")).alias("seen"))
    rank = F.row_number().over(W.partitionBy("kind", "style", "gt", "htr").orderBy(F.desc("n"), "seen"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= contexts).drop("seen")


#: The operations of the topology, and how they are written.
OPERATIONS = ("substitution", "deletion", "insertion")
OPERATION_NAMES = {"substitution": ("sub", "subs", "substitution", "replace", "replacement", "s", "x"), "insertion": ("ins", "insert", "insertion", "i"), "deletion": ("del", "delete", "deletion", "d")}
OPERATION_PARTS = {"substitution": ("sub", "replace"), "insertion": ("insert",), "deletion": ("delet",)}
OPERATION_TAGS = {"substitution": ("X", "R"), "insertion": ("I",), "deletion": ("D",)}


def operation(word_op=None, tag=None):
    """The operation that counts for topology: the word's in any usual spelling, else what the tag's last letter says; null for other issues."""
    word_op, tag = F.col("word_op") if word_op is None else word_op, F.col("tag") if tag is None else tag
    name, code = F.lower(F.trim(F.coalesce(word_op, F.lit("")))), F.upper(F.trim(F.coalesce(tag, F.lit(""))))
    tests = [(name.isin(*names), op) for op, names in OPERATION_NAMES.items()]
    tests += [(name.contains(part), op) for op, parts in OPERATION_PARTS.items() for part in parts]
    tests += [(code == "S2S", "substitution")] + [(code.endswith(end), op) for op, ends in OPERATION_TAGS.items() for end in ends]
    return F.coalesce(*[F.when(test, op) for test, op in tests])


def topology(events: DataFrame, pairs: DataFrame, bin_col: str, op_col: str = "op", bins: int = 10, ops: tuple[str, ...] = OPERATIONS, least: int = 1) -> DataFrame:
    """Events per document of each style, operation and position bin, zeros filled in for all; empty with fewer than ``least`` events."""
    docs = pairs.groupBy("style").agg(F.count(F.lit(1)).alias("docs"))
    counts = events.filter(F.col(bin_col).isNotNull() & F.col(op_col).isin(*ops)).groupBy("style", F.col(op_col).alias("op"), F.col(bin_col).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = small(counts)  # styles x operations x bins
    usable = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) >= least).alias("usable")).filter("usable").drop("usable")
    styles = docs.select("style").union(counts.select("style")).distinct()
    cells = styles.crossJoin(F.broadcast(usable)).withColumn("op", F.explode(F.array(*map(F.lit, ops)))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return cells.join(counts, ["style", "op", "bin"], "left").join(docs, "style", "left").select("style", "op", "bin", n.alias("n"), (n / F.coalesce("docs", F.lit(1))).alias("events_per_doc"))


def topology_peaks(table: DataFrame) -> DataFrame:
    """The bin with most events per document of each style and operation; the first of equals."""
    return table.groupBy("style", "op").agg(F.max_by("bin", F.struct("events_per_doc", (-F.col("bin")).alias("b"))).alias("peak_bin"), F.max("events_per_doc").alias("peak"))


def topology_profiles(lines: DataFrame, places: DataFrame) -> DataFrame:
    """Per style and operation and position kind: peak bin, peak, and all bins in order, for JSON."""
    out = []
    for kind, table in (("line", lines), ("document", places)):
        bins = F.transform(F.array_sort(F.collect_list(F.struct("bin", "events_per_doc"))), lambda x: F.struct(bin_label(x["bin"]).alias("bin"), x["events_per_doc"].alias("events_per_document")))
        rows = table.groupBy("style", "op").agg(bins.alias("bins")).join(topology_peaks(table), ["style", "op"])
        out.append(rows.select("style", F.col("op").alias("operation"), F.lit(kind).alias("kind"), bin_label(F.col("peak_bin")).alias("peak_bin"), F.col("peak").alias("peak_events_per_document"), "bins"))
    return out[0].unionByName(out[1])
