"""Reading and writing corpora and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import excel_safe, newlines
from ..operators.corpus import prefix_pairs, stem

#: Fixed value: a byte-order mark that some exports begin with.
BOM = "\ufeff"


def read_texts(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, style (the folder's name), name, stem, text of each .txt file below the path, line ends as \\n. Bytes that are not UTF-8 are an error."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    where = F.col("_metadata.file_path")
    rows = rows.select(where.alias("path"), F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("style"), F.url_decode(F.regexp_extract(where, r"([^/]+)$", 1)).alias("name"), newlines(F.validate_utf8("value")).alias("text"))
    return rows.withColumn("stem", stem(F.col("name"), suffix))


def read_pairs(spark: SparkSession, gt_path: str, htr_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pair_id, style, gt, htr; references without transcription; transcriptions without reference."""
    gt, htr = read_texts(spark, gt_path, "_GT"), read_texts(spark, htr_path, "_HTR")
    own = htr.filter(F.col("name").endswith("_HTR.txt"))
    pairs, missing_htr, _ = prefix_pairs(gt.select("stem"), own.select("stem").distinct())
    a, b = gt.select(F.col("stem").alias("gt_stem"), F.col("text").alias("gt")), own.select(F.col("stem").alias("htr_stem"), "style", "name", F.col("text").alias("htr"))
    rows = pairs.join(a, "gt_stem").join(b, "htr_stem").select(F.concat_ws(":", "gt_stem", "name").alias("pair_id"), "style", "gt", "htr")
    missing_gt = htr.join(pairs.select(F.col("htr_stem").alias("stem")), "stem", "left_anti").select("path")
    return rows, missing_htr, missing_gt


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined with semicolons, structs as JSON: what CSV can hold."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("array<struct") or kind.startswith(("struct", "map")):
            out.append(F.to_json(name).alias(name))
        elif kind.startswith("array"):
            out.append(F.array_join(F.transform(name, lambda x: x.cast("string")), ";").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, excel: bool = False) -> None:
    """excel: text that a spreadsheet would read as a formula gets a quote in front."""
    rows = flat(df)
    if excel:
        rows = rows.select(*[excel_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True, default: DataFrame | None = None) -> DataFrame:
    """The rows of a JSON file or folder; where there is none the default, or no rows. Lines that can't be read are left out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema) if default is None else default
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_issues(issues: DataFrame, path: str) -> None:
    """The fact table, one folder per style: scans of one style read only that."""
    issues.write.mode("overwrite").partitionBy("style").parquet(path)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def issue_text(issues: DataFrame) -> DataFrame:
    """One line of text per distinct (pair, tag, start, end)."""
    one = issues.dropDuplicates(["pair_id", "tag", "start", "end"])
    line = F.format_string("[%s] line %d, chars %d-%d: %s", "tag", "line", "char_start", "char_end", "description")
    return one.select("pair_id", "style", "start", line.alias("line"))


def missing_files(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected paths that the listing lacks."""
    return expected.join(listing.select("path"), "path", "left_anti").withColumn("warning", F.lit("path not found"))
