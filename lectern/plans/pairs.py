"""The pairing of reference and transcription that queries run on: documents, and a deterministic corruption of them.

The expression is the same SQL in Spark and DuckDB, so both see the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ZWSP, _BROKEN = "\u200b", "\ufffd"
HTR = f"""case doc_id % 5
 when 0 then text
 when 1 then replace(replace(translate(text, 'éèêçñ', 'eeecn'), ', ', ' , '), ' de ', ' ')
 when 2 then replace(replace(replace(text, 'tion', 'tjion'), '. ', '..  '), ' la ', ' la la ')
 when 3 then concat('  ', replace(replace(translate(text, 'aou', 'aov'), ' the ', ' thekk '), chr(10), concat(' ', chr(10))))
 else replace(replace(replace(replace(replace(text, ' of ', 'of '), ' le ', ' quale '), chr(10), concat(chr(10), chr(10))), 'er', 'e{_ZWSP}r'), ' and ', ' a{_BROKEN}d ') end"""
COLUMNS = f"coalesce(lang, 'none') as style, doc_id as pair_id, coalesce(text, '') as gt, coalesce({HTR}, '') as htr"
#: the same as a table expression for DuckDB
CTE = f"pairs as (select {COLUMNS} from documents)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("coalesce(lang, 'none') as style", "doc_id as pair_id", "coalesce(text, '') as gt", f"coalesce({HTR}, '') as htr")
