"""From raw documents to a training mixture, in five stages.

Each stage reads what its predecessor kept (Parquet, written and read again), decides over all of it, and hands on the rows that
stay with the columns of ``documents``; the last returns the sampled documents with their chances and weights.

* language_id: learns from the labelled documents; a text whose language is unknown, or less likely than the
  calibrated threshold, goes.
* exact_dedup: of texts equal but for white space one stays.
* near_dedup: sets of five-word shingles with a similarity of 0.8 or more link; of each component the document with the smallest id stays.
* decontamination: a text that holds a benchmark item, or a paraphrase of one, goes.
* mixing: weights are raked to tempered shares of sources, languages and topics, and documents sampled; they get topic, tokens, chance and
  weight beside the columns of ``documents``. A null source or language reads ``(none)`` then.

Empty input: every stage returns no rows. Nulls are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import op01_langid, op02_decontaminate, op06_jaccard, op07_mixing, op09_exact_dedup
from lectern.llm.textkit import Sweep, forget, read, written


#: what the last stage adds to the columns of documents
MADE = ("topic", "n_tokens", "chance", "weight")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_langid.accepted(docs, op01_langid.fit_on(docs, F.lit(True)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_exact_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_jaccard.representatives(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op02_decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "source", "lang", *MADE))
    return op07_mixing.mix(docs, carry=rest).filter("sampled").select(*docs.columns, *[c for c in MADE if c not in docs.columns])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Stages one and four learn models, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Sweep(spark) as sweep:
            before, docs = docs, sweep.keep(written(stage(spark, docs, sf_dir), name))
        forget(before)
    return docs
