"""The pipeline against a plain version of its stages."""

import hashlib
import re

import corpus_pipeline
import numpy as np
from lectern.llm import op01_langid as langid
from lectern.llm import op02_decontaminate as decon
from lectern.llm import op07_mixing as mixing
from pyspark.sql import functions as F

from .test_operators import LOWER, brute_components, odd  # noqa: F401


def test_pipeline(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    model = langid.fit_on(table, F.lit(True))
    known = {r.doc_id for r in langid.detect(table, model).collect() if not r.rejected}
    assert len(known) > 0.97 * len(texts)
    groups: dict[str, list[int]] = {}
    for d in sorted(known):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[d] or ""), []).append(d)
    one = {min(g, key=lambda d: (-len(texts[d] or ""), d)) for g in groups.values()}
    two = {d for d, (_, c) in brute_components({d: texts[d] for d in one}, 5, 80, 100).items() if c == d}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    flat = lambda t: " " + " ".join(word.findall(t.translate(LOWER))) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    three = {d for d in two if not any(i in flat(texts[d] or "") for i in items)}
    chances = {r.doc_id: r.chance for r in mixing.mix(table.filter(F.col("doc_id").isin(sorted(three)))).collect()}
    four = {d for d in three if int(hashlib.md5(f"{d}:mix".encode()).hexdigest()[:8], 16) / 2**32 < chances[d]}

    docs = table
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == table.columns, name
        docs = docs.checkpoint()
        kept.append({r.doc_id for r in docs.collect()})
    assert kept == [known, one, two, three]
    assert {r.doc_id for r in corpus_pipeline.mixing(spark, docs, sf).collect()} == four


def test_run_on_nothing(spark, tmp_path, sf):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, odd, sf):
    """Nulls, empty and long texts, repeated rows and columns with clashing names through every stage."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.columns[: len(odd.columns)] == odd.columns, name
        kept = out.collect()
        assert len(kept) <= odd.count(), name
        if name == "exact_dedup":
            assert len({(r.doc_id, r.text) for r in kept}) == len(kept)


def test_decontamination_learns_from_all_rows(spark, sf, monkeypatch):
    """Rows that a sample would leave out count for the space that the stage searches in."""
    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.concat(F.lit("w"), F.col("id") % 500), F.concat(F.lit("v"), F.col("id") % 70)).alias("text"))
    own, spaces = decon.fit, []
    monkeypatch.setattr(decon, "fit", lambda *a, **k: spaces.append(own(*a, **k)) or spaces[-1])
    for rows in (docs, docs.unionByName(docs)):
        corpus_pipeline.decontamination(spark, rows, sf)
    # vectors are divided by singular values, which twice the passages raise by the root of two
    once, twice = (np.linalg.norm(x.project) for x in spaces)
    assert 1.2 < once / twice < 1.6
