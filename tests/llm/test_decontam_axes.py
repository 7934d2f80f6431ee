from pyspark.sql import functions as F

import corpus_pipeline
from gridols.llm import decontam as dc


def test_axes_are_fitted_on_every_document(spark, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the red fox number "), F.col("id").cast("string")).alias("text"))
    items = spark.createDataFrame([(1, "the red fox number 7"), (2, "a blue bird")], "item_id long, text string")
    fitted, plain = [], dc.latent_axes
    monkeypatch.setattr(dc, "latent_axes", lambda some, *how: fitted.append(some.count()) or plain(some, *how))
    assert (7, 1) in {tuple(r) for r in dc.matches(docs, items).select("doc_id", "item_id").collect()}
    assert fitted == [30_000]


def test_the_pipelines_stage_counts_and_fits_over_every_document(spark, monkeypatch, tmp_path):
    item = "a blue bird sat on the old stone wall"
    plain = F.concat(F.lit("the old number "), F.col("id").cast("string"))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, item).otherwise(plain).alias("text"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, frequencies, axes = [], dc.frequencies, dc.latent_axes
    monkeypatch.setattr(dc, "frequencies", lambda some, *how: read.append(some.count()) or frequencies(some, *how))
    monkeypatch.setattr(dc, "latent_axes", lambda some, *how: read.append(some.count()) or axes(some, *how))
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == set(range(30_000)) - {7}
    assert read == [30_000, 30_000]
