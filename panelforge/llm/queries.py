"""The queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import alignment, ann, decontam, importance, lsh_forest, maxent_lm, mixing, packing, pii, quality, secret_scan, sequences, url_filter
from panelforge.llm.common import table, written
from panelforge.llm.oracles import ORACLES


#: (action, host and path prefix)
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0", ann.CollisionSpec(k=20))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.MixSpec(share=1.0, power=0.5, max_epochs=4))


def op4_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in secret_scan.KINDS]
    spans = pii.listed(F.array_sort(F.concat("base", "extra")))
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.train_and_score(table(spark, sf_dir, "documents"))


def op6_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    spans = pii.listed(F.array_sort(F.concat("base", "extra")))
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = packing.PackSpec(public_tokenizers.path("word_bpe_49k.json"), end_id=2, pieces=True)
    blocks = packing.write_packed(table(spark, sf_dir, "documents"), spec)
    return packing.read_documents(blocks, packing.crc32_of, "ids_crc32")


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spec = table(spark, sf_dir, "documents"), quality.CoTrainSpec()
    seen = written(quality.views(docs), "views")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), spec, seen), seen)
    return scored.withColumn("keep", F.col("score") >= spec.threshold)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), lsh_forest.ForestSpec(words=3, percent=85))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), importance.ResampleSpec(run=1, buckets=10_000, percent=10, least_words=20, seed=2024))


def op12_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sequences.CutSpec(public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return sequences.read_pieces(sequences.write_sequences(table(spark, sf_dir, "documents"), spec))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), alignment.AlignSpec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


OPERATORS = (op1_url_filter, op2_collision_search, op3_mixing, op4_crf_secrets, op5_maxent_lm, op6_contextual_pii, op7_packing, op8_cotraining, op9_decontamination, op10_lsh_forest, op11_resampling, op12_sequences, op13_alignment)
QUERIES = {f.__name__: f for f in OPERATORS}

__all__ = ["ORACLES", "QUERIES"]
