"""From raw documents to packed token ids: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontam, lsh_forest, mixing, packing, quality
from panelforge.llm.common import bounded_broadcast, free_name, shared_folder, table, with_places, without_ids, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Each row is judged by itself, whatever its id: null texts as empty ones, long texts whole, equal rows alike. Ids with a null or contradictory label are not learned from; without labels of both
    kinds all rows get one score. An empty table stays empty. Columns other than text, lang, source, n_chars and doc_id pass through untouched, whatever their names.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Of rows with one id and text one stays; rows with a null id, and texts that are null or without words, have no copies and stay. Long texts are compared whole. An empty table stays empty.
    Other columns pass through untouched, whatever their names.
    """
    found = lsh_forest.near_duplicates(docs, lsh_forest.ForestSpec(words=5, percent=80))
    copies = written(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "copies")
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not repeated.limit(1).count():
        return without_ids(docs, copies)
    at = [free_name(docs, "_file"), free_name(docs, "_row")]
    placed = with_places(docs, *at)
    rows = written(placed.join(bounded_broadcast(repeated), "doc_id").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"), *at), "repeated-rows")
    first = rows.groupBy("doc_id", "text").agg(F.min(F.struct(*at)).alias("at")).select("at.*")
    again = written(rows.select(*at).join(first, at, "left_anti"), "rows-again")
    return without_ids(placed.join(bounded_broadcast(again), at, "left_anti").drop(*at), copies)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs.

    Null texts and texts without words stay, as do rows with a null id; of several rows with one id, one that holds a window takes all away. Long texts are searched whole. Without items, all rows
    stay; an empty table stays empty. Other columns pass through untouched, whatever their names.
    """
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, written(found.where("contaminated and doc_id is not null").select("doc_id").distinct(), "contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows once for each epoch in which the mix takes them, also those with a null or repeated id, each by its place in the files.

    Rows without tokens (null and empty texts) are never taken; long texts count whole. Ties in the order of an epoch go by id, then place. An empty table stays empty. Other columns pass
    through untouched, whatever their names.
    """
    file, row, n, copy = (free_name(docs, name) for name in ("_file", "_row", "_n", "_copy"))
    placed = with_places(docs, file, row)
    times = written(mixing.mix(placed, mixing.MixSpec(), (file, row)).groupBy(file, row).agg(F.count("*").alias(n)), "mix")
    again = placed.join(bounded_broadcast(times, 1_000_000), [file, row])
    return again.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(file, row, n, copy)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the packed file, its number of ids and their crc32, read back from the file.

    Null and empty texts are an end id alone; a null id comes first; repeated rows are packed as often as they stand, long texts whole. An empty table gives no rows. Other columns are left out.
    """
    spec = packing.PackSpec(public_tokenizers.path("word_bpe_49k.json"), end_id=2, pieces=True)
    return packing.read_documents(packing.write_packed(docs, spec), packing.crc32_of, "ids_crc32")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", packing_stage),
]

#: Trained classifiers, tokenizers and bit packing can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a failed job can be resumed from any stage's table. Odd rows and columns are treated as the stages say; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
