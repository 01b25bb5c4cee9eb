"""A corpus pipeline: documents pass from stage to stage, each written as Parquet and reread before the next.

The stages reject toxic documents, then those of low quality, keep one document of each group of near-duplicates, take benchmark passages out, and
encode what is left. Every stage works on all documents that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import decontam, pieces, quality, simhash, toxicity
from proofline.llm.common import discard, settle, unused

#: A document goes if its toxicity is so high, or its quality below so much.
TOXIC_FROM, QUALITY_FROM = 0.5, 0.3
#: Contaminated documents are broadcast, 16 bytes each, up to this number; beyond it the join shuffles.
BROADCAST_HITS = 100_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC_FROM. Null and empty texts have the score of no evidence; repeated rows share their fate."""
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_column(docs, model, F.col("text")) < TOXIC_FROM)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is QUALITY_FROM or more, learned from the labels of those that are left."""
    weights = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_column(docs, weights, F.col("text")) >= QUALITY_FROM)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of near-duplicates, texts whose five-word shingles have a similarity of 0.8 or more; of its repeated rows one. Of a group whose ids are all null one row stays.

    Ids, fingerprints and hashes of whole rows decide which rows stay; texts move once, by id and hash, so that no group's texts meet in a task.
    """
    key = dict(zip(unused(docs, "_no_id", "_id", "_row"), (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64(*docs.columns))))
    each = settle(docs.select(F.struct(*[c.alias(n) for n, c in key.items()]).alias("key"), simhash.wide_fingerprint_column(F.col("text")).alias("fp")))
    chosen = simhash.similar_classes(each).groupBy("component").agg(F.min("key").alias("x")).select("x.*")
    # Of rows that are the same throughout, those of one key, one stays. That comes first, as tasks drop repeats before they shuffle, and the join finds the rows dealt out by its key.
    return docs.withColumns(key).dropDuplicates(list(key)).join(chosen, list(key), "left_semi").select(*docs.columns)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; contaminated documents go whole. Null texts hold none."""
    hits = settle(decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_hash"))
    if hits.count() <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    same = docs["doc_id"].eqNullSafe(hits["doc_id"]) & (F.xxhash64(docs["text"]) == hits["text_hash"])
    return docs.join(hits, same, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, exact) of every document that is left."""
    return pieces.encode_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", remove_benchmark_passages),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir. What a stage kept is removed once the next one is written."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        kept = settle(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return docs


#: SQL has no trained models: the stages are tested against plain versions of their decisions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
