"""The cleaning pipeline over documents: classify, drop near copies, cut repeats, decontaminate, pack.

Each stage takes what its predecessor kept. The first four return the columns
of documents; the last one the packed pieces. Rows without an id, or that
share one, are told apart by a hash of id and text, so that a decision about
one of them never falls on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm import common, decontamination, packing, quality_classifier, simhash, substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key(docs: DataFrame) -> tuple[Column, bool]:
    """What identifies a row of docs, and whether that takes a hash."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = ids.where("n > 1 OR doc_id IS NULL").limit(1).count() > 0
    return (F.xxhash64("doc_id", "text") if shared else F.col("doc_id")), shared


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    model = quality_classifier.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, *COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last; of one id the smallest hash of id and text."""
    _, shared = _key(docs)
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))
    groups = simhash.classes(keyed, "doc_id", "row_key")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = groups.groupBy("root").agg(F.min(place).alias("first")).select("first.doc_id", "first.row_key")
    same = keyed["doc_id"].eqNullSafe(first["doc_id"]) & (keyed["row_key"] == first["row_key"])
    kept = keyed.join(first, same, "left_semi")
    return (kept.dropDuplicates(["row_key"]) if shared else kept).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id has too."""
    found = substrings.repeats(docs, "lang", "source", with_text=True)
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    key, _ = _key(docs)
    keyed = docs.select(*COLUMNS, key.alias("row_key"))
    found = decontamination.decontaminate(keyed.select(F.col("row_key").alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    return keyed.join(found.where("contaminated").select(F.col("doc_id").alias("row_key")), "row_key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
