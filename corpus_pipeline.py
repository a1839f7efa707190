"""The corpus pipeline: quality classifier, near-dedup, substring dedup, decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.llm import bpe, decontamination, near_dedup, quality_model, substring_dedup
from landshift.llm.common import fresh, read, stored

#: The score below which a document is rejected.
QUALITY = 0.3
#: Words of a repeated passage.
PASSAGE = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels, does not reject.

    Every row is judged alone, whatever its doc_id; a null or empty text by statistics of
    zero, a text of any length as a whole.  A table without labelled rows keeps what the
    share of label 1 says of all; an empty table stays empty.
    """
    model = quality_model.train(docs, read(spark, sf_dir, "labels"))
    return quality_model.keep(docs, model, QUALITY)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies.

    Of rows with the same doc_id that with the largest set of shingles is the document and
    stays once; rows without doc_id are compared with nothing and stay; so does each null or
    empty text.
    """
    doc, name = fresh(docs, "kept_doc"), fresh(docs, "kept_text")
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(name))
    hashed = F.xxhash64(F.col("text").cast("string"))
    one = docs.join(kept, (F.col("doc_id").cast("long") == F.col(doc)) & (hashed == F.col(name))).dropDuplicates([doc, name]).select(*docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE words that a document of a smaller doc_id has too; n_chars follows.

    Rows without doc_id keep their text and take none away; rows of one doc_id don't touch
    each other; a null text stays null, a shorter text than PASSAGE words as it is.
    """
    return substring_dedup.cut_repeats(docs, PASSAGE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Texts are searched, so rows with or without doc_id, and all rows of one text, go or stay
    alike; null and empty texts stay.
    """
    name = fresh(docs, "found_text")
    hashed = F.xxhash64(F.col("text").cast("string"))
    found = decontamination.search(docs.select(hashed.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("doc_id").alias(name)).distinct(), hashed == F.col(name), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and the text decoded from them, for every row; a null text is empty."""
    return bpe.round_trip(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_copies),
    ("substring dedup", passages),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", tokens),
]

#: The stages fit models and join approximate candidates; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
