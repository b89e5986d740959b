"""From raw documents to token digests: five stages over the whole table.

Every stage works on all documents that the stage before kept. Repeated rows are
near duplicates of each other; ids may be null or repeat with other texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.base import staged, table
from evidentia.llm.decontamination import drop_contaminated
from evidentia.llm.jaccard_join import jaccard_join
from evidentia.llm.quality_rules import keep_good
from evidentia.llm.sentencepiece_codec import encode_decode
from evidentia.llm.substring_dedup import strip_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the smallest id (null last), once.

    A row is known by its id and text together, so an id that several texts carry
    loses none of them, and a row without an id is a document like any other.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    rows = keyed.groupBy(key).agg(F.min("doc_id").alias("least"))
    classes = jaccard_join(keyed, id_column=key).groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("class"))
    first = F.min(F.struct(F.col("least").isNull(), "least", key))
    chosen = rows.join(classes, key).groupBy("class").agg(first.alias("row")).select(F.col(f"row.{key}").alias(key))
    return keyed.join(chosen, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    return strip_repeats(docs, length_column="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: Trigram weights, retrieval and encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = staged(docs, f"stage-{number}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {}
