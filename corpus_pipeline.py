"""Five stages from raw documents to token ids.

``STAGES`` lists them; each takes ``(spark, docs, sf_dir)`` and works on all
rows that its predecessor kept.  All but the last return the columns of
``documents``.  The last cannot be put in SQL, so ``ORACLE_SQL`` is None and
the tests hold the pipeline against a brute-force version.

Nulls, empty texts and ties follow the operators: texts without words are
rejected by the quality rules; of a group of near duplicates the document with
the smallest ``doc_id`` stays; rows that share a ``doc_id`` and differ in text
are documents of their own; documents that the mix takes twice come twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewash.llm import minhash, mixing, pieces, pii, quality
from tracewash.llm.common import cut, packed, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the threshold table rejects go."""
    return quality.judge(packed(docs, "doc_id", "text", "lang")).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity of 0.8.

    Of rows equal in ``doc_id`` and text one stays, the same in every run; rows
    without a ``doc_id`` and rows without words all stay.
    """
    main = minhash.near_duplicates(docs, width=5, percent=80).where("main and doc_id is not null and text_key is not null")
    main = main.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = packed(docs, F.col("doc_id").cast("long").alias("_id"), minhash.text_key().alias("_key"))
    whole = F.col("_id").isNull() | F.col("_key").isNull()
    once = rows.where(~whole).join(main.hint("merge"), ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return once.select("_row.*").unionByName(rows.where(whole).select("_row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced."""
    return pii.sanitise(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.curriculum(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
