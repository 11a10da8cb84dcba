"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, cut, shared_folder  # noqa: F401

#: Separators of words: blank and the five ASCII control blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of words; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def buckets(rows: int, each: int = 50_000, least: int = 64) -> int:
    """How many buckets keep about ``each`` rows in one bucket."""
    return max(least, -(-rows // each))


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The ``used`` columns, and each whole row in ``_row``.

    What an operator adds then never clashes with a column of the input.
    """
    return docs.select(*used, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
