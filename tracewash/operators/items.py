"""Metadata items in long form: risk, category, order, scores, coordinates.

An item is ``file_id, ord, field, value, risk``; ``ord`` is its place in the
file.  Operators aggregate by ``file_id`` and keep nothing wider than an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import CATEGORIES, EXIF_RISK, LEVELS, OFFICE_RISK, PDF_RISK, SELECTABLE, SELECTED, WEIGHTS


def field_name(df: DataFrame) -> Column:
    """The first of key, label, name and field that the table has, lower case."""
    own = [F.col(c) for c in ("key", "label", "name", "field") if c in df.columns]
    return F.lower(F.coalesce(*own, F.lit("")))


def exif_risk(field: Column) -> Column:
    return F.when(field.isin(*EXIF_RISK["high"]), "high").when(field.isin(*EXIF_RISK["medium"]), "medium").otherwise("low")


def pdf_risk(field: Column) -> Column:
    return F.when(field.isin(*PDF_RISK["high"]), "high").when(field.isin(*PDF_RISK["medium"]), "medium").otherwise("low")


def office_risk(field: Column) -> Column:
    key, out = F.lower(field), None
    for risk, names in OFFICE_RISK.items():
        hit = key.rlike("|".join(n.lower() for n in names))
        out = F.when(hit, risk) if out is None else out.when(hit, risk)
    return out.otherwise("low")


def keyword_risk(keyword: Column) -> Column:
    """Risk of a text chunk by its keyword."""
    return F.when(keyword.rlike("GPS|Location|Author|Creator|Comment"), "high").when(keyword.rlike("Software|Date|Time|Description"), "medium").otherwise("low")


def category(field: Column) -> Column:
    key, out = F.lower(F.coalesce(field, F.lit(""))), None
    for name, parts in CATEGORIES.items():
        hit = key.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("technical")


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "critical", 0).when(risk == "high", 1).when(risk == "medium", 2).otherwise(3)


def sorted_items(items: DataFrame) -> DataFrame:
    """Items with ``place``: by risk within the file, stable by ``ord``."""
    from pyspark.sql import Window as W

    return items.withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy(risk_rank(F.col("risk")), "ord")))


def weight(risk: Column, compat: bool = False) -> Column:
    """Critical weighs as much as high; ``compat`` gives it the lowest weight."""
    out = F.when(risk == "high", WEIGHTS["high"]).when(risk == "medium", WEIGHTS["medium"])
    return (out if compat else out.when(risk == "critical", WEIGHTS["high"])).otherwise(WEIGHTS["low"])


def level(score: Column) -> Column:
    out = None
    for name, least in LEVELS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("low")


def file_risk(items: DataFrame, compat: bool = False) -> DataFrame:
    """Counts by risk, score and level of every file."""
    count = lambda r: F.count_if(F.col("risk") == r).alias(f"n_{r}")
    out = items.groupBy("file_id").agg(F.count("*").alias("n_items"), *(count(r) for r in ("critical", "high", "medium", "low")), F.least(F.sum(weight(F.col("risk"), compat)), F.lit(100)).alias("score"))
    return out.withColumn("level", level(F.col("score")))


def with_screenshot_floor(risk: DataFrame, shots: DataFrame) -> DataFrame:
    """A screenshot scores 60 at least."""
    out = risk.join(shots.select("file_id", "is_screenshot"), "file_id", "left")
    score = F.when(F.col("is_screenshot"), F.greatest("score", F.lit(60))).otherwise(F.col("score"))
    return out.withColumn("score", score).withColumn("level", level(F.col("score")))


def category_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("file_id", category(F.col("field")).alias("category")).agg(F.count("*").alias("n"))


def coordinate(value: Column) -> Column:
    """A decimal or ``d° m' s"`` coordinate; zero is a place like any other."""
    dms = r"(\d+)[°]\s*(\d+)[']\s*([\d.]+)"
    piece = lambda n: F.regexp_extract(value, dms, n).try_cast("double")
    plain = F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return F.when(value.rlike(dms), piece(1) + piece(2) / 60 + piece(3) / 3600).otherwise(plain)


def gps_points(items: DataFrame) -> DataFrame:
    """``file_id, lat, lon`` by the last latitude and longitude of a file."""
    key = F.lower(F.col("field"))
    found = lambda word: F.max_by(coordinate(F.col("value")), F.when(key.contains(word) & ~key.contains("ref"), F.col("ord")))
    place = items.where(key.rlike("latitude|longitude")).groupBy("file_id").agg(found("latitude").alias("lat"), found("longitude").alias("lon"))
    return place.where("lat is not null and lon is not null")


def selected_tags(categories=SELECTED) -> list[str]:
    return list(dict.fromkeys(t for c in categories for t in SELECTABLE[c]))


def selective(items: DataFrame, categories=SELECTED) -> DataFrame:
    """Items with ``removed``: whether selective cleaning takes the tag."""
    return items.withColumn("removed", F.coalesce(F.col("field").isin(selected_tags(categories)), F.lit(False)))


def report_rows(items: DataFrame) -> DataFrame:
    """What a report shows: items above low risk, values cut to 100 characters."""
    return items.where("risk <> 'low'").select("file_id", "ord", "field", "risk", F.substring("value", 1, 100).alias("value"))
