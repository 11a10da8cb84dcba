"""Screenshots by file name, resolution, software and maker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import DESKTOP, IPAD, IPHONE, OTHER_SCREENS, PHONE_MAKERS, SHOT_NAMES, SHOT_SOFTWARE

SLACK = 10


def _any(sizes, test) -> Column:
    out = F.lit(False)
    for w, h in sizes:
        out = out | test(w, h) | test(h, w)
    return out


def is_screen(width: Column, height: Column) -> Column:
    """A known screen either way up, ten pixels more or less."""
    near = lambda w, h: (F.abs(width - w) <= SLACK) & (F.abs(height - h) <= SLACK)
    return F.coalesce(_any([*IPHONE, *IPAD, *DESKTOP, *OTHER_SCREENS], near), F.lit(False))


def platform(width: Column, height: Column) -> Column:
    same = lambda w, h: (width == w) & (height == h)
    return F.when(_any(IPHONE, same), "iPhone").when(_any(IPAD, same), "iPad").when(_any(DESKTOP, same), "Desktop").otherwise("Android")


def detect(files: DataFrame) -> DataFrame:
    """``files`` with verdict, confidence, reasons and platform.

    Needs ``name, width, height, software, make, model``; any may be null.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    by_name = low("name").rlike("|".join(SHOT_NAMES))
    by_size = is_screen(F.col("width"), F.col("height"))
    by_software = low("software").rlike(SHOT_SOFTWARE)
    by_maker = low("make").rlike("|".join(PHONE_MAKERS)) | low("model").rlike("|".join(PHONE_MAKERS))
    points = by_name.cast("int") * 40 + by_size.cast("int") * 30 + by_software.cast("int") * 30 + by_maker.cast("int") * 20
    reasons = [F.when(c, n) for c, n in ((by_name, "filename_pattern"), (by_size, "phone_resolution"), (by_software, "software_tag"), (by_maker, "phone_manufacturer"))]
    out = files.withColumns({"confidence": points, "reasons": F.concat_ws(",", *reasons), "platform": F.when(by_size, platform(F.col("width"), F.col("height")))})
    return out.withColumn("is_screenshot", F.col("confidence") >= 40)


def recommendations(shots: DataFrame) -> DataFrame:
    """What to remove from each screenshot, as names."""
    apple = F.col("platform").isin("iPhone", "iPad")
    names = F.array_compact(F.array(F.lit("device"), F.lit("timestamp"), F.lit("screen"), F.when(apple, "apple")))
    return shots.where("is_screenshot").select("file_id", F.concat_ws(",", names).alias("recommendations"))


#: What is said of each part that goes.
SAID = {
    "device": ("Device", "maker and model of the phone or computer go"),
    "timestamp": ("Time", "day and hour of the screenshot go"),
    "screen": ("Screen", "its resolution and the program's name go"),
    "apple": ("Apple", "what iOS and iPadOS add goes"),
}


def recommendation_rows(shots: DataFrame) -> DataFrame:
    """``file_id, ord, part, title, said``: a row for each part to remove."""
    parts = F.posexplode(F.split("recommendations", ",")).alias("ord", "part")
    told = lambda k: F.create_map(*(F.lit(x) for part, texts in SAID.items() for x in (part, texts[k])))[F.col("part")]
    return recommendations(shots).select("file_id", parts).withColumns({"title": told(0), "said": told(1)})


def warnings(found: DataFrame) -> DataFrame:
    """``file_id, kind, value, risk``: makers of phones and times in files described by ``from_items``."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    makers = "|".join(PHONE_MAKERS)
    device = found.where(low("make").rlike(makers) | low("model").rlike(makers)).select("file_id", F.lit("device").alias("kind"), F.trim(F.concat_ws(" ", low("make"), low("model"))).alias("value"), F.lit("medium").alias("risk"))
    return device.union(found.where("taken is not null").select("file_id", F.lit("datetime"), "taken", F.lit("low")))


def from_items(items: DataFrame, names: DataFrame) -> DataFrame:
    """Inputs of ``detect`` from items: the first item of each field counts."""
    key = F.lower(F.col("field"))
    first = lambda hit: F.min_by(F.col("value"), F.when(hit, F.col("ord")))
    whole = lambda c: F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("int")
    width, height = key.contains("width") | (key == "pixelxdimension"), key.contains("height") | (key == "pixelydimension")
    found = items.groupBy("file_id").agg(
        whole(first(width)).alias("width"), whole(first(height)).alias("height"), first(key == "software").alias("software"), first(key == "make").alias("make"), first(key == "model").alias("model"), first((key.contains("date") | key.contains("time") & ~key.contains("exposure")) & F.col("value").isNotNull()).alias("taken")
    )
    return names.join(found, "file_id", "left")
