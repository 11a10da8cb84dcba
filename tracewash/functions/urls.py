"""Tracking parameters in URLs, as column expressions.

Parsing covers http and https; anything else is an invalid URL and gives null
parts.  Everything here is a narrow projection: no shuffle, no user function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dictionaries import HIGH_PARAMS, MEDIUM_PARAMS, PRESERVED, SUSPECT_KEYS, SUSPECT_LENGTH, SUSPECT_VALUE, TRACKERS

#: scheme, host, path, query, fragment
URL = r"^\s*([hH][tT][tT][pP][sS]?)://(?:[^/?#@]*@)?([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?\s*$"
IN_TEXT = r"""(?i)https?://[^\s<>"{}|\\^`\[\]]+"""


def valid(url: Column) -> Column:
    return F.coalesce(F.regexp_like(url, F.lit(URL)), F.lit(False))


def part(url: Column, number: int) -> Column:
    return F.when(valid(url), F.regexp_extract(url, URL, number))


def host(url: Column) -> Column:
    """Lower case, without the scheme's own port."""
    own = F.when(F.lower(part(url, 1)) == "https", F.regexp_replace(part(url, 2), ":443$", "")).otherwise(F.regexp_replace(part(url, 2), ":80$", ""))
    return F.lower(own)


def path(url: Column) -> Column:
    return F.when(part(url, 3) == "", "/").otherwise(part(url, 3))


def decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def params(query: Column) -> Column:
    """``(pos, name, value)`` in order, duplicates kept; ``query`` starts with ? or #."""
    pairs = F.filter(F.split(F.substring(query, 2, 2**31 - 1), "&"), lambda p: p != "")
    cut = lambda p: F.instr(p, F.lit("="))
    name = lambda p: F.when(cut(p) > 0, F.substring_index(p, "=", 1)).otherwise(p)
    value = lambda p: F.when(cut(p) > 0, p.substr(cut(p) + 1, F.length(p))).otherwise("")
    return F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), decoded(name(p)).alias("name"), decoded(value(p)).alias("value")))


def platform(name: Column, value: Column) -> Column:
    """The first platform whose list has the key, ``unknown`` for a suspect, else null."""
    key = F.lower(name)
    out = F.when(key.isin(*PRESERVED), F.lit(None).cast("string"))
    for known, listed in TRACKERS.items():
        exact = [p for p in listed if not p.endswith("*")]
        hit = key.isin(*exact)
        for p in listed:
            if p.endswith("*"):
                hit = hit | key.startswith(p[:-1])
        out = out.when(hit, known)
    return out.when(key.rlike("|".join(SUSPECT_KEYS)) | (F.length(value) > SUSPECT_LENGTH) & value.rlike(SUSPECT_VALUE), "unknown")


def param_risk(name: Column, known: Column) -> Column:
    key = F.lower(name)
    listed = F.when(key.isin(*HIGH_PARAMS), "high").when(key.isin(*MEDIUM_PARAMS), "medium").otherwise("low")
    return F.when(known == "unknown", "low").when(known.isNotNull(), listed)


def classified(query: Column) -> Column:
    def one(p):
        known = platform(p["name"], p["value"])
        return F.struct(
            p["pos"].alias("pos"),
            p["name"].alias("name"),
            p["value"].alias("value"),
            known.alias("platform"),
            F.when(known == "unknown", "suspected").when(known.isNotNull(), "tracking").alias("category"),
            param_risk(p["name"], known).alias("risk"),
        )

    return F.transform(params(query), one)


def shortened(value: Column, most: int = 30) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(F.coalesce(value, F.lit("")))


def cleaned(url: Column, kept: Column, preserve_hash: bool = False) -> Column:
    """The URL with only ``kept`` of its parameters, encoded as a form."""
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    out = F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    if preserve_hash:
        out = F.concat(out, F.when(F.instr(part(url, 5), F.lit("=")) == 0, part(url, 5)).otherwise(""))
    return out


def clean_url(url: Column, remove_all: bool = True, preserve_hash: bool = False, aggressive: bool = False) -> Column:
    """``struct(success, cleaned, removed, removed_count, size_saved)``.

    With ``remove_all`` known and suspected trackers go; without it
    ``aggressive`` removes the suspected ones only.  An invalid URL has no
    success and null parts.
    """
    every = classified(part(url, 4))
    goes = lambda p: F.coalesce(p["category"].isNotNull() if remove_all else (p["category"] == "suspected") & F.lit(aggressive), F.lit(False))
    out = cleaned(url, F.filter(every, lambda p: ~goes(p)), preserve_hash)
    removed = F.filter(every, goes)
    return F.struct(
        valid(url).alias("success"),
        out.alias("cleaned"),
        removed.alias("removed"),
        F.size(removed).alias("removed_count"),
        (F.length(url) - F.length(out)).alias("size_saved"),
    )


def analyzed(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with the analysis and privacy report of a URL column."""
    c = F.col(url)
    weight = lambda p: F.when(p["risk"] == "high", 3).when(p["risk"] == "medium", 2).otherwise(1)
    df = df.withColumn("_all", classified(part(c, 4))).withColumn("_hash", F.when(F.instr(part(c, 5), F.lit("=")) > 0, classified(part(c, 5))))
    df = df.withColumn("_tracking", F.filter("_all", lambda p: p["category"].isNotNull()))
    n_hash = F.size(F.filter(F.coalesce("_hash", F.array()), lambda p: p["category"].isNotNull()))
    score = F.aggregate("_tracking", F.lit(0), lambda n, p: n + weight(p)) + n_hash
    return df.select(
        *(x for x in df.columns if not x.startswith("_")),
        host(c).alias("domain"),
        path(c).alias("path"),
        F.when(valid(c), F.size("_tracking")).alias("n_tracking"),
        F.when(valid(c), F.size("_all") - F.size("_tracking")).alias("n_preserved"),
        F.when(valid(c), n_hash).alias("n_hash"),
        F.when(valid(c), score).alias("risk_score"),
        F.when(valid(c), F.when(score > 5, "high").when(score > 2, "medium").otherwise("low")).alias("risk_level"),
        F.when(valid(c), F.array_join(F.array_sort(F.array_distinct(F.transform("_tracking", lambda p: p["platform"]))), ",")).alias("platforms"),
        F.coalesce(F.size("_tracking") > 0, F.lit(False)).alias("has_tracking"),
    )


def exploded(df: DataFrame, url: str = "url") -> DataFrame:
    """A row for each parameter of query and fragment, classified."""
    c = F.col(url)
    sections = F.array(
        F.struct(F.lit("query").alias("section"), classified(part(c, 4)).alias("found")),
        F.struct(F.lit("hash").alias("section"), F.when(F.instr(part(c, 5), F.lit("=")) > 0, classified(part(c, 5))).alias("found")),
    )
    keys = df.columns
    rows = df.where(valid(c)).withColumn("_s", F.explode(sections)).select(*keys, "_s.section", F.explode("_s.found").alias("_p"))
    return rows.select(*keys, "section", "_p.pos", "_p.name", shortened(F.col("_p.value")).alias("value"), "_p.category", "_p.platform", "_p.risk")


def clean_text(text: Column, **options) -> Column:
    """``struct(found, cleaned_urls, text)``: URLs in a text cleaned in place.

    Each URL that loses something replaces its first occurrence.
    """
    found = F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0))

    def step(acc, url):
        c = clean_url(url, **options)
        changed = F.coalesce(c["success"] & (c["removed_count"] > 0), F.lit(False))
        at = F.instr(acc["text"], url)
        new = F.concat(acc["text"].substr(F.lit(1), at - 1), c["cleaned"], acc["text"].substr(at + F.length(url), F.length(acc["text"])))
        return F.struct(F.when(changed & (at > 0), new).otherwise(acc["text"]).alias("text"), (acc["n"] + changed.cast("int")).alias("n"))

    done = F.aggregate(found, F.struct(text.alias("text"), F.lit(0).alias("n")), step)
    return F.struct(F.size(found).alias("found"), done["n"].alias("cleaned_urls"), done["text"].alias("text"))


def known_trackers(spark: SparkSession) -> DataFrame:
    rows = [(p, k) for k, listed in TRACKERS.items() for p in listed]
    return spark.createDataFrame(rows, "param string, platform string")
