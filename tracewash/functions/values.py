"""Scalar expressions on values: sizes, escapes, names, coordinates, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import EARTH_KM


def human_size(n: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``2.25 MB``."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0))
        .when(n.isNotNull(), F.format_string("%.2f MB", n / 1048576.0))
    )


def escaped(text: Column) -> Column:
    """The five characters of HTML as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_name(name: Column, prefix: str = "clean_") -> Column:
    """Name of the cleaned file; a HEIC file comes out as JPEG."""
    return F.concat(F.lit(prefix), F.regexp_replace(name, r"(?i)\.hei[cf]$", ".jpg"))


def redacted_name(name: Column) -> Column:
    return F.when(name.rlike(r"\.[^.]+$"), F.regexp_replace(name, r"(\.[^.]+)$", "_redacted$1")).otherwise(F.concat(name, F.lit("_redacted")))


def neutral_name(millis: Column, name: Column, prefix: str = "shared_") -> Column:
    """A name that tells only a time, in base 36, and the file's ending."""
    return F.concat(F.lit(prefix), F.lower(F.conv(millis.cast("string"), 10, 36)), F.lit("."), F.lower(F.regexp_extract(name, r"([^.]*)$", 1)))


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    sign = F.when(F.upper(ref).isin("S", "W"), -1.0).otherwise(1.0)
    return (d + m / 60.0 + s / 3600.0) * sign


def decimal_to_dms(value: Column) -> Column:
    """``struct(d, m, s100)``: degrees, minutes, hundredths of seconds."""
    a = F.abs(value)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = F.round(((a - d) * 60 - m) * 60 * 100)
    return F.struct(d.cast("int").alias("d"), m.cast("int").alias("m"), s.cast("int").alias("s100"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = F.radians
    h = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def wrapped_base64(value: Column, width: int = 76) -> Column:
    plain = F.regexp_replace(F.base64(value), r"[\r\n]", "")
    return F.regexp_replace(plain, f"(.{{{width}}})(?=.)", "$1\r\n")
