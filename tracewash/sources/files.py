"""Files as rows: scans and kinds of files; `streaming` has them as they arrive."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import ADDED

# File kinds in order of precedence, by MIME type and by ending.
KINDS = (
    ("jpeg", "image/jpe?g", "jpe?g"),
    ("png", "image/png", "png"),
    ("webp", "image/webp", "webp"),
    ("svg", r"image/svg\+xml", "svg"),
    ("gif", "image/gif", "gif"),
    ("eml", "message/rfc822", "eml|msg"),
    ("heic", "image/hei[cf]", "hei[cf]"),
    ("tiff", "image/tiff", "tiff?"),
    ("pdf", "application/pdf", "pdf"),
    ("office", r"application/vnd\.openxmlformats-officedocument\..*", "docx|xlsx|pptx"),
    ("video", "video/(mp4|quicktime|x-m4v|3gpp2?)", "mp4|mov|m4v|3gp|3g2"),
    ("audio", "audio/(mpeg|mp3|wav|x-wav|wave|mp4|x-m4a|aac|ogg|flac|x-flac)", "mp3|wav|wave|m4a|aac|ogg|oga|flac"),
)
#: First bytes, in hexadecimal, that each kind may start with.
MAGIC = {"jpeg": "FFD8", "png": "89504E470D0A1A0A", "webp": "52494646", "gif": "47494638", "tiff": "49492A00|4D4D002A", "pdf": "25504446", "office": "504B"}


def file_type(name: Column, mime: Column | None = None) -> Column:
    """The first kind whose MIME type or ending fits, else ``unknown``."""
    low, kind = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime if mime is not None else F.lit(None).cast("string"), F.lit("")))
    out = None
    for k, types, endings in (*KINDS, *((f.kind, f.mime, f.endings) for f in ADDED.values())):
        hit = kind.rlike(f"^({types})$") | low.rlike(rf"\.({endings})$")
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise("unknown")


def starts() -> dict[str, str]:
    """First bytes by kind, as in ``MAGIC``, with those of formats that were added."""
    return MAGIC | {f.kind: f.magic for f in ADDED.values() if f.magic}


def magic_error(kind: str | None, content: bytes | None, known: dict[str, str]) -> str | None:
    """``NOT_<KIND>`` where the content does not start as its kind does."""
    start = known.get(kind)
    if start is None or content is None:
        return None
    head = content[: max(map(len, start.split("|"))) // 2].hex().upper()
    return None if re.match(f"(?:{start})", head) else f"NOT_{kind.upper()}"


def described(raw: DataFrame, *more: str) -> DataFrame:
    """``file_id, path, name, file_type, size, content`` from binary file rows."""
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\+", "%2B"))
    return raw.select(F.sha2("path", 256).substr(1, 16).alias("file_id"), "path", name.alias("name"), file_type(name).alias("file_type"), F.col("length").alias("size"), "content", *more)


def scan(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int = 512 * 2**20) -> DataFrame:
    """All files below ``path``; the size limit is pushed to the scan, so that
    larger files are never read.  Use ``rejects`` to see those.  Spark's file
    scans pass over empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return described((reader.option("pathGlobFilter", glob) if glob else reader).load(path).where(F.col("length") <= most_bytes))


def rejects(spark: SparkSession, path: str, most_bytes: int = 512 * 2**20) -> DataFrame:
    """Files that are too large or of no known kind; their content is not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = described(raw).drop("content")
    error = F.when(F.col("size") > most_bytes, "TOO_LARGE").when(F.col("file_type") == "unknown", "UNKNOWN_TYPE")
    return out.withColumn("error_code", error).where("error_code is not null")
