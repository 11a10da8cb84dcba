"""From files to metadata items.

``with_parts`` runs the walkers in Arrow batches and keeps their rows beside the
content, so that neither is shuffled.  Where ``content`` holds what a file is
opened by, it is opened in the task that walks it and its bytes never leave it.  What a part is called and how risky it is
are column expressions over those rows; ``cleaning`` has those on what goes.

A file that can't be walked to its end gets an ``error_code``; no file fails the
job.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.items import category, exif_risk, keyword_risk, office_risk, pdf_risk
from .files import magic_error, starts
from .names import EMBEDDED, ENDINGS, ESSENTIAL_HEADERS, KEPT_CHUNKS, KEPT_IN_WAV, KEPT_IN_WEBP, LABELLED, LABELS, MORE_HEADERS, SCANNERS, SENSITIVE_HEADERS
from .registry import ADDED, walkers_by_kind

#: Files whose parts go on to Spark at once.
BATCH = 1024
PART = "struct<ord:int,kind:string,key:string,start:int,end:int,text:string>"

# Risky names of sound and film, of GIF applications and of TIFF.
ID3_HIGH, ID3_MEDIUM = ("TENC", "TSSE", "TXXX", "PRIV", "GEOB", "WOAR", "WOAS"), ("TPE1", "TPE2", "TCOM", "COMM", "TCOP", "TPUB")
WAV_HIGH, WAV_MEDIUM = ("IENG", "ISFT", "ITCH"), ("IART", "ICMT", "ICOP")
VORBIS_HIGH, VORBIS_MEDIUM = ("VENDOR", "ENCODER", "ENCODED-BY"), ("ARTIST", "COMMENT", "COPYRIGHT")
MP4_HIGH = ("©xyz", "©too", "©enc", "auth", "©ART", "©wrt")
GIF_APPS = "XMP Data|ICCRGBG1|ADOBE:IR|ImageMagick|MGK8BIM0000|Adobe|Photoshop"
TIFF_HIGH = ("Make", "Model", "MakerNote")


def _walked_type() -> Column:
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return F.when(F.col("file_type") == "audio", ending).otherwise(F.col("file_type"))


def walking():
    """A function of ``(file_type, walked, content)`` that gives the parts of a file and its error, for use in tasks."""
    from . import walkers

    known, first = walkers_by_kind(), starts()

    def walk(file_type: str | None, walked: str | None, content: bytes | None) -> tuple[list, str | None]:
        walker, error, parts = known.get(walked), magic_error(file_type, content, first), []
        if walker and not error:
            try:
                for part in walker(content or b""):
                    parts.append(part)
            except Exception as e:  # a damaged file keeps the parts found so far
                error = f"DAMAGED: {e if isinstance(e, walkers.Damaged) else type(e).__name__}"
        return parts, error

    return walk


def part_lists(found: list[list[tuple]]) -> pa.Array:
    """Parts of files, as walkers give them, as lists of ``PART``."""
    offsets = [0]
    for parts in found:
        offsets.append(offsets[-1] + len(parts))
    columns = list(zip(*(p for parts in found for p in parts))) or [[]] * 5
    ords = pa.array([n for parts in found for n in range(len(parts))], pa.int32())
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    rows = pa.StructArray.from_arrays([ords, *map(pa.array, columns, kinds)], ["ord", "kind", "key", "start", "end", "text"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def with_parts(files: DataFrame, opened: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """``files`` with ``parts`` and ``error_code``; ``opened`` gives a file's bytes where ``content`` holds what it is opened by."""
    files = files.withColumn("walked", _walked_type()).withColumn("error_code", F.lit(None).cast("string"))
    columns = files.columns
    at = {c: columns.index(c) for c in ("file_type", "walked", "content", "error_code")}
    schema = T.StructType([*files.schema.fields, T.StructField("parts", T.DataType.fromDDL(f"array<{PART}>"))])
    walk = walking()

    def run(batches):
        for whole in batches:  # Spark bounds a batch by its bytes
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                errors, found = [], []
                types = (batch.column(at[c]).to_pylist() for c in ("file_type", "walked"))
                for file_type, walked, content in zip(*types, batch.column(at["content"])):  # one file's bytes at a time
                    content = content.as_py()
                    parts, error = walk(file_type, walked, opened(content) if opened else content)
                    errors.append(error)
                    found.append(parts)
                data = [*batch.columns, part_lists(found)]
                data[at["error_code"]] = pa.array(errors, pa.string())
                yield pa.RecordBatch.from_arrays(data, [*columns, "parts"])

    return files.mapInArrow(run, schema)


def _listed(key: Column, high, medium=()) -> Column:
    return F.when(key.isin(list(high)), "high").when(key.isin(list(medium)), "medium").otherwise("low")


def _mail_risk(low: Column) -> Column:
    return (
        F.when(low == "x-originating-ip", "critical")
        .when(low.isin("x-mailer", "user-agent", "message-id"), "medium")
        .when(sensitive(low), "high")
        .when(low.isin("from", "to", "cc", "subject", "date"), "low")
    )


def sensitive(low: Column) -> Column:
    """Whether a header of mail, in lower case, goes."""
    return ~low.isin(*ESSENTIAL_HEADERS) & low.rlike("|".join((*SENSITIVE_HEADERS, *MORE_HEADERS)))


def _risk(walked: Column, p: Column) -> Column:
    """Risk of a part, null for structure that is no metadata."""
    kind, key, text = p["kind"], p["key"], p["text"]
    exif = F.when(kind.isin("0th", "1st", "Sub", "Exif", "GPS", "Interop") & text.isNotNull(), exif_risk(key))
    svg_risk = {"rdf": "high", "script": "high", "attribute": "high", "namespace": "medium", "editor": "medium", "metadata": "medium", "embedded": "medium", "license": "low", "title": "low", "desc": "medium", "instruction": "medium"}
    svg = F.when((kind == "attribute") & key.rlike("^(inkscape|sodipodi):") & ~key.isin("inkscape:version", "sodipodi:docname"), "medium")
    svg = svg.when(kind == "dc", F.when(key.isin("dc:creator", "dc:rights"), "high").otherwise("medium")).when((kind == "comment") & (F.length(text) > 5), "medium")
    for k, r in svg_risk.items():
        svg = svg.when(kind == k, r)
    out = (
        F.when(kind == "technical", F.when(key.isin("UnreadableEXIF"), "medium").otherwise("low"))
        .when(kind == "trailing", "medium")
        .when(walked == "png", F.when(kind.isin("tEXt", "zTXt", "iTXt"), keyword_risk(key)).when(kind == "iCCP", "medium").when(kind.isin("eXIf"), "high").when(kind.isin("tIME"), "medium").when(kind == "IHDR", "low").when(~kind.isin(*KEPT_CHUNKS), "medium"))
        .when(walked == "webp", F.when(kind.isin("EXIF", "XMP "), "high").when(kind == "ICCP", "medium").when(kind == "VP8X", "low").when((kind == "in frame") & ~key.isin(*KEPT_IN_WEBP) | ~kind.isin("in frame", *KEPT_IN_WEBP), "medium"))
        .when(walked == "gif", F.when(kind == "comment", "high").when(kind == "plain", "medium").when(kind == "application", F.when(key.startswith("NETSCAPE"), "low").when(key.rlike(GIF_APPS), "high").otherwise("medium")).when(kind == "screen", "low").when(kind == "extension", "medium"))
        .when(walked == "tiff", F.when(kind.isin("directory", "gap"), None).when((kind == "GPS") | (kind == "pointer") & (key == "GPS"), "critical").when((kind == "pointer") & (key == "Sub"), "low").when((kind == "pointer") | key.isin(*TIFF_HIGH), "high").otherwise(exif))
        .when(walked == "jpeg", F.when(key.isin("XMP", "IPTC"), "high").when(key.isin("ICC", "comment"), "medium").when((kind == "1st") & (key == "JPEGInterchangeFormat"), "medium").when(key == "frame", "low").when(kind.rlike("^E[3-9A-CF]$"), "medium").otherwise(exif))
        .when(walked.isin("mp3", "aac"), F.when(kind == "frame", _listed(key, ID3_HIGH, ID3_MEDIUM)).when(kind == "tag", F.when(key.isin("Artist", "Comment"), "medium").otherwise("low")).when(kind.isin("APE", "Lyrics3"), "medium"))
        .when(walked.isin("wav", "wave"), F.when(kind == "INFO", _listed(key, WAV_HIGH, WAV_MEDIUM)).when(kind == "fmt ", "low").when(kind.isin("bext", "iXML", "id3 "), "high").when(~kind.isin("LIST", "INFO", *KEPT_IN_WAV), "medium"))
        .when(walked.isin("flac", "ogg", "oga"), F.when(kind == "comment", _listed(key, VORBIS_HIGH, VORBIS_MEDIUM)).when(kind.isin("picture", "application", "block"), "medium").when(kind == "tag", "medium").when(kind == "frame", _listed(key, ID3_HIGH, ID3_MEDIUM)))
        .when(walked.isin("video", "m4a"), F.when(kind == "place", "high").when(key == "mvhd", F.when(text.try_cast("long") > 0, "high")).when((kind == "udta") & text.isNotNull(), _listed(key, MP4_HIGH)).when(kind == "ilst", _listed(key, ["©too", "©enc"], ["©ART", "©cmt", "cprt"])).when((kind == "samples"), "high").when((key == "uuid") & ~kind.isin("stsd"), "medium"))
        .when(walked == "heic", F.when((kind == "marker") & (key == "GPS"), "critical").when((kind == "marker") | (key == "meta"), "high").when(key == "ftyp", "low"))
        .when(walked == "office", F.when(kind == "media", "medium").otherwise(office_risk(key)))
        .when(walked == "eml", F.when(kind == "header", _mail_risk(F.lower(key))).when(kind == "attachment", F.when(key.isin(*EMBEDDED) | F.lower(F.regexp_extract(text, r"\.([^.]+)$", 1)).isin(*ENDINGS), "medium").otherwise("high")))
        .when(walked == "svg", svg)
        .when(walked == "pdf", F.when(kind == "info", pdf_risk(key)).when(kind.isin("page", "xmp"), "high"))
    )
    for f in ADDED.values():
        out = out.when(walked == f.kind, f.risk(p) if f.risk else F.lit(None))
    return out


def label(walked: Column, field: Column) -> Column:
    """The name to show for a field."""
    out = None
    for kind, table in LABELLED.items():
        names = F.create_map(*(F.lit(x) for pair in LABELS[table].items() for x in pair))
        out = F.when(walked == kind, names[field]) if out is None else out.when(walked == kind, names[field])
    return F.coalesce(out, field)


def items(walked_files: DataFrame) -> DataFrame:
    """``file_id, ord, field, label, value, risk, category, src`` from parts.

    Values are whole.  JPEG files that look scanned or printed get one more
    item, ``PrinterTracking``.
    """
    judged = F.transform(F.concat("parts", _printed()), lambda p: F.struct(p.alias("part"), _item_risk(p).alias("risk")))
    p = F.col("i.part")
    # The rules as one expression of a row make a method too long to be compiled; over an array they are judged once and not inlined.
    rows = walked_files.select("file_id", "walked", F.explode(F.filter(judged, lambda i: i["risk"].isNotNull())).alias("i"))
    field = F.when(p["key"] != "", p["key"]).otherwise(p["kind"])
    return rows.select("file_id", p["ord"].alias("ord"), field.alias("field"), label(F.col("walked"), field).alias("label"), _value(p).alias("value"), F.col("i.risk").alias("risk"), category(field).alias("category"), p["kind"].alias("src"))


def _item_risk(p: Column) -> Column:
    return F.when(p["kind"] == "warning", "high").otherwise(_risk(F.col("walked"), p))


def _value(p: Column) -> Column:
    ip = F.regexp_extract(p["text"], r"\[(\d{1,3}(?:\.\d{1,3}){3})\]", 1)
    return (
        F.when(p["key"] == "mvhd", F.timestamp_seconds(p["text"].try_cast("long") - 2082844800).cast("string"))
        .when((p["kind"] == "header") & (F.lower(p["key"]) == "received") & (ip != ""), ip)
        .when(p["kind"] != "embedded", p["text"])
    )


def risks_left(telling: Callable[[Column, Column], Column]) -> Column:
    """Risks of those items of a walked file of which ``telling(src, value)`` holds, without a row for each item."""
    rows = F.transform(F.concat("parts", _printed()), lambda p: F.struct(_item_risk(p).alias("risk"), p["kind"].alias("src"), _value(p).alias("value")))
    return F.transform(F.filter(rows, lambda i: i["risk"].isNotNull() & telling(i["src"], i["value"])), lambda i: i["risk"])


def _printed() -> Column:
    """One part more where a JPEG's software or its resolution and words point to a scanner or printer."""
    parts = F.filter("parts", lambda p: p["kind"].isin("0th", "1st", "Exif"))
    maker = F.exists(parts, lambda p: p["key"].isin("Software", "ProcessingSoftware") & F.lower(p["text"]).rlike("|".join(s.lower() for s in SCANNERS)))
    fine = F.exists(parts, lambda p: (p["kind"] == "0th") & (p["key"] == "XResolution") & (p["text"].try_cast("double") >= 300))
    said = F.exists(parts, lambda p: F.lower(p["text"]).rlike("scan|print"))
    part = F.from_json(F.lit('{"ord":-1,"kind":"warning","key":"PrinterTracking","start":0,"end":0,"text":"may be a scan or print with tracking dots"}'), PART)
    return F.when((F.col("walked") == "jpeg") & F.coalesce(maker | fine & said, F.lit(False)), F.array(part)).otherwise(F.array().cast(f"array<{PART}>"))


def attachment_counts(walked_files: DataFrame) -> DataFrame:
    """``file_id, n_attachments, n_embedded`` of mail, counted by its MIME parts."""
    count = lambda kind: F.size(F.filter("parts", lambda p: p["kind"] == kind))
    return walked_files.where("walked = 'eml'").select("file_id", count("attachment").alias("n_attachments"), count("embedded").alias("n_embedded"))
