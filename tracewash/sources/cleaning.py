"""From walked files to cleaned ones, and a search of those for what should be gone.

Which part of a file stays is a column expression over the rows of its walker: a
list of what a format needs, and all else goes.  A small pass over Arrow batches
then splices each file once.  Files inside files are rows of their own: level by
level they are taken out, walked and written, and level by level they are put
back, the innermost first, however kinds are mixed.

``verified`` does not rely on the walkers alone: it also searches the cleaned
bytes for the values and texts of all parts that went, in three encodings, and
for marks of containers that no cleaned file has.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import cut
from .metadata import PART, part_lists, risks_left, sensitive, walking, with_parts
from .names import IMAGE_TAGS, KEPT_BOXES, KEPT_CHUNKS, KEPT_IN_STSD, KEPT_IN_WAV, KEPT_IN_WEBP, KEPT_SEGMENTS, KEPT_TIFF
from .registry import ADDED
from .walkers import HOLDERS, SHOWN_TRACKS, boxes

#: Kinds that can be cleaned, and the error of those that can't.
CLEANED = ("png", "webp", "gif", "jpeg", "tiff", "mp3", "aac", "wav", "wave", "flac", "video", "m4a", "eml", "svg", "pdf", "office")
REFUSED = {"heic": "HEIC_DECODE_UNSUPPORTED", "ogg": "OGG_VORBIS_CLEAN_UNSUPPORTED", "oga": "OGG_VORBIS_CLEAN_UNSUPPORTED"}
NOTED = {"encrypted": "PDF_ENCRYPTED", "compressed": "PDF_COMPRESSED_INFO", "unknown": "UNKNOWN_PART"}
SOUND_TAGS = ("ID3v2", "ID3v1", "APE", "Lyrics3", "junk")
#: Bytes after which files that were taken out or cleaned go on to Spark, and their number.
LARGE, BATCH = 2**25, 1024
#: Files inside others that a task puts back.
EACH = 2_000
#: Patterns that are looked for one by one; an automaton pays for more.
FEW = 64
#: Kinds in which files lie; of a stored table others are not even read for those.
HOLDING = ("eml", "svg", "office")
#: How many files may lie in each other.
DEEPEST = 8

# The emptied property parts of Office packages.
EMPTIED = {
    "docProps/core.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"/>',
    "docProps/app.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"/>',
    "docProps/custom.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"/>',
}
# Marks of containers of metadata, which no cleaned file of the kind has.
MARKS = {
    "jpeg|png|webp|gif|tiff": (b"http://ns.adobe.com/", b"<x:xmpmeta", b"<?xpacket", b"<rdf:RDF", b"Photoshop 3.0\0", b"ICC_PROFILE\0", b"Exif\0\0II", b"Exif\0\0MM", b"jumbjumd"),
    "mp3|aac|wav|wave|flac": (b"APETAGEX", b"LYRICSBEGIN", b"<x:xmpmeta", b"<?xpacket"),
    "video|m4a": (bytes.fromhex("BE7ACFCB97A942E89C71999491E3AFAC"), b"<x:xmpmeta", b"<?xpacket", b"com.apple.quicktime."),
    "pdf": (b"<x:xmpmeta", b"<?xpacket"),
    "svg": (b"<x:xmpmeta", b"<?xpacket", b"<rdf:RDF", "<metadata".encode("utf-16-le"), "<metadata".encode("utf-16-be")),
}


def edit(walked: Column, p: Column) -> Column:
    """What is done to a part, null where it stays.

    ``drop`` takes it out, ``zero`` and ``blank`` overwrite it in place; the
    others keep what the format needs of it, see ``_replaced``.
    """
    kind, key, size = p["kind"], p["key"], p["end"] - p["start"]
    chunk = F.lit(False)
    for name, n in KEPT_CHUNKS.items():
        chunk = chunk | ((kind == name) if n is None else (kind == name) & (size == n + 12))
    inside = kind.isin("technical", "INFO", "in frame")
    loop = (kind == "application") & key.isin("NETSCAPE2.0", "ANIMEXTS1.0") & (size == 19)
    out = (
        F.when(kind == "trailing", "drop")
        .when(walked == "png", F.when(~chunk, "drop"))
        .when(walked == "webp", F.when(kind == "VP8X", "flags").when((kind == "in frame") & ~key.isin(*KEPT_IN_WEBP), "zero").when(~inside & ~kind.isin(*KEPT_IN_WEBP), "drop"))
        .when(walked == "gif", F.when(~kind.isin("screen", "technical", "frame", "control") & ~loop, "drop"))
        .when(walked == "jpeg", F.when(kind == "E0", "jfif").when(kind == "EE", "adobe").when(kind.rlike("^[0-9A-F]{2}$") & ~kind.isin(*KEPT_SEGMENTS), "drop"))
        .when(walked == "tiff", F.when((kind == "directory") & key.isin("0th", "1st", "Sub"), "directory").when(kind.isin("gap", "directory", "GPS", "Exif", "Interop") | kind.isin("0th", "1st", "Sub") & ~key.isin(*KEPT_TIFF), "zero"))
        .when(walked.isin("mp3", "aac"), F.when(kind.isin(*SOUND_TAGS), "drop"))
        .when(walked.isin("wav", "wave"), F.when(~inside & ~kind.isin(*KEPT_IN_WAV), "drop"))
        .when(walked == "flac", F.when(kind.isin(*SOUND_TAGS), "drop").when(kind.isin("padding", "application", "vorbis", "cuesheet", "picture", "block"), "zero"))
        .when(walked.isin("video", "m4a"), _film_edit(p))
        .when(walked == "eml", F.when(kind.isin("header", "part header") & sensitive(F.lower(key)), "drop"))
        .when(walked == "svg", F.when(kind.isin("comment", "metadata", "script", "editor", "namespace", "attribute", "instruction", "rdf", "dc", "license"), "drop"))
        .when(walked == "pdf", F.when(kind.isin("info", "xmp"), "blank").when(kind == "stream", "deflated"))
    )
    for f in ADDED.values():
        if f.edit:
            out = out.when(walked == f.kind, f.edit(p))
    return out


def _film_edit(p: Column) -> Column:
    kind, key = p["kind"], p["key"]
    named = (kind == "stsd") & key.isin("compressor", "junk")
    return (
        F.when(kind.isin("technical", "place"), None)
        .when(named | kind.isin("hdlr", "dref", "samples", "junk"), "zero")
        .when(kind == "stsd", F.when(~key.isin(*KEPT_IN_STSD), "free"))
        .when((key == "trak") & ~p["text"].isin(*SHOWN_TRACKS) | ~key.isin(*KEPT_BOXES), "drop")
        .when(key.isin("mvhd", "tkhd", "mdhd"), "times")
    )


_TIFF_NUMBERS = {n for n, name in IMAGE_TAGS.items() if name in KEPT_TIFF}


def _replaced(old: bytes, how: str) -> bytes:
    """What stands in place of a part."""
    if how == "drop":
        return b""
    if how in ("zero", "blank"):
        return (b"\0" if how == "zero" else b" ") * len(old)
    if how == "flags":  # a picture without colour profile, EXIF and XMP
        return old[:8] + bytes([old[8] & ~0x2C]) + old[9:]
    if how == "jfif":  # without a thumbnail
        return old[:2] + b"\0\x10" + old[4:16] + b"\0\0" if old[4:9] == b"JFIF\0" and len(old) >= 18 else b""
    if how == "adobe":  # how colours are to be read
        return old[:2] + b"\0\x0e" + old[4:16] if old[4:9] == b"Adobe" and len(old) >= 16 else b""
    if how == "free":
        return old[:4] + b"free" + bytes(len(old) - 8)
    if how == "times":
        n = 16 if old[8] == 1 else 8
        return old[:12] + bytes(n) + old[12 + n :]
    return _directory(old)


def _directory(old: bytes) -> bytes:
    """A TIFF directory with those entries alone that tell how to draw, and zeros for the rest."""
    order = "<" if struct.unpack("<H", old[:2])[0] * 12 + 2 in (len(old), len(old) - 4) else ">"
    count = struct.unpack(order + "H", old[:2])[0]
    entries = [old[2 + 12 * k : 14 + 12 * k] for k in range(count)]
    kept = [e for e in entries if struct.unpack(order + "H", e[:2])[0] in _TIFF_NUMBERS]
    return (struct.pack(order + "H", len(kept)) + b"".join(kept) + old[2 + 12 * count :]).ljust(len(old), b"\0")


def _film(content: bytes, edits) -> bytes:
    """A film with boxes taken out: sizes of what held them and places of samples follow.

    In a fragmented film places hang on each other in more ways, so what goes
    there is emptied where it stands.
    """
    b, drops, at = bytearray(content), [], 0
    fragments = any(kind == "moof" for kind, *_ in boxes(content, 0, len(content)))
    for start, end, how in edits:
        if start < at:
            continue
        if how == "drop" and not fragments:
            drops.append((start, end))
            at = end
        elif how != "times":
            b[start:end] = _replaced(content[start:end], "free" if how == "drop" else how)
            at = end if how in ("drop", "free") else at
        else:
            b[start:end] = _replaced(bytes(b[start:end]), how)
    if not drops:
        return bytes(b)
    starts = [x for x, _ in drops]
    gone = [0]
    for x, z in drops:
        gone.append(gone[-1] + z - x)
    before = lambda place: gone[bisect.bisect_left(starts, place)]
    todo = [(0, len(content))]
    while todo:
        for kind, start, body, end in boxes(content, *todo.pop()):
            if before(start + 1) - before(start):  # gone itself
                continue
            less = before(end) - before(start)
            if less and struct.unpack(">I", content[start : start + 4])[0] > 1:
                struct.pack_into(">I", b, start, end - start - less)
            elif less and body - start == 16:
                struct.pack_into(">Q", b, start + 8, end - start - less)
            if kind in ("stco", "co64"):
                code = ">%dI" if kind == "stco" else ">%dQ"
                code %= struct.unpack(">I", content[body + 4 : body + 8])[0]
                places = struct.unpack_from(code, content, body + 8)
                struct.pack_into(code, b, body + 8, *(x - before(x) for x in places))
            elif kind in HOLDERS:
                todo.append((body, end))
    pieces = [b[x:z] for x, z in zip([0, *(z for _, z in drops)], [*starts, len(b)])]
    return b"".join(pieces)


def _package(content: bytes, inner: dict[str, bytes]) -> bytes:
    """A package with emptied properties and what came back for its members, without their own times."""
    made = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as to:
        for name in z.namelist():
            new = inner.get(name)
            to.writestr(zipfile.ZipInfo(name), EMPTIED.get(name) or z.read(name) if new is None else new, zipfile.ZIP_DEFLATED)
    return made.getvalue()


def spliced(content: bytes, walked: str, edits, inner) -> bytes:
    """The cleaned file: ``edits`` of ``(start, end, how)``, and ``inner`` files as ``(start, end, text, new)``."""
    if walked == "office":
        return _package(content, {text: new for _, _, text, new in inner})
    if walked in ("video", "m4a"):
        return _film(content, sorted(edits))
    if any(how == "deflated" for _, _, how in edits):
        from .pdfs import emptied_streams

        content, edits = emptied_streams(content), [e for e in edits if e[2] != "deflated"]
    out, at = [], 0
    news = [(start, end, how, None) for start, end, how in edits] + [(start, end, "inner", _coded(new, text)) for start, end, text, new in inner]
    for start, end, how, new in sorted(news, key=lambda x: x[:3]):
        if start < at:  # inside one that went, goes with it
            at = max(at, end)
            continue
        out += [content[at:start], _replaced(content[start:end], how) if new is None else new]
        at = end
    whole = b"".join([*out, content[at:]])
    if walked in ("wav", "wave", "webp"):
        whole = whole[:4] + struct.pack("<I", len(whole) - 8) + whole[8:]
    return whole


def _coded(raw: bytes, how: str) -> bytes:
    """A file inside a text, as its transfer encoding writes it."""
    if how.startswith("base64"):
        text = base64.b64encode(raw)
        text = b"\r\n".join(text[k : k + 76] for k in range(0, len(text), 76))
        return text.decode().encode(how[7:] or "ascii")
    if how == "quoted-printable":
        return binascii.b2a_qp(raw, quotetabs=True, istext=False)
    return raw


def _decoded(raw: bytes, how: str) -> bytes:
    if how.startswith("base64"):
        raw = raw.decode(how[7:] or "latin-1").encode("latin-1", "ignore")
        raw = re.sub(rb"[^A-Za-z0-9+/]", b"", raw)
        return base64.b64decode(raw + b"=" * (-len(raw) % 4) if len(raw) % 4 != 1 else raw[:-1])
    return binascii.a2b_qp(raw) if how == "quoted-printable" else raw


def _taken_out(files: DataFrame, opened: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """The files inside ``files``: ``outer, slot, name, file_type, content``; one that does not come out is empty, and fails as such."""
    inside = F.filter("parts", lambda p: p["kind"].isin("embedded", "media"))
    rows = files.where(F.col("walked").isin(*HOLDING, *ADDED) & (F.size(inside) > 0) & F.col("error_code").isNull()).select("file_id", "walked", "content", inside.alias("inside"))

    names = ["outer", "slot", "name", "file_type", "content"]

    def run(batches):
        held, size = [], 0

        def batch_of():
            columns = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()))], names)

        for batch in batches:
            for k in range(batch.num_rows):
                outer, walked, content, inside = (batch.column(c)[k].as_py() for c in range(4))
                content = opened(content) if opened else content
                package = zipfile.ZipFile(io.BytesIO(content)) if walked == "office" else None
                for p in inside:
                    kind = p["key"] if package is None else _kind_of(p["key"])
                    try:
                        raw = package.read(p["key"]) if package else _decoded(content[p["start"] : p["end"]], p["text"])
                    except Exception:
                        raw = b""
                    held.append((outer, p["ord"], f"inner.{kind}", kind, raw))
                    size += len(raw)
                    if size > LARGE:
                        yield batch_of()
                        held, size = [], 0
        if held:
            yield batch_of()

    return rows.mapInArrow(run, "outer string, slot int, name string, file_type string, content binary")


def _kind_of(name: str) -> str:
    from .names import ENDINGS

    return ENDINGS.get(name.rsplit(".", 1)[-1].lower(), "unknown")


_EDITS = "array<struct<start:int,end:int,how:string>>"
_INNER = "array<struct<slot:int,cleaned:binary>>"


def _put_together(files: DataFrame, opened: Callable[[bytes], bytes] | None = None, check: bool = False) -> DataFrame:
    """``files`` with ``cleaned`` and ``error_code``, from their parts and from ``inner``, what came back of the files inside.

    With ``check`` a cleaned file does not leave its task: it is walked again
    and searched there, and ``file_id, walked, error_code, cleaned_sha256,
    again, parts, n_traces`` come of it, ``again`` the error and ``parts`` those
    of the second walk.
    """
    walked = F.col("walked")
    noted = F.element_at(F.transform(F.filter("parts", lambda p: p["kind"] == "note"), lambda p: F.create_map(*(F.lit(x) for pair in NOTED.items() for x in pair))[p["key"]]), 1)
    lost = F.exists("parts", lambda p: (p["key"] == "trak") & ~p["text"].isin(*SHOWN_TRACKS)) & F.exists("parts", lambda p: p["key"] == "moof")
    critical = F.exists("parts", lambda p: p["kind"].rlike("^[A-Z][A-Za-z]{3}$") & ~p["kind"].isin(*KEPT_CHUNKS))
    unknown = F.when(walked.isin("video", "m4a") & lost | (walked == "png") & critical, "UNKNOWN_PART")
    refused = F.when(~walked.isin(*CLEANED, *(f.kind for f in ADDED.values() if f.edit)), F.coalesce(F.create_map(*(F.lit(x) for pair in REFUSED.items() for x in pair))[walked], F.lit("CLEAN_UNSUPPORTED")))
    kept = [f for f in files.schema.fields if f.name != "inner"]
    done = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("a"), p["end"].alias("z"), p["text"].alias("text"), edit(walked, p).alias("how")))
    files = files.withColumns({"error_code": F.coalesce("error_code", refused, F.when(F.exists("parts", lambda p: p["kind"] == "note"), noted), unknown), "done": done})
    edits = F.transform(F.filter("done", lambda e: e["how"].isNotNull() & (e["z"] > e["a"])), lambda e: F.struct(e["a"].alias("start"), e["z"].alias("end"), e["how"].alias("how"))).cast(_EDITS)
    more = {"edits": edits} | (dict(zip(("spans", "values"), _gone())) if check else {})
    files = files.withColumns(more).drop("done")
    at = {c: k for k, c in enumerate(files.columns)}
    columns = ["file_id", "walked"] if check else [f.name for f in kept]
    walk = walking()

    def again(value, content: bytes, new: bytes | None):
        if new is None:
            return None, None, [], None
        parts, error = walk(value("file_type"), value("walked"), new)
        return hashlib.sha256(new).hexdigest(), error, parts, len(_searched(content, new, value("walked"), [(x["a"], x["z"]) for x in value("spans")], value("values")))

    def run(batches):
        for whole in batches:
            lo, errors, made, size = 0, [], [], 0
            for k in range(whole.num_rows):
                value = lambda c: whole.column(at[c])[k].as_py()  # noqa: E731, B023
                error, new, content = value("error_code"), None, b""
                if error is None:
                    content = (opened(value("content")) if opened else value("content")) or b""
                    back = {i["slot"]: i["cleaned"] for i in value("inner") or ()}
                    inner = [(p["start"], p["end"], p["key"] if p["kind"] == "media" else p["text"], back[p["ord"]]) for p in value("parts") if p["ord"] in back] if back else []
                    try:
                        new = spliced(content, value("walked"), [(e["start"], e["end"], e["how"]) for e in value("edits")], inner)
                    except Exception as e:
                        error = f"DAMAGED: {type(e).__name__}"
                errors.append(error)
                made.append(again(value, content, new) if check else new)
                size += 0 if check else len(new or b"")
                if size > LARGE or k + 1 - lo == BATCH or k + 1 == whole.num_rows:
                    batch, names = whole.slice(lo, k + 1 - lo), columns if not check else [*columns, "error_code"]
                    data = [pa.array(errors, pa.string()) if c == "error_code" else batch.column(at[c]) for c in names]
                    if check:
                        seals, errors_again, parts, found = zip(*made)
                        data += [pa.array(seals, pa.string()), pa.array(errors_again, pa.string()), part_lists(parts), pa.array(found, pa.int32())]
                        names = [*names, "cleaned_sha256", "again", "parts", "n_traces"]
                    else:
                        data, names = [*data, pa.array(made, pa.binary())], [*names, "cleaned"]
                    yield pa.RecordBatch.from_arrays(data, names)
                    lo, errors, made, size = k + 1, [], [], 0

    if check:
        return files.mapInArrow(run, f"file_id string, walked string, error_code string, cleaned_sha256 string, again string, parts array<{PART}>, n_traces int")
    return files.mapInArrow(run, T.StructType([*kept, T.StructField("cleaned", T.BinaryType())]))


def cleaned(walked_files: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``walked_files`` with ``cleaned``, null where a file can't be cleaned.

    Of each format what it needs stays and all else goes; a part that a reader
    cannot do without and that is not known gives ``UNKNOWN_PART``.  Files
    inside mail, SVG and Office packages are cleaned by the same rules, up to
    ``deepest`` levels; one that can't be leaves the outer file without
    ``cleaned`` and with the ``error_code`` ``INNER_`` and its own, and
    ``TOO_DEEP`` where files go on below the last level.
    """
    return _by_level(walked_files, deepest)


def checked(walked_files: DataFrame, opened: Callable[[bytes], bytes] | None = None, deepest: int = DEEPEST) -> DataFrame:
    """``file_id, error_code, cleaned_sha256, n_left, n_bad, n_traces, verified``: what ``cleaned`` and ``verified`` give, without the bytes.

    A file is opened, cleaned, walked again and searched in one task, and its
    bytes are neither stored nor sent; ``opened`` is that of ``with_parts``.
    The four last columns are null where a file can't be cleaned.
    """
    rows = _by_level(walked_files, deepest, opened, check=True)
    return rows.select("file_id", "error_code", "cleaned_sha256", *(F.when(F.col("cleaned_sha256").isNotNull(), c).alias(n) for n, c in _verdict("again").items()))


def dealt_to(stored: DataFrame) -> int:
    """Tasks for the files that hold those of a stored table: Spark merges partitions by their bytes, and small files are as much work as large ones."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // EACH))


def _by_level(walked_files: DataFrame, deepest: int, opened: Callable[[bytes], bytes] | None = None, check: bool = False) -> DataFrame:
    levels = [walked_files]
    while len(levels) <= deepest:
        inside = _taken_out(levels[-1], opened if len(levels) == 1 else None).withColumn("file_id", F.concat("outer", F.lit("/"), F.col("slot").cast("string")))
        inside = cut(with_parts(inside), "zstd")  # walked once for what is read of it below
        if inside.isEmpty():
            break
        levels.append(inside)
    below = None
    for n in range(len(levels) - 1, -1, -1):
        rows = levels[n]
        if n == deepest:
            more = F.exists("parts", lambda p: p["kind"].isin("embedded", "media"))
            rows = rows.withColumn("error_code", F.coalesce("error_code", F.when(more, "TOO_DEEP")))
        if below is None:
            rows = rows.withColumn("inner", F.lit(None).cast(_INNER))
        else:
            tasks = dealt_to(below)
            back = below.repartition(tasks, "outer").groupBy("outer").agg(F.collect_list(F.when(F.col("cleaned").isNotNull(), F.struct("slot", "cleaned"))).cast(_INNER).alias("inner"), F.min("error_code").alias("_inner_error"))
            rows = rows.repartition(tasks, "file_id").join(back.withColumnRenamed("outer", "_of").hint("merge"), F.col("file_id") == F.col("_of"), "left").drop("_of")
            rows = rows.withColumn("error_code", F.coalesce("error_code", F.concat(F.lit("INNER_"), "_inner_error"))).drop("_inner_error")
        done = _put_together(rows, None if n else opened, check and not n)
        below = cut(done.select("outer", "slot", "cleaned", "error_code")) if n else None
    return done


def ready(walked_files: DataFrame) -> DataFrame:
    """Those of ``walked_files`` that a batch can clean: walked to their end and of a kind that has a cleaner."""
    return walked_files.where(F.col("error_code").isNull() & F.col("walked").isin(*CLEANED, *(f.kind for f in ADDED.values() if f.edit)))


def parts_left(walked_files: DataFrame) -> DataFrame:
    """``file_id, name, mime``: attachments of mail of a kind that is not cleaned."""
    from .names import EMBEDDED

    p = F.col("p")
    rows = walked_files.where("walked = 'eml'").select("file_id", F.explode(F.filter("parts", lambda p: p["kind"] == "attachment")).alias("p"))
    return rows.where(~p["key"].isin(*EMBEDDED)).select("file_id", p["text"].alias("name"), p["key"].alias("mime"))


def _searched(content: bytes, cleaned: bytes, walked: str, spans, values) -> list[str]:
    """Texts of what went that are still in the cleaned bytes, and marks of containers there."""
    text = walked in ("eml", "svg", "office")
    if walked == "office":
        with zipfile.ZipFile(io.BytesIO(cleaned)) as z:
            cleaned = b"\n".join(z.read(n) for n in z.namelist() if n.startswith("docProps/"))
    kept, at = [], 0
    for start, end in sorted(spans):
        kept.append(content[at : max(at, start)])
        at = max(at, end)
    kept = b"\n".join([*kept, content[at:]])
    patterns = {m: m.decode("latin-1") for kinds, marks in MARKS.items() if walked in kinds.split("|") for m in marks}
    for value in values:
        value = value.strip()
        if len(value) >= 6 and re.search(r"[^\W\d_]", value):
            for code in ("utf-8", "utf-16-le", "utf-16-be", "latin-1"):
                raw = value.encode(code, "ignore")
                if len(raw) >= 6 and not (text and raw in kept):  # what was to be read stays to be read
                    patterns[raw] = value
    for start, end in () if text else spans:
        for m in re.finditer(rb"[\x20-\x7e]{8,200}|(?:[\x20-\x7e]\0){8,100}", content[start:end]):
            if len(set(m[0])) > 2 and m[0] not in kept:
                patterns[m[0]] = m[0].replace(b"\0", b"").decode("latin-1")
    if len(patterns) <= FEW:
        return sorted({shown for p, shown in patterns.items() if p in cleaned})
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p, shown in patterns.items():
        machine.add_word(p.decode("latin-1"), shown)
    machine.make_automaton()
    return sorted({shown for _, shown in machine.iter(cleaned.decode("latin-1"))})


def _gone() -> tuple[Column, Column]:
    """Spans and values, in ``done``, of what should be gone."""
    gone = F.filter("done", lambda p: p["how"].isNotNull() & (p["kind"] != "directory") & ~p["how"].isin("times", "flags", "jfif", "adobe"))
    told = F.filter("done", lambda p: p["text"].isNotNull() & ((F.col("walked") == "office") & (p["kind"] != "media") | p["how"].isNotNull() & ~p["kind"].isin("VP8X", "IHDR", "moov", "trak", "mdia", "directory")))
    return F.transform(gone, lambda p: F.struct(p["a"].alias("a"), p["z"].alias("z"))), F.transform(told, lambda p: p["text"])


def traces(cleaned_files: DataFrame) -> DataFrame:
    """``file_id, traces``: texts of removed parts that the cleaned bytes still hold.

    Values are looked for in UTF-8, UTF-16 and Latin-1, and so is each run of
    eight printable characters or more of a part that went.  Files that still
    carry their ``parts`` are not walked again.
    """
    walked = F.col("walked")
    rows = cleaned_files.where("cleaned is not null")
    if not {"walked", "parts"} <= set(rows.columns):
        rows = with_parts(rows.select("file_id", "name", "file_type", "content", "cleaned"))
    done = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("a"), p["end"].alias("z"), p["text"].alias("text"), edit(walked, p).alias("how")))
    spans, values = _gone()
    rows = rows.select("file_id", "walked", "content", "cleaned", done.alias("done")).select("file_id", "walked", "content", "cleaned", spans.alias("spans"), values.alias("values"))

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                walked, content, cleaned, spans, values = (batch.column(c)[k].as_py() for c in range(1, 6))
                found.append(_searched(content, cleaned, walked, [(s["a"], s["z"]) for s in spans], values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["file_id", "traces"])

    return rows.mapInArrow(run, "file_id string, traces array<string>")


def verified(cleaned_files: DataFrame) -> DataFrame:
    """``file_id, n_left, n_bad, n_traces, verified``: what is still found in cleaned files.

    No high and no critical item may be left, blanked values aside, and no trace
    of what went.
    """
    again = with_parts(cleaned_files.where("cleaned is not null").select("file_id", "name", "file_type", F.col("cleaned").alias("content")))
    found = traces(cleaned_files).select("file_id", F.size("traces").alias("n_traces"))
    out = again.select("file_id", "walked", "error_code", "parts").join(found.hint("merge"), "file_id", "left").na.fill(0, ["n_traces"])
    return out.select("file_id", *(c.alias(n) for n, c in _verdict("error_code").items()))


def _verdict(error: str) -> dict[str, Column]:
    """What is still found, from the parts of the second walk, its error and the number of traces."""
    telling = lambda src, value: ~src.isin("technical", "pointer") & ~F.coalesce(value, F.lit("")).rlike("^[0. ]*$") | src.isin("script", "rdf", "marker", "page", "eXIf", "E1", "ED", "EXIF", "XMP ")
    risks = risks_left(telling)
    bad = F.filter(risks, lambda r: r.isin("high", "critical"))
    n_bad, traced = F.size(bad).cast("long"), F.col("n_traces")
    return {"n_left": F.size(risks).cast("long"), "n_bad": n_bad, "n_traces": traced, "verified": (n_bad == 0) & (traced == 0) & F.col(error).isNull()}
