"""Small files of every kind, built from rows of ``part``, and what must come of them.

``FORMS[kind](secret, shape)`` gives a file with the secret planted; without a
secret it gives the same file as cleaning must leave it, built without the parts
that go.  Of each kind there are four shapes: a plain one, and three with parts
that are unknown, nested or written in unusual ways.  ``EXPECTED[kind]`` lists
field, value and risk of the items of all shapes, with ``*`` for the secret, and
``EXTRA[kind][shape]`` those of one.
"""

from __future__ import annotations

import base64
import binascii
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``Jane Secret`` and the key in eight digits, 20 characters.
SECRET_SQL = "concat('Jane Secret ', lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0'))"
NAMES = {"jpeg": "a.jpg", "video": "a.mp4", "eml": "a.eml", "office": "a.docx", "mp4": "a.mp4"}
TYPES = {"mp3": "audio", "wav": "audio", "flac": "audio", "ogg": "audio", "m4a": "audio", "mp4": "video"}


SHAPES = 4
#: Files that a task makes, and those that go on to Spark at once, at most 16 MB.
EACH, BATCH = 5_000, 256


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(s: bytes | None, shape: int = 0) -> bytes:
    told = chunk(b"tEXt", b"Author\0" + s) + chunk(b"tEXt", b"Software\0Tool") + chunk(b"zTXt", b"Comment\0\0" + zlib.compress(s)) + chunk(b"eXIf", b"II*\0" + s) if s else b""
    told += {1: chunk(b"caBX", b"jumb" + s), 2: chunk(b"prVt", s), 3: chunk(b"sRGB", b"\0" + s)}.get(shape, b"") if s else b""
    told += chunk(b"gAMA", b"\0\0\xb1\x8f") if shape == 2 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + told + chunk(b"IDAT", b"pixels") + chunk(b"IEND", b"") + (s or b"")


def _chunks(*chunks: tuple[bytes, bytes]) -> bytes:
    return b"".join(k + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for k, x in chunks)


def _riff(form: bytes, *chunks: tuple[bytes, bytes]) -> bytes:
    body = form + _chunks(*chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def webp(s: bytes | None, shape: int = 0) -> bytes:
    size = (7).to_bytes(3, "little") + (5).to_bytes(3, "little")
    told = [(b"EXIF", b"Exif\0\0" + s), (b"XMP ", b"<x>" + s)] if s else []
    told += {1: [(b"META", s)], 3: [(b"C2PA", s)]}.get(shape, []) if s else []
    frame = [(b"ANMF", bytes(16) + _chunks((b"VP8 ", b"moving"), (b"XMP ", s or bytes(20))))] if shape == 2 else []
    return _riff(b"WEBP", (b"VP8X", (b"\x1c" if s else b"\x10") + b"\0\0\0" + size), (b"VP8 ", b"image"), *frame, *told)


def wav(s: bytes | None, shape: int = 0) -> bytes:
    info = b"INFO" + b"IART" + struct.pack("<I", 20) + s + b"ISFT" + struct.pack("<I", 4) + b"Tool" if s else b""
    told = [(b"LIST", info), (b"bext", s)] if s else []
    told += {1: [(b"_PMX", s)], 2: [(b"id3 ", s)], 3: [(b"LIST", b"adtl" + s)]}.get(shape, []) if s else []
    return _riff(b"WAVE", (b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)), *told, (b"data", bytes(64_000)))


def gif(s: bytes | None, shape: int = 0) -> bytes:
    block = lambda x: bytes([len(x)]) + x + b"\0"
    told = b"!\xfe" + block(s) + b"!\xff\x0bXMP DataXMP" + block(s) if s else b""
    told += {1: b"!\x99" + block(s), 2: b"!\xff\x0bICCRGBG1012" + block(s), 3: b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0" + block(s)}.get(shape, b"") if s else b""
    frame = b"," + bytes(9) + b"\x02\x01X\0"
    return b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + told + b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0" + frame * 2 + b";"


# Structure in the TIFF files below: width, places and sizes of strips, directories below.
_STRUCTURE = (0x0100, 0x0111, 0x0117, 0x014A)


def _tiff(s: bytes | None, shape: int, order: str) -> tuple[bytes, dict[str, int]]:
    """A TIFF file and where its directories lie."""
    who = (0x013B, 2, 21, (s or bytes(20)) + b"\0")
    point = lambda name: (0x014A, 4, 1, name)
    wide = (0x0100, 3, 1, struct.pack(order + "HH", 4, 0))
    gps = [(1, 2, 2, b"S\0\0\0"), (2, 5, 3, struct.pack(order + "6I", 41, 1, 30, 1, 36, 1))]
    first = [(0x010F, 2, 6, b"Canon\0"), (0x0111, 4, 1, "pixels"), (0x0117, 4, 1, struct.pack(order + "I", 6)), who]
    below = {1: {"sub": [wide, who]}, 2: {"sub": [wide, point("sub2")], "sub2": [wide, who]}, 3: {}}.get(shape, {})
    first += [point("first" if shape == 3 else "sub")] if shape else []
    directories = {"gps": gps, "first": [*first, (0x8825, 4, 1, "gps")], **below}
    at, places = 16, {"pixels": 8}
    for name, entries in directories.items():
        places[name] = at
        at += 6 + 12 * len(entries) + sum(len(x) for *_, x in entries if not isinstance(x, str) and len(x) > 4)
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", places["first"]) + b"pixels\0\0"
    for name, entries in directories.items():
        kept, data, place = [], b"", places[name] + 6 + 12 * len(entries)
        for tag, kind, n, value in entries:
            raw = struct.pack(order + "I", places[value]) if isinstance(value, str) else value
            inline = raw if len(raw) <= 4 else struct.pack(order + "I", place + len(data))
            if s or tag in _STRUCTURE and name != "gps":
                kept.append(struct.pack(order + "HHI", tag, kind, n) + inline)
            data += (raw if s or tag in _STRUCTURE else bytes(len(raw))) if len(raw) > 4 else b""
        count = struct.pack(order + "H", len(kept)) if name != "gps" or s else b"\0\0"
        out += (count + b"".join(kept)).ljust(6 + 12 * len(entries), b"\0") + data
    return out + (s or bytes(20) if shape == 3 else b""), places


def tiff(s: bytes | None, shape: int = 0, order: str = "<") -> bytes:
    return _tiff(s, shape, order)[0]


def jpeg(s: bytes | None, shape: int = 0) -> bytes:
    segment = lambda mark, body: b"\xff" + mark + struct.pack(">H", len(body) + 2) + body
    told = b"\xff" + segment(b"\xe1", b"Exif\0\0" + tiff(s, 0, ">")) + segment(b"\xe2", b"ICC_PROFILE\0\1\1" + s) + segment(b"\xfe", s) if s else b"\xff"  # a fill byte stays
    told += {1: segment(b"\xeb", b"JP\0\1" + s), 2: segment(b"\xec", b"Ducky" + s)}.get(shape, b"") if s else b""
    if shape == 3:  # a thumbnail, and more than colours need
        told += segment(b"\xe0", b"JFIF\0\1\2\0\0\1\0\1" + (b"\1\6" + s[:18] if s else b"\0\0")) + segment(b"\xee", b"Adobe\0d\0\0\0\0\1" + (s or b""))
    frame = segment(b"\xc0", b"\x08" + struct.pack(">HH", 6, 8) + b"\1\1\x11\0")
    between = segment(b"\xfe", s) if s else b""
    return b"\xff\xd8" + told + frame + segment(b"\xda", b"\0") + b"scan\xff\0\xff\xd0one" + between + segment(b"\xda", b"\0") + b"two\xff\xd9" + (s or b"")


def _id3(s: bytes) -> bytes:
    frame = b"TPE1" + struct.pack(">I", len(s) + 1) + b"\0\0" + b"\0" + s
    return b"ID3\x03\0\0" + bytes([0, 0, 0, len(frame)]) + frame


def mp3(s: bytes | None, shape: int = 0) -> bytes:
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    if not s:
        return frame * 116
    tail = b"TAG" + b"Title".ljust(30, b"\0") + s.ljust(30, b"\0") + bytes(65)
    if shape == 1:
        item = struct.pack("<II", len(s), 0) + b"Composer\0" + s
        ends = lambda flags: b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, flags) + bytes(8)
        tail = ends(0xA0000000) + item + ends(0x80000000) + tail
    elif shape == 2:
        lyrics = b"LYRICSBEGININD0000200LYR00020" + s
        tail = lyrics + b"%06d" % len(lyrics) + b"LYRICS200" + tail
    return _id3(s) + frame * 2 + (s if shape == 3 else b"") + frame * 114 + tail


def _vorbis(s: bytes | None) -> bytes:
    return struct.pack("<I", 4) + b"libF" + struct.pack("<I", 1) + struct.pack("<I", 7 + len(s)) + b"ARTIST=" + s if s else bytes(4 + 4 + 4 + 4 + 27)


def flac(s: bytes | None, shape: int = 0) -> bytes:
    body = _vorbis(s)
    more = {1: b"\2\0\0\x18" + (b"ABCD" + s if s else bytes(24)), 3: b"\5\0\0\x14" + (s or bytes(20))}.get(shape, b"")
    return (_id3(s) if s and shape == 2 else b"") + b"fLaC" + b"\0\0\0\x22" + bytes(34) + more + b"\x84" + len(body).to_bytes(3, "big") + body + b"\xff\xf8frames"


def ogg(s: bytes | None, shape: int = 0) -> bytes:
    packets = (b"\x01vorbis" + bytes(23), b"\x03vorbis" + _vorbis(s))
    return b"".join(b"OggS\0" + bytes([k, *([0] * 20)]) + b"\1" + bytes([len(p)]) + p for k, p in enumerate(packets))


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _track(time: int, handler: bytes, name: bytes, described: bytes, size: bytes, place: int, length: int) -> bytes:
    tkhd = box(b"tkhd", bytes(4) + struct.pack(">IIIII", time, time, 1, 0, 65_000) + bytes(52) + size)
    tables = box(b"stsc", bytes(4) + struct.pack(">IIII", 1, 1, 1, 1)) + box(b"stsz", bytes(4) + struct.pack(">III", 0, 1, length)) + box(b"stco", bytes(4) + struct.pack(">II", 1, place))
    return box(b"trak", tkhd + box(b"mdia", box(b"hdlr", bytes(8) + handler + bytes(12) + name) + box(b"minf", box(b"stbl", described + tables))))


def _movie(s: bytes | None, shape: int, told: bytes) -> bytes:
    time, head = 3_700_000_000 if s else 0, box(b"ftyp", b"isom\0\0\0\0") + (box(b"uuid", bytes(16) + s) if s and shape == 1 else b"")
    mvhd = box(b"mvhd", bytes(4) + struct.pack(">IIII", time, time, 1000, 65_000) + bytes(80))
    name, entry = b"\0", bytes(8)
    if shape == 3:
        name, entry = s or bytes(20), bytes(42) + (s or b"").ljust(32, b"\0") + bytes(4) + box(b"avcC", b"set up") + (box(b"XtRa", s) if s else box(b"free", bytes(20)))
    stsd = box(b"stsd", struct.pack(">II", 0, 1) + box(b"avc1", entry))

    def moov(place: int) -> bytes:
        tracks = _track(time, b"vide", name, stsd, struct.pack(">II", 8 << 16, 6 << 16), place, 6)
        tracks += _track(time, b"meta", b"\0", b"", bytes(8), place + 6, 20) if s and shape == 2 else b""
        return box(b"moov", mvhd + tracks + (box(b"udta", told) if s else b""))

    return head + moov(len(head) + len(moov(0)) + 8) + box(b"mdat", b"frames" + ((s or bytes(20)) if shape == 2 else b""))


def mp4(s: bytes | None, shape: int = 0) -> bytes:
    text = lambda kind, x: box(kind.encode("latin-1"), struct.pack(">HH", len(x), 0) + x)
    return _movie(s, shape, text("©too", s or b"") + text("©xyz", b"+41.5100-008.2500/"))


def m4a(s: bytes | None, shape: int = 0) -> bytes:
    data = lambda x: box(b"data", bytes(8) + x)
    ilst = box(b"ilst", box("©too".encode("latin-1"), data(s or b"")) + box("©nam".encode("latin-1"), data(b"Song")))
    return _movie(s, shape, box(b"meta", bytes(4) + ilst))


def heic(s: bytes | None, shape: int = 0) -> bytes:
    return box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", bytes(4) + b"infeExif" + (s or b"")) + box(b"mdat", b"GPS" + (s or b""))


def _wrapped(raw: bytes) -> bytes:
    text = base64.b64encode(raw)
    return b"\r\n".join(text[k : k + 76] for k in range(0, len(text), 76))


def svg(s: bytes | None, shape: int = 0) -> bytes:
    image = (base64.b64encode(png(s)) if s else _wrapped(png(s))).decode()  # lines are wrapped at 76 characters
    said = s.decode() if s else ""
    told = f'<!-- made by {said} --><metadata><rdf:RDF xmlns:rdf="r"><dc:creator xmlns:dc="d">{said}</dc:creator></rdf:RDF></metadata><script>x()</script>' if s else ""
    editor = f' xmlns:inkscape="i" inkscape:version="{said}"' if s else ""
    if s and shape == 2:  # a prefix of one's own, and text that is not markup
        editor += f' xmlns:q="http://www.inkscape.org/namespaces/inkscape" q:label="{said}"'
        told += f"<q:grid>{said}</q:grid>"
    elif s and shape == 3:
        editor += f' data-author="{said}"'
        told += f"<?app {said}?>"
    title = "<title><![CDATA[t]]></title>" if shape == 2 else "<title>&#116;</title>"
    text = f'<svg xmlns="s"{editor}>{told}{title}<image href="data:image/png;base64,{image}"/></svg>'
    return ("\ufeff" + text).encode("utf-16-be") if shape == 1 else text.encode()


def pdf(s: bytes | None, shape: int = 0) -> bytes:
    author, title = (s, b"a\\)b(c)") if s else (b" " * 20, b" " * 7)
    drawn = zlib.compress(b"0 0 0 rg 1 1 9 9 re f")
    field = {1: b"/Author 6 0 R", 2: b"/Auth#6Fr (" + author + b")"}.get(shape, b"/Author (" + author + b")")
    info = b"<<" + field + b" /Title (" + title + b")>>"
    made = b"1 0 obj" + info + b"endobj\n" if shape != 3 else b"7 0 obj<</Type /ObjStm /N 1 /First 4 /Length " + str(len(info) + 4).encode() + b">>stream\n1 0 " + info + b"\nendstream endobj\n"
    made += b"6 0 obj(" + author + b")endobj\n" if shape == 1 else b""
    return (
        b"%PDF-1.5\n" + made + b"2 0 obj<</Type /Pages /Kids [3 0 R]>>endobj\n"
        b"3 0 obj<</Type /Page /Contents 4 0 R>>endobj\n4 0 obj<</Filter /FlateDecode /Length " + str(len(drawn)).encode() + b">>stream\n" + drawn + b"\nendstream endobj\n"
        b"5 0 obj<</Type /Metadata /Subtype /XML>>stream\n" + (b"<x>" + s + b"</x>" if s else b" " * 27) + b"endstream endobj\ntrailer<</Info 1 0 R>>\n%%EOF"
    )


def _part(edge: bytes, mime: bytes, name: bytes, encoding: bytes, body: bytes) -> bytes:
    shown = b'Content-Disposition: attachment; filename="' + name + b'"\r\n' if name else b""
    return b"--" + edge + b"\r\nContent-Type: " + mime + b"\r\nContent-Transfer-Encoding: " + encoding + b"\r\n" + shown + b"\r\n" + body + b"\r\n"


_DOCX = b"application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def eml(s: bytes | None, shape: int = 0) -> bytes:
    told = b"Received: from x\r\n by [10.1.2.3] for " + s + b"\r\nX-Originating-IP: 9.9.9.9\r\nMessage-ID: <" + s + b">\r\n" if s else b""
    parts = b"--edge\r\nContent-Type: multipart/alternative; boundary=inner\r\n\r\n--inner\r\nContent-Type: text/plain\r\n\r\nReceived: text\r\n--inner--\r\n"
    parts += _part(b"edge", b"image/png", b"a.png", b"base64", _wrapped(png(s)))
    if shape == 1:  # a photo in a document in a mail in the mail
        head = b"From: c@d\r\n" + (b"Return-Path: <" + s + b">\r\n" if s else b"") + b"Content-Type: multipart/mixed; boundary=deep\r\n\r\n"
        parts += _part(b"edge", b"message/rfc822", b"", b"8bit", head + _part(b"deep", _DOCX, b"b.docx", b"base64", _wrapped(office(s))) + b"--deep--")
    elif shape == 2:
        parts += _part(b"edge", b"image/svg+xml", b"a.svg", b"quoted-printable", binascii.b2a_qp(svg(s, 3), quotetabs=True, istext=False))
    elif shape == 3:
        parts += _part(b"edge", b"application/octet-stream", b"a.docx", b"base64", _wrapped(office(s, 3)))
    return b"From: a@b\r\n" + told + b"Subject: hi\r\nContent-Type: multipart/mixed;\r\n boundary=\"edge\"\r\n\r\n" + parts + b"--edge--\r\n"


@lru_cache(256)
def _deflated(data: bytes) -> bytes:
    """Short members are the same in all packages."""
    return zlib.compress(data, -1, -15)


def zipped(members: list[tuple[str, str | bytes]]) -> bytes:
    """A package of deflated members, byte for byte what ``zipfile`` makes of names and data alone, without its time for each member."""
    out, listed, at = [], [], 0
    for name, data in members:
        name, data = name.encode(), data.encode() if isinstance(data, str) else data
        packed = _deflated(data) if len(data) < 64 else zlib.compress(data, -1, -15)
        told = struct.pack("<HHHHHIIIHH", 20, 0, 8, 0, 33, zlib.crc32(data), len(packed), len(data), len(name), 0)
        out += (b"PK\3\4", told, name, packed)
        listed += (b"PK\1\2\x14\3", told, struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at), name)
        at += 30 + len(name) + len(packed)
    listed = b"".join(listed)
    return b"".join(out) + listed + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, len(members), len(members), len(listed), at, 0)


def office(s: bytes | None, shape: int = 0) -> bytes:
    from ..sources.cleaning import EMPTIED

    creator, title = (f"<![CDATA[{s.decode()}]]>", "Pl&#97;n") if s and shape == 2 else (s.decode() if s else "", "Plan")
    core = f'<?xml version="1.0"?><cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>{creator}</dc:creator><dc:title>{title}</dc:title></cp:coreProperties>' if s else EMPTIED["docProps/core.xml"]
    app = "<Properties><Company>Works</Company></Properties>" if s else EMPTIED["docProps/app.xml"]
    members = [("word/document.xml", "<w/>"), ("docProps/core.xml", core), ("docProps/app.xml", app), ("word/media/a.png", png(s))]
    if shape in (1, 3):  # made for these shapes alone
        members.append(("word/embeddings/b.docx", office(s)) if shape == 1 else ("docProps/thumbnail.jpeg", jpeg(s)))
    return zipped(members)


FORMS = {f.__name__: f for f in (png, webp, wav, gif, tiff, jpeg, mp3, flac, ogg, mp4, m4a, heic, svg, pdf, eml, office)}
_FILM = [("mvhd", "2021-03-31 01:46:40", "high"), ("Duration", "1:05", "low"), ("Resolution", "8x6", "low"), ("Codec", "H.264/AVC", "low")]
_EXIF = [("Make", "Canon"), ("StripOffsets", "8"), ("StripByteCounts", "6"), ("Artist", "*"), ("GPSLatitudeRef", "S"), ("GPSLatitude", "-41.510000")]
EXPECTED = {
    "png": [("IHDR", "4x3", "low"), ("Author", "*", "high"), ("Software", "Tool", "medium"), ("Comment", "[binary/compressed]", "high"), ("eXIf", None, "high"), ("trailing", None, "medium")],
    "webp": [("VP8X", "8x6", "low"), ("EXIF", None, "high"), ("XMP ", None, "high")],
    "wav": [("fmt ", "2 channels, 8000 Hz, 16 bits", "low"), ("IART", "*", "medium"), ("ISFT", "Tool", "high"), ("bext", None, "high"), ("Bitrate", "256 kbps", "low"), ("Duration", "0:02", "low")],
    "gif": [("screen", "2x2", "low"), ("Version", "GIF89a", "low"), ("comment", "*", "high"), ("XMP DataXMP", None, "high"), ("NETSCAPE2.0", None, "low"), ("Frames", "2", "low")],
    "tiff": [("ByteOrder", "little endian", "low"), ("GPS", "16", "critical"), *((f, v, r) for (f, v), r in zip(_EXIF, ("high", "low", "low", "high", "critical", "critical")))],
    "jpeg": [("ByteOrder", "big endian", "low"), *((f, v, r) for (f, v), r in zip(_EXIF, ("medium", "low", "low", "high", "high", "high"))), ("ICC", "ICC_PROFILE, *", "medium"), ("comment", "*", "medium"), ("comment", "*", "medium"), ("frame", "8x6", "low"), ("trailing", None, "medium")],
    "mp3": [("TPE1", "*", "medium"), ("Channels", "stereo", "low"), ("SampleRate", "44100 Hz", "low"), ("Bitrate", "128 kbps", "low"), ("Duration", "0:03", "low"), ("Title", "Title", "low"), ("Artist", "*", "medium")],
    "flac": [("VENDOR", "libF", "high"), ("ARTIST", "*", "medium")],
    "ogg": [("VENDOR", "libF", "high"), ("ARTIST", "*", "medium")],
    "mp4": [*_FILM, ("©too", "*", "high"), ("©xyz", "+41.5100-008.2500/", "high"), ("GPSLatitude", "+41.5100", "high"), ("GPSLongitude", "-008.2500", "high")],
    "m4a": [*_FILM, ("©too", "*", "high"), ("©nam", "Song", "low")],
    "heic": [("ftyp", "heic", "low"), ("meta", None, "high"), ("Exif", None, "high"), ("GPS", None, "critical")],
    "svg": [("comment", "made by *", "medium"), ("metadata", None, "medium"), ("rdf", None, "high"), ("dc:creator", "*", "high"), ("script", None, "high"), ("namespace", None, "medium"), ("namespace", None, "medium"), ("namespace", None, "medium"), ("inkscape:version", "*", "high"), ("title", "t", "low"), ("png", None, "medium")],
    "pdf": [("Author", "*", "high"), ("Title", "a)b(c)", "medium"), ("XMP", None, "high"), ("Pages", "1", "low"), ("FakeRedaction", "page 1", "high")],
    "eml": [("From", "a@b", "low"), ("Received", "10.1.2.3", "high"), ("X-Originating-IP", "9.9.9.9", "critical"), ("Message-ID", "<*>", "medium"), ("Subject", "hi", "low"), ("image/png", "a.png", "medium")],
    "office": [("creator", "*", "high"), ("title", "Plan", "medium"), ("Company", "Works", "low"), ("word/media/a.png", None, "medium")],
}
_SUB = lambda shape, name: ("Sub", str(_tiff(b" " * 20, shape, "<")[1][name]), "low")
_FILM_EXTRA = {1: [("uuid", None, "medium")], 2: [("meta", None, "high")]}
EXTRA = {
    "png": {1: [("caBX", None, "medium")], 2: [("prVt", None, "medium")]},
    "webp": {1: [("META", None, "medium")], 2: [("XMP ", None, "medium")], 3: [("C2PA", None, "medium")]},
    "wav": {1: [("_PMX", None, "medium")], 2: [("id3 ", None, "high")]},
    "gif": {1: [("extension", None, "medium")], 2: [("ICCRGBG1012", None, "high")], 3: [("NETSCAPE2.0", None, "low")]},
    "tiff": {1: [_SUB(1, "sub"), ("ImageWidth", "4", "low"), ("Artist", "*", "high")], 2: [_SUB(2, "sub"), _SUB(2, "sub2"), ("ImageWidth", "4", "low"), ("ImageWidth", "4", "low"), ("Artist", "*", "high")], 3: [_SUB(3, "first")]},
    "jpeg": {1: [("EB", None, "medium")], 2: [("EC", None, "medium")]},
    "mp3": {1: [("APE", None, "medium"), ("Composer", "*", "low")], 2: [("Lyrics3", None, "medium")]},
    "flac": {1: [("ABCD", None, "medium")], 2: [("TPE1", "*", "medium")]},
    "mp4": _FILM_EXTRA,
    "m4a": _FILM_EXTRA,
    "svg": {2: [("namespace", None, "medium"), ("inkscape:label", "*", "medium"), ("inkscape:grid", None, "medium")], 3: [("data-author", "*", "high"), ("instruction", "*", "medium")]},
    "eml": {1: [("message/rfc822", None, "medium")], 2: [("image/svg+xml", "a.svg", "medium")], 3: [("application/octet-stream", "a.docx", "medium")]},
    "office": {1: [("word/embeddings/b.docx", None, "medium")], 3: [("docProps/thumbnail.jpeg", None, "medium")]},
}
#: Kinds that cannot be cleaned, or stay suspect when they are.
REFUSED = {"ogg": "OGG_VORBIS_CLEAN_UNSUPPORTED", "heic": "HEIC_DECODE_UNSUPPORTED"}
STILL_BAD = ("pdf",)  # what looks redacted is shown, not changed


def dealt(spark: SparkSession, sf_dir: str, *kinds: str, shapes: int = 1) -> DataFrame:
    """One file for each row of ``part``, of the kinds and shapes in turn by key: ``file_id, ord, name, file_type, content``.

    ``content`` is what ``opened`` makes the file of: a key is a few bytes and
    its file up to 64 KB, so keys are dealt to tasks and files are made there.
    """
    turn = lambda named: F.element_at(F.array(*(F.lit(named.get(x, x)) for x in kinds)), F.expr(f"cast(pmod(ord, {len(kinds)}) as int) + 1"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{SECRET_SQL} AS secret")
    tasks = max(spark.sparkContext.defaultParallelism, -(-part.count() // EACH))
    rows = part.repartition(tasks, "p_partkey").select(F.col("p_partkey").cast("long").alias("ord"), "secret")
    by = F.concat_ws(" ", turn({}), F.expr(f"pmod(ord, {shapes})"), "secret").cast("binary")
    name = turn({x: NAMES.get(x, f"a.{x}") for x in kinds})
    return rows.select(F.concat(F.lit("p"), F.col("ord").cast("string")).alias("file_id"), "ord", name.alias("name"), turn(TYPES).alias("file_type"), by.alias("content"))


def walked_as(kind: str) -> str:
    """The walker's name for files of a kind: sound has one for each ending, other files one for each type."""
    known = TYPES.get(kind, kind)
    return kind if known == "audio" else known


def opened(by: bytes) -> bytes:
    """The file that ``content`` of ``dealt`` stands for."""
    kind, shape, secret = by.split(b" ", 2)
    return FORMS[kind.decode()](secret, int(shape))


def built(spark: SparkSession, sf_dir: str, *kinds: str, shapes: int = 1) -> DataFrame:
    """Files of ``dealt`` with their bytes as ``content``."""
    rows = dealt(spark, sf_dir, *kinds, shapes=shapes)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                made = pa.array([opened(by) for by in batch.column(4).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], made], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
