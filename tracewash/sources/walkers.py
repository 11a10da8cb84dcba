"""Small walkers over binary containers: where each part of a file lies.

A walker yields ``(kind, key, start, end, text)``: the span of a part in the
file, its name, and its text if it has one; a span without length tells
something about the file that nothing can be cut from.  Walkers judge nothing;
risk, labels and what to remove are rules on the resulting rows.  They go on to
the end of the file, and raise ``Damaged`` where its structure does not hold, so
that a file is never taken for walked when a part of it was not seen.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from contextlib import nullcontext
from xml.etree import ElementTree

from .names import CODECS, EXIF_TAGS, FRAME_RATES, GPS_TAGS, IMAGE_TAGS, SAMPLE_RATES

DEEPEST = 16
#: What the first eight bytes of a user's comment say of its encoding; two bytes a character have the file's order.
CHARSETS = {b"ASCII\0\0\0": "latin-1", b"UNICODE\0": None, b"JIS\0\0\0\0\0": "iso2022_jp", bytes(8): "utf-8"}
SUB_IFDS = {0x8769: "Exif", 0x8825: "GPS", 0xA005: "Interop", 0x014A: "Sub"}
#: Tags with places of image data, and those with its sizes.
DATA_TAGS = {"StripOffsets": "StripByteCounts", "TileOffsets": "TileByteCounts", "JPEGInterchangeFormat": "JPEGInterchangeFormatLength"}
_DATA = {*DATA_TAGS, *DATA_TAGS.values()}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}


_TAGS = {**IMAGE_TAGS, **EXIF_TAGS}


class Damaged(Exception):
    pass


def whole(ok: bool, what: str) -> None:
    if not ok:
        raise Damaged(what)


def _text(raw: bytes, encoding: str = "latin-1") -> str:
    return raw.decode(encoding, "replace").strip("\0 ")


def clock(seconds: float) -> str:
    return f"{int(seconds) // 60}:{int(seconds) % 60:02d}"


def png(b: bytes):
    at, kind = 8, ""
    while kind != "IEND":
        whole(at + 12 <= len(b), "no IEND")
        n, name = struct.unpack(">I4s", b[at : at + 8])
        end, body = at + 12 + n, b[at + 8 : at + 8 + n]
        whole(end <= len(b), "chunk beyond the end")
        kind, key, text = name.decode("latin-1"), "", None
        if kind in ("tEXt", "zTXt", "iTXt"):
            key, _, rest = body.partition(b"\0")
            key, text = _text(key), _text(rest) if kind == "tEXt" else "[binary/compressed]"
        elif kind == "IHDR" and n >= 8:
            text = "{}x{}".format(*struct.unpack(">II", body[:8]))
        yield kind, key, at, end, text
        at = end
    if at < len(b):
        yield "trailing", "", at, len(b), None


def riff(b: bytes):
    whole(len(b) >= 12, "no header")
    stop = 8 + struct.unpack("<I", b[4:8])[0]
    whole(stop <= len(b) + 1, "file ends early")
    at, rate, data = 12, 0, 0
    while at + 8 <= min(stop, len(b)):
        kind, n = struct.unpack("<4sI", b[at : at + 8])
        whole(at + 8 + n <= len(b), "chunk beyond the end")
        end = min(at + 8 + n + n % 2, len(b))
        kind, form, text = kind.decode("latin-1"), b[at + 8 : at + 12], None
        if kind == "fmt " and n >= 16:
            _, channels, hertz, rate, _, bits = struct.unpack("<HHIIHH", b[at + 8 : at + 24])
            text = f"{channels} channels, {hertz} Hz, {bits} bits"
        elif kind == "data":
            data += n
        elif kind == "VP8X" and n >= 10:
            text = "{}x{}".format(*(1 + int.from_bytes(b[at + k : at + k + 3], "little") for k in (12, 15)))
        yield kind, form.decode("latin-1") if kind == "LIST" else "", at, end, text
        if kind == "LIST" and form == b"INFO":
            k = at + 12
            while k + 8 <= end:
                name, m = struct.unpack("<4sI", b[k : k + 8])
                whole(k + 8 + m <= end, "INFO beyond its list")
                yield "INFO", name.decode("latin-1"), k, k + 8 + m, _text(b[k + 8 : k + 8 + m])
                k += 8 + m + m % 2
        elif kind == "ANMF":
            k = at + 24
            while k + 8 <= end:
                name, m = struct.unpack("<4sI", b[k : k + 8])
                whole(k + 8 + m <= end, "chunk beyond its frame")
                yield "in frame", name.decode("latin-1"), k + 8, k + 8 + m, None
                k += 8 + m + m % 2
        at = end
    if rate:
        yield "technical", "Bitrate", at, at, f"{rate * 8 // 1000} kbps"
        yield "technical", "Duration", at, at, clock(data / rate)
    if at < len(b):
        yield "trailing", "", at, len(b), None


def gif(b: bytes):
    whole(len(b) >= 13, "no header")
    yield "screen", "", 6, 6, "{}x{}".format(*struct.unpack("<HH", b[6:10]))
    yield "technical", "Version", 0, 0, _text(b[:6])
    at, frames = 13 + (3 << ((b[10] & 7) + 1) if b[10] & 128 else 0), 0

    def blocks(k):
        parts = []
        while True:
            whole(k < len(b), "blocks beyond the end")
            if not b[k]:
                return k + 1, parts
            parts.append(b[k + 1 : k + 1 + b[k]])
            k += 1 + b[k]

    while True:
        whole(at < len(b), "no trailer")
        if b[at] == 0x21:
            whole(at + 2 < len(b), "no label")
            end, parts = blocks(at + 2)
            label = {0xFE: "comment", 0x01: "plain", 0xFF: "application", 0xF9: "control"}.get(b[at + 1], "extension")
            key = _text(parts[0]) if label == "application" and parts else ""
            yield label, key, at, end, _text(b"".join(parts)) if label == "comment" else None
        elif b[at] == 0x2C:
            whole(at + 10 <= len(b), "no frame")
            end, _ = blocks(at + 11 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 128 else 0))
            frames += 1
            yield "frame", "", at, end, None
        else:
            whole(b[at] == 0x3B, "unknown block")
            break
        at = end
    yield "technical", "Frames", at, at, str(frames)
    if at + 1 < len(b):
        yield "trailing", "", at + 1, len(b), None


_ENTRIES = {order: struct.Struct(order + "HHI") for order in "<>"}


def tiff(b: bytes, base: int = 0):
    """Directories and entries of all IFDs, chained ones and those that a tag points to, and bytes that belong to none.

    A directory is met once, however many tags point to it, and directories may
    not overlap, so a cycle ends.
    """
    order = {b"II": "<", b"MM": ">"}.get(b[base : base + 2])
    whole(order is not None and base + 8 <= len(b), "no byte order")
    yield "technical", "ByteOrder", base, base, "little endian" if order == "<" else "big endian"
    todo, seen, entries = [("0th", struct.unpack(order + "I", b[base + 4 : base + 8])[0])], set(), 0
    used, known, entry = [(base, base + 8)], True, _ENTRIES[order]
    while todo:
        name, offset = todo.pop(0)
        at = base + offset
        if offset in seen or not offset:
            continue
        whole(at + 2 <= len(b), "directory beyond the end")
        seen.add(offset)
        count = struct.unpack(order + "H", b[at : at + 2])[0]
        entries += count
        nxt = at + 2 + 12 * count
        whole(nxt <= len(b), "entries beyond the end")
        whole(12 * entries <= len(b), "directories overlap")
        yield "directory", name, at, min(nxt + 4, len(b)), order
        used.append((at, nxt + 4))
        refs, data = {}, {}
        for k in range(count):
            e = at + 2 + 12 * k
            tag, kind, n = entry.unpack_from(b, e)
            size = SIZES.get(kind, 1) * n
            start = e + 8 if size <= 4 else base + struct.unpack(order + "I", b[e + 8 : e + 12])[0]
            raw = b[start : start + size]
            used.append((start, start + size))
            if tag in SUB_IFDS:
                there = [x for x in struct.unpack(order + "I" * (len(raw) // 4), raw[: len(raw) // 4 * 4]) if x] if kind in (4, 13) else []
                todo += [(SUB_IFDS[tag], x) for x in there]
                if there:
                    yield "pointer", SUB_IFDS[tag], e, e, " ".join(map(str, there))
                continue
            key = (GPS_TAGS if name == "GPS" else _TAGS).get(tag, f"Unknown_{name}_{tag}")
            if kind in (3, 4) and key in _DATA:
                data[key] = struct.unpack(order + {3: "H", 4: "I"}[kind] * (len(raw) // SIZES[kind]), raw)
            text = _value(order, kind, n, raw, key, refs)
            if key.endswith("Ref") and text:
                refs[key[:-3]] = text
            yield name, key, min(start, len(b)), min(start + size, len(b)), text
        for places, sizes in DATA_TAGS.items():
            known &= len(data.get(places, ())) == len(data.get(sizes, ()))
            used += [(base + x, base + x + n) for x, n in zip(data.get(places, ()), data.get(sizes, ()))]
        if name in ("0th", "1st", "Sub") and nxt + 4 <= len(b):
            more = struct.unpack(order + "I", b[nxt : nxt + 4])[0]
            if more:
                yield "technical", "AdditionalIFD", nxt, nxt, str(more)
                todo.append(("Sub" if name == "Sub" else "1st", more))
    at = base
    for start, end in sorted(used) if known and not base else ():
        if at < start:
            yield "gap", "", at, min(start, len(b)), None
        at = max(at, end)
    if known and not base and at < len(b):
        yield "gap", "", at, len(b), None
    if not known and not base:  # image data without an end
        yield "note", "unknown", 0, 0, None


def _value(order: str, kind: int, n: int, raw: bytes, key: str, refs: dict) -> str | None:
    if kind == 2:
        return _text(raw, "utf-8") or None
    if key.startswith("XP"):
        return _text(raw, "utf-16-le")
    if key == "UserComment" and raw[:8] in CHARSETS:
        return _text(raw[8:], CHARSETS[raw[:8]] or ("utf-16-be" if order == ">" else "utf-16-le"))
    code = {3: "H", 4: "I", 5: "II", 8: "h", 9: "i", 10: "ii"}.get(kind)
    if code is None or n > 1000 or len(raw) < struct.calcsize("=" + code) * n:
        return "[binary data]"
    x = struct.unpack(order + code * n, raw[: struct.calcsize("=" + code) * n])
    if len(code) == 2:
        x = [a / c if c else 0.0 for a, c in zip(x[::2], x[1::2])]
        if key in ("GPSLatitude", "GPSLongitude") and len(x) == 3:
            return f"{(x[0] + x[1] / 60 + x[2] / 3600) * (-1 if refs.get(key, '')[:1].upper() in ('S', 'W') else 1):.6f}"
        if len(x) == 1:
            return _rational(key, x[0])
    return " ".join(f"{v:.2f}" if isinstance(v, float) else str(v) for v in x)


def _rational(key: str, x: float) -> str:
    if key == "ExposureTime":
        return f"1/{round(1 / x)}s" if 0 < x < 1 else f"{x:g}s"
    return {"FNumber": f"f/{x:.1f}", "FocalLength": f"{x:.0f}mm"}.get(key, f"{x:.2f}")


_SEGMENTS = {0xE2: "ICC", 0xED: "IPTC", 0xFE: "comment"}
_SAID = re.compile(rb"[\x20-\x7e]{8,}")
_MARKER = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")


def jpeg(b: bytes):
    at = 2
    while True:
        whole(at + 2 <= len(b) and b[at] == 0xFF, "no marker")
        while b[at + 1] == 0xFF:  # fill bytes
            at += 1
            whole(at + 2 <= len(b), "no marker")
        mark = b[at + 1]
        if mark == 0xD9:
            break
        if 0xD0 <= mark <= 0xD7 or mark == 0x01:
            at += 2
            continue
        whole(at + 4 <= len(b), "no length")
        end = at + 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
        whole(at + 4 <= end <= len(b), "segment beyond the end")
        body = b[at + 4 : end]
        key = ("EXIF" if body[:6] == b"Exif\0\0" else "XMP") if mark == 0xE1 else _SEGMENTS.get(mark, "")
        text = _text(body, "utf-8") if mark == 0xFE else None
        if mark == 0xE2:
            text = ", ".join(_text(s) for s in _SAID.findall(body)[:2]) or None
        if 0xC0 <= mark <= 0xC3 and len(body) >= 5:
            key, text = "frame", "{1}x{0}".format(*struct.unpack(">HH", body[1:5]))
        yield f"{mark:02X}", key, at, end, text
        if key == "EXIF":
            try:
                yield from tiff(b[:end], at + 10)
            except Damaged as e:  # the segment goes as a whole
                yield "technical", "UnreadableEXIF", at, at, str(e)
        if mark == 0xDA:
            stop = _MARKER.search(b, end)
            whole(stop is not None, "no end of image")
            end = stop.start()
        at = end
    if at + 2 < len(b):
        yield "trailing", "", at + 2, len(b), None


def _id3v2(b: bytes):
    """The tag at the start and its frames."""
    synchsafe = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
    whole(len(b) >= 10 and 10 + synchsafe(b[6:10]) <= len(b), "tag beyond the end")
    end = 10 + synchsafe(b[6:10])
    yield "ID3v2", str(b[3]), 0, end, None
    at, wide = 10, 3 if b[3] == 2 else 4
    while at + (6 if wide == 3 else 10) <= end and b[at]:
        key, size = b[at : at + wide].decode("latin-1"), b[at + wide : at + 2 * wide]
        n = synchsafe(size) if b[3] == 4 else int.from_bytes(size, "big")
        start = at + (6 if wide == 3 else 10)
        raw, text = b[start : min(start + n, end)], None
        if raw and (key[0] in "TW" or key in ("COMM", "COM")):
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
            text = _text(raw, "latin-1") if key[0] == "W" else _text(raw[4 if key[0] == "C" else 1 :], code)
        yield "frame", key, at, min(start + n, end), text
        at = start + n


def _tail_tags(b: bytes, at: int):
    """Tags at the end of sound, the last one first: ID3v1, Lyrics3 and APE."""
    stop = len(b)
    while True:
        if stop - at >= 128 and b[stop - 128 : stop - 125] == b"TAG":
            start = stop - 128 - (227 if b[stop - 355 : stop - 351] == b"TAG+" else 0)
            yield "ID3v1", "", start, stop, None
            for key, lo, hi in (("Title", 3, 33), ("Artist", 33, 63), ("Album", 63, 93), ("Comment", 97, 127)):
                text = _text(b[stop - 128 + lo : stop - 128 + hi])
                if text:
                    yield "tag", key, stop - 128 + lo, stop - 128 + hi, text
        elif stop - at >= 32 and b[stop - 32 : stop - 24] == b"APETAGEX":
            size, count, flags = struct.unpack("<III", b[stop - 20 : stop - 8])
            start = stop - size
            whole(at <= start <= stop - 32, "tag beyond the start")
            k = start
            start -= 32 if flags >> 31 and b[max(start - 32, 0) : start - 24] == b"APETAGEX" else 0
            yield "APE", "", start, stop, None
            for _ in range(count):
                m = re.compile(rb"[\x20-\x7e]+\0").match(b, k + 8, stop - 32)
                whole(m is not None and m.end() + int.from_bytes(b[k : k + 4], "little") <= stop - 32, "item beyond its tag")
                end = m.end() + int.from_bytes(b[k : k + 4], "little")
                yield "tag", _text(m[0]), k, end, _text(b[m.end() : end], "utf-8") if not b[k + 4] & 6 else None
                k = end
        elif b[stop - 9 : stop] == b"LYRICS200" and b[stop - 15 : stop - 9].isdigit():
            start = stop - 15 - int(b[stop - 15 : stop - 9])
            whole(at <= start and b[start : start + 11] == b"LYRICSBEGIN", "lyrics without begin")
            yield "Lyrics3", "", start, stop, None
        else:
            return
        stop = start


def _frame(b: bytes, at: int) -> int:
    """Length of the frame of sound at ``at``, 0 where there is none."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return 0
    version, layer, rate, hertz, pad = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 4, b[at + 2] >> 2 & 3, b[at + 2] >> 1 & 1
    if layer == 4:  # AAC has its length in the header
        n = (b[at + 3] & 3) << 11 | int.from_bytes(b[at + 4 : at + 6], "big") >> 5 if version >> 1 else 0
        return n if n >= 7 else 0
    if version == 1 or hertz == 3 or not 0 < rate < 15:
        return 0
    kbps = FRAME_RATES["1" if version == 3 else "2", layer][rate]
    hertz = SAMPLE_RATES[hertz] >> {3: 0, 2: 1, 0: 2}[version]
    if layer == 1:
        return (12_000 * kbps // hertz + pad) * 4
    return (72_000 if layer == 3 and version != 3 else 144_000) * kbps // hertz + pad


def _between_frames(b: bytes, at: int, stop: int):
    """Spans before, between and behind the frames of sound."""
    gap, met, known = at, False, {}

    def length(at: int) -> int:
        head = b[at : at + 4]
        n = known.get(head)
        if n is None:
            n = _frame(b, at)
            if len(head) == 4 and head[1] & 6:  # AAC has more of it behind
                known[head] = n
        return n

    while 0 <= at < stop:
        n = length(at)
        if n and (met and gap == at or at + n >= stop or length(at + n)):
            if gap < at:
                yield "junk", "", gap, at, None
            gap, met = min(at + n, stop), True
            at = gap
        else:
            at = b.find(b"\xff", at + 1, stop)
    whole(met, "no frames")
    if gap < stop:
        yield "junk", "", gap, stop, None


def mp3(b: bytes):
    end = 0
    if b[:3] == b"ID3":
        for part in _id3v2(b):
            end = max(end, part[3] if part[0] == "ID3v2" else 0)
            yield part
    tail = list(_tail_tags(b, end))
    stop = min([len(b), *(p[2] for p in tail if p[0] != "tag")])
    gaps = list(_between_frames(b, end, stop))
    first = gaps[0][3] if gaps and gaps[0][2] == end else end
    _, version, rate, mode = b[first : first + 4]
    mpeg1, layer3 = version >> 3 & 3 == 3, version >> 1 & 3 == 1
    kbps, hertz = FRAME_RATES["1", 3][rate >> 4] if mpeg1 and layer3 else 0, SAMPLE_RATES[rate >> 2 & 3] if mpeg1 else 0
    yield "technical", "Channels", end, end, "mono" if mode >> 6 == 3 else "stereo"
    if hertz:
        yield "technical", "SampleRate", end, end, f"{hertz} Hz"
    if kbps:
        yield "technical", "Bitrate", end, end, f"{kbps} kbps"
        yield "technical", "Duration", end, end, clock((len(b) - end) * 8 / (kbps * 1000))
    yield from gaps
    yield from tail


def _comments(b: bytes, k: int, end: int):
    """Vendor and comments of a Vorbis comment block."""
    whole(k + 4 <= end, "no vendor")
    size = struct.unpack("<I", b[k : k + 4])[0]
    whole(k + 8 + size <= end, "vendor beyond its block")
    yield "comment", "VENDOR", k + 4, k + 4 + size, _text(b[k + 4 : k + 4 + size], "utf-8")
    k += 4 + size
    count = struct.unpack("<I", b[k : k + 4])[0]
    k += 4
    for _ in range(count):
        whole(k + 4 <= end, "comment beyond its block")
        size = struct.unpack("<I", b[k : k + 4])[0]
        whole(k + 4 + size <= end, "comment beyond its block")
        key, _, text = _text(b[k + 4 : k + 4 + size], "utf-8").partition("=")
        yield "comment", key.upper(), k + 4, k + 4 + size, text
        k += 4 + size


FLAC_BLOCKS = ("info", "padding", "application", "seektable", "vorbis", "cuesheet", "picture")


def flac(b: bytes):
    at, last = 0, False
    if b[:3] == b"ID3":
        for part in _id3v2(b):
            at = max(at, part[3] if part[0] == "ID3v2" else 0)
            yield part
    whole(b[at : at + 4] == b"fLaC", "no marker")
    at += 4
    while not last:
        whole(at + 4 <= len(b), "block beyond the end")
        kind, n = b[at] & 127, int.from_bytes(b[at + 1 : at + 4], "big")
        last, end = bool(b[at] & 128), at + 4 + n
        whole(end <= len(b), "block beyond the end")
        name = FLAC_BLOCKS[kind] if kind < len(FLAC_BLOCKS) else "block"
        if name == "info" and n != 34 or name == "seektable" and n % 18:
            name = "block"
        yield name, _text(b[at + 4 : at + 8]) if kind == 2 else "", at + 4, end, None
        if kind == 4:
            yield from _comments(b, at + 4, end)
        at = end
    whole(at == len(b) or b[at] == 0xFF and b[at + 1] & 0xFC == 0xF8, "no frame")
    yield from _tail_tags(b, at)


def ogg(b: bytes):
    """Comments of the first stream; pages are joined to packets for reading alone."""
    at, packet, n = 0, b"", 0
    while at < len(b):
        whole(b[at : at + 4] == b"OggS" and at + 27 <= len(b), "no page")
        sizes = b[at + 27 : at + 27 + b[at + 26]]
        whole(at + 27 + len(sizes) + sum(sizes) <= len(b), "page beyond the end")
        k = at + 27 + len(sizes)
        for size in sizes:
            if n < 2:
                packet += b[k : k + size]
                if size < 255:
                    for mark in (b"\x03vorbis", b"OpusTags"):
                        if packet.startswith(mark):
                            yield from ((kind, key, at, at, text) for kind, key, _, _, text in _comments(packet, len(mark), len(packet)))
                    packet, n = b"", n + 1
            k += size
        at = k


HOLDERS = {"moov", "trak", "mdia", "udta", "ilst", "minf", "stbl", "edts", "dinf", "mvex", "moof", "traf"}
SHOWN_TRACKS = ("vide", "soun", "text", "sbtl", "subt", "clcp")


_BOX = struct.Struct(">I4s")


def boxes(b: bytes, at: int, stop: int):
    """``(kind, start, body, end)`` of the boxes in a span."""
    while at + 8 <= stop:
        n, kind = _BOX.unpack_from(b, at)
        head = 8
        if n == 1 and at + 16 <= stop:
            n, head = struct.unpack(">Q", b[at + 8 : at + 16])[0], 16
        end = stop if n == 0 else at + n
        whole(at + head <= end <= stop, "box beyond its holder")
        yield kind.decode("latin-1"), at, at + head, end
        at = end


def _inside(b: bytes, at: int, stop: int, *path: str) -> tuple[int, int]:
    """Body of the first box at a path below a span, an empty one where there is none."""
    for name in path:
        at, stop = next(((body, end) for kind, _, body, end in boxes(b, at, stop) if kind == name), (stop, stop))
    return at, stop


def _table(b: bytes, span: tuple[int, int], code: str, skip: int = 4) -> list[tuple]:
    """Rows of a table box, each as ``code`` tells, behind version, flags and count."""
    at, stop = span
    if stop - at < skip + 4:
        return []
    n = struct.unpack(">I", b[at + skip : at + skip + 4])[0]
    whole(at + skip + 4 + n * struct.calcsize(">" + code) <= stop, "table beyond its box")
    return list(struct.iter_unpack(">" + code, b[at + skip + 4 : at + skip + 4 + n * struct.calcsize(">" + code)]))


def _samples(b: bytes, at: int, stop: int):
    """Spans of the chunks of a track whose body is given."""
    table = lambda name: _inside(b, at, stop, "mdia", "minf", "stbl", name)
    places = [x for x, in _table(b, table("stco"), "I")] or [x for x, in _table(b, table("co64"), "Q")]
    span = table("stsz")
    same, count = struct.unpack(">II", b[span[0] + 4 : span[0] + 12]) if span[1] - span[0] >= 12 else (0, 0)
    sizes = None if same else [x for x, in _table(b, span, "I", 8)]
    runs, first = _table(b, table("stsc"), "III"), 0
    whole(bool(places and runs) and (same > 0 or sum(sizes) > 0), "track without samples")
    for (start, each, _), (then, _, _) in zip(runs, [*runs[1:], (len(places) + 1, 0, 0)]):
        for k in range(start - 1, min(then - 1, len(places))):
            n = same * each if same else sum(sizes[first : first + each])
            first += each
            whole(places[k] + n <= len(b), "sample beyond the end")
            yield places[k], places[k] + n
    whole(first == (count if same else len(sizes)), "samples that are not placed")


def _described(b: bytes, at: int, stop: int, handler: str):
    """Names and unknown boxes in the sample descriptions of a track."""
    for _, start, body, end in boxes(b, at + 8, stop):
        k = end
        if handler == "vide" and end - start >= 86:
            yield "stsd", "compressor", start + 50, start + 82, None
            k = start + 86
        elif handler == "soun" and end - start >= 36:
            k = start + 36 + {1: 16, 2: 36}.get(int.from_bytes(b[start + 16 : start + 18], "big"), 0)
        try:
            for kind, x, _, z in boxes(b, k, end):
                yield "stsd", kind, x, z, None
                k = z
        except Damaged:
            pass
        if k < end:
            yield "stsd", "junk", k, end, None


def mp4(b: bytes):
    """Boxes, as ``(holder, box)``; what tracks hold that are not for eyes and ears is told as ``samples``."""
    todo = [(0, len(b), "", 0, "")]
    while todo:
        at, stop, path, depth, handler = todo.pop()
        whole(depth <= DEEPEST, "boxes too deep")
        holder = path.rpartition("/")[2]
        for kind, start, begin, end in boxes(b, at, stop):
            # Of boxes that hold boxes and of samples no bytes are read here.
            text, body = None, b"" if (kind in HOLDERS or kind == "mdat") and holder not in ("udta", "ilst") else b[begin : min(end, begin + 2**20)]
            at = end
            if kind in ("mvhd", "tkhd", "mdhd") and len(body) >= 20:
                wide = body[0] == 1
                text = str(int.from_bytes(body[4:12] if wide else body[4:8], "big"))
                scale, length = (body[20:24], body[24:32]) if wide else (body[12:16], body[16:20])
                if kind == "mvhd" and int.from_bytes(scale, "big"):
                    yield "technical", "Duration", start, start, clock(int.from_bytes(length, "big") / int.from_bytes(scale, "big"))
                size = struct.unpack(">II", body[-8:])
                if kind == "tkhd" and len(body) >= 84 and size[0]:
                    yield "technical", "Resolution", start, start, f"{size[0] >> 16}x{size[1] >> 16}"
            elif kind == "stsd" and len(body) >= 16:
                code = body[12:16].decode("latin-1")
                yield "technical", "Codec", start, start, CODECS.get(code, code)
                yield from _described(b, begin, end, handler)
            elif kind == "trak":
                x, z = _inside(b, begin, end, "mdia", "hdlr")
                text = handler = _text(b[x + 8 : x + 12]) if z - x >= 12 else "none"
                if handler not in SHOWN_TRACKS:
                    yield from (("samples", handler, x, z, None) for x, z in _samples(b, begin, end))
            elif kind == "hdlr" and end - begin > 24:
                yield "hdlr", "name", begin + 24, end, None
            elif kind == "dref":
                yield from (("dref", k, y + 4, z, None) for k, _, y, z in boxes(b, begin + 8, end) if z > y + 4)
            elif holder == "udta" and kind not in HOLDERS and kind != "meta" and len(body) > 4:
                text = _text(b[begin + 4 : begin + 4 + int.from_bytes(body[:2], "big")] if kind[0] == "©" else b[begin + 4 : end], "utf-8")
                place = re.match(r"([+-]\d+\.?\d*)([+-]\d+\.?\d*)", text) if kind == "©xyz" else None
                if place:
                    yield "place", "GPSLatitude", start, start, place[1]
                    yield "place", "GPSLongitude", start, start, place[2]
            elif holder == "ilst":
                text = _text(b[begin + 16 : end], "utf-8") if body[4:8] == b"data" and kind != "covr" else None
            yield holder or "file", kind, start, end, text
            if kind in HOLDERS:
                todo.append((begin, end, f"{path}/{kind}", depth + 1, handler))
            elif kind == "meta":
                todo.append((begin + (0 if body[4:8] == b"hdlr" else 4), end, f"{path}/meta", depth + 1, handler))
        whole(path != "" or at == stop, "bytes behind the last box")
        if path and at < stop:
            yield "junk", holder, at, stop, None


def heic(b: bytes):
    at = 0
    while at + 8 <= len(b):
        n, kind = struct.unpack(">I4s", b[at : at + 8])
        head = 16 if n == 1 else 8
        n = int.from_bytes(b[at + 8 : at + 16], "big") if n == 1 else n
        end = len(b) if n == 0 else at + n
        whole(at + head <= end <= len(b), "box beyond the end")
        name = kind.decode("latin-1")
        yield "file", name, at, end, _text(b[at + head : at + head + 4]) if name == "ftyp" else None
        if name == "meta" and b.find(b"Exif", at, end) >= 0:
            yield "marker", "Exif", at, at, None
        if re.search(rb"GPS|gps", b[at + head : min(end, at + head + 200)]):
            yield "marker", "GPS", at, at, None
        at = end


MEDIA = re.compile(r"/(?:media|embeddings)/[^/]*\.(?:jpe?g|png|webp|gif|tiff?|svg|docx|xlsx|pptx|pdf|mp4|mov|m4a|mp3|wav)$|^docProps/thumbnail\.(?:jpe?g|png)$", re.I)


_LISTED = struct.Struct("<4sBBHHHIIIIHHHHHII")


def _plain_members(b: bytes) -> dict[str, tuple] | None:
    """``(method, CRC-32, packed size, size, place, limit)`` of the members of a package by name.

    None where the package has anything that asks for more care: ``zipfile``
    takes several times as long for small ones, and reads all others.
    """
    if b[-22:-18] != b"PK\5\6":
        return None
    disk, first, here, count, size, at, comment = struct.unpack("<HHHHIIH", b[-18:])
    start = at
    if disk or first or comment or here != count or at + size != len(b) - 22:
        return None
    found = []
    while at + 46 <= start + size:
        mark, _, _, needed, flags, method, _, crc, packed, long, named, extra, said, _, _, _, place = _LISTED.unpack_from(b, at)
        name = b[at + 46 : at + 46 + named]
        at += 46 + named
        if mark != b"PK\1\2" or needed > 63 or flags & ~0x806 or method not in (0, 8) or extra or said or max(packed, long) >= 0x7FFFFFFF or not name.isascii() or b"\0" in name:
            return None
        found.append((name.decode(), method, crc, packed, long, place))
    limits = [f[5] for f in found[1:]] + [start]
    out = {f[0]: (*f[1:], limit) for f, limit in zip(found, limits)}
    return out if at == start + size and len(out) == count and all(f[5] < limit for f, limit in zip(found, limits)) else None


def _member(b: bytes, name: str, method: int, crc: int, packed: int, long: int, place: int, limit: int) -> bytes:
    """The data of a member of ``_plain_members``; where they do not hold, ``zipfile`` tells the fault."""
    if b[place : place + 4] == b"PK\3\4" and place + 30 <= limit:
        flags, named, extra = (int.from_bytes(b[place + k : place + k + 2], "little") for k in (6, 26, 28))
        start = place + 30 + named + extra
        if not flags & ~0x806 and b[place + 30 : place + 30 + named] == name.encode() and start + packed <= limit:
            try:
                data = zlib.decompress(b[start : start + packed], -15, long) if method else b[start : start + packed]
            except zlib.error:
                data = b""
            if len(data) == long and zlib.crc32(data) == crc:
                return data
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        return z.read(name)


def _elements(xml: bytes):
    """Elements of a document; of a damaged one those up to the fault, which is raised behind them."""
    try:
        return ElementTree.fromstring(xml).iter()
    except ElementTree.ParseError:  # rare, and slow for small documents
        return (x for _, x in ElementTree.iterparse(io.BytesIO(xml)))


def office(b: bytes):
    """Leaves of the property parts, and the members that hold media or other packages."""
    plain = _plain_members(b)
    with zipfile.ZipFile(io.BytesIO(b)) if plain is None else nullcontext() as z:
        for name in z.namelist() if plain is None else plain:
            if MEDIA.search(name):
                yield "media", name, 0, 0, None
            elif name in ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"):
                for leaf in _elements(z.read(name) if plain is None else _member(b, name, *plain[name])):
                    if not len(leaf) and (leaf.text or "").strip():
                        yield name, leaf.tag.rpartition("}")[2], 0, 0, leaf.text.strip()
