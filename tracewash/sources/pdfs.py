"""What a PDF tells about its making: objects resolved, names unescaped, strings found.

Strings are blanked where they stand.  Those inside compressed object streams,
and compressed XMP, are blanked in the stream, which is deflated anew to the
length that it had, so that no offset moves.
"""

from __future__ import annotations

import re
import zlib

from .walkers import Damaged, whole

_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[ \r\n\t]+(\d{1,5})[ \r\n\t]+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_TOKEN = re.compile(rb"(?:[\s\0]|%[^\r\n]*)*+(<<|>>|[\[\](]|<[0-9A-Fa-f\s]*>|/[^\s\0()<>\[\]{}/%]*|[^\s\0()<>\[\]{}/%]+|.)?", re.S)
_PLAIN = re.compile(rb"[-+.0-9]+|R|true|false|null|endobj|>>|[\[\]]")
#: A stream that grows beyond this many bytes is refused.
LARGEST = 2**29


def _string_end(b: bytes, at: int, stop: int) -> int:
    """The place of the bracket that ends the literal string whose text starts at ``at``."""
    depth = 1
    for m in re.compile(rb"\\.|[()]", re.S).finditer(b, at, stop):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    raise Damaged("string without end")


def _tokens(b: bytes, at: int, stop: int):
    """``(token, start, end)``; a literal string is one token with its brackets."""
    while at < stop:
        m = _TOKEN.match(b, at, stop)
        if m[1] is None:  # blanks and comments to the end
            return
        start, at = m.span(1)
        if m[1] == b"(":
            at = _string_end(b, at, stop) + 1
        yield b[start:at], start, at


def _name(token: bytes) -> str:
    if b"#" in token:
        token = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token)
    return token[1:].decode("latin-1")


def _dictionary(b: bytes, at: int, stop: int) -> dict[str, list]:
    """Keys of the dictionary that starts at or behind ``at``, with the tokens of their values."""
    out, depth, key = {}, 0, None
    for token, start, end in _tokens(b, at, stop):
        if not depth and token != b"<<":
            return out
        depth += {b"<<": 1, b"[": 1, b">>": -1, b"]": -1}.get(token, 0)
        if not depth:
            return out
        if depth == 1 and token[:1] == b"/" and (key is None or out[key]):
            key = _name(token)
            out[key] = []
        elif depth == 1 and token == b"<<":
            continue
        elif key is not None:
            out[key].append((token, start, end))
    return out


def _is(value: list, name: str) -> bool:
    return len(value) == 1 and value[0][0][:1] == b"/" and _name(value[0][0]) == name


def _text(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = token[1:-1]
        if raw[:2] == b"\xfe\xff" or b"\\376\\377" == raw[:8]:
            raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw)
            raw = re.sub(rb"\\(.)", rb"\1", raw, flags=re.S)
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if token[:1] == b"<":
        return raw.decode("latin-1")
    text = re.sub(r"\\([0-7]{1,3})", lambda m: chr(int(m[1], 8) & 255), raw.decode("latin-1"))
    return re.sub(r"\\([()\\])", r"\1", text)


def _inflated(data: bytes) -> bytes:
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(data, LARGEST)
    except zlib.error:
        raise Damaged("stream does not inflate") from None
    whole(not engine.unconsumed_tail, "stream too large")
    return out


class Objects:
    """Objects of a file by number, all versions, those in object streams too."""

    def __init__(self, b: bytes):
        self.b, self.spans, self.inner, self._read = b, {}, {}, {}
        starts = list(_OBJECT.finditer(b))
        for m, nxt in zip(starts, [*(x.start() for x in starts[1:]), len(b)]):
            self.spans.setdefault(int(m[1]), []).append((m.end(), nxt))
        for spans in self.spans.values():
            for at, stop in spans:
                if _STREAM.search(b, at, stop) and _is(self.dictionary(at, stop).get("Type", ()), "ObjStm"):
                    self._open(at, stop)

    def dictionary(self, at: int, stop: int) -> dict[str, list]:
        """``_dictionary`` of a span of the file, read once."""
        if (at, stop) not in self._read:
            self._read[at, stop] = _dictionary(self.b, at, stop)
        return self._read[at, stop]

    def stream(self, at: int, stop: int) -> tuple[int, int, dict]:
        """Span of a stream's data, and its dictionary."""
        m = _STREAM.search(self.b, at, stop)
        end = self.b.rfind(b"endstream", at, stop)
        whole(m is not None and m.end() <= end, "stream without end")
        return m.end(), end, self.dictionary(at, m.start())

    def data(self, at: int, stop: int) -> bytes | None:
        """A stream's data as it is meant, None behind filters that are not known."""
        start, end, entries = self.stream(at, stop)
        used = [_name(t) for t, *_ in entries.get("Filter", ()) if t[:1] == b"/"]
        if used and (used != ["FlateDecode"] or "DecodeParms" in entries):
            return None
        return _inflated(self.b[start:end]) if used else self.b[start:end]

    def _open(self, at: int, stop: int) -> None:
        start, end, entries = self.stream(at, stop)
        data = self.data(at, stop)
        whole(data is not None and "First" in entries, "object stream of an unknown kind")
        first = int(entries["First"][0][0])
        numbers = [int(x) for x in data[:first].split() if x.isdigit()]
        places = [*(first + x for x in numbers[1::2]), len(data)]
        for n, x, y in zip(numbers[::2], places, places[1:]):
            self.inner.setdefault(n, []).append((start, end, data, x, y))

    def entries(self, number: int) -> dict[str, list]:
        """The dictionary of the last version of an object; places are those of the file or of the object."""
        if number in self.spans:
            return self.dictionary(*self.spans[number][-1])
        body = self.body(number)
        return _dictionary(body, 0, len(body))

    def body(self, number: int) -> bytes:
        """The last version of an object."""
        if number in self.spans:
            at, stop = self.spans[number][-1]
            return self.b[at:stop]
        if number in self.inner:
            _, _, data, x, y = self.inner[number][-1]
            return data[x:y]
        return b""


def _strings(objects: Objects, tokens: list, key: str, source, seen: frozenset):
    """``(source, key, start, end, text)`` of the strings in a value, references followed.

    ``source`` is None where the value stands in the file itself, else the
    stream that holds it.
    """
    for k, (token, start, end) in enumerate(tokens):
        whole(source is not None or token[:1] in b"(</" or _PLAIN.fullmatch(token) is not None, "stray text in a dictionary")
        if token[:1] == b"(" or token[:1] == b"<" and token != b"<<":
            yield source, key, start + 1, end - 1, _text(token)
        elif token == b"R" and k >= 2 and tokens[k - 2][0].isdigit() and int(tokens[k - 2][0]) not in seen:
            number = int(tokens[k - 2][0])
            for at, stop in objects.spans.get(number, ()):
                stop = min((x for x in (objects.b.find(b"endobj", at, stop), objects.b.find(b"stream", at, stop)) if x >= 0), default=stop)
                yield from _strings(objects, list(_tokens(objects.b, at, stop)), key, None, seen | {number})
            for held in objects.inner.get(number, ()):
                yield from _strings(objects, list(_tokens(held[2], held[3], held[4])), key, held[:2], seen | {number})


def _made(objects: Objects):
    """Strings of all information dictionaries, as ``_strings`` gives them, and whether the file is encrypted."""
    b, trailers = objects.b, [m.end() for m in re.finditer(rb"\btrailer\b", objects.b)]
    for spans in objects.spans.values():
        trailers += [at for at, stop in spans if _is(objects.dictionary(at, stop).get("Type", ()), "XRef")]
    done, found, locked = set(), [], False
    for at in trailers:
        entries = _dictionary(b, at, len(b))
        locked |= "Encrypt" in entries
        info = entries.get("Info", [])
        if len(info) == 3 and info[2][0] == b"R":
            number = int(info[0][0])
            if number in done:
                continue
            done.add(number)
            holders = [(b, *span, None) for span in objects.spans.get(number, ())] + [(held[2], held[3], held[4], held[:2]) for held in objects.inner.get(number, ())]
        else:
            holders = [(b, info[0][1], len(b), None)] if info else []
        for data, start, stop, source in holders:
            for key, value in _dictionary(data, start, stop).items():
                found += _strings(objects, value, key, source, frozenset(done))
    # Dictionaries that no trailer names any more, of what is never in others.
    lost = [(b, *span, None) for n, spans in objects.spans.items() if n not in done for span in spans]
    lost += [(held[2], held[3], held[4], held[:2]) for n, some in objects.inner.items() if n not in done for held in some]
    for data, start, stop, source in lost:
        entries = objects.dictionary(start, stop) if data is b else _dictionary(data, start, stop)
        if "Type" not in entries and not {"Author", "Creator", "Producer", "CreationDate"}.isdisjoint(entries):
            for key, value in entries.items():
                found += _strings(objects, value, key, source, frozenset(done))
    return found, locked


def _packets(objects: Objects):
    """``(at, stop)`` of the objects that are streams of metadata."""
    for spans in objects.spans.values():
        for at, stop in spans:
            if _STREAM.search(objects.b, at, stop):
                entries = objects.dictionary(at, stop)
                if _is(entries.get("Subtype", ()), "XML") or _is(entries.get("Type", ()), "Metadata"):
                    yield at, stop


def pdf(b: bytes):
    """Strings of the information dictionary, XMP, pages and what looks redacted.

    ``stream`` is the data of a compressed stream that holds some of them; notes
    ``encrypted`` and ``compressed`` stand for what cannot be blanked.
    """
    whole(b.rfind(b"%%EOF") > max(b.rfind(b" obj"), b.rfind(b"trailer")), "no end of file")
    objects = Objects(b)
    found, locked = _made(objects)
    if locked:
        yield "note", "encrypted", 0, 0, None
    for source, key, start, end, text in found:
        yield "info", key, *((start, end) if source is None else (0, 0)), text
    streams = {source for source, *_ in found if source is not None}
    for at, stop in _packets(objects):
        start, end, entries = objects.stream(at, stop)
        packed = "Filter" in entries
        yield "xmp", "XMP", *((0, 0) if packed else (start, end)), None
        if packed and objects.data(at, stop) is None:
            yield "note", "compressed", 0, 0, None
        elif packed:
            streams.add((start, end))
    for start, end in sorted(streams):
        yield "stream", "", start, end, None
    pages = [page for n in sorted({*objects.spans, *objects.inner}) if _is((page := objects.entries(n)).get("Type", ()), "Page")]
    yield "technical", "Pages", 0, 0, str(len(pages))
    for n, page in enumerate(pages, 1):
        if _looks_redacted(objects, page):
            yield "page", "FakeRedaction", 0, 0, f"page {n}"


def _linked(objects: Objects, tokens: list) -> list[int]:
    """Numbers that a value refers to, those of an array that it refers to included."""
    out = [int(tokens[k][0]) for k in range(len(tokens) - 2) if tokens[k + 2][0] == b"R" and tokens[k][0].isdigit()]
    for n in list(out):
        body = objects.body(n)
        if body.lstrip()[:1] == b"[":
            out += [int(m[1]) for m in re.finditer(rb"(\d+)\s+\d+\s+R", body)]
    return out


def _looks_redacted(objects: Objects, page: dict) -> bool:
    notes = b" ".join(t for t, *_ in page.get("Annots", ())) + b" ".join(objects.body(n) for n in _linked(objects, page.get("Annots", [])))
    drawn = []
    for n in _linked(objects, page.get("Contents", [])):
        for at, stop in objects.spans.get(n, ())[-1:]:
            if _STREAM.search(objects.b, at, stop):
                try:
                    drawn.append(objects.data(at, stop) or b"")
                except Damaged:
                    pass
    drawn = b"\n".join(drawn)
    black = re.search(rb"\b0\s+0\s+0\s+r[gG]\b", drawn) and re.search(rb"\bre\s+[fFbB]", drawn)
    return bool((black or re.search(rb"/Subtype\s*/(?:Square|Highlight|StrikeOut)\b", notes)) and not re.search(rb"/Subtype\s*/Redact\b", notes))


def _deflated(data: bytes, size: int) -> bytes:
    """``data`` as a zlib stream of ``size`` bytes: blocks without content fill it up."""
    engine = zlib.compressobj(9)
    head = engine.compress(data) + engine.flush(zlib.Z_SYNC_FLUSH)
    tail = engine.flush()
    spare = size - len(head) - len(tail)
    if spare < 0:
        head, tail = b"", zlib.compress(data, 9)
        spare = size - len(tail)
        whole(spare >= 0, "stream grows")
        return tail + b"\n" * spare
    return head + b"\0\0\0\xff\xff" * (spare // 5) + tail + b"\n" * (spare % 5)


def emptied_streams(b: bytes) -> bytes:
    """``b`` with the strings blanked that stand in compressed streams, and compressed metadata."""
    objects = Objects(b)
    blanks = {}
    for source, _, start, end, _ in _made(objects)[0]:
        if source is not None:
            blanks.setdefault(source, []).append((start, end))
    for at, stop in _packets(objects):
        start, end, entries = objects.stream(at, stop)
        if "Filter" in entries:
            blanks[start, end] = None
    deflated = {objects.stream(*span)[0] for spans in objects.spans.values() for span in spans if _STREAM.search(b, *span) and "Filter" in objects.stream(*span)[2]}
    out = bytearray(b)
    for (start, end), spans in blanks.items():
        packed = start in deflated
        data = bytearray(_inflated(b[start:end]) if packed else b[start:end])
        for x, y in [(0, len(data))] if spans is None else spans:
            data[x:y] = b" " * (y - x)
        out[start:end] = _deflated(bytes(data), end - start) if packed else data
    return bytes(out)
