"""Walkers over formats that are text: mail and SVG; see ``walkers``.

No pattern here backtracks over more than one value, whatever its length.
"""

from __future__ import annotations

import re
from xml.parsers import expat

from .names import EMBEDDED, ENDINGS, HOME_NAMES, TELLING_ATTRIBUTES
from .walkers import DEEPEST, Damaged, whole

_HEADER = re.compile(rb"([^\r\n:]*):([^\r\n]*(?:\r?\n[ \t][^\r\n]*)*+)(?:\r?\n|$)")
_LINE = re.compile(rb"[^\r\n]*(?:\r?\n|$)")
#: What may stand behind a boundary in its line.
_EDGE = re.compile(rb"(?m)(?:--)?[ \t]*\r?$\n?")
_FOLD = re.compile(r"\r?\n[ \t]+")
_END = re.compile(rb"\r?\n\r?\n|\A\r?\n")


def _headers(b: bytes, at: int, end: int):
    """``(name, value, start, end)`` of the header lines in a span, unfolded."""
    while at < end:
        m = _HEADER.match(b, at, end)
        if m:
            value = m[2].decode("latin-1")
            yield m[1].decode("latin-1").strip(), (_FOLD.sub(" ", value) if "\n" in value else value).strip(), at, m.end()
        m = m or _LINE.match(b, at, end)
        if m.end() == at:
            return
        at = m.end()


def _parameter(value: str, name: str) -> str | None:
    found = re.search(name + r"""\s*=\s*(?:"([^"]*)"|([^\s;]+))""", value, re.I)
    return (found[1] or found[2]) if found else None


def _edges(b: bytes, mark: bytes, body: int, stop: int):
    """Spans of the lines of a body that hold a boundary; looked for by the mark, as few lines have one."""
    at = b.find(mark, body, stop)
    while at >= 0:
        m = _EDGE.match(b, at + len(mark), stop) if at == body or b[at - 1] == 10 else None
        if m:
            yield at, m.end()
        at = b.find(mark, m.end() if m else at + 1, stop)


def eml(b: bytes):
    """Headers, and the parts of a multipart body down to the innermost.

    ``embedded`` is the body of a part that is a file of a known kind, with its
    transfer encoding as text; the line end before a boundary is not part of it.
    """
    whole(b[:4] != b"\xd0\xcf\x11\xe0", "OLE container")
    todo = [(0, len(b), 0)]
    while todo:
        at, stop, depth = todo.pop()
        whole(depth <= DEEPEST, "parts too deep")
        m = _END.search(b, at, stop)
        head, body = (m.start() + (2 if b[m.start() : m.start() + 2] == b"\r\n" else 1), m.end()) if m else (stop, stop)
        mime, encoding, boundary, attached, name = "text/plain", "7bit", None, False, None
        for field, value, a, z in _headers(b, at, head):
            low = field.lower()
            yield "part header" if depth else "header", field, a, z, value
            if low == "content-type":
                mime = value.partition(";")[0].strip().lower()
                boundary, name = _parameter(value, "boundary"), name or _parameter(value, "name")
            elif low == "content-transfer-encoding":
                encoding = value.lower()
            elif low == "content-disposition":
                name = _parameter(value, "filename") or name
                attached = value.lower().startswith("attachment") or name is not None
        if mime.startswith("multipart/") and boundary:
            edges = list(_edges(b, b"--" + boundary.encode("latin-1"), body, stop))
            whole(bool(edges) and b[slice(*edges[-1])].rstrip().endswith(b"--"), "no last boundary")
            todo += [(x[1], y[0], depth + 1) for x, y in zip(edges[-2::-1], edges[:0:-1])]
            continue
        if not depth and not attached and mime not in EMBEDDED:
            continue
        kind = EMBEDDED.get(mime) or (ENDINGS.get((name or "").rpartition(".")[2].lower()) if mime == "application/octet-stream" else None)
        while stop > body and b[stop - 1] in b"\r\n":
            stop -= 1
        if kind and body < stop:
            yield "embedded", kind, body, stop, encoding
        if attached or kind == "eml":
            yield "attachment", mime, at, at, name


_IMAGE = re.compile(r"data:image/(jpe?g|png|webp|gif|svg\+xml);base64,([A-Za-z0-9+/=\s]*)")
_IMAGE_BYTES = re.compile(_IMAGE.pattern.encode())
_ATTRIBUTE = re.compile(r"""\s+([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_LOCAL = re.compile(r"(?i)^\s*(?:file:|[a-z]:[\\/]|/(?:home|users)/)")
_PLAIN_ENTITY = re.compile(r"https?://(?:www\.w3\.org|ns\.adobe\.com)/[\w./-]*")


def _events(b: bytes):
    """Events of a parser as ``[kind, start, end, data]`` over bytes of the file, and its encoding."""
    parser, events, said = expat.ParserCreate(), [], [None]
    parser.ordered_attributes = True

    def told(kind):
        return lambda *data: events.append([kind, parser.CurrentByteIndex, 0, data])

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = told("start"), told("end"), told("text")
    parser.CommentHandler, parser.ProcessingInstructionHandler, parser.EntityDeclHandler = told("comment"), told("instruction"), told("entity")
    parser.StartDoctypeDeclHandler, parser.EndDoctypeDeclHandler, parser.AttlistDeclHandler = told("doctype"), told("other"), told("attlist")
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler, parser.DefaultHandlerExpand = told("other"), told("other"), told("other")
    parser.XmlDeclHandler = lambda version, encoding, alone: said.__setitem__(0, encoding)
    try:
        parser.Parse(b, True)
    except expat.ExpatError as e:
        raise Damaged(str(e)) from None
    after = len(b)
    for k in range(len(events) - 1, -1, -1):  # an event ends where the next one further on starts
        if k + 1 < len(events) and events[k + 1][1] > events[k][1]:
            after = events[k + 1][1]
        events[k][2] = after
    encoding = {b"\xff\xfe": "utf-16-le", b"<\0": "utf-16-le", b"\xfe\xff": "utf-16-be", b"\0<": "utf-16-be"}.get(b[:2]) or said[0] or "utf-8"
    return events, encoding


def _one_line(text: str) -> str:
    return " ".join(text.split())


def svg(b: bytes):
    """What an SVG tells, from the events of a parser, in any encoding.

    Names are told apart by their namespaces, whatever prefix they have; that of
    the root is at home.  A document type with entities other than names of
    namespaces gives the note ``unknown``.
    """
    events, encoding = _events(b)
    size = lambda text: len(text.encode(encoding))
    scopes, opened, home = [{"xml": "http://www.w3.org/XML/1998/namespace"}], [], None
    for kind, start, end, data in events:
        if kind == "start":
            names, values = data[1][::2], data[1][1::2]
            stated = dict(zip(names, values))
            own = {n[6:]: v for n, v in stated.items() if n.startswith("xmlns") and n[5:6] in ("", ":")}
            scope = {**scopes[-1], **own} if own else scopes[-1]
            scopes.append(scope)
            space = lambda name: scope.get(name.rpartition(":")[0], "")  # noqa: E731, B023

            def shown(name):
                prefix, _, local = name.rpartition(":")
                prefix = HOME_NAMES.get(scope.get(prefix, ""), prefix)  # noqa: B023
                return f"{prefix}:{local}" if prefix and local else prefix or local

            here = space(data[0])
            home = here if home is None else home
            opened.append((data[0], shown(data[0]), here, start, []))
            if not names:  # what looks like attributes in a tag are its attributes, and it has none
                continue
            tag = b[start:end].decode(encoding)
            even = len(tag) == end - start  # a byte for each character
            for m in _ATTRIBUTE.finditer(tag):
                name, value = m[1], _one_line(stated.get(m[1], ""))
                a = start + (m.start() if even else size(tag[: m.start()]))
                z = a + (m.end() - m.start() if even else size(m[0]))
                here = shown(name) if ":" in name else name
                if name.startswith("xmlns:"):
                    if scope[name[6:]] not in (home, "http://www.w3.org/1999/xlink", scopes[0]["xml"]):
                        yield "namespace", "", a, z, None
                elif name == "xmlns":
                    continue
                elif name[:2].lower() == "on" or value.lower().startswith("javascript:"):
                    yield "script", "", a, z, None
                elif ":" in name and space(name) not in (home, "http://www.w3.org/1999/xlink", scopes[0]["xml"]) or name.startswith("data-") or here in TELLING_ATTRIBUTES or _LOCAL.match(value):
                    yield "attribute", here, a, z, value
        elif kind == "end":
            scopes.pop()
            name, here, space_of, a, texts = opened.pop()
            z, prefix = end, here.rpartition(":")[0]
            if opened:
                opened[-1][4].extend(texts)
            local = name.rpartition(":")[2] if space_of == home else ""
            text = _one_line("".join(texts).replace("\0", " ")) if local in ("title", "desc") or prefix == "dc" else None
            if local in ("metadata", "script"):
                yield local, "", a, z, None
            elif local in ("title", "desc"):
                yield local, "", a, z, text
            elif here == "rdf:RDF":
                yield "rdf", "", a, z, None
            elif prefix == "dc":
                yield "dc", here, a, z, text
            elif here == "cc:license":
                yield "license", "", a, z, None
            elif space_of != home:
                yield "editor", here, a, z, None
        elif kind == "text":
            if opened:
                opened[-1][4].append(data[0])
        elif kind in ("comment", "instruction"):
            yield kind, "", start, end, _one_line(data[-1])
        elif kind == "entity" and not _PLAIN_ENTITY.fullmatch(data[2] or "") or kind == "attlist":
            yield "note", "unknown", 0, 0, None
    if encoding.startswith("utf-16"):
        text = b.decode(encoding)
        for m in _IMAGE.finditer(text):
            a = size(text[: m.start(2)])
            yield "embedded", {"jpg": "jpeg", "svg+xml": "svg"}.get(m[1], m[1]), a, a + size(m[2]), f"base64:{encoding}"
    else:
        for m in _IMAGE_BYTES.finditer(b):
            yield "embedded", {b"jpg": "jpeg", b"svg+xml": "svg"}.get(m[1], m[1].decode()), m.start(2), m.end(2), "base64"
