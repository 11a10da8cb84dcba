"""Formats by kind: those of the library, those that users add, and their name in SQL.

``add_format`` makes a format known everywhere at once: to the choice of a kind
by name or MIME type, to the table function, to items and to cleaning.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import udtf


@dataclass(frozen=True)
class Format:
    """A kind of file.

    ``walker`` yields ``(kind, key, start, end, text)`` over the bytes of a file
    and raises where its structure does not hold.  ``risk`` gives a part's risk,
    null where it is no metadata; ``edit`` gives what is done to it, as
    ``cleaning.edit`` does, null where it stays.  Both take a part as a column of
    ``kind, key, start, end, text``.  Without ``edit`` the kind is not cleaned.
    """

    kind: str
    endings: str
    walker: Callable[[bytes], Iterable[tuple]]
    mime: str = "$^"
    magic: str | None = None
    risk: Callable[[Column], Column] | None = None
    edit: Callable[[Column], Column] | None = None


ADDED: dict[str, Format] = {}


def add_format(new: Format) -> None:
    """Make a format known; ``endings`` and ``mime`` are patterns, ``magic`` the first bytes in hexadecimal.

    A kind of the library cannot be replaced, one that was added can.
    """
    from .files import KINDS

    if new.kind in walkers_by_kind() and new.kind not in ADDED or any(new.kind == k for k, *_ in KINDS):
        raise ValueError(f"{new.kind} is a kind of the library")
    ADDED[new.kind] = new


def remove_format(kind: str) -> None:
    ADDED.pop(kind, None)


def walkers_by_kind() -> dict[str, Callable[[bytes], Iterable[tuple]]]:
    """The walker of each kind; sound has one for each ending."""
    from . import pdfs, texts, walkers

    out = {n: getattr(walkers, n) for n in ("png", "gif", "tiff", "jpeg", "mp3", "flac", "ogg", "heic", "office")}
    out |= {"eml": texts.eml, "svg": texts.svg, "pdf": pdfs.pdf, "webp": walkers.riff, "wav": walkers.riff, "wave": walkers.riff}
    out |= {"video": walkers.mp4, "m4a": walkers.mp4, "aac": walkers.mp3, "oga": walkers.ogg}
    return out | {kind: f.walker for kind, f in ADDED.items()}


def _walker_of(name: str):
    """The walker for a file of this name, None where there is none."""
    from .files import KINDS

    known = walkers_by_kind()
    ending = (name or "").rpartition(".")[2].lower()
    for kind, _, endings in (*KINDS, *((f.kind, f.mime, f.endings) for f in ADDED.values())):
        if re.fullmatch(endings, ending):
            return known.get(ending if kind == "audio" else kind)
    return None


def register(spark: SparkSession) -> None:
    """Make ``metadata_parts(name, content)`` known to SQL, with the formats added so far.

    It gives the parts of one file, for ``LATERAL metadata_parts(name, content)``;
    a damaged file ends with a row ``error``.
    """
    added = dict(ADDED)

    @udtf(returnType="ord int, kind string, key string, start int, end int, text string")
    class MetadataParts:
        def eval(self, name: str, content: bytes):
            from tracewash.sources import registry  # the module of the worker, not a copy of it

            registry.ADDED.update(added)
            n, walker = 0, registry._walker_of(name)
            try:
                for kind, key, start, end, text in walker(bytes(content or b"")) if walker else ():
                    yield n, kind, key, start, end, text
                    n += 1
            except Exception as e:
                yield n, "error", type(e).__name__, 0, 0, str(e)

    spark.udtf.register("metadata_parts", MetadataParts)
