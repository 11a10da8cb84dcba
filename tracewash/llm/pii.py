"""Personal data by pattern, and terms that disclose it by co-occurrence.

Patterns give the base spans (e-mail, IP, card, phone).  The information-
theoretic part then asks which other terms give a protected value away.  A term
near a value in several distinct contexts is compared with how often the term
occurs in the whole corpus.  All counts are occurrences in distinct texts: with
``N`` words in all, the term discloses the value when the pointwise mutual information ``log(both * N / (value * term))``
reaches the share ``disclosure`` of the value's own information
``log(N / value)``.  Such a term, wherever it stands, becomes a ``term`` span.
Sanitised text replaces base spans by their kind; disclosing terms are
generalised to a placeholder or removed.

Scale: only texts with copies are shuffled, once each; counting sends partial
counts by word and by (value, term, context); a frequent value or word is summed
before the shuffle.  Disclosing terms are not broadcast: a bit map of 16 bits a term,
16 MB at most, finds possible occurrences and a join on the term confirms them.

Defined results: a null text counts as empty and has no spans.  Copies of a
text count once and those of a context support no pair, so copying a document
neither discloses a term nor hides one.  Rows stay rows, whatever repeats;
``doc_id`` may be null and rows of one ``doc_id`` may differ in text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, packed

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of a value that are its context.
WINDOW = 6
#: Most bits of the map of disclosing terms, and bits of a block that one row holds.
BITS, BLOCK = 2**27, 2**15
FLUSH = 200_000

# The base patterns.  Digits are consumed whole, so no start is tried twice.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>#*$%&|"


def _emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` once: the run of local characters before it, then domains."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)`` of the pattern matches, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(map(_octet, parts)):
            out.append((m.start(), 1, m.end(), ".".join(p.lstrip("0") or "0" for p in parts)))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 10 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def term_of(word: str) -> str:
    return word.lower().strip(_EDGE)


def _overlaps(a: int, b: int, spans) -> bool:
    return any(s < b and a < e for s, _, e, _ in spans)


def contexts(text: str, spans) -> list[tuple[str, int, set[str]]]:
    """Value, number of its context and the terms within ``WINDOW`` words."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    out = []
    for a, kind, b, value in spans:
        lo, hi = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
        near = [w for w in words[max(0, lo - WINDOW) : hi + WINDOW] if not _overlaps(*w, spans)]
        found = [term_of(text[x:y]) for x, y in near]
        out.append((f"{KINDS[kind]}:{value}", zlib.crc32("\n".join(found).encode()), {t for t in found if len(t) > 1}))
    return out


def _copied_map(docs: DataFrame) -> bytes:
    """Bit map of the hashes of texts that occur more than once."""
    keys = docs.select(F.md5(F.col("text").cast("string").cast("binary")).alias("term")).where("term is not null")
    return _bit_map(keys.groupBy("term").agg(F.count("*").alias("n")).where("n > 1").select("term"))


def _maybe_copied(text: str, flat: bytes) -> bool:
    if not flat:
        return False
    k = _slot(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(), 8 * len(flat))
    return bool(flat[k >> 3] >> (k & 7) & 1)


def _distinct_counts(docs: DataFrame) -> DataFrame:
    """``_counts`` over distinct texts.

    Only texts that the bit map takes for copied are shuffled; the map is of
    bounded size, and one that is too small only has more texts shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(_copied_map(docs))

    def copied(batches):
        for batch in batches:
            keep = [t is not None and _maybe_copied(t, held.value) for t in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    once = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(copied, "text string").distinct()
    return _counts(docs, held).unionByName(_counts(once))


def _counts(docs: DataFrame, copied=None) -> DataFrame:
    """Partial counts: ``value`` null for a term, ``term`` null for a value; ``copied`` maps texts to pass over."""

    def run(batches):
        terms: Counter = Counter()

        def flush():
            keys = list(terms)
            n = len(keys)
            out = pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array(keys, pa.string()), pa.nulls(n, pa.int64()), pa.array(terms.values(), pa.int64())], ["value", "term", "context", "n"])
            terms.clear()
            return out

        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text or (copied is not None and _maybe_copied(text, copied.value)):
                    continue
                terms.update(w.strip(_EDGE) for w in _WORD.findall(text.lower()))
                spans = base_spans(text)
                if spans:
                    for value, number, near in contexts(text, spans):
                        rows.append((value, None, number, 1))
                        rows += [(value, t, number, 1) for t in near]
                if len(terms) >= FLUSH:
                    yield flush()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["value", "term", "context", "n"])
        if terms:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "value string, term string, context long, n long")


def disclosing_terms(docs: DataFrame, disclosure: float = 0.9, support: int = 3) -> DataFrame:
    """Terms that disclose some value: ``term, value, both, n_value, n_term``.

    ``support`` is the number of distinct contexts a pair needs.
    """
    counted = cut(_distinct_counts(docs).groupBy("value", "term", "context").agg(F.sum("n").alias("n")))
    n_term = counted.where("value is null and term <> ''").groupBy("term").agg(F.sum("n").alias("n_term"))
    total = n_term.agg(F.coalesce(F.sum("n_term"), F.lit(0))).first()[0]
    n_value = counted.where("value is not null and term is null").groupBy("value").agg(F.sum("n").alias("n_value"))
    both = counted.where("value is not null and term is not null").groupBy("value", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    mutual = F.log(F.col("both") * F.lit(float(total)) / (F.col("n_value") * F.col("n_term")))
    own = F.log(F.lit(float(total)) / F.col("n_value"))
    return both.join(n_value.hint("merge"), "value").join(n_term.hint("merge"), "term").where(mutual >= disclosure * own).select("term", "value", "both", "n_value", "n_term")


def _slot(term: str, bits: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % bits


def _bit_map(terms: DataFrame) -> bytes:
    """Set bits of the terms' slots, put together in tasks; empty without terms."""
    many = terms.count()
    if not many:
        return b""
    bits = min(BITS, max(2 * BLOCK, 2 ** (16 * many - 1).bit_length()))
    slot = F.crc32(F.col("term").cast("binary")) % bits
    blocks = terms.groupBy(F.floor(slot / BLOCK).alias("block")).agg(F.collect_set((slot % BLOCK).cast("int")).alias("slots"))  # BLOCK slots at most

    def run(batches):
        for batch in batches:
            out = []
            for slots in batch.column(1):
                flags = np.zeros(BLOCK, np.uint8)
                flags[np.asarray(slots.values)] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "flags"])

    flat = bytearray(bits // 8)
    for row in blocks.mapInArrow(run, "block long, flags binary").toLocalIterator():
        at = row.block * BLOCK // 8
        flat[at : at + BLOCK // 8] = row.flags
    return bytes(flat)


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _scan(rows: DataFrame, flat: bytes) -> DataFrame:
    """``rows`` with, for the last column ``text``, its base spans and the words that may be disclosing terms."""
    held = rows.sparkSession.sparkContext.broadcast(flat)
    keys = rows.columns[:-1]

    def run(batches):
        seen: dict[str, bool] = {}
        flat = held.value
        bits = 8 * len(flat)

        def listed(word: str) -> bool:
            hit = seen.get(word)
            if hit is None:
                if len(seen) >= FLUSH:
                    seen.clear()
                k = _slot(term_of(word), bits)
                hit = seen[word] = bool(flat[k >> 3] >> (k & 7) & 1)
            return hit

        for batch in batches:
            base, maybe = [], []
            for text in batch.column(len(keys)).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in spans])
                found = []
                if bits and any(map(listed, set(_WORD.findall(text)))):
                    for m in _WORD.finditer(text):
                        if listed(m[0]) and not _overlaps(m.start(), m.end(), spans):
                            lead = len(m[0]) - len(m[0].lstrip(_EDGE))
                            bare = m[0].strip(_EDGE)
                            found.append({"term": term_of(m[0]), "start": m.start() + lead, "end": m.start() + lead + len(bare)})
                maybe.append(found)
            span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            term = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(base, pa.list_(span)), pa.array(maybe, pa.list_(term))], [*keys, "base", "maybe"])

    schema = rows.drop("text").schema.add("base", T.DataType.fromDDL(_SPANS)).add("maybe", T.DataType.fromDDL("array<struct<term:string,start:int,end:int>>"))
    return rows.mapInArrow(run, schema)


def _confirmed(maybe: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """``key, terms``: the spans of ``maybe`` whose term is one of ``terms``, sorted."""
    hits = maybe.where(F.size("maybe") > 0).select(key, F.explode("maybe").alias("m")).join(terms.hint("merge"), F.col("m.term") == F.col("term"), "left_semi")
    return hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col("m.start").alias("start"), F.lit(4).alias("kind"), F.col("m.end").alias("end")))).alias("terms"))


def find(docs: DataFrame, disclosure: float = 0.9, support: int = 3) -> DataFrame:
    """Rows ``doc_id, base, terms``: arrays of ``(start, kind, end)``, sorted."""
    terms = cut(disclosing_terms(docs, disclosure, support).select("term").distinct())
    flat = _bit_map(terms)
    none = F.array().cast(_SPANS)
    rows = _scan(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), flat)
    if not flat:
        return rows.select("doc_id", "base", none.alias("terms"))
    rows = cut(rows)
    return rows.drop("maybe").join(_confirmed(rows, "rid", terms).hint("merge"), "rid", "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and the list of all spans."""
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *(count(k) for k in range(4)),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, disclosure: float = 0.9, support: int = 3, remove: bool = False) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; other columns stay.

    Base spans become ``[EMAIL]`` and so on; disclosing terms become ``[TERM]``
    or, with ``remove``, go.  ``n_chars`` follows the new text where it exists.
    Spans depend on the text alone, so those of terms come back by its hash.
    """
    terms = cut(disclosing_terms(docs, disclosure, support).select("term").distinct())
    flat = _bit_map(terms)
    rows = packed(docs, F.col("text").cast("string").alias("text"))
    if flat:
        key = F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key")
        maybe = _scan(docs.select(key, F.col("text").cast("string").alias("text")), flat).where(F.size("maybe") > 0)
        spans = _confirmed(maybe.groupBy("text_key").agg(F.first("maybe").alias("maybe")), "text_key", terms)
        rows = rows.select(key, "*").join(spans.hint("merge"), "text_key", "left").drop("text_key")

    listed = bool(flat)

    def run(batches):
        for batch in batches:
            new = []
            extra = batch.column(2).to_pylist() if listed else [None] * batch.num_rows
            for text, found in zip(batch.column(0).to_pylist(), extra):
                if text is None:
                    new.append(None)
                    continue
                cuts = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b, _ in base_spans(text)]
                cuts += [(s["start"], s["end"], "" if remove else "[TERM]") for s in found or []]
                out, end = [], 0
                for a, b, name in sorted(cuts):
                    if b <= end:
                        continue
                    if a >= end:
                        out += [text[end:a], name]
                    end = b
                new.append("".join([*out, text[end:]]))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column(1)], ["text", "_row"])

    out = rows.mapInArrow(run, rows.select("text", "_row").schema)
    length = F.length("text")
    new = {"text": F.col("text"), "n_chars": length}
    return out.select(*((new[f.name].cast(f.dataType) if f.name in new else F.col("_row")[f.name]).alias(f.name) for f in docs.schema))
