"""Near-duplicate documents by b-bit MinHash.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document
stands for the set of its distinct word shingles.  Minima of 160 hash functions
give 32 bands of five full minima for candidates; of each minimum only the two
low bits are kept in the packed signature, whose agreeing bit pairs, corrected
for chance agreement, estimate the similarity.  Estimates only prune: every
link is confirmed on the full sets.

How skew is met: documents with equal sets are one node; within a band bucket
each node is first compared with the bucket's hub only, the node that shares
most buckets, so a bucket gives rows in proportion to its size; the next hub
follows in buckets that still hold several components.  Joins by bucket deal
the members of a large bucket to tasks by parts of 1,000.  Pairs that the hubs
leave apart are then compared by size and by sharper signatures inside the
join, and come out of the first bucket that they share.  All joins merge: a
table of keys is small on disk and many times that where it is broadcast, and
broadcasts pass through the driver.

Defined results: a null or blank text has no shingles and links with nothing; a
null ``doc_id`` links with nothing and keeps a null component; repeated rows
are rows of their own with the same component.  Nodes are sets, not ids, so rows
that share a ``doc_id`` and differ in text are documents of their own.  Other
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
PER_LONG = 64 // BITS
#: Hash functions of the sharper signatures for what the hubs leave open.
SHARP = 1024
#: Standard errors below the threshold at which an estimate still passes.
MARGIN = 4.5
MEMO = 300_000
#: Hubs of a bucket that all its members are compared with.
HUBS = 2
#: Members of a bucket that one task gets; larger buckets are split.
SPLIT = 1000
#: Shingles whose sets a task keeps while it confirms pairs, 48 MB.
HELD = 6_000_000


class _Hashes(dict):
    """64-bit hash of a word; the memo is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, memo: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    memo = _Hashes() if memo is None else memo
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    width = min(width, len(found))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


@lru_cache(2)
def _functions(many: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, many, np.uint32) | np.uint32(1), rng.integers(0, 2**32, many, np.uint32)


def _minima(sets: list[np.ndarray], many: int = HASHES) -> np.ndarray:
    """Minima of ``many`` functions, a row for each set; no set is empty."""
    a, b = _functions(many)
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    low = np.concatenate(sets).astype(np.uint32)
    out = np.empty((len(sets), many), np.uint32)
    for k in range(many):
        x = low * a[k]
        x += b[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(x, at)
    return out


def _pack(minima: np.ndarray) -> np.ndarray:
    low = (minima & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(minima), -1, PER_LONG)
    return np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _bands(minima: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(minima), BANDS)).copy()
    parts = minima.astype(np.uint64).reshape(-1, BANDS, ROWS)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


class _Sets(dict):
    """Sets by node, emptied when they hold ``HELD`` shingles."""

    def __init__(self, width: int):
        super().__init__()
        self.width, self.words, self.held = width, _Hashes(), 0

    def of(self, node: int, text: str) -> np.ndarray:
        found = self.get(node)
        if found is None:
            if self.held >= HELD:
                self.clear()
                self.held = 0
            found = self[node] = shingles(text, self.width, self.words)
            self.held += len(found)
        return found


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def text_key():
    """With ``doc_id``, what tells rows apart: the hash of the text."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("text_key")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, signature, bands`` for every row."""

    def sketch(batches):
        memo = _Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, width, memo) for t in part.column(2).to_pylist()]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signature, bands = [None] * len(sets), [None] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    minima = _minima([sets[i] for i in full])
                    for i, s, k in zip(full, _pack(minima).view(np.int64), _bands(minima).view(np.int64)):
                        signature[i], bands[i] = s, k
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signature, longs), pa.array(bands, longs)],
                    ["doc_id", "text_key", "n_shingles", "set_key", "signature", "bands"],
                )

    schema = "doc_id long, text_key binary, n_shingles long, set_key binary, signature array<long>, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), text_key(), F.col("text").cast("string")).mapInArrow(sketch, schema)


def sharp_signatures(nodes: DataFrame, width: int) -> DataFrame:
    """``node, n_shingles, signature`` by ``SHARP`` functions."""

    def sketch(batches):
        memo = _Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, width, memo) for t in part.column(2).to_pylist()]
                packed = pa.array(list(_pack(_minima(sets, SHARP)).view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], ["node", "n_shingles", "signature"])

    return nodes.select("node", "n_shingles", "text").mapInArrow(sketch, "node long, n_shingles long, signature array<long>")


def estimate(a, b, many: int = HASHES):
    """Similarity from agreeing bit pairs, corrected for agreement by chance."""
    differ = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))),
    )
    chance = 2.0**-BITS
    return ((1 - differ / many) - chance) / (1 - chance)


def _least_estimate(share: float, many: int = HASHES) -> float:
    """The threshold less ``MARGIN`` standard errors of the estimate."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * share
    return share - MARGIN * (agree * (1 - agree) / many) ** 0.5 / (1 - chance)


def _close(percent: int, many: int = HASHES):
    """Sizes and signatures of ``u`` and ``v`` let the pair reach the threshold."""
    sizes = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    return sizes & (estimate(F.col("su"), F.col("sv"), many) >= _least_estimate(percent / 100, many))


def _signed(nodes: DataFrame, x: str) -> DataFrame:
    return nodes.select(F.col("node").alias(x), F.col("n_shingles").alias("n" + x), F.col("signature").alias("s" + x))


def _pruned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` that sizes and signatures leave."""
    return pairs.join(_signed(nodes, "u").hint("merge"), "u").join(_signed(nodes, "v").hint("merge"), "v").where(_close(percent)).select("u", "v")


def _verified(near: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs of ``near(u, v)`` whose full sets reach the threshold.

    ``nodes`` has the texts; Spark can split the join on a frequent ``v``.
    """
    text = nodes.select("node", "text")
    full = near.join(text.select(F.col("node").alias("u"), F.col("text").alias("tu")).hint("merge"), "u").join(text.select(F.col("node").alias("v"), F.col("text").alias("tv")).hint("merge"), "v")

    def confirm(batches):
        sets = _Sets(width)
        for batch in batches:
            keep = []
            for i, (u, v, tu, tv) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                a, b = sets.of(u, tu), sets.of(v, tv)
                both = _shared(a, b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["u", "v"])

    return full.select("u", "v", "tu", "tv").mapInArrow(confirm, "u long, v long")


def _each_part(buckets: DataFrame) -> DataFrame:
    """A row of ``buckets(band, parts, ...)`` for every part of its members."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def _open(member: DataFrame, label: DataFrame | None) -> DataFrame:
    """Members, with their labels, of the buckets that hold two or more."""
    if label is None:
        return member.withColumn("label", F.col("node"))
    known = member.drop("label").join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("band", "parts").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band", "parts")
    return cut(known.join(_each_part(mixed).hint("merge"), ["band", "part"], "left_semi"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Component of every document under links of ``percent`` similarity.

    Returns ``doc_id, n_shingles, component_id, kept, text_key, main`` for every
    row; ``component_id`` is the smallest ``doc_id`` that links reach.  ``main``
    marks the rows of each component that have its smallest ``doc_id`` and, of
    its texts, the one of the smallest ``text_key``; rows without a component
    are their own.
    """
    rows = cut(sketches(docs, width))
    sets = rows.where("doc_id is not null and set_key is not null")
    shared = rows.select("doc_id", "text_key", "n_shingles", "set_key")
    # A node is a set; one document stands for it.
    first = sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "bands")))
    first = cut(first.withColumn("node", F.monotonically_increasing_id()))
    band = first.select("node", F.explode("bands").alias("band"))
    some = band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    member = cut(band.join(some.hint("merge"), "band"))
    degree = member.groupBy("node").agg(F.sum("n").alias("degree"))
    order = F.struct("degree", F.xxhash64("node").alias("h"), "node")
    none = F.lit(None).cast("struct<degree:bigint,h:bigint,node:bigint>")
    # What a bucket's members are joined with by bucket is joined by parts of it.
    parts = F.ceil(F.col("n") / SPLIT).cast("long")
    part = F.pmod(F.xxhash64("node"), parts)
    member = cut(member.join(degree.hint("merge"), "node").select("band", "node", parts.alias("parts"), part.alias("part"), order.alias("order"), none.alias("last")))

    chosen = first.join(degree.select("node").hint("merge"), "node", "left_semi").select("node", "n_shingles", "signature", "least.*")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text"))
    nodes = cut(chosen.join(text.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["node"]).drop("doc_id", "text_key"))

    links, label = None, None
    for _ in range(HUBS):
        member = _open(member, label)
        top = member.where("last is null or order < last").groupBy("band", "parts").agg(F.max(F.struct("order", "label")).alias("top"))
        top = _each_part(top.select("band", "parts", F.col("top.order").alias("last"), F.col("top.label").alias("main")))
        member = cut(member.drop("last", "main").join(top.hint("merge"), ["band", "part"]))
        star = cut(member.where("order < last and label <> main").select(F.col("node").alias("u"), F.col("last.node").alias("v")).distinct())
        new = cut(_verified(_pruned(star, nodes, percent), nodes, width, percent))
        links = new if links is None else links.union(new)
        label = cut(components(links))

    # What the hubs leave open: pairs of a bucket that are still apart.
    known = _open(member.drop("main"), label).where("order < last")
    head = known.groupBy("band", "parts").agg(F.max(F.struct("order", "label"))["label"].alias("main"))
    known = cut(known.join(_each_part(head).hint("merge"), ["band", "part"]).select("band", "parts", "part", "node", "label", "main"))
    sharp = sharp_signatures(nodes.join(known.select("node").distinct().hint("merge"), "node", "left_semi"), width)
    sharp = cut(sharp.join(known.groupBy("node").agg(F.collect_set("band").alias("bands")).hint("merge"), "node"))
    side = lambda x: _signed(sharp, x).join(sharp.select(F.col("node").alias(x), F.col("bands").alias("b" + x)).hint("merge"), x)
    apart = known.where("label <> main").select("band", "parts", F.col("node").alias("u"), F.col("label").alias("lu")).join(side("u").hint("merge"), "u")
    other = known.select("band", "part", F.col("node").alias("v"), F.col("label").alias("lv"), "main").join(side("v").hint("merge"), "v")
    once = (F.col("lu") != F.col("lv")) & ((F.col("lv") == F.col("main")) | (F.col("u") < F.col("v")))
    apart = _each_part(apart)
    first_shared = apart["band"] == F.array_min(F.array_intersect("bu", "bv"))
    same = (apart["band"] == other["band"]) & (apart["part"] == other["part"])
    rest = cut(apart.join(other.hint("merge"), same & once & _close(percent, SHARP) & first_shared).select("u", "v"))
    more = cut(_verified(rest, nodes, width, percent))
    if not more.isEmpty():
        label = cut(components(links.union(more)))

    # A component is named by its smallest document.
    of_node = cut(first.join(label.hint("merge"), "node", "left").select("set_key", "least", F.coalesce("label", "node").alias("label")))
    several = of_node.groupBy("label").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1")
    # From a table of its own the join can be split where a label is frequent.
    several = cut(several.drop("n"))
    of_set = cut(of_node.join(several.hint("merge"), "label", "left").select("set_key", F.coalesce("first", "least").alias("first")))
    out = shared.join(of_set.hint("merge"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    main = kept & F.coalesce(F.col("text_key") == F.col("first.text_key"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_key", main.alias("main"))
