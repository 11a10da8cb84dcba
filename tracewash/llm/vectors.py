"""Near-duplicate vectors by spherical-cap filters with list decoding.

A filter is a direction; a vector belongs to the caps whose directions it
exceeds.  Directions are structured: after a random rotation each half of the
vector has a code of random unit words, and a direction is a pair of words, so
its product with the vector is a sum of two.  All directions above the cap
height are decoded: of the words whose best partner reaches it, sorted, each
takes its partners as far down as the sum holds, so that no other direction is
visited.  The height is the one that a random vector exceeds ``LIST`` times a
code; a vector that exceeds it fewer than ``LEAST`` times gets a lower one of
its own.  The number of directions follows the size of the largest label, so a
cap holds a quarter of a random vector of a label however large the table is.

Vectors of one label that share a cap are compared in double precision.  Equal
vectors are one node, counted by multiplicity.  Only numbers of caps and nodes
are counted and joined; vectors go to the caps that hold two or more.  A cap's
members are compared in numpy blocks and give only counts and one edge for each
linked member; a pair is counted in the first cap that it shares.  A cap with
more than ``TILE`` members is cut into tiles, so no task holds it whole; each
member is then sent once for each ``TILE`` members, as counting all links asks.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components, or whose label or ``vec_id`` is null, links with nothing; vectors
of different lengths do not link; rows that repeat are vectors of their own and
link with each other.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut

CODES, LIST, LEAST, TILE, SMALL = 2, 6, 8, 1000, 12
#: Sums that one block of vectors may hold at once.
BLOCK = 4_000_000


class Code:
    """The product codes for vectors of one length; equal on every executor."""

    def __init__(self, dim: int, directions: int):
        rng = np.random.default_rng(dim)
        self.half = (dim + 1) // 2
        self.words = max(LIST, int(np.ceil(directions**0.5)))
        self.codes = []
        for _ in range(CODES):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            self.codes.append((turn, [self._word_code(rng, n) for n in (self.half, dim - self.half)]))
        sample = _unit(rng.standard_normal((max(1, min(200, BLOCK // self.words)), dim)))
        #: The cap height of each code.
        self.heights = [float(np.median(self._best(*self._scores(code, sample), LIST))) for code in self.codes]

    def _word_code(self, rng, n: int) -> np.ndarray:
        if n < 2:  # there are only two words, or none
            return np.array([[1.0], [-1.0]])[: n + 1, :n]
        p = rng.standard_normal((self.words, n))
        return p / np.linalg.norm(p, axis=1, keepdims=True)

    def _scores(self, code, unit: np.ndarray) -> list[np.ndarray]:
        turn, parts = code
        turned = unit @ turn
        return [v @ p.T for p, v in zip(parts, (turned[:, : self.half], turned[:, self.half :]))]

    def _best(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """The ``k``-th best sum of each row: both its words are among the best ``k``."""
        a, b = (-np.partition(-x, min(k, x.shape[1]) - 1, axis=1)[:, :k] for x in (a, b))
        sums = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)
        return -np.partition(-sums, min(k, sums.shape[1]) - 1, axis=1)[:, :k].max(axis=1)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of all their caps, in order of both."""
        rows, caps = [], []
        for k, (code, height) in enumerate(zip(self.codes, self.heights)):
            a, b = self._scores(code, unit)
            low = np.minimum(height, self._best(a, b, LEAST))
            reach = lambda x, y: int((x >= (low - y.max(axis=1))[:, None]).sum(axis=1).max())  # noqa: B023, E731
            best, score = [], []
            for x, n in ((a, reach(a, b)), (b, reach(b, a))):
                top = np.argpartition(-x, n - 1, axis=1)[:, :n]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(x, top, 1), axis=1, kind="stable"), 1)
                best.append(top)
                score.append(np.take_along_axis(x, top, 1))
            for i in range(score[0].shape[1]):
                row, j = np.nonzero(score[0][:, i, None] + score[1] >= low[:, None])
                if not len(row):
                    break  # words come sorted, so none is left
                rows.append(row)
                caps.append(best[0][row, i].astype(np.int64) * self.words + best[1][row, j] + k * self.words**2)
        rows, caps = np.concatenate(rows), np.concatenate(caps)
        order = np.lexsort((caps, rows))
        return rows[order], caps[order]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _memberships(nodes: DataFrame, directions: int) -> DataFrame:
    """``label, dim, cap, node`` for every cap of every vector."""

    def run(batches):
        codes: dict[int, Code] = {}
        for batch in batches:
            label, node, vectors = (batch.column(k) for k in range(3))
            sizes = np.asarray(pa.compute.list_value_length(vectors))
            flat, starts = np.asarray(vectors.flatten(), np.float64), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                some = np.flatnonzero(sizes == dim)
                if dim not in codes:
                    codes[dim] = Code(int(dim), directions)
                code = codes[dim]
                step = max(1, min(2000, BLOCK // code.words))
                for lo in range(0, len(some), step):
                    at = some[lo : lo + step]
                    rows, caps = code.decode(_unit(flat[starts[at][:, None] + np.arange(dim)]))
                    took = pa.array(at[rows])
                    yield pa.RecordBatch.from_arrays([label.take(took), pa.array(np.full(len(took), dim, np.int32)), pa.array(caps), node.take(took)], ["label", "dim", "cap", "node"])

    return nodes.select("label", "node", "vector").mapInArrow(run, "label string, dim int, cap long, node long")


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Lists as rows of one length, filled up with -1."""
    n = np.asarray(pa.compute.list_value_length(lists))
    out = np.full((len(n), n.max(initial=0)), -1, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = np.asarray(lists.flatten())
    return out


def _links_of_run(unit, caps, block, cap, crossing, threshold):
    """Pairs of one cap's members that link and share no earlier cap."""
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    if crossing:
        keep = block[a] != block[b]
        a, b = a[keep], b[keep]
    if len(a):
        early = np.where(caps < cap, caps, -1)
        names, place = np.unique(early, return_inverse=True)
        held = np.zeros((len(unit), len(names)), np.float32)
        held[np.arange(len(unit))[:, None], place.reshape(early.shape)] = 1
        held[:, names < 0] = 0
        keep = (held @ held.T)[a, b] == 0
        a, b = a[keep], b[keep]
    return a, b


def _links_of_small(unit, caps, cap, starts, size, threshold):
    """The same for many caps of ``size`` members each."""
    i, j = np.triu_indices(size, 1)
    a, b = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
    keep = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
    a, b = a[keep], b[keep]
    out = []
    step = max(1, 20_000_000 // max(1, caps.shape[1] ** 2))
    for lo in range(0, len(a), step):
        x, y = a[lo : lo + step], b[lo : lo + step]
        same = (caps[x][:, :, None] == caps[y][:, None, :]) & ((caps[x] < cap[x][:, None]) & (caps[x] >= 0))[:, :, None]
        out.append(~same.any(axis=(1, 2)))
    keep = np.concatenate(out) if out else np.zeros(0, bool)
    return a[keep], b[keep]


def _compare(members: DataFrame, threshold: float) -> DataFrame:
    """``node, root, links`` from members sorted by tile within a partition."""

    def blocks(table):
        label = table.column("label").to_numpy(zero_copy_only=False)
        dim, cap, tile, block, node, many = (table.column(c).to_numpy() for c in ("dim", "cap", "tile", "block", "node", "many"))
        new = np.ones(len(cap), bool)
        new[1:] = (cap[1:] != cap[:-1]) | (tile[1:] != tile[:-1]) | (dim[1:] != dim[:-1]) | (label[1:] != label[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(cap))
        found = []
        for d in np.unique(dim):
            rows = np.flatnonzero(dim == d)
            at = np.full(len(dim), -1)
            at[rows] = np.arange(len(rows))
            pick = table.take(pa.array(rows))
            unit = _unit(pick.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(rows), -1))
            caps = _padded(pick.column("caps").combine_chunks())
            own = dim[starts] == d
            s, e = at[starts[own]], at[ends[own] - 1] + 1
            size = e - s
            whole = tile[starts[own]] < 0
            for n in np.unique(size[whole & (size <= SMALL)]):
                if n > 1:
                    a, b = _links_of_small(unit, caps, cap[rows], s[whole & (size == n)], n, threshold)
                    found.append((rows[a], rows[b]))
            for x, y, w in zip(s, e, whole):
                if y - x > 1 and not (w and y - x <= SMALL):
                    t = tile[rows[x]]
                    crossing = t >= 0 and t // 2**20 != t % 2**20
                    a, b = _links_of_run(unit[x:y], caps[x:y], block[rows[x:y]], cap[rows[x]], crossing, threshold)
                    found.append((rows[x + a], rows[x + b]))
        a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        # Within a cap the smallest linked partner is enough for components and
        # every pair is kept as counts only.
        run = np.cumsum(new) - 1
        links = np.zeros(len(cap), np.int64)
        np.add.at(links, a, many[b])
        np.add.at(links, b, many[a])
        root = np.arange(len(cap))
        changed = len(a) > 0
        while changed:  # smallest reachable row of the same cap
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            changed = not np.array_equal(before, root)
        got = np.flatnonzero(links)
        assert np.array_equal(run[got], run[root[got]])
        return pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(node[root[got]]), pa.array(links[got])], ["node", "root", "links"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            last = [table.column(c)[table.num_rows - 1].as_py() for c in ("label", "dim", "cap", "tile")]
            k = table.num_rows - 1  # the last run may go on in the next batch
            names = [table.column(c) for c in ("label", "dim", "cap", "tile")]
            while k > 0 and all(c[k - 1].as_py() == v for c, v in zip(names, last)):
                k -= 1
            rest = table.slice(k)
            if k:
                yield blocks(table.slice(0, k))
        if rest is not None:
            yield blocks(rest)

    return members.mapInArrow(run, "node long, root long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    given = vectors.schema["embedding"].dataType
    narrow = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)  # as exact, and half as wide
    vector = F.col("embedding") if narrow else F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    zero = F.lit(0.0).cast("float" if narrow else "double")
    content = F.md5(F.array_join(F.transform(vector, lambda x: (x + zero).cast("string")), ",").cast("binary"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(sound, F.lit(False)), F.concat_ws("|", F.col("label").cast("string"), content)).alias("key"), F.col("label").cast("string").alias("label"), vector.alias("vector"))
    groups = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = cut(groups.withColumn("node", F.monotonically_increasing_id()))
    largest = nodes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]

    # Caps with one member say nothing; large ones are cut into tiles.
    members = cut(_memberships(nodes, 4 * LIST * largest))
    sizes = members.groupBy("label", "dim", "cap").agg(F.count("*").alias("count")).where("count > 1")
    live = cut(members.join(sizes, ["label", "dim", "cap"]))
    held = live.groupBy("node").agg(F.collect_list("cap").alias("caps")).join(nodes.select("node", "many", "vector"), "node")
    live = live.withColumn("tiles", F.ceil(F.col("count") / TILE).cast("long"))
    live = live.withColumn("block", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tile = F.when(F.col("tiles") == 1, F.lit(-1).cast("long")).otherwise(F.least("block", "_o") * 2**20 + F.greatest("block", "_o"))
    live = live.select("label", "dim", "cap", tile.alias("tile"), "block", "node").join(held, "node").select("label", "dim", "cap", "tile", "block", "node", "many", "vector", "caps")
    parts = live.repartition(F.col("label"), F.col("dim"), F.col("cap"), F.col("tile")).sortWithinPartitions("label", "dim", "cap", "tile", "node")
    found = cut(_compare(parts, threshold))

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select("key", "node", "least", "many").join(label.withColumnRenamed("label", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_key = cut(named.join(least, "comp").join(linked, "node", "left").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")))
    out = rows.select("vec_id", "key").join(of_key, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
