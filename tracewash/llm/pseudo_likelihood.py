"""Documents scored by masked pseudo-likelihood.

A small bidirectional network predicts every word from ``SIDE`` words on either
side, the word itself being masked: embeddings, scaled by position, are added up
and pass through tanh, and three softmaxes give the word's number digit by
digit, each knowing the digits before it.  The ``OWN`` most frequent words have
a number each; the others share the ``SHARED`` numbers left by hash, and of a
shared number a word has the part that it has in the corpus's counts.  A word's
log probability is that of its number, given the words around it, plus the log
of its part.  The score of a document is the sum over its words.

Training starts from the corpus's word counts as biases, so that the network
only has to learn what context adds.  A hash of ``doc_id`` and text deals the
documents to rounds and, within a round, to groups of about ``GROUP`` words;
every document is trained on once, all its words being targets.  A group is
trained in numpy in the order of the hash, from the parameters that the round
starts with, and the parameters of all groups, weighted by words, are averaged
in blocks by two shuffles; only the average, whose size is fixed, reaches the
driver.  Neither input splits nor lost tasks change the result.

The vocabulary grows with the corpus and stays in tables.  At most ``COMMON``
words of at most ``LONGEST`` bytes, the most frequent, are broadcast with their
parts; the others of each document are joined with the vocabulary by word.

Defined results: a null or blank text has no words, the score 0 and no mean;
rows that repeat get equal scores; an empty table trains nothing and scores
nothing.  A word that a given vocabulary lacks counts as seen once more beside
those of its number.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BASE = 32  # of the three digits of a word's number
WORDS = BASE**3
SHARED = 4096
OWN = WORDS - SHARED
SIDE, WIDTH, ROUNDS = 2, 8, 2
BATCH, RATE, MEMO = 16_384, 0.2, 300_000
GROUP = (1_000_000, 32_000_000)  # words of a group, at least and at most
BLOCK = 2**15
COMMON, LONGEST = 200_000, 64
_FINE = 2.0**30  # parts are added up as whole numbers, so that their order doesn't matter
_SHIFTS = np.array([k for k in range(-SIDE, SIDE + 1) if k])

SHAPES = {
    "embed": (WORDS + 1, WIDTH),
    "scale": (len(_SHIFTS), WIDTH),
    "bias": (WIDTH,),
    "first": (WIDTH, BASE),
    "first_bias": (BASE,),
    "second": (BASE, WIDTH, BASE),
    "second_bias": (BASE, BASE),
    "third": (BASE * BASE, WIDTH, BASE),
    "third_bias": (BASE * BASE, BASE),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


@dataclass
class Vocabulary:
    """``words``: table ``word, number, n`` of all words; the rest is of bounded size.

    ``least`` is the count from which words are in ``common``, which holds the
    number of each and its place in ``parts``; ``totals`` are counts by number.
    """

    words: DataFrame
    least: int
    common: dict[bytes, int]
    parts: np.ndarray
    totals: np.ndarray


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(totals: np.ndarray) -> np.ndarray:
    """Parameters that give each number its share of ``totals``, whatever the context."""
    rng = np.random.default_rng(8)
    flat = np.zeros(SIZE, np.float32)
    p = views(flat)
    p["embed"][...] = rng.standard_normal(SHAPES["embed"]) * 0.1
    p["first"][...] = rng.standard_normal(SHAPES["first"]) * 0.1
    p["scale"][...] = 1
    seen = totals.reshape(BASE, BASE, BASE) + 0.1
    for name, x in (("third_bias", seen.reshape(-1, BASE)), ("second_bias", seen.sum(2)), ("first_bias", seen.sum((1, 2)))):
        p[name][...] = np.log(x / x.sum(-1, keepdims=True))
    return flat


class Numbers(dict):
    """Number of a word, plus ``WORDS`` times its place among the parts, 0 if it isn't common."""

    def __init__(self, common: dict[bytes, int] | None = None):
        super().__init__()
        self.common = common or {}

    def __missing__(self, word: bytes) -> int:
        n = self.common.get(word)
        if n is None:
            n = shared_number(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = n
        return n


def shared_number(word: bytes) -> int:
    return OWN + xxhash.xxh3_64_intdigest(word) % SHARED


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in one array with gaps between them, and the words' places."""
    gap = np.full(SIDE, WORDS, np.int64)
    line = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    lengths = np.array([len(d) for d in docs], np.int64)
    return line, np.arange(lengths.sum()) + SIDE + np.repeat(np.arange(len(docs)) * SIDE, lengths)


def _hidden(p: dict, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near = line[at + _SHIFTS[:, None]]
    seen = p["embed"].take(near, axis=0)
    return near, seen, np.tanh(np.einsum("kh,knh->nh", p["scale"], seen) + p["bias"])


def _by(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by ``rows``, and ``rows`` in it; numbers up to 16 bits sort by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    return order, rows[order]


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one row start in sorted ``rows``, and with the end behind them."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return first, np.append(first, len(rows))


def _by_runs(rows: np.ndarray, product, out: np.ndarray) -> np.ndarray:
    """Adds ``product(row, i, j)`` to ``out[i:j]`` for each run of one row in sorted ``rows``."""
    first, ends = _runs(rows)
    for row, i, j in zip(rows[first].tolist(), ends.tolist(), ends[1:].tolist()):
        out[i:j] += product(row, i, j)
    return out


def _logits(p: dict, h: np.ndarray, number: np.ndarray):
    """Rows, wanted digits and logits of the three softmaxes; numbers come sorted by their first digits."""
    a, ab = number >> 10, number >> 5
    yield None, a, h @ p["first"] + p["first_bias"]
    for name, row, want in (("second", a, ab & 31), ("third", ab, number & 31)):
        yield row, want, _by_runs(row, lambda r, i, j: h[i:j] @ p[name][r], p[name + "_bias"].take(row, axis=0))  # noqa: B023


def log_probabilities(p: dict, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at))
    for lo in range(0, len(at), BATCH):
        some = at[lo : lo + BATCH]
        order = _by(line[some] >> 5)[0]
        some = some[order]
        total = 0.0
        for _, want, x in _logits(p, _hidden(p, line, some)[2], line[some]):
            x -= max(x.max() - 60, 0)  # far from overflow
            total = total + x[np.arange(len(some)), want] - np.log(np.exp(x).sum(axis=1))
        out[lo + order] = total
    return out


def _step(target: np.ndarray, squares: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
    """Adagrad."""
    squares[rows] += grad * grad
    target[rows] -= RATE * grad / np.sqrt(squares[rows])


def _through(h: np.ndarray, g: np.ndarray, w: np.ndarray, rows: np.ndarray, ends: np.ndarray, back: np.ndarray) -> np.ndarray:
    """``h.T @ g`` of each run; adds ``g @ w[row].T`` to ``back``.  Runs of one row go all at once."""
    out = h.take(ends[:-1], axis=0)[:, :, None] * g.take(ends[:-1], axis=0)[:, None, :]
    long = np.diff(ends) > 1
    for k, row, i, j in zip(np.flatnonzero(long).tolist(), rows[long].tolist(), ends[:-1][long].tolist(), ends[1:][long].tolist()):
        part = g[i:j]
        np.matmul(h[i:j].T, part, out=out[k])
        back[i:j] += part @ w[row].T
    one = ends[:-1][~long]
    if len(one):
        back[one] += np.matmul(w.take(rows[~long], axis=0), g.take(one, axis=0)[:, :, None])[:, :, 0]
    return out


def train(p: dict, squares: dict, line: np.ndarray, at: np.ndarray) -> None:
    """One pass over the words at ``at``, changing ``p`` and ``squares``."""
    for lo in range(0, len(at), BATCH):
        some = at[lo : lo + BATCH]
        some = some[_by(line[some] >> 5)[0]]
        near, seen, h = _hidden(p, line, some)
        errors = []
        for row, want, x in _logits(p, h, line[some]):
            x -= max(x.max() - 60, 0)
            np.exp(x, out=x)
            x /= x.sum(axis=1, keepdims=True)
            x[np.arange(len(some)), want] -= 1
            errors.append((row, x))
        (_, g), (a, ga), (ab, gab) = errors
        back, steps = g @ p["first"].T, []
        for name, row, error in (("second", a, ga), ("third", ab, gab)):
            first, ends = _runs(row)
            steps.append((name, row[first], _through(h, error, p[name], row[first], ends, back), np.add.reduceat(error, first, axis=0)))
        back *= 1 - h * h
        _step(p["first"], squares["first"], h.T @ g)
        _step(p["first_bias"], squares["first_bias"], g.sum(0))
        for name, rows, grad, grad_bias in steps:
            _step(p[name], squares[name], grad, rows)
            _step(p[name + "_bias"], squares[name + "_bias"], grad_bias, rows)
        _step(p["bias"], squares["bias"], back.sum(0))
        grads = p["scale"][:, None, :] * back
        _step(p["scale"], squares["scale"], np.einsum("nh,knh->kh", back, seen))
        order, rows = _by(near.ravel())
        first, _ = _runs(rows)
        _step(p["embed"], squares["embed"], np.add.reduceat(grads.reshape(-1, WIDTH).take(order, axis=0), first, axis=0), rows[first])


# -- Counting -----------------------------------------------------------------


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(map(shared_number, counts), pa.int32()), pa.array(counts.values(), pa.int64())], ["word", "number", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) >= MEMO:
                    yield flush()
        if counts:
            yield flush()

    partial = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, number int, n long")
    return partial.groupBy("word", "number").agg(F.sum("n").alias("n"))


def _least_common(short: DataFrame) -> int:
    """The least count, to an eighth of an octave, that at most ``COMMON`` words reach."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    held, least = 0, 2**62
    for row in sorted(short.groupBy(step).count().collect(), reverse=True):  # 500 rows at most
        held += row["count"]
        if held > COMMON:
            break
        least = int(np.ceil(2 ** (row["step"] / 8) - 1e-9))
    return least


def vocabulary(docs: DataFrame, own: int = OWN) -> Vocabulary:
    """Every word with its count, and the bounded tables of the frequent ones; ``own`` words, ``OWN`` at most, get a number each."""
    words = cut(_word_counts(docs))
    short = words.where(F.octet_length("word") <= LONGEST)
    least = _least_common(short)
    totals = np.zeros(WORDS, np.int64)
    for row in words.groupBy("number").agg(F.sum("n").alias("n")).collect():  # SHARED rows at most
        totals[row.number] = row.n
    rows = sorted(((-r.n, bytes(r.word), r.number) for r in short.where(F.col("n") >= least).select("word", "number", "n").collect()))  # COMMON rows at most
    for k, (n, _, number) in enumerate(rows[:own]):
        totals[k], totals[number] = -n, totals[number] + n
    common = {word: (k if k < own else number) + WORDS * (k + 1) for k, (_, word, number) in enumerate(rows)}
    parts = [0] + [0 if k < own else round(np.log(-n / totals[number]) * _FINE) for k, (n, _, number) in enumerate(rows)]
    return Vocabulary(words, least, common, np.array(parts, np.int64), totals)


def _unpacked(numbers: pa.Scalar) -> np.ndarray:
    return np.frombuffer(numbers.as_buffer(), np.uint16).astype(np.int64)


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """Documents as numbers of two bytes each, written once for training and scoring.

    ``parts`` is the sum over common words, ``rare`` has the other words.
    """
    held = docs.sparkSession.sparkContext.broadcast((known.common, known.parts))  # COMMON short words

    def coded(part: pa.RecordBatch, memo: Numbers, parts: np.ndarray) -> pa.RecordBatch:
        lengths, numbers, shares, rare, ends = [], [], [], ([], [], []), [0]
        for text in part.column(3).to_pylist():
            words = words_of(text)
            found = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
            place, number = found >> 15, (found & (WORDS - 1)).astype(np.uint16)
            lengths.append(len(words))
            numbers.append(number.tobytes())
            shares.append(int(parts[place].sum()))
            at = np.flatnonzero(place == 0).tolist()
            of = dict(zip([words[i] for i in at], number[at].tolist()))
            seen = Counter([words[i] for i in at])
            for column, values in zip(rare, (seen.keys(), map(of.__getitem__, seen), seen.values())):
                column += values
            ends.append(len(rare[0]))
        kind = ((pa.binary(), "word"), (pa.int32(), "number"), (pa.int64(), "k"))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, t) for x, (t, _) in zip(rare, kind)], [n for _, n in kind]))
        new = [pa.array(lengths, pa.int64()), pa.array(numbers, pa.binary()), pa.array(shares, pa.int64()), listed]
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), *new], ["rid", "key", "doc_id", "n_words", "numbers", "parts", "rare"])

    def run(batches):
        common, parts = held.value
        memo = Numbers(common)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                yield coded(batch.slice(lo, 256), memo, parts)

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"))
    schema = "rid long, key long, doc_id long, n_words long, numbers binary, parts long, rare array<struct<word:binary,number:int,k:long>>"
    return cut(rows.mapInArrow(run, schema))


# -- Training -----------------------------------------------------------------


def _groups(batches):
    """Runs of one group, sorted by it, as lists of documents of bounded size."""
    held, size, now = [], 0, None
    for batch in batches:
        for group, numbers in zip(batch.column(0).to_pylist(), batch.column(2)):
            if held and (group != now or size >= 4 * BATCH):
                yield now, held
                held, size = [], 0
            now = group
            held.append(_unpacked(numbers))
            size += len(held[-1])
    if held:
        yield now, held


def _blocks(group: int, seen: int, flat: np.ndarray) -> pa.RecordBatch:
    blocks = [flat[k : k + BLOCK] * np.float32(seen) for k in range(0, SIZE, BLOCK)]
    n = len(blocks)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int32()), pa.array([group] * n, pa.int64()), pa.array([float(seen)] * n), pa.array(blocks, pa.list_(pa.float32()))],
        ["block", "part", "weight", "total"],
    )


def _added(batches):
    """Sums of rows that share ``block`` and ``part``, which come sorted."""
    now = None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([now[2]]), pa.array([now[3].astype(np.float32)], pa.list_(pa.float32()))], ["block", "part", "weight", "total"])

    for batch in batches:
        for block, part, weight, total in zip(*(batch.column(k).to_pylist() for k in range(3)), (np.asarray(x.values) for x in batch.column(3))):
            if now and now[:2] == [block, part]:
                now[2] += weight
                now[3] = now[3] + total
            else:
                if now:
                    yield row()
                now = [block, part, weight, total.astype(np.float64)]
    if now:
        yield row()


def _train_round(dealt: DataFrame, groups: int, flat: np.ndarray) -> np.ndarray:
    held = dealt.sparkSession.sparkContext.broadcast(flat)  # SIZE floats

    def run(batches):
        flat = held.value
        group, seen, own, p, squares = None, 0, None, None, None
        for now, found in _groups(batches):
            if now != group:
                if seen:
                    yield _blocks(group, seen, own)
                group, seen, own = now, 0, flat.copy()
                p, squares = views(own), views(np.full(SIZE, 1.0, np.float32))
            line, at = laid_out(found)
            train(p, squares, line, at)
            seen += len(at)
        if seen:
            yield _blocks(group, seen, own)

    schema = "block int, part long, weight double, total array<float>"
    sent = dealt.repartition(groups, "group").sortWithinPartitions("group", "key").select("group", "key", "numbers")
    rows = cut(sent.mapInArrow(run, schema))
    for spread in (32, 1):  # sums of sums, so that no task adds up what all groups sent
        rows = rows.withColumn("order", F.col("part")).withColumn("part", F.pmod("part", F.lit(spread)))
        rows = rows.repartition(F.col("block"), F.col("part")).sortWithinPartitions("block", "part", "order").drop("order").mapInArrow(_added, schema)
    new = flat.copy()
    for row in rows.collect():  # SIZE floats
        k = row.block * BLOCK
        new[k : k + BLOCK] = np.asarray(row.total) / row.weight
    return new


def fit(coded: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters trained on each word of the ``encoded`` documents, as one flat array of fixed size."""
    flat = start(known.totals)
    total = int(known.totals.sum())
    groups = -(-total // rounds // int(min(max((total * GROUP[0]) ** 0.5 / 4, GROUP[0]), GROUP[1]))) or 1
    dealt = coded.select(F.pmod("key", F.lit(rounds)).alias("round"), F.pmod(F.shiftright("key", 8), F.lit(groups)).alias("group"), "key", "numbers")
    for turn in range(rounds):
        flat = _train_round(dealt.where(F.col("round") == turn).drop("round"), groups, flat)
    return flat


# -- Scoring ------------------------------------------------------------------


def score(coded: DataFrame, known: Vocabulary, flat: np.ndarray) -> DataFrame:
    """``doc_id, n_words, score, mean_score`` for every row of ``encoded`` documents."""
    held = coded.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        p = views(held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [_unpacked(x) for x in part.column(4)]
                line, at = laid_out(found)
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                sums = np.add.reduceat(np.append(log_probabilities(p, line, at), 0.0), ends[:-1]) * (np.diff(ends) > 0)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(sums, pa.float64())], ["rid", "doc_id", "n_words", "parts", "logs"])

    rows = coded.select("rid", "doc_id", "n_words", "parts", "numbers").mapInArrow(run, "rid long, doc_id long, n_words long, parts long, logs double")
    rare = coded.select("rid", F.explode("rare").alias("r")).select("rid", "r.*")
    counts = known.words.where((F.col("n") < known.least) | (F.octet_length("word") > LONGEST)).select("word", "n")
    total = coded.sparkSession.createDataFrame([(k, int(known.totals[k])) for k in range(OWN, WORDS)], "number int, total long")
    rare = rare.join(counts, "word", "left").join(F.broadcast(total), "number")
    part = F.when(F.col("n").isNull(), -F.log(F.col("total") + 1)).otherwise(F.log(F.col("n") / F.col("total")))
    more = rare.groupBy("rid").agg(F.sum(F.col("k") * F.round(part * _FINE).cast("long")).alias("more"))
    whole = F.col("logs") + (F.col("parts") + F.coalesce("more", F.lit(0))) / _FINE
    out = rows.join(more, "rid", "left").select("doc_id", "n_words", whole.alias("score"))
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


def fit_and_score(docs: DataFrame) -> DataFrame:
    """Documents scored by a network trained on all of them."""
    known = vocabulary(docs)
    coded = encoded(docs, known)
    return score(coded, known, fit(coded, known))
