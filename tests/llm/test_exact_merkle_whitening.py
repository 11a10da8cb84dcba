"""Exact dedup, the Merkle manifest and whitening against brute force, with nulls, ties and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewash.llm import exact, merkle, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, group_size string, kept string, tree string, idx string, row string, batch string"


def frame(spark, rows, splits=5):
    """``rows`` of (doc_id, text, lang, source, n_chars) with clashing names beside them."""
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(splits)


def documents():
    rnd = random.Random(5)
    words = ["a", "b  c", "\n", "x\ty", "é", " ", "😀 ", "", "line\nline\n", "\x85", "▁", "w " * 3000]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 3))) for _ in range(150)] + [None, None, "", " ", "\r\n", "same  copy"] + ["same copy"] * 60
    sources = [None, "", "b", "a", "B", "ż", "=", "hot", "hot", "hot", "hot"]
    rows = [(i, t, rnd.choice([None, "en", ""]), rnd.choice(sources), rnd.choice([None, 0, 7])) for i, t in enumerate(texts)]
    rows += [(3, "again", "en", "hot", 1), (3, "again", "en", "hot", 1), (3, "other\n", None, "hot", 1), (None, "nobody", None, "b", None), (None, "nobody", None, "b", None), (None, "nobody", "en", None, 2), (9000, "nobody", "en", None, 2), (-5, "same copy", "en", "a", 2), (2**40, "lone\n", "en", "lonely", 3)]
    return rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def deduplicated(rows):
    """(doc_id, keep_id, group_size, kept, digest) of each row, by plain loops."""
    groups = defaultdict(list)
    for r in rows:
        groups[sha(normal(r[1]))].append(r[0])
    out = []
    for digest, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_exact_dedup_equals_brute_force(spark, rounds):
    rows = documents()
    got = exact.deduplicate(frame(spark, rows), rounds=rounds, buckets=8)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == deduplicated(rows)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_dedup_of_nothing_and_of_one_text(spark):
    assert exact.deduplicate(frame(spark, [], 1), buckets=4).count() == 0
    rows = [(None, "x", None, None, None)] * 3000
    got = exact.deduplicate(frame(spark, rows), buckets=4)
    assert [tuple(r) for r in got.groupBy("keep_id", "group_size").agg(F.count("*"), F.count_if("kept")).collect()] == [(None, 3000, 3000, 1)]


def test_index_outlives_its_calls(spark, tmp_path):
    rows, path = documents(), f"file:{tmp_path}/index"
    first = [r for r in rows if r[0] is not None and r[0] % 2]
    second = rows
    exact.deduplicate(frame(spark, first), path, buckets=4).collect()
    got = {(r.doc_id, r.text_sha256): r for r in exact.deduplicate(frame(spark, second), path).collect()}
    seen = {}
    for i, keep, _, kept, digest in deduplicated(first):
        seen[digest] = keep
    for i, keep, size, kept, digest in deduplicated(second):
        r = got[i, digest]
        assert (r.keep_id, r.group_size) == (seen.get(digest, keep), size)
        assert not (r.kept and digest in seen)
    index = exact.DigestIndex(spark, path)
    assert index.buckets == 4 and index.rows().count() == index.rows().select("digest").distinct().count() == len({sha(normal(r[1])) for r in rows})
    plan = frame(spark, first).select(exact.digest(F.col("text")).alias("digest")).repartition(4, "digest").join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in plan
    index.close()
    before = sum(1 for _ in (tmp_path / "index" / "digests").glob("*.parquet"))
    assert exact.deduplicate(frame(spark, second), path).where("kept").count() == 0
    assert sum(1 for _ in (tmp_path / "index" / "digests").glob("*.parquet")) == before  # nothing new, nothing written


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return sha("".join(shown(x) for x in (r[0], r[3], r[2], r[4], text)))


def tree(leaves):
    """Root of a list of digests and, for each, its steps as (left, right)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = place // 3 * 3
            paths[k].append((level[run:place], level[place + 1 : run + 3]))
            at[k] = place // 3
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return (level or [None])[0], paths


def manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = [], []
    for s in sources:
        members = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((members, *tree([leaf(r, r[1]) for r in members])))
    root, above = tree([t[1] for t in trees])
    for (members, subroot, paths), up in zip(trees, above):
        for r, path in zip(members, paths):
            path = path + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            digest = leaf(r, r[1].replace("\n", "") if hit else r[1])
            for a, b in path:
                digest = sha("".join([*a, digest, *b]))
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(x for a, b in path for x in (*a, *b))), digest, digest == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("splits", [1, 7])
def test_merkle_equals_brute_force(spark, splits):
    rows = documents()
    got = merkle.verified(frame(spark, rows, splits))
    want = manifest(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_merkle_of_small_tables(spark, n):
    rows = [(i, f"t\n{i}", "en", "s", i) for i in range(n)]
    assert sorted((tuple(r) for r in merkle.verified(frame(spark, rows, 2)).collect()), key=repr) == manifest(rows)


def test_merkle_of_equal_rows_and_many_sources(spark):
    rows = [(None, "same", None, "s", None)] * 2000 + [(i, "t", None, f"s{i}", None) for i in range(500)]
    got = merkle.verified(frame(spark, rows, 6)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest(rows)


def whitened(vectors, components=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(sum((n * c - s) ** 2 for c, s in zip(row, total))) for row in x]
    y = x.astype(float) - total.astype(float) / n
    v = y.T @ y / n
    values, turned = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    return deviation, y @ turned[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def embeddings(spark, vectors, splits=4):
    rows = [(i, v, "k", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, k string, component int").repartition(splits)


@pytest.mark.parametrize("width", [3, 20])
def test_whitening_equals_brute_force(spark, width):
    rng = np.random.default_rng(width)
    good = (rng.standard_normal((700, width)) * np.geomspace(3, 0.01, width)).astype(np.float32).tolist()
    good += good[:40] + [[0.0] * width]
    bad = [None, [], [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], good[0][:-1], [1e30] + good[0][1:]]
    got = defaultdict(dict)
    df = whitening.whiten(embeddings(spark, good + bad))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for r in df.collect():
        got[r.vec_id][r.component] = r
    deviation, want, explained = whitened(good)
    assert sorted(got) == list(range(len(good))) and all(sorted(g) == list(range(1, min(8, width) + 1)) for g in got.values())
    z = np.array([[got[i][c + 1].whitened for c in range(want.shape[1])] for i in range(len(good))])
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z - want * sign).max() < 1e-8
    assert [got[i][1].deviation for i in range(len(good))] == deviation
    assert np.abs(np.array([got[0][c + 1].explained for c in range(want.shape[1])]) / explained - 1).max() < 1e-10
    assert {r.n for g in got.values() for r in g.values()} == {len(good)} and got[0][1].identity_error < 1e-8


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(embeddings(spark, [], 1)).count() == 0
    assert whitening.whiten(embeddings(spark, [None, [], [None]])).count() == 0
    assert whitening.whiten(embeddings(spark, [[1.0, 2.0]] * 5)).count() == 0  # no variance, no component
    line = [[float(i), 2.0 * i, -float(i)] for i in range(50)]
    rows = whitening.whiten(embeddings(spark, line)).collect()
    assert len(rows) == 50 and {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1) and rows[0].identity_error < 1e-9
    far = [[2.0**40, 0.0], [-(2.0**40), 1.0]] * 3
    assert {r.deviation for r in whitening.whiten(embeddings(spark, far)).collect()} == {None}


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_rotations_find_small_eigenvalues(d):
    rng = np.random.default_rng(d)
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    scale = np.geomspace(1, 1e-5, d)
    a = scale[:, None] * (turn @ np.diag(np.linspace(1, 2, d)) @ turn.T) * scale  # eigenvalues over ten orders of magnitude
    values, vectors = whitening.jacobi(a)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-14
    inverse = np.linalg.inv(turn @ np.diag(np.linspace(1, 2, d)) @ turn.T)
    small = np.linalg.eigvalsh(inverse / scale[:, None] / scale)[-1]
    assert abs(values.min() * small - 1) < 1e-9
