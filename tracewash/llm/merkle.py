"""A Merkle manifest of a dataset, its nodes stored level by level.

Each row is a leaf, each source a tree whose leaves ascend by ``doc_id``, and
the roots of the sources are the leaves of one more tree, whose root stands for
the dataset.  A node is the SHA-256 of the hexadecimal digests of three nodes
that follow each other, the last run of a level being shorter.

Leaves are sorted in runs, one a task, and written with their place in their
tree.  Level after level is then made from the one before and written as a
Parquet table of its own, ``tree, idx, digest, last, children``; a node's
children stand in it, so a level is a merge of the level below.  Proofs come
down the same way: the paths of a level, merged with its nodes by coordinate
``(tree, idx)``, give the paths of their children.

Scale: keys of shuffles are coordinates, with three rows each at most, so a
source that holds a third of all rows is dealt like any other.  What is
broadcast is at most two rows for each task of the sort.  Levels shrink by three;
100 TB of documents of 2 kB make 23.  Only the number of levels and the root
reach the driver.

Defined results: a null field is ``-``; rows that repeat are leaves of their own,
next to each other; rows without ``doc_id`` come first in their source; an empty
table has no rows and the root null.  Other columns are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field ``-`` or its length in bytes, a colon and the value."""
    shown = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*shown), 256)


def _numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with ``part``, the task, ``place``, counted from 0 in each tree, and ``ends`` at a tree's last row there."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("ends", T.BooleanType())])
    at = rows.columns.index("tree")

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, held, tree, count = TaskContext.get().partitionId(), None, None, 0

        def finished(batch, places, ends):
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(places), part, np.int32)), pa.array(places), pa.array(ends)], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(at).to_numpy(zero_copy_only=False)
            new = np.append(True, trees[1:] != trees[:-1])
            new[0] = trees[0] != tree
            starts = np.flatnonzero(new)
            here = np.arange(batch.num_rows)
            run_of = np.searchsorted(starts, here, side="right") - 1
            places = np.where(run_of < 0, count + here, here - (starts[np.maximum(run_of, 0)] if len(starts) else 0)).astype(np.int64)
            if held:
                held[2][-1] = new[0]
                yield finished(*held)
            held = batch, places, np.append(new[1:], True)
            tree, count = trees[-1], int(places[-1]) + 1
        if held:
            yield finished(*held)

    return rows.mapInArrow(run, schema)


def placed(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Leaves ``rows(tree, ...)`` with ``idx``, their place in their tree by ``order``, and ``last``; and the largest tree's size."""
    by = ["tree", *order]
    runs = cut(_numbered(rows.repartitionByRange(*by).sortWithinPartitions(*by)))
    spans = cut(runs.groupBy("tree", "part").agg(F.count("*").alias("n")))
    most = spans.groupBy("tree").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    # A run's first tree may have begun in runs before, its last one may go on: two rows a run at most.
    along = W.partitionBy("tree").orderBy("part")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    seams = spans.select("tree", "part", before, F.lead("part").over(along).isNotNull().alias("goes_on")).where("before > 0 or goes_on")
    out = runs.join(F.broadcast(seams), ["tree", "part"], "left")
    out = out.withColumns({"idx": F.col("place") + F.coalesce("before", F.lit(0)), "last": F.col("ends") & ~F.coalesce("goes_on", F.lit(False))})
    return out.drop("part", "place", "ends", "before", "goes_on"), most


def _tops(level: DataFrame) -> DataFrame:
    return level.where("idx = 0 and last")


class NodeStore:
    """All levels over leaves ``tree, idx, last, digest, row``, each a table written from the one below."""

    def __init__(self, leaves: DataFrame, most: int):
        self.leaves = leaves
        self.levels: list[DataFrame] = []
        below = leaves
        while most > 1:
            child = F.struct("idx", "digest", *(["row"] if below is leaves else []))
            up = below.where("not (idx = 0 and last)").groupBy("tree", F.expr(f"idx div {FAN} AS idx"))
            up = up.agg(F.sort_array(F.collect_list(child)).alias("children"), F.bool_or("last").alias("last"))
            digest = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
            below = cut(up.select("tree", "idx", digest.alias("digest"), "last", "children"))
            self.levels.append(below)
            most = -(-most // FAN)

    def tops(self) -> DataFrame:
        """``tree, level, digest`` of the roots; a lone leaf is its tree's root."""
        out = _tops(self.leaves).select("tree", F.lit(0).alias("level"), "digest")
        for k, nodes in enumerate(self.levels, 1):
            out = out.union(_tops(nodes).select("tree", F.lit(k), "digest"))
        return out

    def proofs(self, crowns: DataFrame) -> DataFrame:
        """``row, digest, path`` and ``subroot`` of all leaves, from ``crowns(tree, level, subroot, path)`` of the trees."""
        crown = lambda k: crowns.where(F.col("level") == k)
        left = lambda c, p: F.array_join(F.transform(F.slice(c, 1, p), lambda x: x["digest"]), "")
        right = lambda c, p: F.array_join(F.transform(F.slice(c, p + 2, FAN), lambda x: x["digest"]), "")
        lone = _tops(self.leaves).join(crown(0), "tree").select("row", "digest", "path", "subroot")
        if not self.levels:
            return lone
        paths = crown(len(self.levels)).select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot")
        for k in range(len(self.levels), 0, -1):
            nodes = self.levels[k - 1].select("tree", "idx", "children")
            down = paths.join(nodes.hint("merge"), ["tree", "idx"]).select("tree", "path", "subroot", "children", F.posexplode("children").alias("at", "child"))
            step = F.array(F.struct(left("children", F.col("at")).alias("left"), right("children", F.col("at")).alias("right")))
            down = down.select("tree", F.col("child.idx").alias("idx"), F.concat(step, "path").alias("path"), "subroot", "child")
            paths = down.select("tree", "idx", "path", "subroot")
            if k > 1:
                paths = paths.union(crown(k - 1).select("tree", F.lit(0).cast("long"), "path", "subroot"))
        return down.select("child.row", "child.digest", "path", "subroot").union(lone)


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path in one digest, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(leaves: DataFrame, group: str = "source", key: str = "doc_id") -> DataFrame:
    """``row, digest, path, subroot, root`` for ``leaves(group, key, digest, row)``.

    ``path`` lists the siblings from leaf to root, those on the left and those on
    the right of each step joined; ``folded(digest, path)`` is ``root``.
    """
    name = F.md5(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).cast("binary"))
    leaves = cut(leaves.select(name.alias("tree"), F.col(group).alias("group"), F.col(key).alias("key"), "digest", "row").withColumn("rid", F.monotonically_increasing_id()))
    # A row with equal id and digest is told apart by rid, so that no range is too large for a task.
    rows, most = placed(leaves.drop("group"), "key", "digest", "rid")
    store = NodeStore(rows.select("tree", "idx", "last", "digest", "row"), most)
    names = leaves.groupBy("tree").agg(F.first("group").alias("group"))
    tops = cut(store.tops().join(names, "tree"))
    trees, many = placed(tops.select(F.lit("").alias("tree"), "group", "digest", F.struct(F.col("tree").alias("tree"), "level").alias("row")), "group")
    above = NodeStore(trees.select("tree", "idx", "last", "digest", "row"), many)
    root = above.tops().first()
    crown = cut(leaves.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(len(above.levels)).alias("level"), F.lit("").alias("subroot"), F.array().cast(_STEP).alias("path")))
    crowns = cut(above.proofs(crown).select("row.tree", "row.level", F.col("digest").alias("subroot"), "path"))
    return store.proofs(crowns).withColumn("root", F.lit(root["digest"] if root else None).cast("string"))


def tampered() -> Column:
    """The digest of a row whose text lost its line ends, null where none is lost or the checksum of ``doc_id`` is odd."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    hit = (F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0) & (F.instr(text, "\n") > 0)
    return F.when(hit, leaf({c: F.col(c) for c in FIELDS} | {"text": F.replace(text, F.lit("\n"), F.lit(""))}))


def verified(docs: DataFrame) -> DataFrame:
    """Proofs of all rows of ``docs``, checked against rows of which a part was tampered with.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    leaves = docs.select("source", doc_id, leaf({c: F.col(c) for c in FIELDS}).alias("digest"), F.struct(doc_id, tampered().alias("changed")).alias("row"))
    out = manifest(leaves).withColumn("folded_root", folded(F.coalesce("row.changed", "digest"), F.col("path")))
    return out.select("row.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
