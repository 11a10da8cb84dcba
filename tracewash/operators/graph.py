"""Connected components and the tables that loops are cut with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder for this session's tables, below the one that ``spark.checkpoint.dir`` names.

    Where a session names none, a local one gets a temporary folder; on a
    cluster, where executors do not share it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{sc.getCheckpointDir()}/tables"


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from its files.

    A table read back has no lineage and, unlike a checkpoint, carries no
    constraints of earlier plans, which would slow the planning of loops.
    Results are read lazily, so tables stay until ``drop_tables``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete what ``cut`` wrote in this session; for when its results have been stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of undirected ``edges(u, v)`` by connected component.

    Randomised contraction: in every round each node points to the node of the
    smallest hash within two steps, edges are rewritten to those targets and
    loops go.  A star collapses in one round, and the node set shrinks by a
    constant factor in expectation whatever the shape of the graph.  The maps
    of all rounds, applied in turn, give the label.  Only edges and maps are
    stored, nothing is collected; joins are by merging, as a table that Spark
    takes for small and broadcasts would pass through the driver.

    Returns ``(node, label)`` for every node that has an edge; nodes of one
    component share a label, which is the id of one of them.
    """
    edges = edges.where("u <> v").select("u", "v")
    maps: list[DataFrame] = []
    while True:
        turn = len(maps)
        both = cut(edges.union(edges.select("v", "u")).distinct())
        if both.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))
        near = both.groupBy("u").agg(F.min(order("v")).alias("n")).select(F.col("u").alias("v"), F.least("n", order("u")).alias("n"))
        far = both.join(near.hint("merge"), "v").groupBy("u").agg(F.min("n").alias("n"))
        to = cut(far.select(F.col("u").alias("node"), F.least("n", order("u"))["id"].alias("label")))
        maps.append(to)
        a = to.select(F.col("node").alias("u"), F.col("label").alias("a"))
        b = to.select(F.col("node").alias("v"), F.col("label").alias("b"))
        edges = both.where("u < v").join(a.hint("merge"), "u").join(b.hint("merge"), "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = maps[0]
    for step in maps[1:]:
        step = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        out = out.join(step.hint("merge"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return out
