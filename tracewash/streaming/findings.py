"""Findings across files that follow each arrival.

What has arrived is kept in a folder: keys of devices and authors, places, and
the cluster of each cell of places.  A batch looks only at the cells that its
places fall in and at those around them; the links that it finds join stored
clusters, so the components of a graph of labels, as small as the batch, say
which labels become one.  At any time the findings are those of a batch run over
all files so far.

A batch that is run again replaces what it wrote.  Folders are ``keys/batch=n``,
``places/batch=n`` and ``labels/batch=n``; of the last the newest counts and the
one before is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import RADIUS_KM
from ..operators import correlation
from ..operators.graph import components, cut
from ..operators.items import gps_points

_KEYS = "finding_type string, key string, file_id string, batch long"
_PLACES = "file_id string, lat double, lon double, band long, col long, cell long, batch long"
_LABELS = "cell long, label long, batch long"


def _stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _labels(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest labels of cells, those written before a batch if one is given."""
    every = _stored(spark, folder, "labels", _LABELS)
    every = every if before is None else every.where(F.col("batch") < before)
    newest = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == newest).select("cell", "label") if newest is not None else every.select("cell", "label").limit(0)


def add_batch(items: DataFrame, folder: str, number: int, radius_km: float = RADIUS_KM) -> None:
    """Take in the items of files that are new with batch ``number``; a file arrives with all its items."""
    spark = items.sparkSession
    items = cut(items)
    keys = correlation.device_members(items).unionByName(correlation.author_members(items))
    keys.write.mode("overwrite").parquet(f"{folder}/keys/batch={number}")
    correlation.placed(gps_points(items), radius_km).write.mode("overwrite").parquet(f"{folder}/places/batch={number}")
    upto = _stored(spark, folder, "places", _PLACES).where(F.col("batch") <= number)
    new = upto.where(F.col("batch") == number)
    fresh = cut(new.select("cell").distinct())
    old = _labels(spark, folder, number)
    near = cut(upto.join(correlation.near_cells(new, radius_km), ["band", "col"], "left_semi").drop("batch"))
    links = correlation.cell_links(near, radius_km, fresh)
    named = lambda c: old.select(F.col("cell").alias(c), F.col("label").alias("l" + c))
    edges = links.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    joined = cut(components(edges)).withColumnRenamed("label", "now")
    every = old.unionByName(fresh.join(old, "cell", "left_anti").select("cell", F.col("cell").alias("label")))
    every = every.join(joined, F.col("label") == F.col("node"), "left").select("cell", F.coalesce("now", "label").alias("label"))
    every.write.mode("overwrite").parquet(f"{folder}/labels/batch={number}")
    for k in range(number - 2, -1, -1):  # older labels go; one that is gone already ends the search
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/labels/batch={k}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True):
            break


def members(spark: SparkSession, folder: str) -> DataFrame:
    """``finding_type, key, file_id`` of all that has arrived."""
    places = _stored(spark, folder, "places", _PLACES).join(_labels(spark, folder), "cell")
    clusters = correlation.clusters(places.select("file_id", "label"))
    return _stored(spark, folder, "keys", _KEYS).drop("batch").unionByName(clusters.select(F.lit("gps-cluster").alias("finding_type"), F.col("cluster").alias("key"), "file_id"))


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """``finding_type, severity, key, n_files`` as of the last batch."""
    return correlation.findings(members(spark, folder))


def keep_findings(items: DataFrame, folder: str, checkpoint: str, radius_km: float = RADIUS_KM):
    """A streaming query that takes in arriving ``items``; start it with a trigger of choice."""

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, folder, number, radius_km)

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
