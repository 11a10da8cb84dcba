"""Files as they arrive: known contents dropped, items and scores kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.items import file_risk
from ..sources.files import described
from ..sources.metadata import items, with_parts

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """New files below ``path``, each content once within ``late`` of its time.

    State is one hash for each content seen within ``late``.
    """
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(path)
    rows = described(raw, "modificationTime").withColumn("sha256", F.sha2("content", 256))
    return rows.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])


def arriving_items(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Metadata items of arriving files, as ``sources.metadata.items`` has them."""
    return items(with_parts(arriving(spark, path, late)))


def keep_scores(spark: SparkSession, path: str, table: str, checkpoint: str, late: str = "1 day"):
    """A query that appends the risk of each arriving file to the Parquet folder ``table``."""

    def add(batch: DataFrame, number: int) -> None:
        file_risk(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")  # a batch run again replaces itself

    return arriving_items(spark, path, late).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
