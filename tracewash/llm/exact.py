"""Exact dedup against a persistent index of text digests.

The index is a Parquet table of one row for each text seen so far, bucketed and
sorted by digest, in a folder that outlives the session.  New data is digested
once, its distinct digests go through a sort-merge anti-join with the index, in
which only the new side is shuffled, and what is left is appended.  Then each
row looks up the one that stays.

Scale: texts are hashed where they are read and never shuffled.  Copies are
counted before the shuffle.  A digest that at least one row in 1,024 has goes to
the rows by broadcast, and there are at most 1,024 of those; all others meet
their rows by sort-merge join, where no key is large.

Recovery: the digests of a call are a table in the shared folder, and a batch
that is admitted again adds nothing, as its digests are there.  One call at a
time may append to an index.

Defined results: a null text counts as empty; a null ``doc_id`` comes after all
others, so a row without one stays only where all its copies have none; of rows
equal in ``doc_id`` and text one stays.  Other columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, cut, shared_folder

#: Buckets of an index; one holds about 4 million texts when 100 TB are indexed.
BUCKETS = 256
#: A digest with at least this part of all rows is joined by broadcast.
HOT = 1024


def digest(text: Column) -> Column:
    """SHA-256 of a text whose runs of blanks are one space each, in 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " "), 256))


class DigestIndex:
    """Digests of all texts seen, with the row that stays for each.

    ``path`` is a folder that all executors reach; it is made where it is not
    there.  ``buckets`` holds for the index as it is made and is read from the
    folder afterwards.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        settings = f"{path}/settings"
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{settings}/_SUCCESS")
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            buckets = spark.read.parquet(settings).first()["buckets"]
        else:
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(settings)
        self.buckets = buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, doc_id BIGINT, batch STRING, rid BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/digests'"
        )

    def rows(self) -> DataFrame:
        """``digest, doc_id, batch, rid`` of all texts seen."""
        return self.spark.table(self.table)

    def admit(self, digests: DataFrame, batch: str) -> None:
        """Append what the index lacks of ``digests(doc_id, rid, digest)``, the smallest ``doc_id`` of each."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
        # Written first: else the join would go below the aggregate, and all copies of a text through one task of it.
        found = cut(digests.groupBy("digest").agg(first))
        new = found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        rows = new.select("digest", "first.doc_id", F.lit(batch).alias("batch"), "first.rid").repartition(self.buckets, "digest")
        rows.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def looked_up(digests: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``digests``."""
    n = digests.count()
    groups = cut(digests.groupBy("digest").agg(F.count("*").alias("group_size")))
    groups = cut(groups.join(index.rows().hint("merge"), "digest").select("digest", "group_size", F.col("doc_id").alias("keep_id"), F.col("batch").alias("of"), F.col("rid").alias("main")))
    hot = groups.where(F.col("group_size") * HOT >= n)
    few = digests.join(F.broadcast(hot), "digest")
    rest = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.where(F.col("group_size") * HOT < n).hint("merge"), "digest")
    kept = (F.col("of") == batch) & (F.col("main") == F.col("rid"))
    return few.unionByName(rest).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, path: str | None = None, rounds: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """Each row of ``docs`` with the row that stays of its text: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``path`` is the folder of an index that earlier calls have filled; texts
    that it holds are not kept again and name the ``doc_id`` that was.  Without
    it the index is made for this call.  ``group_size`` counts rows of this
    call.  Rows are admitted in ``rounds`` ascending ranges of ``doc_id``, as
    data that arrives: first come is then the smallest as well.
    """
    spark, batch = docs.sparkSession, uuid.uuid4().hex
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")).withColumn("rid", F.monotonically_increasing_id()))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = DigestIndex(spark, path or f"{shared_folder(spark)}/{uuid.uuid4().hex}", buckets)
    edges = [] if low is None else [low + (high - low + 1) * k // rounds for k in range(1, rounds)]
    for start, end in zip([None, *edges], [*edges, None]):
        part = rows if start is None else rows.where(F.coalesce(F.col("doc_id") >= start, F.lit(True)))
        index.admit(part if end is None else part.where(F.col("doc_id") < end), batch)
    out = looked_up(rows, index, batch)
    index.close()
    return out
