"""Mixing sources to target weights along a time-varying curriculum.

Sources, in code point order with null last, weigh 1, 2, 3, repeating.  They
share all words by weight; a target stops at ``most`` times its source's size
and the excess is reshared by weight.  Documents of a source stand in a fixed
random order; the source is read through, again and again, until its target is
reached, so the words taken differ from the target by less than one.

Over training time ``t`` in 0..1 a source's weight runs along a line,
``1 + slope * (2t - 1)``.  Its integral is the share of the target demanded by
``t``; solving it for the words that stand before a document gives the
document's training position, and rows are range-sorted by position.

Scale: a source may hold any share of the rows.  Running totals are taken in
two steps, within buckets of about 50,000 rows and over bucket totals, so no
task gets a whole source; only the table of sources is ranked in one task.

Defined results: a null or blank text has no words and takes none; rows that
repeat are rows of their own; with no words at all the targets are zero.
Reruns agree, as the order depends on ``doc_id`` and text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets, packed, words


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """``key, source, source_size, weight, target`` from ``key, source, size``.

    Sources sorted by ``cap / weight`` fill up in that order; the level at
    which the first of them is not full is the level of all the others.
    """
    total = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.asc_nulls_last("source"))
    rows = total.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    cap = F.col("source_size") * most
    every, before = W.partitionBy(), W.orderBy(cap / F.col("weight"), "key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "rest": F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
            "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    full = cap * F.col("left") < F.col("rest") * F.col("weight")
    rows = rows.withColumn("full", full)
    # The first source that is not full has the smallest rank among those.
    first = F.min(F.when(~F.col("full"), F.struct((cap / F.col("weight")).alias("r"), F.col("key"), F.col("rest"), F.col("left")))).over(every)
    rows = rows.withColumn("first", first)
    open_target = F.col("first.rest").cast("double") * F.col("weight") / F.col("first.left")
    target = F.when(F.col("full") | F.col("first").isNull(), cap.cast("double")).otherwise(F.least(open_target, cap.cast("double")))
    return rows.select("key", "source", "source_size", "weight", target.alias("target"))


def _position(share: Column, slope: Column) -> Column:
    """The time at which the integral of the weight schedule is ``share``."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope)) + F.lit(0.0)


def mix(docs: DataFrame, most: int = 3, ramp: float = 0.5) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken, copies, position``.

    ``copies`` counts the passes that take at least half of the document.
    ``ramp`` is the slope of weight 3; weight 1 has the opposite one.  New
    columns take the place of those of their names; ``common.packed`` keeps these.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    size = F.size(words(F.col("text").cast("string"))).cast("long")
    n = buckets(docs.count())
    # Buckets are ranges of the order, so results do not depend on their number.
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))
    bucket = F.shiftright(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * n, 32)
    rows = docs.withColumns({"size": size, "key": key, "_order": order}).withColumn("_bucket", bucket)
    lean = rows.select("key", "source", "size", "_bucket")
    targets = source_targets(lean.select("key", "source", "size"), most)
    part = lean.groupBy("key", "_bucket").agg(F.sum("size").alias("part"))
    upto = W.partitionBy("key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("_skip", F.coalesce(F.sum("part").over(upto), F.lit(0))).drop("part").join(targets.drop("source"), "key")
    within = W.partitionBy("key", "_bucket").orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(part, ["key", "_bucket"])
    at = F.col("_skip") + F.col("_before")
    goal = F.round("target").cast("long")
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), goal - at - p * F.col("source_size"))) for p in range(most)]
    share = F.least(at / F.greatest(goal, F.lit(1)), F.lit(1.0))
    rows = rows.withColumns(
        {
            "taken": sum(passes[1:], passes[0]).cast("long"),
            "copies": F.when(F.col("size") > 0, sum((F.when(2 * p >= F.col("size"), 1).otherwise(0) for p in passes[1:]), F.when(2 * passes[0] >= F.col("size"), 1).otherwise(0))).otherwise(1),
            "_at": at,
            "slope": (F.col("weight") - 2) * F.lit(ramp),
        }
    )
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, _position(share, F.col("slope"))))
    return rows.drop("key", "_bucket", "_order", "_before", "_skip", "weight")


def curriculum(docs: DataFrame, most: int = 3, ramp: float = 0.5) -> DataFrame:
    """Documents as the mix reads them: each as often as it is taken, whole,
    range-sorted by training position, with the columns of ``docs``."""
    rows = mix(packed(docs, "doc_id", "text", "source"), most, ramp).where("copies > 0")
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = (F.col("_at") + F.col("_pass") * F.col("source_size")) / F.greatest(F.round("target"), F.lit(1.0))
    rows = rows.withColumn("_position", _position(F.least(share, F.lit(1.0)), F.col("slope")))
    return rows.orderBy("_position", "doc_id", "_pass").select("_row.*")
