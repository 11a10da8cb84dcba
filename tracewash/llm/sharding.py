"""Shards of even row counts that keep equal texts together, by balanced label propagation.

Documents with equal texts are linked.  Rows start dealt evenly by hash.  Labels
then spread over all links at once: a group of copies is complete, so the shard
that most of its rows have, which one aggregation finds, is the label of all,
and a group stays whole from there on.  In rounds of joins groups ask for the
shard of their label; each shard admits them, the largest first, as long as its
quota holds, and those refused are offered the shards that have room, one after
the other along their running total.  A round leaves less groups than there are
shards without one, namely those that lie across the end of a room, so rounds
end soon; they stop when none is admitted.

Groups larger than a quota come first and fill shard after shard.  Groups that
fit nowhere are laid over the room that is left, row after row, so that they are
cut only where a shard ends.  Unlinked documents have no edge to cut; they fill
what is left, so that in the end the row counts of any two shards differ by one
at most.

Scale: votes and groups are partial sums, with at most one row a shard for a
frequent text; a join on a frequent text is one that Spark splits; ranks and
running totals are taken within buckets of about 50,000 rows and over bucket
totals, and rows equal in ``doc_id`` and text are numbered first, so they share
no bucket.  The driver sees the room of each shard.

Defined results: a null text has size 1, the checksum of an empty text, and
links with nothing; rows that repeat are rows of their own, linked by their
text; an empty table gives an empty result.  Results depend on ``doc_id`` and
text alone, not on the input splits.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets, cut


#: What rows are ordered by; ``rid`` numbers equal rows.
ROW = ["doc_id", "gid", "rid"]
#: Rounds of asking at most; a handful is needed.
ROUNDS = 12
#: Equal rows that one task numbers.
EQUAL = 10_000


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rid``, from 0 among those that are equal: counted, and dealt out again in blocks."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_many"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_many") - 1) / EQUAL))))
    dealt = blocks.where(F.col("_many") > EQUAL).repartition(*rows.columns, "_block")
    blocks = dealt.union(blocks.where(F.col("_many") <= EQUAL))
    last = F.least(F.col("_many"), (F.col("_block") + 1) * EQUAL) - 1
    return blocks.withColumn("rid", F.explode(F.sequence(F.col("_block") * EQUAL, last))).drop("_many", "_block")


def _ranked(rows: DataFrame, keys: list[str], order: list[str], n: int, seed: int = 3) -> DataFrame:
    """``rank`` from 0 within ``keys``: bucket totals, then within buckets."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(n)))
    total = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    skip = F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    total = total.select(*keys, "_bucket", F.coalesce(skip, F.lit(0)).alias("_skip"))
    at = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_at", at).join(total, [*keys, "_bucket"]).withColumn("rank", F.col("_skip") + F.col("_at")).drop("_bucket", "_at", "_skip")


def _running(groups: DataFrame, key: str, n: int) -> DataFrame:
    """``groups(gid, n)`` with ``upto``, the rows of those before them in ``key``, the largest first."""
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64("gid"), F.lit(n)))
    total = groups.groupBy(key, "n", "_bucket").agg(F.sum("n").alias("_rows"))
    skip = F.sum("_rows").over(W.partitionBy(key).orderBy(F.desc("n"), "_bucket").rowsBetween(W.unboundedPreceding, -1))
    total = total.select(key, "n", "_bucket", F.coalesce(skip, F.lit(0)).alias("_skip"))
    within = F.sum("n").over(W.partitionBy(key, "n", "_bucket").orderBy("gid").rowsBetween(W.unboundedPreceding, -1))
    groups = groups.withColumn("_at", F.coalesce(within, F.lit(0))).join(total, [key, "n", "_bucket"])
    return groups.withColumn("upto", F.col("_skip") + F.col("_at")).drop("_bucket", "_at", "_skip")


def propagated(groups: DataFrame, room: list[int], n: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Groups ``gid, n, label`` on the shards that admit them.

    Returns ``gid, n, shard``, the groups that fit nowhere, ``gid, n``, and the
    room left.
    """
    asking, admitted, room = groups.select("gid", "n", "label"), [], list(room)
    for _ in range(ROUNDS):
        free = F.element_at(F.array(*map(F.lit, room)), F.col("label") + 1)
        asked = cut(_running(asking, "label", n).withColumn("fits", F.col("upto") + F.col("n") <= free))
        taken = {r["label"]: r["rows"] for r in asked.where("fits").groupBy("label").agg(F.sum("n").alias("rows")).collect()}
        admitted.append(asked.where("fits").select("gid", "n", F.col("label").alias("shard")))
        room = [r - taken.get(k, 0) for k, r in enumerate(room)]
        refused = asked.where("not fits").select("gid", "n", F.lit(0).alias("every"))
        if not taken or refused.isEmpty():
            break
        upto, steps = 0, []
        for k in sorted(range(len(room)), key=lambda k: -room[k]):
            upto += room[k]
            steps.append(F.when(F.col("upto") < upto, k))
        asking = _running(refused, "every", n).select("gid", "n", F.coalesce(*steps, F.lit(0)).alias("label"))
    out = admitted[0]
    for more in admitted[1:]:
        out = out.union(more)
    return out, refused.select("gid", "n"), room


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, n_copies``."""
    text = F.col("text").cast("string")
    full = F.coalesce(text, F.lit(""))
    rows = cut(
        _numbered(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                (F.octet_length(full) + 1).cast("long").alias("size"),
                F.crc32(full.cast("binary")).alias("text_crc32"),
                F.unhex(F.md5(text.cast("binary"))).alias("gid"),
            )
        )
    )
    total = rows.count()
    n = buckets(total)
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    start = F.pmod(F.xxhash64(*ROW), F.lit(shards)).cast("int").alias("start")
    votes = rows.where("gid is not null").groupBy("gid", start).agg(F.count("*").alias("votes"))
    label = F.max_by("start", F.struct("votes", -F.col("start"))).alias("label")
    groups = cut(votes.groupBy("gid").agg(F.sum("votes").alias("n"), label).where("n > 1"))
    over = groups.where(F.col("n") > quota[0]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    laid = [max(0, min(q, over - sum(quota[:k]))) for k, q in enumerate(quota)]
    whole, lost, spare = propagated(groups.where(F.col("n") <= quota[0]), [q - x for q, x in zip(quota, laid)], n)
    lost = lost.union(groups.where(F.col("n") > quota[0]).select("gid", "n"))
    groups = cut(whole.union(lost.withColumn("shard", F.lit(None).cast("int"))))
    flagged = cut(rows.join(groups, "gid", "left").withColumn("n", F.coalesce("n", F.lit(1))))

    columns = ["rid", "gid", "doc_id", "size", "text_crc32", "n"]
    keep = flagged.where("shard is not null").select(*columns, "shard")
    # Groups that fit nowhere, each in one run: less than two for each shard, as those above a quota and those across the ends of rooms are.
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("n"), "gid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = groups.where("shard is null").select("gid", before.alias("before"))
    split = _ranked(flagged.where("n > 1 and shard is null").join(runs, "gid"), ["gid"], ROW, n).withColumn("rank", F.col("rank") + F.col("before"))
    n_split = groups.where("shard is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = _ranked(flagged.where("n = 1").withColumn("_all", F.lit(0)), ["_all"], ROW, n).withColumn("rank", F.col("rank") + n_split)
    rest = split.select(*columns, "rank").union(rest.select(*columns, "rank"))
    upto, steps = 0, []
    for k, free in [*enumerate(laid), *sorted(enumerate(spare), key=lambda x: -x[1])]:
        upto += free
        steps.append(F.when(F.col("rank") < upto, k))
    place = F.coalesce(*steps, F.lit(None).cast("int"))
    placed = keep.union(rest.select(*columns, place.alias("shard")))
    out = _ranked(cut(placed), ["shard"], ROW, n, seed=5)  # ranks above follow the other buckets, so a shard has few of those
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int"),
        F.col("rank").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("n").alias("n_copies"),
    )
