"""After cleaning: verification, certificates, summaries, session duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .items import category


def verify_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items removed and left by file; verified when no high or critical is left."""
    bad = F.count_if(F.col("risk").isin("high", "critical"))
    left = after.groupBy("file_id").agg(F.count("*").alias("n_after"), bad.alias("n_bad"))
    out = before.groupBy("file_id").agg(F.count("*").alias("n_before")).join(left, "file_id", "left")
    n_after = F.coalesce("n_after", F.lit(0))
    return out.select("file_id", "n_before", n_after.alias("n_remaining"), F.greatest(F.col("n_before") - n_after, F.lit(0)).alias("n_removed"), (F.coalesce("n_bad", F.lit(0)) == 0).alias("verified"))


def verify_detail(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every item with ``removed``, ``kept`` or ``added``."""
    key = ["file_id", "field", "value"]
    side = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n))
    a, b = side(before, "a"), side(after, "b").withColumnsRenamed({k: f"_{k}" for k in key})
    out = a.join(b, F.expr("file_id <=> _file_id and field <=> _field and value <=> _value"), "full")
    status = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("kept")
    return out.select(*(F.coalesce(k, f"_{k}").alias(k) for k in key), status.alias("status"))


def removed_by_category(before: DataFrame, after: DataFrame) -> DataFrame:
    """The certificate's summary: items of each category before and after."""
    side = lambda df, n: df.groupBy("file_id", category(F.col("field")).alias("category")).agg(F.count("*").alias(n))
    out = side(before, "n_before").join(side(after, "n_after"), ["file_id", "category"], "left")
    return out.withColumn("n_after", F.coalesce("n_after", F.lit(0))).withColumn("removed", F.col("n_after") < F.col("n_before"))


def certificates(files: DataFrame) -> DataFrame:
    """Hashes, size difference and an unkeyed seal over the certificate.

    Needs ``file_id, name, content, cleaned``; the time of issue is a column
    ``issued`` if there is one, so that results can be repeated.
    """
    size, clean = F.length("content"), F.length("cleaned")
    issued = F.col("issued").cast("string") if "issued" in files.columns else F.lit("")
    body = files.select(
        "file_id",
        "name",
        F.sha2("content", 256).alias("original_sha256"),
        F.sha2("cleaned", 256).alias("cleaned_sha256"),
        size.alias("original_size"),
        clean.alias("cleaned_size"),
        (size - clean).alias("size_difference"),
        F.round(100 * (size - clean) / size, 2).alias("percent_saved"),
        issued.alias("issued"),
    )
    sealed = body.withColumn("seal", F.sha2(F.to_json(F.struct(*body.columns)), 256))
    return sealed.withColumn("qr_payload", F.concat_ws("|", F.lit("CERT"), F.substring("cleaned_sha256", 1, 16), F.substring("issued", 1, 19), F.col("name")))


def certificate_holds(certificate: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each file still has the certified content."""
    out = certificate.select("file_id", "cleaned_sha256").join(files.select("file_id", F.sha2("content", 256).alias("now")), "file_id", "left")
    return out.select("file_id", F.coalesce(F.col("now") == F.col("cleaned_sha256"), F.lit(False)).alias("holds"))


def session_duplicates(files: DataFrame) -> DataFrame:
    """``already_cleaned``: an earlier file, by ``ord``, has the same hash."""
    first = files.groupBy(F.col("sha256").alias("_hash")).agg(F.min("ord").alias("_first"))
    out = files.join(first, F.col("sha256").eqNullSafe(F.col("_hash")))
    return out.withColumn("already_cleaned", F.col("ord") > F.col("_first")).drop("_hash", "_first")


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: files, failures, sizes and how many are verified."""
    ok = F.col("error_code").isNull()
    return results.agg(
        F.count("*").alias("n_files"),
        F.count_if(~ok).alias("n_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("original_size"))), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum(F.when(ok, F.col("cleaned_size"))), F.lit(0)).alias("cleaned_bytes"),
        F.coalesce(F.sum(F.when(ok, F.col("original_size") - F.col("cleaned_size"))), F.lit(0)).alias("saved_bytes"),
        F.count_if(ok & F.col("verified")).alias("n_verified"),
    )


