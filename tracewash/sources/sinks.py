"""What leaves the library: cleaned files, certificates, reports, archives."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import clean_name, human_size
from ..operators.graph import cut


def write_results(done: DataFrame, path: str) -> None:
    """Cleaned files as rows with their bytes, and the refused ones with their ``error_code``."""
    kept = [c for c in done.columns if c not in ("content", "parts")]
    done.select(*kept).write.mode("overwrite").parquet(path)


def certificate_text(c: str | None = None) -> Column:
    """A certificate's columns as text to read."""
    at = lambda name: F.col(f"{c}.{name}" if c else name).cast("string")
    lines = (
        ("File", at("name")), ("Original SHA-256", at("original_sha256")), ("Cleaned SHA-256", at("cleaned_sha256")),
        ("Original size", human_size(F.col("original_size"))), ("Cleaned size", human_size(F.col("cleaned_size"))), ("Saved", F.concat(at("percent_saved"), F.lit(" %"))), ("Seal", at("seal")),
    )
    return F.concat_ws("\n", F.lit("CLEANING CERTIFICATE"), *(F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("-"))) for name, value in lines))


def write_certificates(certificates: DataFrame, path: str) -> None:
    """JSON lines below ``path/json`` and texts, parted by a blank line, below ``path/text``."""
    certificates.write.mode("overwrite").json(f"{path}/json")
    certificates.select(F.concat(certificate_text(), F.lit("\n")).alias("value")).write.mode("overwrite").text(f"{path}/text")


def report(done: DataFrame, items: DataFrame) -> DataFrame:
    """``file_id, report, report_json``: items above low risk, the most risky first, and how cleaning went.

    Needs ``file_id, name, error_code`` and sizes of bytes in ``content`` and ``cleaned``.
    """
    rank = F.when(F.col("risk") == "critical", 0).when(F.col("risk") == "high", 1).otherwise(2)
    told = items.where("risk <> 'low'").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "ord", "risk", "field", F.substring("value", 1, 100).alias("value")))).alias("items"))
    none = F.array().cast(told.schema["items"].dataType)
    rows = done.select("file_id", "name", "error_code", F.length("content").alias("original_size"), F.length("cleaned").alias("cleaned_size")).join(told, "file_id", "left").withColumn("items", F.coalesce("items", none))
    status = F.when(F.col("error_code").isNull(), "SUCCESS").otherwise(F.concat(F.lit("FAILED "), "error_code"))
    lines = F.transform("items", lambda i: F.concat(F.lit("- ["), i["risk"], F.lit("] "), i["field"], F.lit(": "), F.coalesce(i["value"], F.lit(""))))
    text = F.concat_ws("\n", F.concat(F.lit("File: "), "name"), F.concat(F.lit("Status: "), status), F.concat(F.lit("Size: "), human_size(F.col("original_size")), F.coalesce(F.concat(F.lit(" -> "), human_size(F.col("cleaned_size"))), F.lit(""))), lines)
    body = F.struct("name", status.alias("status"), "original_size", "cleaned_size", F.transform("items", lambda i: i.dropFields("rank", "ord")).alias("items"))
    return rows.select("file_id", text.alias("report"), F.to_json(body).alias("report_json"))


def gps_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f, %.6f", lat, lon)


def summary_lines(rows: DataFrame, certificates: DataFrame) -> DataFrame:
    """``file_id, lines``: what the summary says of each file, ``rows`` having its sizes and how it went."""
    seals = certificates.select("file_id", "cleaned_sha256")
    went = F.when(F.col("error_code").isNotNull(), F.concat(F.lit("failed, "), "error_code")).when(F.col("verified"), "verified").otherwise("to be checked by hand")
    sizes = F.concat(human_size(F.col("original_size")), F.lit(" -> "), F.coalesce(human_size(F.col("cleaned_size")), F.lit("-")))
    seal = F.when(F.col("cleaned_sha256").isNotNull(), F.concat(F.lit("   SHA-256: "), "cleaned_sha256"))
    return rows.join(seals, "file_id", "left").select("file_id", F.concat_ws("\n", "name", F.concat(F.lit("   Size: "), sizes), F.concat(F.lit("   Status: "), went), seal).alias("lines"))


def packed(rows: DataFrame, most_bytes: int) -> DataFrame:
    """``rows(file_id, size)`` with ``archive`` and ``place``: files in order until an archive holds ``most_bytes``.

    Running totals are taken in two steps, within parts of the order and over
    the totals of parts.  An archive is larger than ``most_bytes`` by less than
    its last file.
    """
    n = max(64, -(-rows.count() // 50_000))
    rows = rows.withColumn("_part", F.shiftright(F.conv(F.substring(F.md5("file_id"), 1, 8), 16, 10).cast("long") * n, 32)).withColumn("_order", F.md5("file_id"))
    total = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_files"))
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    total = total.select("_part", F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_skip"), F.coalesce(F.sum("_files").over(upto), F.lit(0)).alias("_past"))
    within = W.partitionBy("_part").orderBy("_order", "file_id")
    rows = rows.withColumns({"_at": F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_nth": F.row_number().over(within)}).join(total, "_part")
    archive = F.floor((F.col("_skip") + F.col("_at")) / most_bytes).alias("archive")
    return rows.select("file_id", "size", archive, (F.col("_past") + F.col("_nth")).alias("place"))


def archives(done: DataFrame, certificates: DataFrame, most_bytes: int = 256 * 2**20) -> DataFrame:
    """ZIP files of cleaned files, their certificates and a summary: ``archive, zip``.

    Archives are filled one after the other; each is put together by one task,
    as its files come, and its summary lists them in that order.  ``done`` may
    have ``verified``.
    """
    verified = F.col("verified") if "verified" in done.columns else F.lit(None).cast("boolean")
    rows = done.where("cleaned is not null").select("file_id", "name", "cleaned", "error_code", verified.alias("verified"), F.length("content").cast("long").alias("original_size"), F.length("cleaned").cast("long").alias("cleaned_size"))
    places = cut(packed(rows.select("file_id", F.col("cleaned_size").alias("size")), most_bytes))
    many = places.agg(F.count_distinct("archive")).first()[0] or 1
    text = certificates.select("file_id", F.to_json(F.struct(*certificates.columns)).alias("certificate"))
    rows = rows.join(places, "file_id").join(text, "file_id", "left").join(summary_lines(rows, certificates), "file_id")
    rows = rows.select("archive", "place", "file_id", clean_name(F.col("name")).alias("name"), "cleaned", "certificate", "lines", "original_size", "verified")

    def run(batches):
        now, made, z, told, before, after, good = None, None, None, [], 0, 0, 0

        def row():
            head = f"Files: {len(told)}\n\n"
            tail = f"\n\nOriginal bytes: {before}\nCleaned bytes: {after}\nSaved bytes: {before - after}\nVerified: {good} of {len(told)}\n"
            z.writestr(zipfile.ZipInfo("summary.txt"), head + "\n".join(f"{n}. {lines}" for n, lines in enumerate(told, 1)) + tail)
            z.close()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([made.getvalue()], pa.binary())], ["archive", "zip"])

        for batch in batches:
            for archive, _, file_id, name, cleaned, certificate, lines, size, verified in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if archive != now:
                    if z:
                        yield row()
                    now, made, told, before, after, good = archive, io.BytesIO(), [], 0, 0, 0
                    z = zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(f"cleaned_files/{file_id}/{name}"), cleaned)
                if certificate:
                    z.writestr(zipfile.ZipInfo(f"certificates/{file_id}.json"), certificate)
                told.append(lines)
                before, after, good = before + size, after + len(cleaned), good + bool(verified)
        if z:
            yield row()

    return rows.repartition(many, "archive").sortWithinPartitions("archive", "place").mapInArrow(run, "archive long, zip binary")
