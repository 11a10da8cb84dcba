"""Input views derived from the driver's tables, as SQL that Spark and DuckDB share.

The tables hold no file metadata, so files, items, places and URLs of every
interesting kind are derived from their keys, without chance or clock.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_urls": """
        SELECT page_id, CASE page_id % 12
            WHEN 0 THEN concat(base, '?fbclid=abc123&id=5')
            WHEN 1 THEN concat(base, '?utm_source=x&utm_medium=y&q=a+b')
            WHEN 2 THEN concat(base, '?pf_rd_p=1&pd_rd_w=2&keep=1')
            WHEN 3 THEN concat(base, '?trackingId=zz&UTM_Campaign=c')
            WHEN 4 THEN concat(base, '?page=2&lang=en')
            WHEN 5 THEN concat(base, '?campaign_x=1&my_token=9&foo=bar')
            WHEN 6 THEN concat(base, '?foo=abcdefghijklmnopqrstuvwxyz0123&bar=short')
            WHEN 7 THEN concat(base, '?t=1&t=2&a=1&a=2')
            WHEN 8 THEN concat(base, '?q=%C3%A9%20x&ref=%41&w=*~')
            WHEN 9 THEN concat(base, '?x=1#utm_source=h&sec=2')
            WHEN 10 THEN concat('not a url ', CAST(page_id AS VARCHAR(20)))
            ELSE url END AS url
        FROM (SELECT page_id, url, regexp_extract(url, '^[^?#]*', 0) AS base FROM pages) b""",
    "v_text": """
        SELECT d.doc_id, concat(d.text, coalesce(concat(' see ', u.url, ' and ', u.url, '.'), '')) AS text
        FROM documents d LEFT JOIN v_urls u ON u.page_id = floor(d.doc_id / 4)""",
    "v_items": """
        SELECT concat('f', CAST(l_orderkey AS VARCHAR(20))) AS file_id, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000) * 1000 + l_suppkey % 1000 AS ord, field,
            CASE field
                WHEN 'Make' THEN CASE l_suppkey % 4 WHEN 0 THEN 'Canon' WHEN 1 THEN ' canon ' WHEN 2 THEN 'NIKON' ELSE 'Apple' END
                WHEN 'Model' THEN concat('M', CAST(l_suppkey % 7 AS VARCHAR(20)))
                WHEN 'Software' THEN CASE l_suppkey % 3 WHEN 0 THEN 'ShareX 13' WHEN 1 THEN 'Snipping Tool' ELSE 'Editor' END
                WHEN 'GPSLatitude' THEN concat(CAST(l_partkey % 8 AS VARCHAR(20)), '.', CAST(l_suppkey % 9 + 10 AS VARCHAR(20)))
                WHEN 'GPSLongitude' THEN concat('-', CAST(l_partkey % 17 AS VARCHAR(20)), '.', CAST(l_suppkey % 9 + 10 AS VARCHAR(20)))
                WHEN 'BodySerialNumber' THEN CASE WHEN l_suppkey % 9 = 0 THEN ' ' ELSE concat('SN', CAST(l_partkey % 900 AS VARCHAR(20))) END
                WHEN 'ImageWidth' THEN CASE l_suppkey % 3 WHEN 0 THEN '1170' WHEN 1 THEN '1920' ELSE '801' END
                WHEN 'ImageHeight' THEN CASE l_suppkey % 3 WHEN 0 THEN '2532' WHEN 1 THEN '1080' ELSE '601' END
                ELSE CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('Name ', CAST(l_partkey % 60 AS VARCHAR(20))) END
            END AS value
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_partkey + l_orderkey) % 16
                WHEN 0 THEN 'Make' WHEN 1 THEN 'Model' WHEN 2 THEN 'Software' WHEN 3 THEN 'GPSLatitude'
                WHEN 4 THEN 'GPSLongitude' WHEN 5 THEN 'BodySerialNumber' WHEN 6 THEN 'Artist' WHEN 7 THEN 'Author'
                WHEN 8 THEN 'creator' WHEN 9 THEN 'lastModifiedBy' WHEN 10 THEN 'DateTimeOriginal' WHEN 11 THEN 'ImageWidth'
                WHEN 12 THEN 'ImageHeight' WHEN 13 THEN 'FNumber' WHEN 14 THEN 'GPSLatitudeRef' ELSE 'Keywords' END AS field
            FROM lineitem) f""",
    "v_risk": """
        SELECT file_id, ord, field, value, CASE
            WHEN field IN ('GPSLatitude', 'GPSLongitude', 'GPSLatitudeRef', 'BodySerialNumber', 'Artist') THEN 'high'
            WHEN field IN ('Make', 'Model', 'Software', 'DateTimeOriginal') THEN 'medium'
            WHEN field = 'Keywords' AND ord % 5 = 0 THEN 'critical' ELSE 'low' END AS risk
        FROM v_items""",
    "v_after": "SELECT * FROM v_risk WHERE ord % 7 = 0 AND (risk = 'low' OR ord % 5 = 0)",
    "v_gps": """
        SELECT concat('g', CAST(c_custkey AS VARCHAR(20))) AS file_id, CAST((c_custkey % 97) * 0.01 AS DOUBLE) AS lat,
            CAST((c_nationkey * 7 % 360) - 180 + (c_custkey % 11) * 0.005 AS DOUBLE) AS lon
        FROM customer
        UNION ALL SELECT file_id, CAST(lat AS DOUBLE), CAST(lon AS DOUBLE) FROM (VALUES ('z1', 10.0, 179.995), ('z2', 10.0, -179.995), ('z3', 0.0, 0.0), ('z4', 0.0, 0.0179),
            ('z5', 50.0, 8.0), ('z6', 50.0179, 8.0), ('z7', 50.0358, 8.0), ('z8', 60.0, 8.0), ('z9', 60.0181, 8.0)) z(file_id, lat, lon)""",
    "v_files": """
        SELECT concat('p', CAST(p_partkey AS VARCHAR(20))) AS file_id, CASE p_partkey % 8
            WHEN 0 THEN 'Screenshot_2024.png' WHEN 1 THEN 'IMG_0042.JPG' WHEN 2 THEN 'Bildschirmfoto.png' WHEN 3 THEN 'holiday.heic'
            WHEN 4 THEN 'report.v2.pdf' WHEN 5 THEN 'noending' WHEN 6 THEN 'screen  capture.webp' ELSE 'a<b>&c.jpg' END AS name,
            CASE p_size % 6 WHEN 0 THEN 1170 WHEN 1 THEN 1160 WHEN 2 THEN 1159 WHEN 3 THEN 1920 WHEN 4 THEN 2360 ELSE NULL END AS width,
            CASE p_size % 6 WHEN 0 THEN 2532 WHEN 1 THEN 2542 WHEN 2 THEN 2532 WHEN 3 THEN 1080 WHEN 4 THEN 1640 ELSE 5 END AS height,
            CASE p_partkey % 5 WHEN 0 THEN 'Flameshot' WHEN 1 THEN NULL ELSE 'Camera' END AS software,
            CASE p_partkey % 3 WHEN 0 THEN 'SAMSUNG' WHEN 1 THEN NULL ELSE 'Canon' END AS make,
            CASE p_partkey % 7 WHEN 0 THEN 'Pixel 8' ELSE 'X1' END AS model,
            p_partkey * p_partkey * 37 AS size, p_partkey AS ord, p_name AS content
        FROM part""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needed(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def with_views(sql: str) -> str:
    """``sql`` behind the views that it uses, as one statement."""
    need: list[str] = []

    def add(text):
        for v in _needed(text):
            if v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    head, _, tail = sql.lstrip().partition(" ")
    if not need:
        return sql
    parts = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    if head.upper() == "WITH":
        word, _, rest = tail.lstrip().partition(" ")
        return f"WITH RECURSIVE {parts}, {rest}" if word.upper() == "RECURSIVE" else f"WITH {parts}, {tail}"
    return f"WITH {parts} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the files of a folder."""
    text = with_views(f"SELECT * FROM {name}")
    for t in TABLES:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)
