"""All queries of the library by name, with the SQL that checks them.

Each query reads its whole view or table.  The SQL is written apart from the
Spark code, in relational form, for DuckDB.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls, values
from ..functions.dictionaries import AUTHOR_PARTS, CATEGORIES, DESKTOP, DEVICE_PARTS, EXIF_RISK, HIGH_PARAMS, IPAD, IPHONE, MEDIUM_PARAMS, OTHER_SCREENS, PHONE_MAKERS, PRESERVED, SHOT_NAMES, SHOT_SOFTWARE, SUSPECT_KEYS, SUSPECT_LENGTH, SUSPECT_VALUE, TRACKERS
from ..operators import correlation, items, results, screenshots
from ..operators.graph import cut
from ..sources import cleaning, metadata
from . import fixtures
from .views import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return keep


def _list(names) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _cases(key: str, table: dict, test) -> str:
    return " ".join(f"WHEN {test(key, names)} THEN '{name}'" for name, names in table.items())


# -- URLs ---------------------------------------------------------------------

_URL = urls.URL.replace("'", "''")


def _tracker(key: str, names: tuple[str, ...]) -> str:
    exact = [n for n in names if not n.endswith("*")]
    stars = [f"starts_with({key}, '{n[:-1]}')" for n in names if n.endswith("*")]
    return "(" + " OR ".join([f"{key} IN {_list(exact)}", *stars]) + ")"


def _decoded(c: str) -> str:
    return f"url_decode(replace({c}, '+', ' '))"


def _parsed(source: str) -> str:
    return f"""parsed AS (
    SELECT page_id, url, regexp_matches(url, '{_URL}') AS ok, lower(regexp_extract(url, '{_URL}', 1)) AS scheme,
        lower(regexp_replace(regexp_extract(url, '{_URL}', 2), ':80$', '')) AS domain,
        CASE WHEN regexp_extract(url, '{_URL}', 3) = '' THEN '/' ELSE regexp_extract(url, '{_URL}', 3) END AS path,
        substring(regexp_extract(url, '{_URL}', 4), 2) AS query, substring(regexp_extract(url, '{_URL}', 5), 2) AS hash
    FROM {source}),
pairs AS (
    SELECT page_id, 'query' AS section, unnest(list_filter(string_split(query, '&'), lambda x: x <> '')) AS pair,
        generate_subscripts(list_filter(string_split(query, '&'), lambda x: x <> ''), 1) - 1 AS pos FROM parsed WHERE ok
    UNION ALL
    SELECT page_id, 'hash', unnest(list_filter(string_split(hash, '&'), lambda x: x <> '')),
        generate_subscripts(list_filter(string_split(hash, '&'), lambda x: x <> ''), 1) - 1 FROM parsed WHERE ok AND contains(hash, '=')),
named AS (
    SELECT page_id, section, pos, {_decoded("regexp_extract(pair, '^[^=]*', 0)")} AS name,
        {_decoded("CASE WHEN contains(pair, '=') THEN substring(pair, instr(pair, '=') + 1) ELSE '' END")} AS value FROM pairs),
placed AS (
    SELECT *, CASE WHEN lower(name) IN {_list(PRESERVED)} THEN NULL {_cases("lower(name)", TRACKERS, _tracker)}
        WHEN regexp_matches(lower(name), '{"|".join(SUSPECT_KEYS)}') OR length(value) > {SUSPECT_LENGTH} AND regexp_matches(value, '{SUSPECT_VALUE}') THEN 'unknown' END AS platform FROM named),
classified AS (
    SELECT *, CASE WHEN platform = 'unknown' THEN 'suspected' WHEN platform IS NOT NULL THEN 'tracking' END AS category,
        CASE WHEN platform = 'unknown' THEN 'low' WHEN platform IS NULL THEN NULL WHEN lower(name) IN {_list(HIGH_PARAMS)} THEN 'high'
            WHEN lower(name) IN {_list(MEDIUM_PARAMS)} THEN 'medium' ELSE 'low' END AS risk FROM placed)
"""


_PARSED = "WITH " + _parsed("v_urls")
_ENCODED = lambda c: f"replace(replace(replace(url_encode({c}), '%20', '+'), '~', '%7E'), '%2A', '*')"
_DONE = f"""kept AS (
    SELECT page_id, string_agg({_ENCODED("name")} || '=' || {_ENCODED("value")}, '&' ORDER BY pos) AS q
    FROM classified WHERE section = 'query' AND category IS NULL GROUP BY page_id),
gone AS (SELECT page_id, count(*) AS n FROM classified WHERE section = 'query' AND category IS NOT NULL GROUP BY page_id),
done AS (
    SELECT p.page_id, p.url, p.ok, CASE WHEN ok THEN scheme || '://' || domain || path || CASE WHEN q IS NULL THEN '' ELSE '?' || q END END AS cleaned,
        CASE WHEN ok THEN coalesce(g.n, 0) END AS removed_count
    FROM parsed p LEFT JOIN kept k USING (page_id) LEFT JOIN gone g USING (page_id))"""
_CLEAN = f"{_PARSED}, {_DONE}"


@query(f"{_CLEAN} SELECT page_id, url, ok AS success, cleaned, removed_count, length(url) - length(cleaned) AS size_saved FROM done")
def url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = urls.clean_url(F.col("url"))
    out = view(spark, sf_dir, "v_urls").withColumn("c", c)
    return out.select("page_id", "url", "c.success", "c.cleaned", F.when(F.col("c.success"), F.col("c.removed_count")).alias("removed_count"), "c.size_saved")


@query(f"{_PARSED} SELECT page_id, section, pos, name, CASE WHEN length(value) > 30 THEN substring(value, 1, 30) || '...' ELSE value END AS value, category, platform, risk FROM classified")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.exploded(view(spark, sf_dir, "v_urls")).drop("url")


@query(
    f"""{_PARSED}, a AS (SELECT page_id, count(*) FILTER (section = 'query' AND category IS NOT NULL) AS n_tracking,
            count(*) FILTER (section = 'query' AND category IS NULL) AS n_preserved, count(*) FILTER (section = 'hash' AND category IS NOT NULL) AS n_hash,
            coalesce(sum(CASE WHEN category IS NULL THEN 0 WHEN section = 'hash' THEN 1 WHEN risk = 'high' THEN 3 WHEN risk = 'medium' THEN 2 ELSE 1 END), 0) AS score,
            array_to_string(list_sort(list(DISTINCT platform) FILTER (section = 'query' AND platform IS NOT NULL)), ',') AS platforms
        FROM classified GROUP BY page_id)
    SELECT p.page_id, CASE WHEN ok THEN domain END AS domain, CASE WHEN ok THEN path END AS path, CASE WHEN ok THEN coalesce(n_tracking, 0) END AS n_tracking,
        CASE WHEN ok THEN coalesce(n_preserved, 0) END AS n_preserved, CASE WHEN ok THEN coalesce(n_hash, 0) END AS n_hash, CASE WHEN ok THEN coalesce(score, 0) END AS risk_score,
        CASE WHEN ok THEN CASE WHEN coalesce(score, 0) > 5 THEN 'high' WHEN coalesce(score, 0) > 2 THEN 'medium' ELSE 'low' END END AS risk_level,
        CASE WHEN ok THEN coalesce(platforms, '') END AS platforms, coalesce(n_tracking, 0) > 0 AS has_tracking
    FROM parsed p LEFT JOIN a USING (page_id)"""
)
def url_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.analyzed(view(spark, sf_dir, "v_urls")).drop("url")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{k}')" for k, names in TRACKERS.items() for p in names) + ") t(param, platform)")
def url_known_trackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.known_trackers(spark)


_IN_TEXT = urls.IN_TEXT.replace("'", "''")
_PUT = lambda text, k: f"CASE WHEN u{k}.goes AND instr({text}, u{k}.url) > 0 THEN left({text}, CAST(instr({text}, u{k}.url) AS INT) - 1) || u{k}.cleaned || substring({text}, instr({text}, u{k}.url) + length(u{k}.url)) ELSE {text} END"


@query(
    f"""WITH t AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '{_IN_TEXT}', 0) AS urls FROM v_text),
    found AS (SELECT doc_id * 2 + generate_subscripts(urls, 1) - 1 AS page_id, unnest(urls) AS url FROM t),
    {_parsed("found")}, {_DONE},
    u AS MATERIALIZED (SELECT page_id // 2 AS doc_id, page_id % 2 AS k, url, cleaned, ok AND removed_count > 0 AS goes FROM done),
    one AS (SELECT t.doc_id, len(urls) AS n_found, {_PUT("t.text", 0)} AS text, coalesce(u0.goes, false)::INT AS n FROM t LEFT JOIN u u0 ON u0.doc_id = t.doc_id AND u0.k = 0)
    SELECT one.doc_id, n_found, n + coalesce(u1.goes, false)::INT AS n_cleaned, sha256({_PUT("one.text", 1)}) AS text_sha256 FROM one LEFT JOIN u u1 ON u1.doc_id = one.doc_id AND u1.k = 1"""
)
def url_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, "v_text").withColumn("c", urls.clean_text(F.col("text")))
    return out.select("doc_id", F.col("c.found").alias("n_found"), F.col("c.cleaned_urls").alias("n_cleaned"), F.sha2("c.text", 256).alias("text_sha256"))


# -- Items --------------------------------------------------------------------

_PARTS = lambda key, names: "(" + " OR ".join(f"contains({key}, '{n}')" for n in names) + ")"
_CATEGORY = f"CASE {_cases('lower(field)', CATEGORIES, _PARTS)} ELSE 'technical' END"
_EXIF = f"CASE {_cases('field', EXIF_RISK, lambda k, n: f'{k} IN {_list(n)}')} ELSE 'low' END"
_LEVEL = "CASE WHEN score >= 70 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END"


@query(f"SELECT file_id, ord, field, {_EXIF} AS risk, {_CATEGORY} AS category FROM v_items")
def item_risk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_items").select("file_id", "ord", "field", items.exif_risk(F.col("field")).alias("risk"), items.category(F.col("field")).alias("category"))


@query(f"SELECT file_id, {_CATEGORY} AS category, count(*) AS n FROM v_items GROUP BY ALL")
def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.category_counts(view(spark, sf_dir, "v_items"))


@query(
    f"""WITH s AS (SELECT file_id, count(*) AS n_items, count(*) FILTER (risk = 'critical') AS n_critical, count(*) FILTER (risk = 'high') AS n_high,
        count(*) FILTER (risk = 'medium') AS n_medium, count(*) FILTER (risk = 'low') AS n_low,
        least(sum(CASE WHEN risk IN ('critical', 'high') THEN 35 WHEN risk = 'medium' THEN 15 ELSE 5 END), 100) AS score FROM v_risk GROUP BY file_id)
    SELECT *, {_LEVEL} AS level FROM s"""
)
def file_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.file_risk(view(spark, sf_dir, "v_risk"))


@query("SELECT file_id, ord, risk, row_number() OVER (PARTITION BY file_id ORDER BY CASE risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, ord) AS place FROM v_risk")
def items_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.sorted_items(view(spark, sf_dir, "v_risk")).select("file_id", "ord", "risk", "place")


_POINTS = """points AS (SELECT file_id, arg_max(CAST(value AS DOUBLE), ord) FILTER (field = 'GPSLatitude') AS lat,
    arg_max(CAST(value AS DOUBLE), ord) FILTER (field = 'GPSLongitude') AS lon FROM v_items WHERE field IN ('GPSLatitude', 'GPSLongitude') GROUP BY file_id)"""


@query(f"WITH {_POINTS} SELECT * FROM points WHERE lat IS NOT NULL AND lon IS NOT NULL")
def gps_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.gps_points(view(spark, sf_dir, "v_items"))


@query("SELECT file_id, lat, floor(abs(lat)) AS d, floor((abs(lat) - floor(abs(lat))) * 60) AS m FROM v_gps")
def decimal_to_dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.col("lat").cast("double")
    return view(spark, sf_dir, "v_gps").select("file_id", lat.alias("lat"), values.decimal_to_dms(lat)["d"].cast("double").alias("d"), values.decimal_to_dms(lat)["m"].cast("double").alias("m"))


@query("SELECT file_id, ord, field FROM v_items WHERE field IN ('GPSLatitude', 'GPSLatitudeRef', 'GPSLongitude', 'Make', 'Model', 'Software', 'BodySerialNumber', 'DateTimeOriginal', 'Artist', 'Author')")
def selective_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.selective(view(spark, sf_dir, "v_items")).where("removed").select("file_id", "ord", "field")


@query("SELECT file_id, ord, field, risk, substring(value, 1, 100) AS value FROM v_risk WHERE risk <> 'low'")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.report_rows(view(spark, sf_dir, "v_risk"))


# -- Findings across files ----------------------------------------------------

_SHARED = lambda rows, kind, severity: f"SELECT '{kind}' AS finding_type, {severity} AS severity, key, count(DISTINCT file_id) AS n_files FROM {rows} GROUP BY key HAVING count(DISTINCT file_id) > 1"
_FILES = lambda rows, kind: f"SELECT DISTINCT '{kind}' AS finding_type, key, file_id FROM {rows} WHERE key IN (SELECT key FROM {rows} GROUP BY key HAVING count(DISTINCT file_id) > 1)"
_DEVICE = f"""mm AS (SELECT file_id, arg_min(value, ord) FILTER (field = 'Make') AS make, arg_min(value, ord) FILTER (field = 'Model') AS model FROM v_items WHERE field IN ('Make', 'Model') GROUP BY file_id),
    devices AS (SELECT file_id, 'makemodel:' || lower(trim(coalesce(make, ''))) || '|' || lower(trim(coalesce(model, ''))) AS key FROM mm WHERE coalesce(make, '') <> '' OR coalesce(model, '') <> ''
    UNION ALL SELECT file_id, 'serial:' || lower(trim(value)) FROM v_items WHERE {_PARTS("lower(field)", DEVICE_PARTS)} AND trim(value) <> '')"""
_AUTHOR = f"authors AS (SELECT file_id, lower(trim(value)) AS key FROM v_items WHERE {_PARTS('lower(field)', AUTHOR_PARTS)} AND trim(value) <> '')"
_DEVICE_ROWS = _SHARED("devices", "device-match", "CASE WHEN starts_with(key, 'serial:') THEN 'high' ELSE 'medium' END")
_AUTHOR_ROWS = _SHARED("authors", "author-match", "'medium'")


def _km(a: str, b: str) -> str:
    return f"2 * 6371 * asin(sqrt(least(1.0, power(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"


def _clusters(points: str) -> str:
    return f"""near AS (SELECT a.file_id AS u, b.file_id AS v FROM {points} a, {points} b WHERE {_km("a", "b")} <= 2),
    reach(u, v) AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u),
    cluster AS (SELECT u AS file_id, min(v) AS cluster FROM reach GROUP BY u),
    gps AS (SELECT cluster AS key, file_id FROM cluster)"""


@query(f"WITH RECURSIVE {_clusters('v_gps')} SELECT * FROM cluster")
def gps_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.gps_clusters(view(spark, sf_dir, "v_gps"))


@query(f"WITH {_DEVICE} {_DEVICE_ROWS}")
def device_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.findings(correlation.device_members(view(spark, sf_dir, "v_items")))


@query(f"WITH {_AUTHOR} {_AUTHOR_ROWS}")
def author_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.findings(correlation.author_members(view(spark, sf_dir, "v_items")))


_BATCH = f"WITH RECURSIVE {_POINTS}, placed AS (SELECT * FROM points WHERE lat IS NOT NULL AND lon IS NOT NULL), {_clusters('placed')}, {_DEVICE}, {_AUTHOR}"
_GPS_ROWS = _SHARED("gps", "gps-cluster", "'high'")


@query(f"{_BATCH} {_GPS_ROWS} UNION ALL {_DEVICE_ROWS} UNION ALL {_AUTHOR_ROWS}")
def batch_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_items")
    return correlation.batch_findings(rows, items.gps_points(rows))


@query(f"{_BATCH} {_FILES('gps', 'gps-cluster')} UNION ALL {_FILES('devices', 'device-match')} UNION ALL {_FILES('authors', 'author-match')}")
def batch_finding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_items")
    return correlation.finding_files(correlation.batch_members(rows, items.gps_points(rows)))


# -- Screenshots --------------------------------------------------------------

_SCREENS = "(VALUES " + ", ".join(f"({w}, {h})" for w, h in dict.fromkeys([*IPHONE, *IPAD, *DESKTOP, *OTHER_SCREENS])) + ") s(w, h)"
_IN = lambda sizes: "((width, height) IN (" + ", ".join(f"({a}, {b})" for w, h in sizes for a, b in ((w, h), (h, w))) + "))"
_MATCH = lambda c, p: f"regexp_matches(lower(coalesce({c}, '')), '{p}')"


@query(
    f"""WITH f AS (SELECT *, {_MATCH("name", "|".join(SHOT_NAMES).replace("'", "''"))} AS a,
            EXISTS (SELECT 1 FROM {_SCREENS} WHERE abs(width - w) <= 10 AND abs(height - h) <= 10 OR abs(width - h) <= 10 AND abs(height - w) <= 10) AS b,
            {_MATCH("software", SHOT_SOFTWARE)} AS c, {_MATCH("make", "|".join(PHONE_MAKERS))} OR {_MATCH("model", "|".join(PHONE_MAKERS))} AS d FROM v_files)
    SELECT file_id, a::INT * 40 + b::INT * 30 + c::INT * 30 + d::INT * 20 AS confidence, a::INT * 40 + b::INT * 30 + c::INT * 30 + d::INT * 20 >= 40 AS is_screenshot,
        concat_ws(',', CASE WHEN a THEN 'filename_pattern' END, CASE WHEN b THEN 'phone_resolution' END, CASE WHEN c THEN 'software_tag' END, CASE WHEN d THEN 'phone_manufacturer' END) AS reasons,
        CASE WHEN b THEN CASE WHEN {_IN(IPHONE)} THEN 'iPhone' WHEN {_IN(IPAD)} THEN 'iPad' WHEN {_IN(DESKTOP)} THEN 'Desktop' ELSE 'Android' END END AS platform FROM f"""
)
def screenshot_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screenshots.detect(view(spark, sf_dir, "v_files")).select("file_id", "confidence", "is_screenshot", "reasons", "platform")


_FIRST = lambda test, cast=None: (f"CAST(regexp_extract(arg_min(value, ord) FILTER ({test}), '^\\s*(\\d+)', 1) AS INT)" if cast else f"arg_min(value, ord) FILTER ({test})")
_SHOTS = f"""f AS (SELECT file_id, {_FIRST("field = 'ImageWidth' AND value IS NOT NULL", 1)} AS width, {_FIRST("field = 'ImageHeight' AND value IS NOT NULL", 1)} AS height, {_FIRST("field = 'Software'")} AS software,
            {_FIRST("field = 'Make'")} AS make, {_FIRST("field = 'Model'")} AS model, {_FIRST("field = 'DateTimeOriginal'")} AS taken FROM v_items GROUP BY file_id),
    g AS (SELECT *, EXISTS (SELECT 1 FROM {_SCREENS} WHERE abs(width - w) <= 10 AND abs(height - h) <= 10 OR abs(width - h) <= 10 AND abs(height - w) <= 10) AS b,
            {_MATCH("software", SHOT_SOFTWARE)} AS c, {_MATCH("make", "|".join(PHONE_MAKERS))} OR {_MATCH("model", "|".join(PHONE_MAKERS))} AS d,
            {_IN(IPHONE)} OR {_IN(IPAD)} AS apple FROM f)"""


@query(
    f"""WITH {_SHOTS} SELECT file_id, 'device' AS kind, trim(concat(lower(coalesce(make, '')), ' ', lower(coalesce(model, '')))) AS value, 'medium' AS risk FROM g WHERE d
    UNION ALL SELECT file_id, 'datetime', taken, 'low' FROM g WHERE taken IS NOT NULL"""
)
def screenshot_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screenshots.warnings(_shots(spark, sf_dir))


@query(
    f"""WITH {_SHOTS} SELECT file_id, ord, part FROM g, (VALUES (0, 'device'), (1, 'timestamp'), (2, 'screen'), (3, 'apple')) r(ord, part)
    WHERE b::INT * 30 + c::INT * 30 + d::INT * 20 >= 40 AND (part <> 'apple' OR b AND coalesce(apple, false))"""
)
def screenshot_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screenshots.recommendation_rows(screenshots.detect(_shots(spark, sf_dir))).select("file_id", "ord", "part")


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_items")
    return screenshots.from_items(rows, rows.select("file_id").distinct().withColumn("name", F.lit("a.png")))


# -- Results ------------------------------------------------------------------


@query(
    """WITH a AS (SELECT file_id, count(*) AS n, count(*) FILTER (risk IN ('high', 'critical')) AS bad FROM v_after GROUP BY file_id)
    SELECT b.file_id, n_before, coalesce(n, 0) AS n_remaining, greatest(n_before - coalesce(n, 0), 0) AS n_removed, coalesce(bad, 0) = 0 AS verified
    FROM (SELECT file_id, count(*) AS n_before FROM v_risk GROUP BY file_id) b LEFT JOIN a USING (file_id)"""
)
def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.verify_counts(view(spark, sf_dir, "v_risk"), view(spark, sf_dir, "v_after"))


@query(
    """WITH b AS (SELECT DISTINCT file_id, field, value FROM v_risk), a AS (SELECT DISTINCT file_id, field, value FROM v_after)
    SELECT b.file_id, b.field, b.value, CASE WHEN a.file_id IS NULL THEN 'removed' ELSE 'kept' END AS status
    FROM b LEFT JOIN a ON a.file_id = b.file_id AND a.field = b.field AND a.value IS NOT DISTINCT FROM b.value"""
)
def verify_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.verify_detail(view(spark, sf_dir, "v_risk"), view(spark, sf_dir, "v_after"))


@query(
    f"""WITH b AS (SELECT file_id, {_CATEGORY} AS category, count(*) AS n_before FROM v_risk GROUP BY ALL), a AS (SELECT file_id, {_CATEGORY} AS category, count(*) AS n FROM v_after GROUP BY ALL)
    SELECT file_id, category, n_before, coalesce(n, 0) AS n_after, coalesce(n, 0) < n_before AS removed FROM b LEFT JOIN a USING (file_id, category)"""
)
def certificate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.removed_by_category(view(spark, sf_dir, "v_risk"), view(spark, sf_dir, "v_after"))


def _done(spark: SparkSession, sf_dir: str, *kinds: str, shapes: int = 1) -> DataFrame:
    """Files of these kinds, made and walked once, cleaned and written once for all that reads them."""
    walked = cut(metadata.with_parts(fixtures.built(spark, sf_dir, *kinds, shapes=shapes)), "zstd")
    return cut(cleaning.cleaned(walked), "zstd")


def _hex(raw: bytes) -> str:
    return f"from_hex('{raw.hex()}')"


def _gif_sql() -> str:
    """The GIF of a key as a SQL blob: what stands around the secret, and the secret."""
    mark = b"Jane Secret 00000000"
    pieces = [_hex(x) for x in fixtures.gif(mark).split(mark)]
    return f" || encode({fixtures.SECRET_SQL}) || ".join(pieces)


_CLEAN_GIF = fixtures.gif(None)


@query(
    f"""SELECT 'p' || p_partkey AS file_id, sha256({_gif_sql()}) AS original_sha256, '{hashlib.sha256(_CLEAN_GIF).hexdigest()}' AS cleaned_sha256, octet_length({_gif_sql()}) AS original_size,
        {len(_CLEAN_GIF)} AS cleaned_size, octet_length({_gif_sql()}) - {len(_CLEAN_GIF)} AS size_difference,
        concat('CERT|', '{hashlib.sha256(_CLEAN_GIF).hexdigest()[:16]}', '||a.gif') AS qr_payload, true AS holds FROM part"""
)
def certificate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _done(spark, sf_dir, "gif")
    issued = results.certificates(done)
    holds = results.certificate_holds(issued, done.select("file_id", F.col("cleaned").alias("content")))
    return issued.select("file_id", "original_sha256", "cleaned_sha256", "original_size", "cleaned_size", "size_difference", "qr_payload").join(holds, "file_id")


@query("SELECT file_id, sha256(content) AS sha256, row_number() OVER (PARTITION BY sha256(content) ORDER BY ord) > 1 AS already_cleaned FROM v_files")
def dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "v_files").select("file_id", "ord", F.sha2("content", 256).alias("sha256"))
    return results.session_duplicates(files).select("file_id", "sha256", "already_cleaned")


_MIXED = ("heic", "gif", "wav")
_SIZE = lambda kind, secret: len(fixtures.FORMS[kind](b"Jane Secret 00000000" if secret else None))


@query(
    f"""WITH f AS (SELECT p_partkey % 3 AS k FROM part)
    SELECT count(*) AS n_files, count(*) FILTER (k = 0) AS n_failed, sum(CASE k WHEN 1 THEN {_SIZE("gif", True)} WHEN 2 THEN {_SIZE("wav", True)} END) AS original_bytes,
        sum(CASE k WHEN 1 THEN {_SIZE("gif", False)} WHEN 2 THEN {_SIZE("wav", False)} END) AS cleaned_bytes,
        sum(CASE k WHEN 1 THEN {_SIZE("gif", True) - _SIZE("gif", False)} WHEN 2 THEN {_SIZE("wav", True) - _SIZE("wav", False)} END) AS saved_bytes, count(*) FILTER (k > 0) AS n_verified FROM f"""
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _done(spark, sf_dir, *_MIXED)
    rows = done.select("file_id", "error_code", F.length("content").alias("original_size"), F.length("cleaned").alias("cleaned_size")).join(cleaning.verified(done).hint("merge"), "file_id", "left")
    return results.batch_summary(rows.select("error_code", "verified", "original_size", "cleaned_size"))


# -- Files of every kind ------------------------------------------------------


def _extract_sql(kind: str) -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    every = [(None, *e) for e in fixtures.EXPECTED[kind]] + [(k, *e) for k, some in fixtures.EXTRA.get(kind, {}).items() for e in some]
    rows = ", ".join(f"({'NULL' if k is None else k}, {text(f)}, CAST({text(v)} AS VARCHAR), {text(r)})" for k, f, v, r in every)
    return f"SELECT 'p' || p_partkey AS file_id, field, replace(value, '*', {fixtures.SECRET_SQL}) AS value, risk FROM part JOIN (VALUES {rows}) e(shape, field, value, risk) ON shape IS NULL OR shape = p_partkey % {fixtures.SHAPES}"


def _clean_sql(kind: str) -> str:
    if kind in fixtures.REFUSED:
        return f"SELECT 'p' || p_partkey AS file_id, '{fixtures.REFUSED[kind]}' AS error_code, CAST(NULL AS VARCHAR) AS cleaned_sha256, CAST(NULL AS BOOLEAN) AS verified FROM part"
    seals = " ".join(f"WHEN {k} THEN '{hashlib.sha256(fixtures.FORMS[kind](None, k)).hexdigest()}'" for k in range(fixtures.SHAPES))
    return f"SELECT 'p' || p_partkey AS file_id, CAST(NULL AS VARCHAR) AS error_code, CASE p_partkey % {fixtures.SHAPES} {seals} END AS cleaned_sha256, {kind not in fixtures.STILL_BAD} AS verified FROM part"


def _of_kind(kind: str) -> None:
    def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
        walked = metadata.with_parts(fixtures.dealt(spark, sf_dir, kind, shapes=fixtures.SHAPES), fixtures.opened)
        # All files are walked as one kind: told again as a constant, it leaves the rules of that kind alone in the plan.
        return metadata.items(walked.withColumn("walked", F.lit(fixtures.walked_as(kind)))).select("file_id", "field", "value", "risk")

    def clean_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
        # What holds files is read once for each of three passes, and is small: made once and stored.
        make, opened = (fixtures.built, None) if kind in cleaning.HOLDING else (fixtures.dealt, fixtures.opened)
        walked = cut(metadata.with_parts(make(spark, sf_dir, kind, shapes=fixtures.SHAPES), opened), "zstd")
        return cleaning.checked(walked, opened).select("file_id", "error_code", "cleaned_sha256", "verified")

    for name, f, sql in (("extract", extract, _extract_sql(kind)), ("clean_verify", clean_verify, _clean_sql(kind))):
        f.__name__ = f"{name}_{kind}"
        query(sql)(f)


for _kind in fixtures.FORMS:
    _of_kind(_kind)


@query(
    r"""SELECT file_id, replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
        'clean_' || regexp_replace(name, '(?i)\.hei[cf]$', '.jpg') AS cleaned_name, CASE WHEN contains(name, '.') THEN regexp_replace(name, '(\.[^.]+)$', '_redacted\1') ELSE name || '_redacted' END AS redacted_name,
        CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.2f MB', floor(size / 1048576.0 * 100 + 0.5) / 100) END AS shown_size FROM v_files"""
)
def file_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return view(spark, sf_dir, "v_files").select("file_id", values.escaped(name).alias("escaped"), values.clean_name(name).alias("cleaned_name"), values.redacted_name(name).alias("redacted_name"), values.human_size(F.col("size")).alias("shown_size"))


# -- Markup and text ----------------------------------------------------------


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '<!--[^>]*-->')) AS n_comments, len(regexp_extract_all(html, '(?i)<script')) AS n_scripts,
        len(regexp_extract_all(html, '(?i)src="data:image/')) AS n_embedded, len(regexp_extract_all(html, '(?i)<meta')) AS n_meta FROM pages"""
)
def html_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", count("<!--[^>]*-->").alias("n_comments"), count("(?i)<script").alias("n_scripts"), count('(?i)src="data:image/').alias("n_embedded"), count("(?i)<meta").alias("n_meta"))


@query(r"SELECT doc_id, regexp_extract(text, '(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})', 1) AS first_ip FROM documents WHERE regexp_matches(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')")
def text_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(ip)).select("doc_id", F.regexp_extract("text", ip, 1).alias("first_ip"))
