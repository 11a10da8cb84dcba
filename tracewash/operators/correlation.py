"""Patterns that only show across files: shared devices, authors and places.

Findings are ``finding_type, severity, key, n_files``; the files behind them are
rows ``finding_type, key, file_id`` of a table of their own, as a key may be that
of any share of all files.  Fewer than two files with metadata give none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import AUTHOR_PARTS, DEVICE_PARTS, EARTH_KM, RADIUS_KM
from ..functions.values import haversine_km
from .graph import components, cut

FINDING = ["finding_type", "severity", "key", "n_files"]


def _normal(value: Column) -> Column:
    return F.lower(F.trim(value))


def findings(members: DataFrame) -> DataFrame:
    """Keys of ``members`` that two files or more have, counted by partial sums."""
    serious = F.col("finding_type").isin("gps-cluster") | F.col("key").startswith("serial:") & (F.col("finding_type") == "device-match")
    groups = members.groupBy("finding_type", "key").agg(F.count("*").alias("n_files")).where("n_files > 1")
    return groups.withColumn("severity", F.when(serious, "high").otherwise("medium")).select(*FINDING)


def finding_files(members: DataFrame) -> DataFrame:
    """``finding_type, key, file_id`` of all findings."""
    return members.join(findings(members).select("finding_type", "key"), ["finding_type", "key"], "left_semi").select("finding_type", "key", "file_id")


def _members(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("finding_type"), "key", "file_id").distinct()


def device_members(items: DataFrame) -> DataFrame:
    """Files with the same make and model, or with the same serial value."""
    key = F.lower(F.col("field"))
    first = lambda name: F.min_by(F.col("value"), F.when(key == name, F.col("ord")))
    models = items.where(key.isin("make", "model")).groupBy("file_id").agg(first("make").alias("make"), first("model").alias("model"))
    text = lambda c: _normal(F.coalesce(F.col(c), F.lit("")))
    models = models.where((F.coalesce("make", F.lit("")) != "") | (F.coalesce("model", F.lit("")) != ""))
    models = models.select("file_id", F.concat(F.lit("makemodel:"), text("make"), F.lit("|"), text("model")).alias("key"))
    serial = items.where(key.rlike("|".join(DEVICE_PARTS)) & (F.trim("value") != "")).select("file_id", F.concat(F.lit("serial:"), _normal(F.col("value"))).alias("key"))
    return _members(models.union(serial), "device-match")


def author_members(items: DataFrame) -> DataFrame:
    """Files with the same author; a PDF's ``Creator`` is a program and no author."""
    key = F.lower(F.col("field"))
    rows = items.where(key.rlike("|".join(AUTHOR_PARTS)) & (F.trim("value") != ""))
    if "file_type" in items.columns:
        rows = rows.where(~((F.col("file_type") == "pdf") & (key == "creator")))
    return _members(rows.select("file_id", _normal(F.col("value")).alias("key")), "author-match")


class _Grid:
    """Cells that are at most the radius across, on bands of latitude.

    All points of a cell are thus linked with each other and a cell can stand
    for them.  Cells of one band have one width, in degrees of longitude, from
    the band's latitude next to the equator.
    """

    def __init__(self, radius_km: float):
        self.reach = math.degrees(radius_km / EARTH_KM)
        self.step = self.reach / math.sqrt(2) * 0.999

    def band(self, lat: Column) -> Column:
        return F.floor(lat / self.step).cast("long")

    def width(self, band: Column) -> Column:
        nearest = F.when(band >= 0, band).otherwise(-band - 1) * self.step
        return F.least(F.lit(360.0), self.step / F.greatest(F.cos(F.radians(F.least(nearest, F.lit(90.0)))), F.lit(1e-9)))

    def column(self, lon: Column, band: Column) -> Column:
        return F.floor(F.pmod(lon, F.lit(360.0)) / self.width(band)).cast("long")

    def around(self, box: Column) -> Column:
        """Cells that may hold a point within the radius of a box in one band."""
        farthest = F.least(F.greatest(F.abs(box["south"]), F.abs(box["north"])) + self.reach, F.lit(90.0))
        reach = F.when(farthest >= 90, 180.0).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(self.reach)) / F.cos(F.radians(farthest)))))))
        west = box["west"] - reach
        across = F.least(F.lit(360.0), box["east"] - box["west"] + 2 * reach)

        def cells(shift):
            band = self.band(box["south"]) + shift
            n = (F.ceil(across / self.width(band)) + 1).cast("int")
            at = F.transform(F.sequence(F.lit(0), n), lambda i: self.column(west + i * (across / n), band))
            return F.transform(F.array_distinct(at), lambda c: F.struct(band.alias("band"), c.alias("col")))

        return F.flatten(F.transform(F.sequence(F.lit(-2), F.lit(2)), cells))


def _outer(places: DataFrame, *keys: str) -> DataFrame:
    """The box of each cell's points and its outermost points, four at most."""
    by_lat, by_lon = F.struct("lat", "lon"), F.struct("lon", "lat")
    turned = lambda c: F.struct(c["lat"].alias("lat"), c["lon"].alias("lon"))
    points = F.array_distinct(F.array(F.min(by_lat), F.max(by_lat), turned(F.min(by_lon)), turned(F.max(by_lon))))
    box = F.struct(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    return places.groupBy(*keys).agg(box.alias("box"), points.alias("points"))


def _touch(radius_km: float) -> Column:
    """Some outer point of ``a`` is within the radius of one of ``b``."""
    near = lambda x: F.exists("b.points", lambda y: haversine_km(x["lat"], x["lon"], y["lat"], y["lon"]) <= radius_km)
    return F.exists("a.points", near)


def _may_touch(radius_km: float) -> Column:
    """The boxes of ``a`` and ``b`` come within the radius."""
    a, b = F.col("a.box"), F.col("b.box")
    gap = lambda lo, hi: F.greatest(F.lit(0.0), b[lo] - a[hi], a[lo] - b[hi])
    round_about = 360 - (F.greatest(a["east"], b["east"]) - F.least(a["west"], b["west"]))
    lat, lon = F.radians(gap("south", "north")), F.radians(F.least(gap("west", "east"), F.greatest(F.lit(0.0), round_about)))
    farthest = F.cos(F.radians(F.greatest(*(F.abs(x[c]) for x in (a, b) for c in ("south", "north")))))
    h = F.pow(F.sin(lat / 2), 2) + F.pow(farthest * F.sin(lon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))) <= radius_km * 1.000001


PARTS = 16  # of a cell, each way, where whole cells do not decide


def gps_clusters(points: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """``file_id, cluster`` by single linkage within the radius.

    Equal places are one point, and a cell's points are linked without a pair.
    Neighbouring cells are linked by their outermost points, four each.  Pairs
    of cells that are then still apart, and whose boxes come within the radius,
    are compared by the outermost points of 256 parts each, and only parts that
    leave it open point by point: what is compared does not grow with the
    points of a cell, but where two parts of 90 m face each other at just the
    radius.
    """
    at = cut(placed(points, radius_km))
    label = cut(components(cell_links(at, radius_km)))
    out = at.join(label.withColumnRenamed("node", "cell"), "cell", "left").select("file_id", F.coalesce("label", "cell").alias("label"))
    return clusters(out)


def clusters(labelled: DataFrame) -> DataFrame:
    """``file_id, cluster`` of ``file_id, label``: a cluster is named by its smallest file."""
    names = labelled.groupBy("label").agg(F.min("file_id").alias("cluster"))
    return labelled.join(names, "label").select("file_id", "cluster")


def placed(points: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """``file_id, lat, lon`` with the grid's ``band, col`` and ``cell``."""
    grid = _Grid(radius_km)
    at = points.where("lat is not null and lon is not null").select("file_id", (F.col("lat") + F.lit(0.0)).alias("lat"), F.pmod(F.col("lon") + F.lit(0.0), F.lit(360.0)).alias("lon"))
    at = at.withColumn("band", grid.band(F.col("lat")))
    return at.withColumn("col", grid.column(F.col("lon"), F.col("band"))).withColumn("cell", F.xxhash64("band", "col"))


def near_cells(at: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """``band, col`` of the cells of ``at`` and of all that may hold a point within the radius of them."""
    around = _outer(at, "band", "col", "cell").select("band", "col", F.explode(_Grid(radius_km).around(F.col("box"))).alias("n"))
    return around.select("n.band", "n.col").union(around.select("band", "col")).distinct()


def cell_links(at: DataFrame, radius_km: float = RADIUS_KM, fresh: DataFrame | None = None) -> DataFrame:
    """Links ``u, v`` between cells of placed points, enough to find all clusters.

    With ``fresh(cell)`` only links that have one of those at an end.
    """
    grid = _Grid(radius_km)
    cells = cut(_outer(at, "band", "col", "cell"))
    some = cells if fresh is None else cells.join(fresh, "cell", "left_semi")
    around = some.select(F.col("cell").alias("u"), F.struct("box", "points").alias("a"), F.explode(grid.around(F.col("box"))).alias("n"))
    other = cells.select(F.col("cell").alias("v"), F.struct("box", "points").alias("b"), "band", "col")
    once = F.col("u") < F.col("v") if fresh is None else F.col("u") != F.col("v")
    pairs = around.join(other, (F.col("n.band") == F.col("band")) & (F.col("n.col") == F.col("col")) & once)
    pairs = cut(pairs.where(_may_touch(radius_km)).select("u", "v", _touch(radius_km).alias("linked")))
    links = pairs.where("linked").select("u", "v")
    apart = pairs.where("not linked").select("u", "v")
    if apart.isEmpty():
        return links
    # Cells that others link already need no closer look.
    label = cut(components(links))
    to = lambda x: label.select(F.col("node").alias(x), F.col("label").alias("l" + x))
    apart = cut(apart.join(to("u"), "u", "left").join(to("v"), "v", "left").where("lu is null or lv is null or lu <> lv").select("u", "v"))
    if apart.isEmpty():
        return label.select(F.col("node").alias("u"), F.col("label").alias("v"))
    return label.select(F.col("node").alias("u"), F.col("label").alias("v")).union(cut(_closer(at, apart, grid, radius_km)))


def _closer(at: DataFrame, apart: DataFrame, grid: _Grid, radius_km: float) -> DataFrame:
    """Those pairs of cells that some pair of their points links."""
    some = apart.select(F.col("u").alias("cell")).union(apart.select("v")).distinct()
    north, east = F.floor(F.col("lat") / (grid.step / PARTS)), F.floor(F.col("lon") / (grid.width(F.col("band")) / PARTS))
    places = cut(at.join(some, "cell", "left_semi").select("cell", "lat", "lon", F.xxhash64(north, east).alias("part")).distinct())
    parts = cut(_outer(places, "cell", "part"))
    side = lambda x, y: parts.select(F.col("cell").alias(x), F.col("part").alias("p" + x), F.struct("box", "points").alias(y))
    faced = apart.join(side("u", "a"), "u").join(side("v", "b"), "v").where(_may_touch(radius_km))
    faced = cut(faced.select("u", "v", "pu", "pv", _touch(radius_km).alias("linked")))
    found = faced.where("linked").select("u", "v").distinct()
    rest = faced.join(found, ["u", "v"], "left_anti").select("u", "v", "pu", "pv")
    ends = lambda x, n: places.select(F.col("cell").alias(x), F.col("part").alias("p" + x), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    close = rest.join(ends("u", 1), ["u", "pu"]).join(ends("v", 2), ["v", "pv"]).where(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= radius_km)
    return found.union(close.select("u", "v").distinct())


def gps_members(points: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    return gps_clusters(points, radius_km).select(F.lit("gps-cluster").alias("finding_type"), F.col("cluster").alias("key"), "file_id")


def batch_members(items: DataFrame, points: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """Keys and files of a batch; a batch of one file has none."""
    first, last = items.agg(F.min("file_id"), F.max("file_id")).first()
    if first == last:
        return items.select(F.lit("").alias("finding_type"), F.lit("").alias("key"), "file_id").limit(0)
    return cut(gps_members(points, radius_km).unionByName(device_members(items)).unionByName(author_members(items)))


def batch_findings(items: DataFrame, points: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    return findings(batch_members(items, points, radius_km))
