"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from conftest import folder
from tracewash.plans import catalog
from tracewash.plans.views import TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder('sf0.001')}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return float(v) if type(v).__name__.startswith(("int", "float", "uint")) else str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, folder("sf0.001")).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_text_cleaning_replaces_first_occurrences(spark):
    from pyspark.sql import functions as F

    from tracewash.functions import urls

    text = "see HTTP://Shop.Example.com:80/a?fbclid=1&q=x y and https://b.org and http://c.org/?utm_source=z."
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    out = [r.c for r in df.select(urls.clean_text(F.col("text")).alias("c")).collect()]
    assert out[0].text == "see http://shop.example.com/a?q=x y and https://b.org and http://c.org/"
    assert (out[0].found, out[0].cleaned_urls) == (3, 2)
    assert out[2].text == "" and out[1].text is None


def test_options_of_url_cleaning(spark):
    from pyspark.sql import functions as F

    from tracewash.functions import urls

    df = spark.createDataFrame([("https://u:p@a.org/p?gclid=1&my_token=2&v=3#frag",)], "url string")
    c = F.col("url")
    row = df.select(
        urls.clean_url(c)["cleaned"].alias("all"),
        urls.clean_url(c, preserve_hash=True)["cleaned"].alias("hash"),
        urls.clean_url(c, remove_all=False, aggressive=True)["cleaned"].alias("suspected"),
        urls.clean_url(c, remove_all=False)["cleaned"].alias("none"),
    ).first()
    assert row["all"] == "https://a.org/p?v=3" and row["hash"] == "https://a.org/p?v=3#frag"
    assert row["suspected"] == "https://a.org/p?gclid=1&v=3" and row["none"] == "https://a.org/p?gclid=1&my_token=2&v=3"


def test_clusters_across_the_date_line_and_near_the_pole(spark):
    from tracewash.operators.correlation import gps_clusters

    rows = [("a", 10.0, 179.995), ("b", 10.0, -179.995), ("c", 89.999, 0.0), ("d", 89.999, 180.0), ("e", 0.0, 0.0), ("f", None, 1.0)]
    got = {r.file_id: r.cluster for r in gps_clusters(spark.createDataFrame(rows, "file_id string, lat double, lon double")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_clusters_equal_all_pairs(spark):
    import math
    import random

    from tracewash.operators.correlation import gps_clusters

    rnd = random.Random(4)
    pts = [(f"{i:03d}", rnd.choice([0, 45, 80, -60]) + rnd.uniform(-0.1, 0.1), rnd.choice([0, 180]) + rnd.uniform(-0.1, 0.1)) for i in range(400)]
    up = {p[0]: p[0] for p in pts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (m, a, b) in enumerate(pts):
        for n, c, d in pts[:i]:
            h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
            if 2 * 6371 * math.asin(math.sqrt(min(1, h))) <= 2:
                x, y = sorted((root(m), root(n)))
                up[y] = x
    got = {r.file_id: r.cluster for r in gps_clusters(spark.createDataFrame(pts, "file_id string, lat double, lon double")).collect()}
    assert got == {p[0]: root(p[0]) for p in pts}


def test_two_clouds_at_just_the_radius(spark):
    import numpy as np

    from tracewash.operators.correlation import gps_clusters

    rng = np.random.default_rng(3)
    unit = lambda p: np.stack([np.cos(p[:, 0]) * np.cos(p[:, 1]), np.cos(p[:, 0]) * np.sin(p[:, 1]), np.sin(p[:, 0])], 1)
    rows, want = [], {}
    for k in range(40):  # pairs of clouds far from each other, each cloud well within the radius
        turn, at = rng.uniform(0, 6.28), np.array([k * 0.5 - 10, 20.0])
        here = at + rng.standard_normal((30, 2)) * 0.0012
        there = at + rng.standard_normal((30, 2)) * 0.0012 + np.array([np.sin(turn), np.cos(turn)]) * rng.uniform(0.0195, 0.0235)
        h = np.linalg.norm(unit(np.radians(here))[:, None] - unit(np.radians(there))[None], axis=2)
        joined = (2 * 6371 * np.arcsin(h / 2) <= 2).any()
        for name, cloud in (("a", here), ("b", there)):
            for n, (lat, lon) in enumerate(cloud):
                rows.append((f"{k:02d}{name}{n:02d}", float(lat), float(lon)))
                want[rows[-1][0]] = f"{k:02d}a00" if joined or name == "a" else f"{k:02d}b00"
    assert len(set(want.values())) not in (40, 80)
    got = {r.file_id: r.cluster for r in gps_clusters(spark.createDataFrame(rows, "file_id string, lat double, lon double")).collect()}
    assert got == want


def test_findings_follow_arrivals(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracewash.operators import correlation, items
    from tracewash.plans.views import view
    from tracewash.streaming import findings

    rows = view(spark, folder("sf0.001"), "v_items").select("file_id", "ord", "field", "value")
    places = view(spark, folder("sf0.001"), "v_gps").selectExpr("file_id", "stack(2, 0L, 'GPSLatitude', cast(lat as string), 1L, 'GPSLongitude', cast(lon as string)) as (ord, field, value)")
    rows = rows.where("cast(substring(file_id, 2) as int) < 1500").union(places).cache()
    n = F.pmod(F.xxhash64("file_id"), F.lit(3))
    stored = f"file:{tmp_path}/state"
    for k in (0, 1, 2, 2):  # the last batch runs twice
        findings.add_batch(rows.where(n == k), stored, k)
        upto = rows.where(n <= k)
        want = correlation.batch_findings(upto, items.gps_points(upto)).collect()
        got = findings.findings(spark, stored).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and any(r.finding_type == "gps-cluster" for r in got)
    assert sorted(p.name for p in (tmp_path / "state" / "labels").iterdir()) == ["batch=1", "batch=2"]


def test_clusters_that_a_later_place_joins(spark, tmp_path):
    from tracewash.streaming import findings

    stored = f"file:{tmp_path}/state"
    places = [[("a", 10.0, 20.0), ("b", 10.03, 20.0)], [("c", 10.015, 20.0)], [("d", 50.0, 20.0)]]
    for k, some in enumerate(places):
        rows = [(f, i, field, str(v)) for f, lat, lon in some for i, (field, v) in enumerate((("GPSLatitude", lat), ("GPSLongitude", lon)))]
        findings.add_batch(spark.createDataFrame(rows, "file_id string, ord long, field string, value string"), stored, k)
        assert [(r.key, r.n_files) for r in findings.findings(spark, stored).collect()] == ([("a", 3)] if k else [])
    assert {r.file_id for r in findings.members(spark, stored).where("key = 'a'").collect()} == {"a", "b", "c"}


def test_components_of_a_path_and_a_star(spark):
    from tracewash.operators.graph import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({label[i] for i in range(61)}) == 1 and len({label[100 + i] for i in range(40)}) == 1 and label[0] != label[100]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tables_need_a_shared_folder_and_can_be_dropped(spark, monkeypatch):
    import os

    from tracewash.operators import graph

    table = graph.cut(spark.range(3))
    folder_of = graph.shared_folder(spark).removeprefix("file:")
    assert table.count() == 3 and os.listdir(folder_of)
    graph.drop_tables(spark)
    assert not os.path.exists(folder_of)

    class Far:
        class sparkContext:
            master = "spark://x:1"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        graph.shared_folder(Far)


def test_faults_inside_optional_modules_are_logged(monkeypatch, tmp_path, caplog):
    import __spark_entry__

    (tmp_path / "faulty.py").write_text("import xxhash_is_missing")
    (tmp_path / "broken.py").write_text("from math import nothing_of_that_name")
    (tmp_path / "wrong.py").write_text("1 / 0")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert __spark_entry__._optional("not_there_at_all") is None and not caplog.records
    assert __spark_entry__._optional("faulty") is None and "xxhash_is_missing" in caplog.text
    assert __spark_entry__._optional("broken") is None and "nothing_of_that_name" in caplog.text
    with pytest.raises(ZeroDivisionError):
        __spark_entry__._optional("wrong")
