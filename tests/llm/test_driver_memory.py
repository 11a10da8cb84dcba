"""What must not pass through the driver."""

from pyspark.sql import functions as F

import corpus_pipeline
from tracewash.llm import minhash, pii
from tracewash.operators import graph


def broadcasts(spark, run) -> list[str]:
    """Plans that ran in ``run`` and broadcast a table."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every = store.executionsList(int(before), int(store.executionsCount() - before))
    plans = [every.apply(k).physicalPlanDescription() for k in range(every.size())]
    assert plans
    return [p for p in plans if "BroadcastExchange" in p]


def documents(spark):
    words = lambda k: " ".join(f"w{k * 50 + i}" for i in range(40))
    rows = [(k, f"{words(k // 3)} tail{k} mail person{k // 4}@example.org", "en", "s", 1) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_broadcast_nothing(spark):
    docs = documents(spark)
    assert not broadcasts(spark, lambda: minhash.near_duplicates(docs, 5, 80).collect())
    assert not broadcasts(spark, lambda: corpus_pipeline.near_duplicates(spark, docs, "").collect())


def test_components_broadcast_nothing(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert not broadcasts(spark, lambda: graph.components(edges).collect())


def test_personal_data_broadcasts_no_terms(spark):
    docs = documents(spark)
    assert not broadcasts(spark, lambda: pii.find(docs).collect())
    assert not broadcasts(spark, lambda: pii.sanitise(docs).collect())
