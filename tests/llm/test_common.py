import numpy as np
import pytest
from pyspark.sql import functions as F

from proseline.llm import common


def test_components_of_a_long_path(spark):
    n = 201
    order = np.random.default_rng(1).permutation(n).tolist()
    rows = list(zip(order, order[1:], strict=False)) + [(500, 500), (7, None), (601, 600), (600, 601)]
    edges = spark.createDataFrame(rows, "a long, b long")
    got = {r.id: r.component_id for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {600: 600, 601: 600}
    with pytest.raises(RuntimeError):
        common.connected_components(edges, most_rounds=1)
    assert common.connected_components(edges.limit(0)).count() == 0


def test_star_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.createDataFrame([(5000, 5001), (5001, 2999)], "a long, b long"))
    assert {r.component_id for r in common.connected_components(edges).collect()} == {0}


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = [(k, i) for i, k in enumerate([1] * 50 + [2] * 20 + [3, 4, 5, None, None, 9])]
    big = spark.createDataFrame(rows, "k long, i long")
    small = spark.createDataFrame([(1, "a", 50), (2, "b", 20), (3, "c", 1), (4, None, 1), (7, "x", 0), (None, "n", 2)], "k long, v string, n long")
    want = {1: "a", 2: "b", 3: "c"}
    for times in (None, "n"):
        got = sorted(((r.i, r.k, r.v) for r in common.hot_join(big, small, "k", "i", times).collect()))
        assert got == [(i, k, want.get(k)) for k, i in rows]


def test_smallest_is_exact_at_any_share(spark):
    df = spark.range(2_000_000).select("id", F.when(F.col("id") % 2 == 0, "even").when(F.col("id") < 5, "few").alias("g"))
    for most in (1, 40):
        got = df.where(common.smallest(df, "g", "id", most, 3)).groupBy("g").count().collect()
        assert {r.g: r["count"] for r in got} == {"even": most, "few": min(most, 2)}
    assert df.limit(0).where(common.smallest(df.limit(0), "g", "id", 3, 3)).count() == 0


def test_no_local_folder_on_a_cluster():
    from unittest.mock import MagicMock

    session = MagicMock()
    session.conf.get.return_value = session.sparkContext.getConf().get.return_value = None
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        common.shared_root(session)
    session.conf.get.return_value = "hdfs://host/folder/"
    assert common.shared_root(session) == "hdfs://host/folder"
