"""Statistics of permutations by products of blocks equal those by windows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaspark.functions import association
from sylvaspark.operators import permutation, resampling, splits, trees
from sylvaspark.sources import stages


def rows(spark, classes):
    rng = np.random.default_rng(4)
    cells = [(f"r{i}" + "z" * 40 * (i == 7), i % 2, f, float(round(rng.normal() + (f == "a") * (i % classes), 1)), i % classes) for i in range(90) for f in "ab"]
    return spark.createDataFrame(cells, "row_id string, node long, feature string, x double, y int")


def both_ways(monkeypatch, of):
    """Results by blocks, which must not be left, and by windows."""
    monkeypatch.setattr(resampling, "BLOCK", 16)
    monkeypatch.setattr(resampling, "CHUNK", 3)
    monkeypatch.setattr(resampling, "PIECE", 1)
    asked, way = [], resampling.statistics
    monkeypatch.setattr(resampling, "statistics", lambda *a, **k: asked.append(way(*a, **k)) or asked[-1])
    found = [sorted(map(tuple, of().collect()))]
    assert asked and asked[-1] is not None
    monkeypatch.setattr(resampling, "statistics", lambda *a, **k: None)
    found.append(sorted(map(tuple, of().collect())))
    assert len(found[0]) == len(found[1])
    for a, b in zip(*found):
        assert a == pytest.approx(b, abs=1e-9)


def test_permuted_dependence_on_a_class(spark, monkeypatch):
    both_ways(monkeypatch, lambda: permutation.statistics(rows(spark, 2), 7, 0, "rdc_class", ["node"]).select("node", "feature", "b", "t"))


def test_digests_are_those_of_the_library():
    texts = [b"", b"a" * 60, "é".encode(), b"12345", b"54321"]
    high, low = resampling.Digests(texts).of(b"1|2|")
    assert [f"{h:016x}{v:016x}" for h, v in zip(high, low)] == [hashlib.md5(b"1|2|" + t).hexdigest() for t in texts]
    numbers = np.arange(0, 20000, 7)
    high, low = resampling.Digests(numbers.astype("S")).of(b"0|31|")
    assert all(f"{h:016x}{v:016x}" == hashlib.md5(b"0|31|%d" % i).hexdigest() for i, h, v in zip(numbers, high, low))


def test_orders_are_those_of_the_library():
    texts = [b"%d" % (i % 3000) for i in range(4000)] + ["é".encode(), b"", b"z" * 60]
    for prefix in (b"0|7|", b"12|1234567|"):
        assert resampling.Digests(texts).order(prefix).tolist() == sorted(range(len(texts)), key=lambda i: hashlib.md5(prefix + texts[i]).digest())  # noqa: B023
    ids = np.array(["b", "é", "a\0", "a", "", "10", "9"], object)
    at, found = resampling._by_id(ids)
    assert found == sorted(t.encode() for t in ids) == [ids[i].encode() for i in at]


def test_rows_that_do_not_fit_take_windows(spark):
    r = rows(spark, 2)
    assert resampling.statistics(r.where("NOT (row_id = 'r3' AND feature = 'a')"), 3, 0, "mc", ["node"]) is None
    assert resampling.statistics(r.withColumn("row_id", F.lit("same")), 3, 0, "mc", ["node"]) is None
    assert resampling.statistics(r.withColumn("y", F.when(F.col("row_id") != "r3", F.col("y"))), 3, 0, "mc", ["node"]) is None


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_threshold_statistics(spark, monkeypatch, criterion):
    r = rows(spark, 3)
    both_ways(monkeypatch, lambda: permutation.threshold_statistics(r, splits.thresholds(r, "histogram", 4, by=["node"]), 7, 1, criterion, ["node"]).select("node", "feature", "threshold", "b", "t"))


def test_permuted_correlation_ratio(spark, monkeypatch):
    both_ways(monkeypatch, lambda: permutation.statistics(rows(spark, 3), 7, 0, "mc", ["node"]).select("node", "feature", "b", "t"))


def test_dependence_on_one_class_of_many(spark, monkeypatch):
    both_ways(monkeypatch, lambda: association.rdc(rows(spark, 4), task="classification"))


@pytest.mark.parametrize(("stopping", "depth"), [("adaptive", 2), (None, 1)])
def test_trees_test_wide_rows(spark, monkeypatch, stopping, depth):
    rng = np.random.default_rng(5)
    cells = [(f"r{i}", i % 3, float(rng.normal() + i % 3), float(rng.normal()), 1.0) for i in range(120)]
    df = spark.createDataFrame(cells, "id string, y int, a double, b double, same double")
    grown = lambda: trees.grow(df, "id", ["a", "b", "same"], "y", trees.TreeParams(max_depth=depth, min_leaf=5, n_resamples=20, early_stopping=stopping, threshold_method="histogram", max_thresholds=4)).nodes
    monkeypatch.setattr(resampling, "BLOCK", 16)
    monkeypatch.setattr(resampling, "CHUNK", 7)
    monkeypatch.setattr(resampling, "PIECE", 20000)
    with monkeypatch.context() as m:
        m.setattr(resampling, "statistics", lambda *a, **k: pytest.fail("a long table was made"))
        wide = grown()
    monkeypatch.setattr(resampling, "blocked", lambda *a: None)
    long = grown()
    assert len(wide) > 1 and wide.keys() == long.keys()
    for at, node in wide.items():
        a, b = vars(node), vars(long[at])
        assert a["feature"] == b["feature"] and a["n"] == b["n"]
        for name in ("value", "impurity", "threshold", "p_feature", "p_threshold", "decrease"):
            assert a[name] is b[name] or a[name] == pytest.approx(b[name], abs=1e-9)


def test_tests_of_trees_write_rows_and_thresholds_only(spark, monkeypatch):
    df = spark.createDataFrame([(f"r{i}", i % 3, float(i % 3 + i % 7), float(i % 5)) for i in range(120)], "id string, y int, a double, b double")
    written = []
    for module in (trees, resampling):
        monkeypatch.setattr(module, "stage", lambda t, name: written.append((name, len(t.columns))) or stages.stage(t, name))
    m = trees.grow(df, "id", ["a", "b"], "y", trees.TreeParams(max_depth=1, min_leaf=5, n_resamples=20, threshold_method="histogram", max_thresholds=4))
    assert len(m.nodes) == 3 and [name for name, _ in written] == ["level", "feature", "sweep"]
    assert written[0] == ("level", 7)  # the features are one column


def test_small_tables(spark):
    row = (3, 2**60 + 1, "é \"'", 0.1 + 0.2, None)
    t = stages.small(spark, [row, (1, -1, "", -1e-300, 2.0)], "a int, `b` bigint, c string, d double, e double")
    assert list(map(tuple, t.collect())) == [row, (1, -1, "", -1e-300, 2.0)] and [k for _, k in t.dtypes] == ["int", "bigint", "string", "double", "double"]


def test_rows_that_have_no_blocks(spark):
    r = rows(spark, 3).where("feature = 'a'").select("node", "row_id", "y")
    assert {"code", "block"} <= set(resampling.blocked(r, ["node"]).columns)
    assert resampling.blocked(r.unionByName(r), ["node"]) is None
    assert resampling.blocked(r.withColumn("y", F.when(F.col("row_id") != "r3", F.col("y"))), ["node"]) is None


@pytest.mark.parametrize("classes", [2, 4])
def test_dependence_of_features_that_fit_a_task(spark, monkeypatch, classes):
    r = rows(spark, classes).unionByName(rows(spark, classes).where("feature = 'a'").withColumn("feature", F.lit("flat")).withColumn("x", F.lit(1.0)))
    monkeypatch.setattr(resampling, "_statistics", lambda *a, **k: pytest.fail("permutations were prepared"))
    one = {(x["node"], x["feature"]): x["rdc"] for x in association.rdc(r, by=["node"], task="classification").collect()}
    monkeypatch.setattr(resampling, "statistics", lambda *a, **k: None)
    plain = {(x["node"], x["feature"]): x["rdc"] for x in association.rdc(r, by=["node"], task="classification").collect()}
    assert len(one) == 6 and one == pytest.approx(plain, abs=1e-9)
    w = association._weights(10, 1 / 6, 3)
    for n in (1, 511, 512, 1500):
        assert np.allclose(association._wave_table(n, w), association.waves(np.arange(1, n + 1) / n, w), atol=1e-13)
