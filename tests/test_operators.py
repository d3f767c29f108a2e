"""Hand values, invariants and statistical checks of the analytics operators."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaspark.functions import association, impurity
from sylvaspark.functions.distributions import beta_cdf, budget, chi2_sf, stop_table
from sylvaspark.operators import board, evaluation, inference, numbering, permutation, sampling, splits, trees
from sylvaspark.plans import wrappers
from sylvaspark.registry import SAMPLING_METHODS, THRESHOLD_METHODS
from sylvaspark.sources import files
from sylvaspark.streaming.scoring import score_stream


def long(spark, x, y, feature="f"):
    return spark.createDataFrame([(i, feature, float(a), b) for i, (a, b) in enumerate(zip(x, y))], ["row_id", "feature", "x", "y"])


@pytest.mark.parametrize("y, gini, entropy", [([0, 0, 1, 1], 0.5, 1.0), ([0, 0, 0, 1], 0.375, None), ([0, 1, 2], 2 / 3, math.log2(3))])
def test_class_impurity(spark, y, gini, entropy):
    row = impurity.class_impurity(spark.createDataFrame([(1, v) for v in y], ["g", "y"]), ["g"], "y").first()
    assert row["gini"] == pytest.approx(gini)
    if entropy is not None:
        assert row["entropy"] == pytest.approx(entropy)


@pytest.mark.parametrize("y, mse, mae", [([1, 2, 3, 4], 1.25, 1.0), ([-1, 1], 1.0, 1.0), ([5, 5, 5, 5], 0.0, 0.0)])
def test_value_impurity(spark, y, mse, mae):
    row = impurity.value_impurity(spark.createDataFrame([(1, float(v)) for v in y], ["g", "y"]), ["g"], "y").first()
    assert (row["mse"], row["mae"]) == pytest.approx((mse, mae))


@pytest.mark.parametrize("x, want", [([1, 2, 3, 4], [1.5, 2.5, 3.5]), ([1, 1, 2, 2, 3], [1.5, 2.5]), ([1, 1, 1], []), ([1, 5], [3.0])])
def test_midpoints(spark, x, want):
    got = splits.midpoints(long(spark, x, [0] * len(x)))
    assert sorted(r["threshold"] for r in got.collect()) == want


def test_threshold_methods_are_capped(spark):
    df = long(spark, range(100), [0] * 100)
    assert {m: THRESHOLD_METHODS[m](df, **({} if m == "exact" else {"most": 8})).count() for m in THRESHOLD_METHODS.names()} == {"exact": 99, "random": 8, "percentile": 8, "histogram": 9}


def test_association_hand_values(spark):
    df = long(spark, [0, 0, 0, 10, 10, 10], [0, 0, 0, 1, 1, 1])
    assert association.correlation_ratio(df).first()["eta"] == pytest.approx(1)
    assert association.pearson(long(spark, [1, 2, 3, 4, 5], [5, 4, 3, 2, 1])).first()["pearson"] == pytest.approx(-1)
    constant = long(spark, [2, 2, 2, 2], [0, 1, 0, 1])
    assert association.correlation_ratio(constant).first()["eta"] == 0
    assert association.pearson(constant).first()["pearson"] == 0
    assert association.distance_correlation(constant).first()["dcor"] == 0
    assert association.rdc(constant).first()["rdc"] == 0


def test_dependence_tells_signal_from_noise(spark):
    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=300), rng.normal(size=300)
    y = x * x
    signal, none = long(spark, x, y.tolist()), long(spark, noise, y.tolist())
    assert association.distance_correlation(signal).first()["dcor"] > association.distance_correlation(none).first()["dcor"] + 0.1
    assert association.rdc(signal, s=1.0).first()["rdc"] > association.rdc(none, s=1.0).first()["rdc"]
    label = (y > 0.5).astype(int).tolist()
    assert association.mutual_information(long(spark, y, label)).first()["mi"] > 0.3


def test_permutation_floor_and_constant(spark):
    df = long(spark, [0.0] * 20 + [1.0] * 20, [0] * 20 + [1] * 20)
    assert permutation.permutation_test(df, 100).first()["p_value"] == pytest.approx(1 / 101)
    assert permutation.permutation_test(long(spark, [3] * 10, [0, 1] * 5), 20).first()["p_value"] == 1


def test_null_p_values_are_uniform(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"f{j}", float(rng.normal()), i % 2) for j in range(200) for i in range(40)]
    df = spark.createDataFrame(rows, ["row_id", "feature", "x", "y"])
    p = np.array([r["p_value"] for r in permutation.permutation_test(df, 39).collect()])
    assert 0.01 < (p <= 0.05).mean() < 0.12
    assert abs(p.mean() - 0.5) < 0.1


def test_sequential_stops_for_futility(spark):
    rng = np.random.default_rng(2)
    r = permutation.sequential_test(long(spark, rng.normal(size=60), [0, 1] * 30), 100).first()
    assert r["m"] < 100 and r["p_value"] > 0.05


def test_distributions():
    assert beta_cdf(0.3, 1, 1) == pytest.approx(0.3)
    assert beta_cdf(0.5, 2, 2) == pytest.approx(0.5)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert [budget(0.05, k) for k in ("minimum", "auto", "maximum")] == [20, 52, 100]
    significant = [m for m, low, _ in stop_table(0.05, 0.95, 100) if low == 0]
    assert min(significant) == 58


@pytest.mark.parametrize("weights, total, want", [([1, 2, 3], 5, [1, 2, 2]), ([0, 0, 0], 5, [2, 2, 1])])
def test_apportion(spark, weights, total, want):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], ["i", "w"])
    assert [r["allocated"] for r in sampling.apportion(df, "w", total, "i").orderBy("i").collect()] == want


def test_sampling_sizes(spark):
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(20)], ["id", "y"])
    sizes = {m: [r["count"] for r in SAMPLING_METHODS[m](df, "id", 1, 0, "y").groupBy("stratum").count().orderBy("stratum").collect()] for m in SAMPLING_METHODS.names()}
    assert sizes == {"classic": [20], "stratified": [15, 5], "undersample": [5, 5], "oversample": [10, 10]}


@pytest.mark.parametrize("p, most, want", [(100, "sqrt", 10), (64, "log2", 6), (100, 0.5, 50), (30, 50, 30), (7, None, 7)])
def test_feature_count(p, most, want):
    assert trees.feature_count(p, most) == want


def toy(spark, n=200):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 2, n)
    return spark.createDataFrame([(i, float(z[i] + rng.normal() * 0.1), float(rng.normal()), int(z[i]), float(z[i] * 3)) for i in range(n)], ["id", "a", "b", "y", "t"])


def test_tree_invariants(spark):
    df = toy(spark).cache()
    m = trees.grow(df, "id", ["a", "b"], "y", trees.TreeParams(max_depth=3, n_resamples=40, threshold_method="histogram", max_thresholds=8))
    root = m.nodes[0, 1]
    assert root.feature == "a" and 0.2 < root.threshold < 0.8
    leaves = [n for n in m.nodes.values() if n.feature is None]
    assert sum(n.n for n in leaves) == 200
    assert all(abs(sum(n.value) - 1) < 1e-9 for n in m.nodes.values())
    assert sum(m.importances().values()) == pytest.approx(1)
    assert df.where(m.predict() != F.col("y")).count() == 0
    sizes = {r["leaf"]: r["count"] for r in df.groupBy(m.leaf().alias("leaf")).count().collect()}
    assert sizes == {n.node: n.n for n in leaves}
    path = m.decision_path(df, "id").groupBy("node").count().collect()
    assert {r["node"]: r["count"] for r in path} == {n.node: n.n for n in m.nodes.values()}
    assert m.table(spark).count() == len(m.nodes)
    honest = trees.reestimate(m, df.where("id < 50"), "y")
    assert all(abs(sum(n.value) - 1) < 1e-9 for n in honest.nodes.values())


def test_no_signal_is_one_leaf(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(rng.normal()), i % 2) for i in range(60)], ["id", "a", "y"])
    assert len(trees.grow(df, "id", ["a"], "y", trees.TreeParams(n_resamples=100, alpha_feature=0.01)).nodes) == 1


def test_regression_forest_and_out_of_bag(spark):
    df = toy(spark).cache()
    sample = sampling.bootstrap(df, "id", 3, 0)
    m = trees.grow(df, "id", ["a", "b"], "t", trees.TreeParams(task="regression", trees=3, max_depth=2, min_leaf=5), sample)
    assert evaluation.regression_metrics(df.withColumn("p", m.predict()), "t", "p").first()["r2"] > 0.95
    oob = trees.out_of_bag(m, df, "id", "t", sampling.unsampled(df, "id", sample, 3))
    assert 0 < oob.count() < 200


def test_tree_rejects_bad_input(spark):
    df = spark.createDataFrame([(0, float("nan"), 0), (1, 1.0, 1)], ["id", "a", "y"])
    with pytest.raises(ValueError):
        trees.grow(df, "id", ["a"], "y", trees.TreeParams())
    with pytest.raises(ValueError):
        trees.TreeParams(n_resamples=5)


def test_ranking_metrics(spark):
    df = spark.createDataFrame([([3, 1, 2], [1]), ([4, 5], [])], "r array<int>, t array<int>")
    r, t = F.col("r"), F.col("t")
    got = df.select(evaluation.precision_at(r, t, 2), evaluation.recall_at(r, t, 2), evaluation.jaccard_at(r, t, 2), evaluation.precision_at(r, t, 0)).collect()
    assert [tuple(x) for x in got] == [(0.5, 1.0, 0.5, 0.0), (0.0, 0.0, 0.0, 0.0)]
    assert evaluation.k_values(80) == [5, 10, 25, 50, 80]


def test_effect_sizes_and_signs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], ["g", "v"])
    assert inference.cohens_d(df, "g", "a", "b", "v").first()["d"] == 0
    assert inference.sign_test(5, 0) == pytest.approx(1 / 32)
    assert inference.sign_test(0, 0) == 1
    assert board.keep_last(spark.createDataFrame([(1, 1), (1, 2)], ["k", "o"]), ["k"], "o").first()["o"] == 2
    with pytest.raises(ValueError):
        board.unique_join(df, df, ["g"])


def test_files_and_stream(spark, tmp_path):
    df = toy(spark, 40)
    files.save(df, f"{tmp_path}/d1/cif_seed3.parquet")
    got = files.artifacts(spark, f"{tmp_path}/d1/*").select("dataset", "seed").distinct().collect()
    assert files.exists(spark, f"{tmp_path}/d1") and len(got) == 1
    assert files.config_id("cit", {}) == "cit__99914b932bd37a50"
    df.write.option("header", True).csv(f"{tmp_path}/c")
    assert files.csv(spark, f"{tmp_path}/c").count() == 40
    m = trees.grow(df, "id", ["a", "b"], "y", trees.TreeParams(max_depth=1))
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/d1/cif_seed3.parquet")
    score_stream(stream, m, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("prediction = y").count() == 40


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=300) > 0, "b", "a")
    near = x[:, 0] + 0.05 * rng.normal(size=300)
    return spark.createDataFrame([(i, *(float(v) for v in r), float(w), k) for i, (r, w, k) in enumerate(zip(x, near, y.tolist()))], "id int, f0 double, f1 double, f2 double, f3 double, g double, y string").cache()


def test_wrappers_put_the_signal_first(signal):
    names = ["f1", "f0", "f2", "f3"]
    assert wrappers.permutation_importance(signal, "id", names, "y", repeats=3).where("rank = 1").first()["feature"] == "f0"
    assert wrappers.eliminate(signal, names, "y")[0] == ("f0", 1)
    found = {f: (decision, rank) for f, decision, _, rank in wrappers.boruta(signal, "id", names, "y", rounds=8)}
    assert found["f0"] == ("confirmed", 1) and all(found[f][0] != "confirmed" for f in ("f1", "f2", "f3"))
    for model in ("dt", "rf", "gbt", "et"):
        weight = wrappers.importances(signal, "id", names, "y", model, trees=3, depth=2)
        assert max(weight, key=weight.get) == "f0"


def test_permuting_within_strata_shrinks_a_copied_signal(signal):
    names = ["f0", "f1", "g"]
    whole, within = ({r["feature"]: r["importance"] for r in wrappers.permutation_importance(signal, "id", names, "y", repeats=5, conditional=c).collect()} for c in (None, 0.9))
    assert within["f0"] + within["g"] < whole["f0"] + whole["g"]
    assert within["f1"] == pytest.approx(whole["f1"])


def test_donated_values_are_a_permutation(signal):
    moved = wrappers.donated(signal, "id", ["f0"], 1, 2, {"f0": F.when(F.col("id") == 7, 1).otherwise(0)})
    own = {r["id"]: r["f0"] for r in signal.collect()}
    for b in (1, 2):
        got = {r["row_id"]: r["x"] for r in moved.where(F.col("b") == b).collect()}
        assert sorted(got.values()) == sorted(own.values())
        assert [i for i in own if got[i] == own[i]] == [7]


def test_donated_values_go_round_the_whole_stratum(spark, monkeypatch):
    def cycle(n, strata):
        order = lambda i: hashlib.md5(f"1|f|1|{i}".encode()).hexdigest()
        rings = [sorted((i for i in range(n) if strata(i) == s), key=order) for s in {strata(i) for i in range(n)}]
        return {a: float(b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])}

    got = lambda n, **k: {r["row_id"]: r["x"] for r in wrappers.donated(spark.range(n).withColumn("f", F.col("id")), "id", ["f"], 1, 1, **k).collect()}
    assert got(70_000) == cycle(70_000, lambda i: 0)
    monkeypatch.setattr(numbering, "ROWS", 16)
    within = F.when(F.col("id") % 3 > 0, F.col("id") % 3)
    assert got(300, strata={"f": within}) == cycle(300, lambda i: i % 3)


def test_constant_column_makes_no_stratum(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(10)], ["a", "k"])
    strata = lambda c: [r[0] for r in df.orderBy("a").select(wrappers.strata(df, c)).collect()]
    assert strata(["k"]) == strata([]) == [0] * 10
    assert strata(["k", "a"]) == strata(["a"]) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_neighbours_at_distance_zero_decide_alone(spark):
    train = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 7.0), (3, 1.0, 100.0)], ["id", "x", "v"])
    test = spark.createDataFrame([(9, 0.0), (10, 3.0)], ["id", "x"])
    got = {r["row_id"]: r["prediction"] for r in evaluation.neighbour_predict(train, test, "id", ["x"], "v", 3, "regression").collect()}
    assert got[9] == 6.0
    assert got[10] == pytest.approx((5 / 3 + 7 / 3 + 100 / 2) / (1 / 3 + 1 / 3 + 1 / 2))


def test_coverage_probability():
    assert wrappers.coverage_probability(10, 10, 1) == 1.0
    assert wrappers.coverage_probability(10, 3, 1) == pytest.approx(0.3)


def test_permutation_tree_splits_on_four_features(spark):
    rows = [(i, (i * 37 % 101) / 101, (i * 53 % 97) / 97, (i * 29 % 89) / 89, (i * 41 % 83) / 83, int((i * 29 % 89) / 89 > 0.5)) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int")
    root = trees.grow(df, "id", ["a", "b", "c", "d"], "y", trees.TreeParams(max_depth=1, n_resamples=40, threshold_method="percentile", max_thresholds=9)).nodes[0, 1]
    assert root.feature == "c" and 0.45 < root.threshold < 0.55
    assert root.p_feature == pytest.approx(1 / 161)


def test_permutation_tree_scales_resamples_by_the_features_that_vary(spark):
    rows = [(i, i / 160, 1.0, (i * 29 % 89) / 89, int(i >= 80)) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    root = trees.grow(df, "id", ["a", "b", "c"], "y", trees.TreeParams(max_depth=1, n_resamples=40, threshold_method="percentile", max_thresholds=9)).nodes[0, 1]
    assert root.feature == "a" and root.p_feature == pytest.approx(1 / 81)


def test_twelve_digits_as_in_sql(spark):
    import duckdb

    half = [(500_000_000_000 + 37 * i + 0.5) * 1e-12 for i in range(2000)]
    want = [r[0] for r in duckdb.sql(f"SELECT round(x, 12) FROM (SELECT unnest({half!r}::DOUBLE[]) AS x)").fetchall()]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(half)], "i int, x double").orderBy("i").select(splits.twelfth(F.col("x"))).collect()]
    assert got == want
