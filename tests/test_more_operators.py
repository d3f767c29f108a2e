"""The operators of dependence, tests, trees, models on rankings and experiments against brute force and hand values."""

import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaspark import estimators
from sylvaspark.functions import association, power
from sylvaspark.functions.distributions import beta_cdf, normal_sf, stop_bounds, stop_table, t_cdf, t_quantile, wilcoxon_p
from sylvaspark.operators import board, evaluation, inference, numbering, permutation, sampling, splits, trees
from sylvaspark.plans import downstream, experiments, ranking, wrappers
from sylvaspark.sources import files, generators


def long(spark, x, y, feature="f"):
    return spark.createDataFrame([(i, feature, float(a), b) for i, (a, b) in enumerate(zip(x, y))], ["row_id", "feature", "x", "y"])


def brute_dcor(x, y):
    a, b = (np.abs(np.subtract.outer(v, v)) for v in (x, y))
    centre = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    a, b = centre(a), centre(b)
    bottom = math.sqrt((a * a).mean() * (b * b).mean())
    return math.sqrt(max(0, (a * b).mean()) / bottom) if bottom > 1e-15 else 0.0


@pytest.mark.parametrize("kernel_rows", [8192, 7, 1])
def test_distance_correlation_in_stretches(spark, kernel_rows):
    rng = np.random.default_rng(0)
    x, y = np.round(rng.normal(size=45), 1), np.round(rng.normal(size=45), 1)
    got = association.distance_correlation(long(spark, x, y.tolist()), kernel_rows=kernel_rows).first()["dcor"]
    assert got == pytest.approx(brute_dcor(x, y), abs=1e-9)


def test_distance_correlation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ROWS", 10)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), rng.normal(size=60)
    got = association.distance_correlation(long(spark, x, y.tolist()), kernel_rows=8).first()["dcor"]
    assert got == pytest.approx(brute_dcor(x, y), abs=1e-9)


def brute_mi(x, y, k=3):
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    keep = [i for i in range(len(x)) if y.count(y[i]) > 1]
    terms = []
    for i in keep:
        own = sorted(abs(x[j] - x[i]) for j in keep if y[j] == y[i] and j != i)
        m = min(k, len(own))
        inside = sum(abs(x[j] - x[i]) < own[m - 1] or x[j] == x[i] for j in keep)
        terms.append((psi(m), psi(len(own) + 1), psi(max(1, inside))))
    return max(0.0, psi(len(keep)) + np.mean([t[0] for t in terms]) - np.mean([t[1] for t in terms]) - np.mean([t[2] for t in terms])) if keep else 0.0


def test_mutual_information_is_that_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for rows in (1 << 20, 9):
        monkeypatch.setattr(numbering, "ROWS", rows)
        x = (np.round(rng.normal(size=50) * 8) / 8).tolist()  # distances without rounding
        y = [int(v > 0) + (i % 7 == 0) for i, v in enumerate(x)]
        y[3] = 9  # alone in its class
        assert association.mutual_information(long(spark, x, y)).first()["mi"] == pytest.approx(brute_mi(x, y), abs=1e-6)


def brute_rdc(x, y, seed):
    n = len(x)
    place = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable") / n + 1 / n
    a = association.waves(place(np.array(x)), association._weights(10, 1 / 6, seed))
    b = association.waves(place(np.array(y)), association._weights(10, 1 / 6, seed + 1000))
    return max(abs(np.corrcoef(a[:, i], b[:, j])[0, 1]) for i in range(20) for j in range(20))


def test_randomised_dependence_on_numbers_and_classes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60).tolist()
    y = [float(v * v + 0.1 * w) for v, w in zip(x, rng.normal(size=60))]
    assert association.rdc(long(spark, x, y)).first()["rdc"] == pytest.approx(brute_rdc(x, y, 42), abs=1e-6)
    c = [int(v > 0.5) + int(v > 1) for v in y]
    want = max(brute_rdc(x, [float(v == k) for v in c], 42 + k) for k in range(3))
    assert association.rdc(long(spark, x, c), task="classification").first()["rdc"] == pytest.approx(want, abs=1e-6)
    two = [float(v > 0.5) for v in y]
    assert association.rdc(long(spark, x, two), task="classification").first()["rdc"] == pytest.approx(brute_rdc(x, two, 42), abs=1e-6)


@pytest.mark.parametrize("kind", ["mi", "dc", "rdc", "rdc_class"])
def test_permutation_tests_of_any_statistic(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=40)
    y = (x > 0).astype(int).tolist() if kind in ("mi", "rdc_class") else (x + 0.1 * rng.normal(size=40)).tolist()
    both = long(spark, x, y, "signal").unionByName(long(spark, rng.normal(size=40), y, "noise"))
    p = {r["feature"]: r["p_value"] for r in permutation.permutation_test(both, 19, 0, kind).collect()}
    assert p["signal"] == pytest.approx(1 / 20) and p["noise"] > 0.05
    s = {r["feature"]: r for r in permutation.sequential_test(both, 40, 0, kind, rule="simple").collect()}
    assert s["signal"]["m"] == 20 and s["signal"]["p_value"] < 0.05 <= s["noise"]["p_value"]


def sequential(hits, n, alpha, gamma, every, rule):
    """The loop that the running sums stand for."""
    least, seen = math.ceil(1 / alpha), 0
    for m, h in enumerate(hits, 1):
        seen += h
        if m < least:
            continue
        if rule == "simple":
            if (seen + 1) / (m + 1) < alpha or ((seen + 1) / (n + 1) >= alpha and seen >= 3):
                return m, seen
        elif m % every == 0 or m == n:
            p = beta_cdf(alpha, 1 + seen, 1 + m - seen)
            if p >= gamma or 1 - p >= gamma:
                return m, seen
    return n, seen


@pytest.mark.parametrize("rule, every", [("adaptive", 1), ("adaptive", 32), ("simple", 1)])
def test_stopping_equals_the_loop(spark, rule, every):
    rng, n = random.Random(5), 120
    streams = {k: [int(rng.random() < p) for _ in range(n)] for k, p in enumerate((0, 0.01, 0.03, 0.05, 0.1, 0.4, 1))}
    rows = [(k, 0, 1.0) for k in streams] + [(k, b, float(h)) for k, s in streams.items() for b, h in enumerate(s, 1)]
    got = permutation.stopped(spark.createDataFrame(rows, "k int, b int, t double"), n, ["k"], rule, 0.05, 0.95, every).collect()
    assert {r["k"]: (r["m"], r["hits"]) for r in got} == {k: sequential(s, n, 0.05, 0.95, every, rule) for k, s in streams.items()}


def test_stop_bounds_are_the_posterior():
    table = {(m, c) for m, c, _ in stop_table(0.05, 0.95, 90)}
    for m in range(20, 91):
        for c in range(m + 1):
            p = beta_cdf(0.05, 1 + c, 1 + m - c)
            assert ((m, c) in table) == (p >= 0.95 or p <= 0.05), (m, c)
    assert all(low < high for _, low, high in stop_bounds(0.05, 0.95, 90))


def test_distributions_of_tests():
    assert normal_sf(1.959963984540054) == pytest.approx(0.025)
    assert t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6) and t_quantile(0.975, 98) == pytest.approx(1.984467, abs=1e-5)
    # ranks 1..5 (doubled), all positive: one of 32 sums on each side
    assert wilcoxon_p([2, 4, 6, 8, 10], 15) == pytest.approx(2 / 32)
    assert power.critical_correlation(100, 0.05) == pytest.approx(0.19655, abs=1e-4)
    assert power.correlation_power(0.0, 1000, 0.05) == pytest.approx(0.05, abs=1e-3) and power.correlation_power(0.5, 100, 0.05) > 0.99
    low, high = power.gap_region(2000, 0.05)
    assert low < high and power.gap_region(20, 0.05) is None
    assert power.soft_gate(50, 0.0) == pytest.approx(0.5, abs=1e-3) and power.soft_gate(5, power.soft_gate_centre(0.2, 5)) == pytest.approx(0.2, abs=1e-6)
    assert power.noisy_gate(0.2, 0.0)["true_share"] == 1 and power.chance_first(0.5, 200, 10) > 0.99 and power.critical_depth(0.1, 1000, 0.05) > 0
    assert power.marginal_gate_power(0.1, 400, 0.05) == pytest.approx(power.gate_power(0.1, 400, 0.05), abs=0.05)


def test_wilcoxon_p_values(spark):
    rows = [("a", float(i) * (1 if i % 4 else -1)) for i in range(1, 13)] + [("b", float(v)) for v in (1, 1, -1, 2, 2, 3, -4, 5)]
    df = spark.createDataFrame(rows, "g string, d double")
    approx = {r["g"]: r for r in inference.wilcoxon(df, ["g"], "d").collect()}
    for r in approx.values():
        assert r["p_value"] == pytest.approx(2 * normal_sf(abs(r["z"])), abs=1e-9)
    exact = {r["g"]: r["p_value"] for r in inference.wilcoxon_exact(df, ["g"], "d").collect()}
    d = [v for g, v in rows if g == "b"]
    ranks = [sum(abs(w) < abs(v) for w in d) + (sum(abs(w) == abs(v) for w in d) + 1) / 2 for v in d]
    sums = [sum(r for i, r in enumerate(ranks) if mask >> i & 1) for mask in range(2 ** len(d))]
    w = sum(r for r, v in zip(ranks, d) if v > 0)
    assert exact["b"] == pytest.approx(min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums)))
    z = spark.createDataFrame([(v,) for v in (0.0, 0.5, -1.96, 2.9, 3.0, 3.1, 6.0)], "z double")
    assert [r[0] for r in z.select(inference.normal_p(F.col("z"))).collect()] == pytest.approx([2 * normal_sf(abs(v)) for v in (0.0, 0.5, -1.96, 2.9, 3.0, 3.1, 6.0)], abs=1e-8)


def impurity(y, criterion):
    if criterion in ("gini", "entropy"):
        p = [y.count(v) / len(y) for v in set(y)]
        return 1 - sum(v * v for v in p) if criterion == "gini" else -sum(v * math.log2(v) for v in p)
    return float(np.var(y)) if criterion == "mse" else float(np.mean(np.abs(np.array(y) - np.median(y))))


@pytest.mark.parametrize("criterion", ["gini", "entropy", "mse", "mae"])
def test_threshold_tests_of_all_thresholds(spark, criterion):
    rng = random.Random(6)
    x = [rng.randint(0, 9) for _ in range(40)]
    y = [int(v > 4 or rng.random() < 0.2) if criterion in ("gini", "entropy") else float(v > 4) + rng.randint(0, 2) for v in x]
    df = long(spark, x, y)
    at = splits.midpoints(df).unionByName(spark.createDataFrame([("f", 99.0)], "feature string, threshold double"))
    every = {}
    for r in permutation.permuted(df.select("row_id", "y"), 19, 3).collect():
        every.setdefault(r["b"], {})[r["row_id"]] = r["y"]

    def cost(ys, t):
        left, right = [ys[i] for i in range(40) if x[i] <= t], [ys[i] for i in range(40) if x[i] > t]
        return (len(left) * impurity(left, criterion) + len(right) * impurity(right, criterion)) / 40 if left and right else math.inf

    got = {r["threshold"]: r for r in permutation.threshold_test(df, at, 19, 3, criterion).collect()}
    assert len(got) == len(set(x))
    for t, r in got.items():
        own = cost(every[0], t)
        assert r["statistic"] == pytest.approx(own)
        assert r["p_value"] == pytest.approx((sum(cost(every[b], t) <= own + 1e-9 for b in range(1, 20)) + 1) / 20)
    assert got[99.0]["p_value"] == 1


def test_first_accepted(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.04, 2), ("c", 0.01, 3)], "feature string, p_value double, i int")
    stop = {r["feature"]: r for r in permutation.first_accepted(df, [], ["i"], F.lit(0.05), True).collect()}
    assert stop["b"]["reject"] and stop["a"]["tested"] and not stop["c"]["tested"]
    least = {r["feature"]: r for r in permutation.first_accepted(df, [], ["p_value"], F.lit(0.05), False).collect()}
    assert least["c"]["reject"] and all(r["tested"] for r in least.values())


def toy(spark, n=200, noise=0.1):
    rng = np.random.default_rng(7)
    z = rng.integers(0, 2, n)
    return spark.createDataFrame([(i, float(z[i] + rng.normal() * noise), float(rng.normal()), float(rng.normal()), int(z[i]), float(z[i] * 3)) for i in range(n)], "id long, a double, b double, c double, y int, t double")


def test_trees_stop_early_and_mute(spark):
    df = toy(spark, 120, 0.6)
    options = dict(max_depth=2, min_leaf=5, n_resamples_feature=20, n_resamples_threshold=20, threshold_method="histogram", max_thresholds=8)
    p = trees.TreeParams(early_stopping="adaptive", **options)
    m = trees.grow(df, "id", ["a", "b", "c"], "y", p)
    assert m.nodes[0, 1].feature == "a" and m.nodes[0, 1].p_feature < 0.05 / 3
    assert all(n.p_threshold is not None and n.p_threshold < 0.05 for n in m.nodes.values() if n.feature)
    fixed = trees.grow(df, "id", ["a", "b", "c"], "y", trees.TreeParams(**options))
    assert fixed.nodes[0, 1].feature == "a"
    named = trees.TreeParams(n_resamples="minimum", early_stopping="simple", max_depth=1, threshold_method="histogram", max_thresholds=8)
    assert trees.grow(df, "id", ["a", "b", "c"], "y", named).nodes[0, 1].feature == "a"
    assert trees._resamples("minimum", 0.05, 3, True) == (60, 0.05 / 3) and trees._resamples(20, 0.05, 3, False) == (20, 0.05)


def test_muted_features_stay_muted_below_and_not_beside(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        gate = i % 2
        x = float(rng.normal())
        rows.append((i, gate + 0.01 * float(rng.normal()), x, float(rng.normal()), (3 if x > 0 else 2) if gate else int(rng.random() < 0.5)))
    df = spark.createDataFrame(rows, "id long, gate double, x double, n double, y int")
    m = trees.grow(df, "id", ["gate", "x", "n"], "y", trees.TreeParams(max_depth=2, min_leaf=10, n_resamples_feature=40))
    assert m.nodes[0, 1].feature == "gate"
    right = m.nodes[0, m.nodes[0, 1].right]
    assert right.feature == "x"
    muted = trees.grow(df, "id", ["gate", "x", "n"], "y", trees.TreeParams(max_depth=2, min_leaf=10, n_resamples_feature=40, muting=False))
    assert muted.nodes[0, 1].feature == "gate"


@pytest.mark.parametrize("selector", [("mc", "rdc"), "mi", "rdc"])
def test_selectors_of_trees(spark, selector):
    m = trees.grow(toy(spark, 80), "id", ["b", "a"], "y", trees.TreeParams(max_depth=1, selector=selector))
    assert m.nodes[0, 1].feature == "a"
    with pytest.raises(ValueError):
        trees.TreeParams(selector=("mc", "mi"))
    with pytest.raises(ValueError):
        trees.TreeParams(selector="pc")


def test_honest_trees_and_node_numbers(spark, tmp_path):
    df = toy(spark).cache()
    p = trees.TreeParams(trees=2, max_depth=3, min_leaf=2, honesty=True, honesty_fraction=0.4)
    m = trees.grow(df, "id", ["a", "b"], "y", p)
    leaves = [n for n in m.nodes.values() if n.feature is None]
    assert m.nodes[0, 1].n == 120  # the rest gives leaves their values
    for t in range(2):
        assert sum(n.n for n in leaves if n.tree_id == t) >= 80
    ids = m.node_ids()
    assert sorted(i for (t, _), i in ids.items() if t == 0) == list(range(len(m.order(0)))) and m.n_nodes_ptr()[-1] == len(m.nodes)
    for (t, n), node in m.nodes.items():
        if node.feature:
            assert ids[t, node.left] == ids[t, n] + 1 and m.nodes[t, node.right].parent == n
    m.save(spark, str(tmp_path / "m"))
    again = trees.TreeModel.load(spark, str(tmp_path / "m"))
    assert again.nodes == m.nodes and df.where(again.predict() != m.predict()).count() == 0
    path = m.decision_path(df, "id", None).groupBy("tree_id", "node").count().collect()
    assert {(r["tree_id"], r["node"]) for r in path} <= set(m.nodes) and sum(r["count"] for r in path if r["node"] == 1) == 400
    assert m.apply(df, "id").count() == 400


def test_deep_trees_have_room_for_their_numbers(spark):
    rows = [(i, float(i), i % 2) for i in range(80)]
    m = trees.grow(spark.createDataFrame(rows, "id long, x double, y int"), "id", ["x"], "y", trees.TreeParams(max_depth=7))
    assert max(n.node for n in m.nodes.values()) == len(m.nodes)


def test_estimators(spark):
    df = toy(spark, 120)
    f = estimators.ForestClassifier(trees=4, max_depth=2, min_leaf=3, max_samples=0.5, oob_score=True, seed=2)
    assert f.clone() == f and f.clone().set_params(seed=3) != f and "ForestClassifier" in repr(f) and f.get_params()["max_samples"] == 0.5
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        f.fit(df, "id", ["a", "b"], "y")
    assert f.oob > 0.9 and all(f.model.nodes[t, 1].n <= 60 for t in range(4))
    assert f.predict(df).where("prediction = y").count() > 110
    with pytest.raises(ValueError):
        f.predict(df.drop("a"))
    for bad in ({"bootstrap": False, "oob_score": True}, {"bootstrap": False, "max_samples": 5}, {"n_jobs": 0}):
        with pytest.raises(ValueError):
            estimators.ForestClassifier(**bad)
    with pytest.raises(TypeError):
        estimators.TreeClassifier(nothing=1)
    with pytest.raises(RuntimeError):
        estimators.TreeRegressor().predict(df)
    r = estimators.ForestRegressor(trees=3, max_depth=2, min_leaf=3, oob_score=True)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert r.fit(df, "id", ["a", "b"], "t").oob > 0.8
    assert [estimators.jobs(n, 8) for n in (None, 3, 20, -1, -2, -20)] == [1, 3, 8, 8, 7, 1]
    with pytest.warns(UserWarning, match="honesty_fraction"):
        trees.TreeParams(honesty_fraction=0.3)


def test_capped_samples(spark):
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(20)], "id long, y int")
    size = lambda kind, most: [r["count"] for r in sampling.bootstrap(df, "id", 1, 0, "y", kind, most).groupBy("stratum").count().orderBy("stratum").collect()]
    assert size("classic", 7) == [7] and size("stratified", 8) == [6, 2] and size("undersample", 7) == [4, 3] and size("undersample", 50) == [5, 5] and size("oversample", 7) == [4, 3]


def test_models_on_rankings(spark):
    df = toy(spark, 150, 0.3)
    v = evaluation.folds(df, "id", 5, 0, "y")
    rows = downstream.evaluate_fold(v.where("fold > 0"), v.where("fold = 0"), "id", ["a", "b", "c"], "y", ks=[1, 3])
    assert [(r["k"], r["downstream_model"]) for r in rows] == [(k, m) for k in (1, 3) for m in ("lr", "svm", "knn")]
    assert all(r["accuracy"] > 0.85 and r["auc"] > 0.9 for r in rows)
    rows = downstream.evaluate_fold(v.where("fold > 0"), v.where("fold = 0"), "id", ["a", "b"], "t", "regression", ks=[2])
    assert all(r["r2"] > 0.6 for r in rows) and {r["downstream_model"] for r in rows} == {"ridge", "svr", "knn"}
    ridge = downstream.predict("ridge", v.withColumn("_y", F.col("t")), v.withColumn("_y", F.col("t")), "id", ["a", "b"], "regression").collect()
    data = [(r["a"], r["b"], r["t"]) for r in v.collect()]
    x, y = np.array([d[:2] for d in data]), np.array([d[2] for d in data])
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    want = {r["id"]: float((np.array([r["a"], r["b"]]) - x.mean(0)) @ w + y.mean()) for r in v.collect()}
    assert all(r["prediction"] == pytest.approx(want[r["id"]], abs=1e-6) for r in ridge)


def test_one_against_rest_auc(spark):
    rows = [("a", [0.8, 0.1, 0.1]), ("b", [0.2, 0.7, 0.1]), ("c", [0.1, 0.2, 0.7]), ("a", [0.4, 0.5, 0.1])]
    df = spark.createDataFrame(rows, "y string, p array<double>")
    assert evaluation.roc_auc_ovr(df, "y", "p", ["a", "b", "c"]).first()["auc"] == pytest.approx(1.0)
    assert evaluation.roc_auc_ovr(df.where("y <> 'c'"), "y", "p", ["a", "b", "c"]).first()["auc"] is None


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *(float(v) for v in np.round(rng.normal(size=2), 1)), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, u double, v double, y int")
    train, test = df.where("id >= 20"), df.where("id < 20")
    got = {}
    for r in evaluation.nearest(train, test, "id", ["u", "v"], "y", 4, rows=11).collect():
        got.setdefault(r["row_id"], []).append((round(r["d"], 9), r["y"]))
    for i, u, v, _ in rows[:20]:
        near = sorted((math.hypot(u - p, v - q), j, y) for j, p, q, y in rows[20:])[:4]
        assert sorted(got[i]) == sorted((round(d, 9), y) for d, _, y in near)


def test_running_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ROWS", 5)
    rng = random.Random(10)
    rows = [(rng.randint(0, 2), rng.randint(0, 9), rng.randint(0, 5)) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    blocks = numbering.blocks_for(df)
    assert blocks > 5
    at = numbering.value_block(df, "k", blocks)
    got = numbering.running(df, ["g"], ["k"], {"s": F.col("v")}, at, blocks).collect()
    assert all(r["s"] == sum(v for g, k, v in rows if g == r["g"] and k <= r["k"]) for r in got) and len(got) == 60
    once = df.select("g", "k").distinct()
    for r in numbering.following(once, ["g"], "k", at, blocks, "n").collect():
        assert r["n"] == min((k for g, k, _ in rows if g == r["g"] and k > r["k"]), default=None)


def test_sweeps_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    df = long(spark, [rng.randint(0, 20) for _ in range(80)], [rng.randint(0, 2) for _ in range(80)])
    for sweep in (splits.gini_sweep, splits.entropy_sweep, splits.mse_sweep, splits.midpoints):
        rows = []
        for size in (1 << 20, 7):
            monkeypatch.setattr(numbering, "ROWS", size)
            rows.append(sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sweep(df).collect()))
        assert rows[0] == rows[1] and rows[0]


def test_selection_by_name(spark):
    df = toy(spark, 100, 0.3)
    for method in ("mc", "rdc", "ptest_mc", "mrmr", "rf", "tree"):
        assert wrappers.select(method, df, "id", ["b", "a", "c"], "y")[0] == "a", method
    assert ranking.correlations(df, ["a", "b"])[0, 1] == pytest.approx(np.corrcoef([[r["a"], r["b"]] for r in df.collect()], rowvar=False)[0, 1])


def test_generated_data(spark, tmp_path):
    for s in (*generators.CLASSIFICATION, *generators.REGRESSION):
        if s.n_features > 50:
            continue
        df, truth = generators.make(spark, s)
        assert df.count() == s.n_samples and len(truth.informative) == s.n_informative and len(df.columns) == 2 + s.n_features + s.n_high_cardinality_noise + s.n_correlated_noise
        assert sorted(map(str, df.where("row_id < 5").collect())) == sorted(map(str, generators.make(spark, s)[0].repartition(3).where("row_id < 5").collect()))
    easy = generators.Settings("t", n_samples=400, n_features=6, n_informative=2, class_sep=2.0)
    df, truth = generators.make(spark, easy)
    assert set(wrappers.select("mc", df, "row_id", generators.order_of(df.columns), "y")[:2]) == set(truth.informative)
    generators.write(spark, easy, str(tmp_path))
    assert files.datasets(spark, f"{tmp_path}/classification/synthetic", "clf_") == ["t"]
    assert files.dataset_shape(spark, f"{tmp_path}/classification/synthetic/clf_t.parquet") == (400, 7)
    plan = files.footers(spark, f"{tmp_path}/classification/synthetic/clf_t.parquet")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in plan
    assert files.footer_metadata(spark, f"{tmp_path}/classification/synthetic").count() > 0
    assert board.family_of_name(F.lit("synthetic_corr_noise_p100")) is not None
    names = spark.createDataFrame([("x_corr_noise",), ("x_friedman1",), ("x_plain",)], "n string")
    assert [r[0] for r in names.select(board.family_of_name(F.col("n"))).collect()] == ["confounder", "friedman", "standard"]
    facts = spark.createDataFrame([(0.9, False, None, False, False, 0, 0, 0), (0.0, False, 1, False, False, 0, 0, 0), (0.0, False, None, False, False, 0, 0, 5)], "toeplitz_rho double, weak_signal boolean, friedman_variant int, nonlinear boolean, heteroscedastic boolean, n_high_cardinality_noise int, n_correlated_noise int, n_redundant int")
    assert [r[0] for r in facts.select(board.family_of_settings()).collect()] == ["toeplitz", "friedman", "redundant"]


def test_experiments(spark, tmp_path):
    grid = experiments.Grid("classification", [("mc", {}), ("tree", {"a": 1})], ["d1", "d2"], [0, 1], frozenset({("mc", "d2")}))
    assert len(grid) == 6 and grid.table(spark).count() == 6 and grid.summary()["total"] == 6
    store, queue = experiments.Store(spark, str(tmp_path)), None

    def run(e, store):
        if e.dataset == "d2":
            raise ValueError("no such data")
        return spark.createDataFrame([(0, [1, 2])], "fold int, ranking array<int>")

    queue = experiments.Queue([grid], store)
    found = experiments.work(queue, {"rankings": run, "metrics": run})
    done = [r for r in found if r.status == "done"]
    assert len([r for r in done if r.stage == "rankings"]) == 4 and {r.error for r in found if r.status == "failed"} == {"no such data"}
    assert len(store.completed("rankings", "classification")) == 4 and len(grid.pending(store.completed("rankings", "classification"))) == 2
    assert experiments.run_one("rankings", next(iter(grid)), store, run).status == "skipped"
    lost = experiments.Experiment("mc", "d9", 0, "classification")
    assert experiments.run_one("metrics", lost, store, run).status == "no_rankings"
    assert len(experiments.configurations("tree")) == 2 * (1 + 2) and experiments.configurations("unheard") == [{}]
    with pytest.raises(ValueError):
        experiments.Grid.of("classification", "nothing", ["d1"])
    with pytest.raises(ValueError):
        experiments.Grid.of("classification", "mc" if "mc" in experiments.GRIDS else "pi", ["d1"], seeds="9")
    assert len(experiments.Grid.of("classification", "pi,rfe", ["d1", "d2"], "d1", "0,1")) == 4


def test_calibration_and_ablation(spark):
    p = experiments.null_p_values(spark, 120, 30, "mc", 39)
    share = {r["level"]: r["rejected"] for r in experiments.calibration(p).collect()}
    assert share[0.05] < 0.15 and abs(share[0.5] - 0.5) < 0.2
    assert experiments.root_split_rate(spark, 25, 40, 2, resamples=40) < 0.25
    study = {r["every"]: r for r in experiments.stopping_study(spark, 100, 120).collect()}
    assert study[1]["mean_stop"] <= study[32]["mean_stop"]
    df = toy(spark, 80, 0.3)
    rows = experiments.ablate({"toy": (df, "id", ["b", "a"], "y", ["a"])}, {"default": {}, "histogram": experiments.KNOBS["histogram"]}, {"max_depth": 1})
    assert len(rows) == 2 and all(r["precision"] == 1.0 for r in rows)


def test_command_line(spark, tmp_path, capsys):
    from sylvaspark.__main__ import main

    data = str(tmp_path / "data")
    generators.write(spark, generators.Settings("small", n_samples=60, n_features=4, n_informative=2, class_sep=2.0), data)
    assert main(["list", "--data", data]) == 0 and "dataset small" in capsys.readouterr().out
    assert main(["run", "--data", data, "--methods", "rf", "--seeds", "0", "--most", "1"]) == 0 and "done" in capsys.readouterr().out
    assert main(["check", "--data", data, "--methods", "rf", "--seeds", "0"]) == 0 and '"pending": 0' in capsys.readouterr().out


def test_sensitivity_tables_hand_values(spark):
    rows = [("d1", "m1", "l", 0, 0.9), ("d1", "m2", "l", 0, 0.5), ("d1", "m1", "l", 1, 0.4), ("d1", "m2", "l", 1, 0.6), ("d2", "m1", "l", 0, 0.3)]
    df = spark.createDataFrame(rows, "dataset string, method string, learner string, seed int, score double")
    member = {r["dataset"]: r for r in board.seed_membership(df, ["learner"], "dataset", "method", "seed").collect()}
    assert member["d1"]["seed_complete"] and not member["d2"]["seed_complete"] and member["d2"]["n_observed_cells"] == 1
    places = {r["method"]: r["mean_position"] for r in board.seed_sensitivity(df, ["learner"], "dataset", "method", "seed", "score").collect()}
    assert places == {"m1": 1.5, "m2": 1.5}
    with pytest.raises(KeyError):
        board.with_config(df.withColumnRenamed("method", "config_id"), spark.createDataFrame([("m1", 1)], "config_id string, p int"))
    nan = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, 4.0)], "g int, v double")
    assert board.aggregate_seeds(nan, ["g"], ["v"]).first()["v_mean"] == 3.0


def test_registries(spark):
    from sylvaspark import registry

    assert registry.CLASSIFIER_TESTS.names() == ["mc", "mi", "rdc"] and registry.REGRESSOR_TESTS.names() == ["dc", "pc", "rdc"] and registry.THRESHOLD_TESTS.names() == ["entropy", "gini", "mae", "mse"]
    df = long(spark, [0.0] * 15 + [1.0] * 15, [0] * 15 + [1] * 15)
    assert registry.CLASSIFIER_TESTS["mc"](df, 39).first()["p_value"] == pytest.approx(1 / 40)
    assert registry.THRESHOLD_TESTS["gini"](df, splits.midpoints(df), 39).first()["p_value"] == pytest.approx(1 / 40)
    with pytest.raises(KeyError):
        registry.CLASSIFIER_STATISTICS["pc"]
    with pytest.raises(ValueError):
        registry.SPLIT_CRITERIA.register("gini")(None)


@pytest.mark.parametrize("n", [1, 2, 65, 700])
def test_pairs_in_one_task(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 1)
    y = np.round(x + rng.normal(size=n), 1)
    assert association._pairs(x, y) == pytest.approx(association._products(x, y))
    assert association._distance_value(x, y, True) == pytest.approx(brute_dcor(x, y))
