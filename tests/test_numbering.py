"""Numbers given block by block equal those of one window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sylvaspark.operators import evaluation, inference, numbering, permutation, sampling, trees


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(numbering, "ROWS", 16)


def data(spark, n=300):
    """A hot group with two thirds of the rows, a null group and string identifiers."""
    rows = [(i, f"r{i * 7919 % n:04d}", None if i % 50 == 0 else int(i % 3 == 0), float(i % 11)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, g int, v double")


@pytest.mark.parametrize("column", ["id", "name", "v"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbers_equal_one_window(spark, small_blocks, column, by):
    df = data(spark)
    blocks = numbering.blocks_for(df)
    assert blocks > 10
    got = numbering.number(df, by, [column, "id"], numbering.value_block(df, column, blocks), blocks, "i")
    want = df.withColumn("w", F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(column, "id")))
    assert got.count() == 300
    assert got.join(want, "id").where("i <> w").count() == 0


def test_blocks_are_even(spark, small_blocks):
    df = data(spark)
    block = numbering.value_block(df, "name", 8)
    sizes = [r["count"] for r in df.groupBy(block.alias("b")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100


def test_no_rows_and_only_nulls(spark, small_blocks):
    df = data(spark)
    assert numbering.blocks_for(df.limit(0)) == 1
    nulls = df.withColumn("id", F.lit(None).cast("long"))
    got = numbering.number(nulls, [], ["id"], numbering.value_block(nulls, "id", 4), 4, "i")
    assert sorted(r["i"] for r in got.collect()) == list(range(1, 301))


def test_operators_do_not_depend_on_blocks(spark, monkeypatch):
    df = data(spark).cache()

    def results():
        long = df.where("g IS NOT NULL").select(F.col("id").alias("row_id"), F.lit("v").alias("feature"), F.col("v").alias("x"), F.col("g").alias("y"))
        return [
            sorted(map(tuple, permutation.permuted(long.select("row_id", "y"), 5, 0).collect())),
            permutation.permutation_test(long, 20).first()["p_value"],
            sorted(map(tuple, evaluation.folds(df, "id", 5, 1).select("id", "fold").collect())),
            sorted(map(tuple, evaluation.folds(df, "id", 5, 1, "g").select("id", "fold").collect())),
            sorted(map(tuple, sampling.bootstrap(df, "id", 2, 1).collect())),
            sorted(map(tuple, sampling.bootstrap(df, "name", 2, 1, "g", "stratified").fillna(-1).collect())),
            tuple(inference.bootstrap_mean(df, "id", "v", 20).first()),
        ]

    whole = results()
    monkeypatch.setattr(numbering, "ROWS", 16)
    assert results() == whole


def test_draws_are_dealt_to_tasks_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(inference, "DRAWS", 1000, raising=False)
    df = data(spark)
    drawn = inference.draws(20, df, 3)
    assert sorted((r["b"], r["count"]) for r in drawn.groupBy("b").count().collect()) == [(b, 300) for b in range(1, 21)]
    assert drawn.rdd.getNumPartitions() == 6
    size = lambda t: int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(drawn) >= 20 * 300 * 8


@pytest.mark.parametrize("task, criterion, method", [("classification", "entropy", "exact"), ("classification", "entropy", "histogram"), ("regression", "mae", "percentile"), ("regression", "mae", "exact")])
def test_criteria_of_trees(spark, task, criterion, method):
    rows = [(i, float(i % 10), float(i * 7 % 13), int(i % 10 > 4), 5.0 * (i % 10 > 4) + i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, t double")
    target = "y" if task == "classification" else "t"
    m = trees.grow(df, "id", ["a", "b"], target, trees.TreeParams(task=task, criterion=criterion, threshold_method=method, max_depth=1, n_resamples=60))
    root = m.nodes[0, 1]
    assert root.feature == "a" and 4 <= root.threshold < 5
    assert root.impurity == pytest.approx(1.0 if criterion == "entropy" else 312 / 120)


def test_criterion_must_fit_the_task():
    with pytest.raises(ValueError):
        trees.TreeParams(task="regression", criterion="gini")
