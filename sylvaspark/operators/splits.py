"""Threshold generators and split search, as windows over the distinct values of each feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import blocks_for, following, running, value_block


def midpoints(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, feature, threshold): midpoints of neighbouring distinct values."""
    by = by or []
    v = long.select(*by, "feature", "x").distinct()
    blocks = blocks_for(long)
    v = following(v, [*by, "feature"], "x", value_block(long, "x", blocks), blocks, "next")
    return v.where("next IS NOT NULL").select(*by, "feature", ((F.col("x") + F.col("next")) / 2).alias("threshold"))


def thresholds(long: DataFrame, method: str = "exact", most: int = 256, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Candidate thresholds: exact, random, percentile or histogram; features of up to four values keep all midpoints."""
    by = by or []
    mid = midpoints(long, by)
    if method == "exact":
        return mid
    w = Window.partitionBy(*by, "feature")
    few = mid.withColumn("n", F.count("*").over(w))
    keep = few.where("n <= 3").drop("n")
    rest = few.where("n > 3").drop("n")
    if method == "random":
        order = w.orderBy(F.md5(F.concat(F.lit(f"{seed}|t|"), "feature", F.lit("|"), F.col("threshold").cast("string"))), "threshold")
        out = rest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    elif method == "percentile":
        at = [i / (most - 1) for i in range(most)] if most > 1 else [0.0]
        out = rest.groupBy(*by, "feature").agg(F.percentile("threshold", F.array(*map(F.lit, at))).alias("t")).select(*by, "feature", F.explode("t").alias("threshold")).distinct()
    elif method == "histogram":
        ends = rest.groupBy(*by, "feature").agg(F.min("threshold").alias("a"), F.max("threshold").alias("z"))
        i = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i")
        out = ends.select(*by, "feature", "a", "z", i).select(*by, "feature", (F.col("a") + F.col("i") * (F.col("z") - F.col("a")) / most).alias("threshold")).distinct()
    else:
        raise ValueError(f"unknown threshold method {method!r}")
    return keep.unionByName(out)


def _class_sweep(long: DataFrame, by: list[str] | None, part, merge) -> DataFrame:
    """Weighted child impurity from a sum of ``part(c)`` over a child's class counts and ``merge(n_left, sum_left, n_right, sum_right)``.

    Counts per feature and value, a column for each class, are summed along the values in blocks; rows are never copied.
    """
    by = by or []
    keys = [*by, "feature"]
    classes = sorted(r[0] for r in long.select("y").distinct().collect())  # a column for each
    counted = [F.count_if(F.col("y") == F.lit(c)).alias(f"_c{i}") for i, c in enumerate(classes)]
    cells = long.groupBy(*keys, "x").agg(*counted)
    blocks = blocks_for(long)
    at = value_block(long, "x", blocks)
    cum = running(cells, keys, ["x"], {f"_l{i}": F.col(f"_c{i}") for i in range(len(classes))}, at, blocks)
    cum = following(cum, keys, "x", at, blocks, "next").where("next IS NOT NULL")
    total = cells.groupBy(*keys).agg(*(F.sum(f"_c{i}").alias(f"_t{i}") for i in range(len(classes))))
    t = cum.join(total, keys)
    over = lambda f: sum((f(i) for i in range(len(classes))), F.lit(0))
    t = t.withColumns({
        "n_left": over(lambda i: F.col(f"_l{i}")).cast("long"), "n": over(lambda i: F.col(f"_t{i}")).cast("long"),
        "ql": over(lambda i: part(F.col(f"_l{i}"))), "qr": over(lambda i: part(F.col(f"_t{i}") - F.col(f"_l{i}"))),
    })
    n_right = F.col("n") - F.col("n_left")
    impurity = merge(F.col("n_left"), F.col("ql"), n_right, F.col("qr")) / F.col("n")
    return t.select(*by, "feature", ((F.col("x") + F.col("next")) / 2).alias("threshold"), "n_left", n_right.alias("n_right"), impurity.alias("impurity"))


def gini_sweep(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, feature, threshold, n_left, n_right, impurity): weighted child gini of every midpoint.

    The terms are added from left to right, as in the SQL twins: another order differs in the last digit, which orders near ties.
    """
    return _class_sweep(long, by, lambda c: c * c, lambda n, q, m, r: n - q / n + (n + m) - n - r / m)


def bits(c: Column) -> Column:
    """c log2 c of a count, 0 at 0."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)


def entropy_sweep(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As :func:`gini_sweep`, for entropy in bits."""
    return _class_sweep(long, by, bits, lambda n, q, m, r: bits(n) - q + (bits(m) - r))


def mae_sweep(long: DataFrame, by: list[str] | None = None, at: DataFrame | None = None) -> DataFrame:
    """As :func:`gini_sweep`, for numeric y and the mean distance from a child's median, at thresholds ``at`` or every midpoint.

    Medians have no prefix sums: each threshold reads the counts per (feature, x, y) once,
    so a feature of many values needs few thresholds.
    """
    by = by or []
    cells = long.groupBy(*by, "feature", "x", F.col("y").cast("double").alias("y")).agg(F.count("*").alias("c"))
    sided = cells.join(at if at is not None else midpoints(long, by), [*by, "feature"]).withColumn("side", (F.col("x") > F.col("threshold")).cast("int"))
    keys = [*by, "feature", "threshold"]
    middle = sided.groupBy(*keys, "side").agg(F.percentile("y", F.lit(0.5), F.col("c")).alias("m"))
    off = sided.join(middle, [*keys, "side"]).withColumn("d", F.col("c") * F.abs(F.col("y") - F.col("m")))
    count = lambda side: F.sum(F.when(F.col("side") == side, F.col("c")).otherwise(0))
    return off.groupBy(*keys).agg(count(0).alias("n_left"), count(1).alias("n_right"), (F.sum("d") / F.sum("c")).alias("impurity")).where("n_left > 0 AND n_right > 0")


def mse_sweep(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As :func:`gini_sweep`, for numeric y and population variance."""
    by = by or []
    y = F.col("y").cast("double")
    v = long.groupBy(*by, "feature", "x").agg(F.count("*").alias("c"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    keys = [*by, "feature"]
    blocks = blocks_for(long)
    at = value_block(long, "x", blocks)
    t = running(v, keys, ["x"], {f"{c}l": F.col(c) for c in "csq"}, at, blocks)
    t = following(t, keys, "x", at, blocks, "next").where("next IS NOT NULL")
    t = t.join(v.groupBy(*keys).agg(*(F.sum(c).alias(f"{c}t") for c in "csq")), keys)
    cr, sr = F.col("ct") - F.col("cl"), F.col("st") - F.col("sl")
    sse = F.col("qt") - F.col("sl") * F.col("sl") / F.col("cl") - sr * sr / cr
    return t.select(*by, "feature", ((F.col("x") + F.col("next")) / 2).alias("threshold"), F.col("cl").alias("n_left"), cr.alias("n_right"), (sse / F.col("ct")).alias("impurity"))


def twelfth(c: Column) -> Column:
    """A value that is not negative to twelve digits, by scaled floats as DuckDB and numpy round: ``F.round`` goes by the decimal digits and differs near halves."""
    scaled = c.cast("double") * 1e12
    low = F.floor(scaled).cast("double")
    return (low + F.when(scaled - low >= 0.5, 1.0).otherwise(0.0)) / 1e12


def best_split(sweep: DataFrame, by: list[str], min_leaf: int = 1) -> DataFrame:
    """The least impure split of each group with ``min_leaf`` rows on both sides; ties by feature and threshold."""
    w = Window.partitionBy(*by).orderBy(twelfth(F.col("impurity")), "feature", "threshold")
    return sweep.where((F.col("n_left") >= min_leaf) & (F.col("n_right") >= min_leaf)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
