"""Impurities as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_impurity(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """(*by, n, gini, entropy) of the labels; entropy in bits."""
    cells = df.groupBy(*by, label).agg(F.count("*").alias("c"))
    t = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("e"))
    n = F.col("n").cast("double")
    return t.select(*by, "n", (1 - F.col("q") / (n * n)).alias("gini"), (F.log2(n) - F.col("e") / n).alias("entropy"))


def value_impurity(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """(*by, n, mse, mae): population variance, and mean distance from the median."""
    middle = df.groupBy(*by).agg(F.median(y).alias("_m"), F.var_pop(y).alias("mse"), F.count("*").alias("n"))
    off = df.join(middle, by).groupBy(*by).agg(F.avg(F.abs(F.col(y) - F.col("_m"))).alias("mae"))
    return middle.drop("_m").join(off, by)
