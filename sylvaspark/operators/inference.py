"""Statistics of comparisons: bootstrap intervals, rank tests, sign tests, effect sizes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, wilcoxon_p
from .numbering import blocks_for, number, value_block


#: Draws of a task, about.
DRAWS = 1 << 20


def draws(n_draws: int, rows: DataFrame, seed: int) -> DataFrame:
    """(b, i): the row numbers 1..n drawn with replacement for each replicate, by hash.

    They come from a range, whose size the planner knows: it is dealt to tasks and never broadcast.
    """
    n = rows.count()
    every = rows.sparkSession.range(0, n * n_draws, 1, max(1, math.ceil(n * n_draws / DRAWS)))
    b, j = F.expr(f"id div {max(n, 1)}") + 1, F.col("id") % max(n, 1) + 1
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|d|"), F.col("b").cast("string"), F.lit("|"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long")
    return every.select(b.cast("int").alias("b"), j.alias("j")).select("b", (h % max(n, 1) + 1).alias("i"))


def bootstrap_mean(rows: DataFrame, order: str, value: str, n_draws: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean of ``value``."""
    blocks = blocks_for(rows)
    numbered = number(rows, [], [order], value_block(rows, order, blocks), blocks, "i").select("i", F.col(value).alias("v"))
    means = draws(n_draws, rows, seed).join(numbered, "i").groupBy("b").agg(F.avg("v").alias("m"))
    low = (1 - level) / 2
    ci = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(1 - low)).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).join(ci)


def friedman(ranked: DataFrame, block: str, method: str, rank: str) -> DataFrame:
    """(n, k, chi2, w): Friedman's statistic of complete blocks with the correction for ties, and Kendall's W."""
    k = ranked.agg(F.countDistinct(method).alias("k"), F.countDistinct(block).alias("n"))
    sums = ranked.groupBy(method).agg(F.sum(rank).alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
    ties = ranked.groupBy(block, rank).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tt"))
    t = k.join(sums).join(ties)
    n, kk = F.col("n").cast("double"), F.col("k").cast("double")
    raw = F.lit(12.0) / (n * kk * (kk + 1)) * F.col("rr") - 3 * n * (kk + 1)
    chi2 = F.try_divide(raw, 1 - F.col("tt") / (n * kk * (kk * kk - 1)))
    return t.select("n", "k", chi2.alias("chi2"), F.try_divide(chi2, n * (kk - 1)).alias("w"))


def friedman_p(result: DataFrame) -> float:
    row = result.first()
    return chi2_sf(row["chi2"], row["k"] - 1)


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal z, by the continued fraction or series of the error function to about 1e-9."""
    x = F.abs(z)
    # phi(x) * x * (1 + x^2/3 * (1 + x^2/5 * ...)) below 3, a continued fraction from there on
    series, fraction = F.lit(1.0), x
    for k in range(60, 0, -1):
        series = 1.0 + x * x / float(2 * k + 1) * series
        fraction = x + float(k) / fraction
    phi = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return F.when(x < 3, F.greatest(F.lit(0.0), 1 - 2 * phi * x * series)).otherwise(F.least(F.lit(1.0), 2 * phi / fraction))


def wilcoxon(pairs: DataFrame, by: list[str], delta: str) -> DataFrame:
    """Signed-rank test per group, normal approximation with tie correction: (n, w_plus, z, p_value); zero differences are left out."""
    d = pairs.where(F.col(delta) != 0).withColumn("_a", F.abs(delta))
    w = Window.partitionBy(*by)
    tied = F.count("*").over(Window.partitionBy(*by, "_a"))
    d = d.withColumn("_r", F.rank().over(w.orderBy("_a")) + (tied - 1) / 2).withColumn("_t", (tied * tied - 1).cast("double"))
    t = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col(delta) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum("_t").alias("tt"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tt") / 48
    z = F.when(var > 0, F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var))).otherwise(0.0)
    return t.select(*by, "n", "w_plus", z.alias("z")).withColumn("p_value", normal_p(F.col("z")))


def wilcoxon_exact(pairs: DataFrame, by: list[str], delta: str, most: int = 50) -> DataFrame:
    """(*by, n, w_plus, p_value): two-sided exact p-values of groups of at most ``most`` differences, ties included; larger groups have the approximation's."""
    t = wilcoxon(pairs, by, delta)
    tied = F.count("*").over(Window.partitionBy(*by, "_a"))
    d = pairs.where(F.col(delta) != 0).withColumn("_a", F.abs(delta))
    d = d.withColumn("_r", (2 * F.rank().over(Window.partitionBy(*by).orderBy("_a")) + tied - 1).cast("int"))
    small = t.where(F.col("n") <= most).select(*by, "w_plus").join(d.select(*by, "_r"), by)
    ranks = small.groupBy(*by, "w_plus").agg(F.collect_list("_r").alias("_ranks"))

    @F.pandas_udf("double")
    def exact(doubled: pd.Series, w_plus: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p([int(r) for r in rs], w) for rs, w in zip(doubled, w_plus)])

    p = ranks.select(*by, exact("_ranks", "w_plus").alias("_exact"))
    return t.join(p, by, "left").select(*by, "n", "w_plus", F.coalesce("_exact", "p_value").alias("p_value"))


def pairwise_wilcoxon(scores: DataFrame, cell: list[str], method: str, score: str, least: int = 10) -> DataFrame:
    """(method1, method2, n, w_plus, p_value, holm, significant): every pair of methods over the cells that both have, with Holm's correction.

    Pairs of fewer than ``least`` shared cells are left out.
    """
    a = scores.select(*cell, F.col(method).alias("method1"), F.col(score).alias("_x"))
    b = scores.select(*cell, F.col(method).alias("method2"), F.col(score).alias("_y"))
    pairs = a.join(b, cell).where("method1 < method2").withColumn("delta", F.col("_x") - F.col("_y"))
    enough = pairs.groupBy("method1", "method2").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    tests = wilcoxon(pairs.join(enough, ["method1", "method2"]), ["method1", "method2"], "delta")
    return holm(tests, "p_value", ["method1", "method2"]).withColumn("significant", F.col("holm") < 0.05)


def holm(tests: DataFrame, p: str, order: list[str]) -> DataFrame:
    """Holm's correction: the running maximum of p times the number of tests left."""
    w = Window.orderBy(p, *order)
    scaled = tests.withColumn("_i", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(F.lit(1))))
    scaled = scaled.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_i") + 1)))
    return scaled.withColumn("holm", F.max("_s").over(Window.orderBy("_i"))).drop("_i", "_m", "_s")


def cohens_d(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Pooled effect size of group a against b; 0 without variance."""
    s = [df.where(F.col(group) == g).agg(F.avg(value).alias(f"m{i}"), F.var_samp(value).alias(f"v{i}"), F.count("*").alias(f"n{i}")) for i, g in enumerate((a, b))]
    t = s[0].join(s[1])  # one row each
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    return t.select(F.when(pooled > 0, F.try_divide(F.col("m0") - F.col("m1"), pooled)).otherwise(0.0).alias("d"))


def effect_label(d: Column) -> Column:
    """The usual word for an effect size."""
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def sign_test(wins: int, losses: int, two_sided: bool = False) -> float:
    """Exact binomial p-value of at least this many wins."""
    from math import comb

    n = wins + losses
    if not n:
        return 1.0
    tail = lambda k: sum(comb(n, i) for i in range(k, n + 1)) / 2**n
    return min(1.0, 2 * tail(max(wins, losses))) if two_sided else tail(wins)
