"""Permutation tests with hash-ordered permutations.

Permutation b of a group orders its rows by md5(seed|b|row_id), so it does not depend
on partitions and any engine that has MD5 can replay it.  p-values are (b + 1) / (m + 1).
Only the target is permuted: all features of a row share one permuted target, and only
sums per (feature, permutation, class) leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import association
from ..functions.distributions import stop_bounds
from ..functions.impurity import value_impurity
from . import resampling
from .numbering import blocks_for, digest_block, number, running, value_block
from .splits import bits

SLACK = 1e-9


def key(seed: int, b: Column, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), b.cast("string"), F.lit("|"), row_id.cast("string")))


def permuted(rows: DataFrame, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(*by, b, row_id, y): the target under each permutation 0..n, where 0 is the observed order."""
    by = by or []
    rows = rows.select(*by, "row_id", "y")
    blocks = blocks_for(rows)
    numbered = number(rows, by, ["row_id"], value_block(rows, "row_id", blocks), blocks, "i")
    spread = rows.select(*by, "row_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("b"))
    spread = spread.withColumn("_key", key(seed, F.col("b"), F.col("row_id")))
    placed = number(spread, [*by, "b"], ["_key", "row_id"], digest_block(F.col("_key"), blocks), blocks, "i")
    shuffled = placed.join(numbered.select(*by, "i", "y"), [*by, "i"]).select(*by, "b", "row_id", "y")
    return shuffled.unionByName(rows.select(*by, F.lit(0).alias("b"), "row_id", "y"))


def _pvalue(stats: DataFrame, by: list[str], n: int) -> DataFrame:
    observed = stats.where("b = 0").select(*by, "feature", F.col("t").alias("observed"))
    tail = stats.where("b > 0").join(observed, [*by, "feature"])
    t = tail.groupBy(*by, "feature").agg(F.first("observed").alias("statistic"), F.count_if(F.col("t") >= F.col("observed") - SLACK).alias("hits"))
    return t.withColumn("p_value", (F.col("hits") + 1) / F.lit(float(n + 1)))


def _association(kind: str):
    """A statistic (long, by) -> (*by, feature, t) that has no shortcut under permutation."""

    def of(long: DataFrame, by: list[str]) -> DataFrame:
        if kind == "mi":
            return association.mutual_information(long, by=by).withColumnRenamed("mi", "t")
        if kind == "dc":
            return association.distance_correlation(long, by).withColumnRenamed("dcor", "t")
        task = {"rdc": "regression", "rdc_class": "classification"}[kind]
        return association.rdc(long, by=by, task=task).withColumnRenamed("rdc", "t")

    return of


KINDS = ("mc", "pc", "mi", "dc", "rdc", "rdc_class")


def statistics(long: DataFrame, n: int, seed: int, kind: str | Callable = "mc", by: list[str] | None = None) -> DataFrame:
    """(*by, feature, b, t): the statistic under each permutation.

    ``kind``: ``mc`` correlation ratio, ``pc`` absolute correlation, ``mi`` mutual information with a class, ``dc`` distance
    correlation, ``rdc`` and ``rdc_class`` randomised dependence on a number or a class, or a function
    (long, by) -> (*by, feature, t).
    """
    by = by or []
    if kind in ("mc", "rdc_class"):
        found = resampling.statistics(long, n, seed, kind, by, weights=association.weights_from(42))
        if found is not None:
            return found
    one = long.select(*by, "row_id", "y").distinct()
    x = long.select(*by, "row_id", "feature", "x")
    every = permuted(one, n, seed, by).join(x, [*by, "row_id"])
    if kind == "mc":
        cells = every.groupBy(*by, "feature", "b", "y").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        t = cells.groupBy(*by, "feature", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"))
        centre = F.col("s") * F.col("s") / F.col("n")
        sst = F.col("q") - centre
        return t.select(*by, "feature", "b", F.when(sst > F.col("q") * 1e-12, F.sqrt(F.greatest(F.lit(0.0), (F.col("g") - centre) / sst))).otherwise(0.0).alias("t"))
    if kind == "pc":
        y = F.col("y").cast("double")
        t = every.groupBy(*by, "feature", "b").agg(F.covar_pop("x", y).alias("c"), F.var_pop("x").alias("vx"), F.var_pop(y).alias("vy"))
        return t.select(*by, "feature", "b", F.when(F.col("vx") * F.col("vy") > 0, F.abs(F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))))).otherwise(0.0).alias("t"))
    if kind == "dc":
        most = one.groupBy(*by).count().agg(F.max("count").alias("m")).first()["m"] or 0
        return association.distance_correlation(every, [*by, "b"], most=most).select(*by, "feature", "b", F.col("dcor").alias("t"))
    of = _association(kind) if isinstance(kind, str) else kind
    return of(every, [*by, "b"]).select(*by, "feature", "b", F.abs("t").alias("t"))


def permutation_test(long: DataFrame, n: int = 100, seed: int = 0, kind: str | Callable = "mc", by: list[str] | None = None) -> DataFrame:
    """(*by, feature, statistic, hits, p_value) with a fixed number of permutations."""
    return _pvalue(statistics(long, n, seed, kind, by), by or [], n)


def _largest(long: DataFrame, n: int, seed: int, kinds, by: list[str]) -> DataFrame:
    every = None
    for kind in kinds:
        s = statistics(long, n, seed, kind, by)
        every = s if every is None else every.unionByName(s)
    return every.groupBy(*by, "feature", "b").agg(F.max("t").alias("t"))


def max_t_test(long: DataFrame, n: int = 100, seed: int = 0, kinds: tuple[str, ...] = ("mc", "pc"), by: list[str] | None = None) -> DataFrame:
    """The largest statistic of several kinds inside each permutation, tested as one."""
    return _pvalue(_largest(long, n, seed, kinds, by or []), by or [], n)


def stopped(s: DataFrame, n: int, keys: list[str], rule: str = "adaptive", alpha: float = 0.05, gamma: float = 0.95, every: int = 1, tail: str = "high") -> DataFrame:
    """(*keys, statistic, m, hits, p_value) of statistics (*keys, b, t), 0 the observed one: stopping as a running sum over permutations.

    ``adaptive`` stops once the posterior of p < alpha is ``gamma`` or 1 - ``gamma``, looked at after every ``every`` permutations;
    ``simple`` stops at a p-value below alpha, or when three exceedances rule one out.  Both begin after ceil(1 / alpha) of them.
    ``tail`` ``low`` counts statistics that are not larger.
    """
    observed = s.where("b = 0").select(*keys, F.col("t").alias("statistic"))
    beyond = F.col("t") >= F.col("statistic") - SLACK if tail == "high" else F.col("t") <= F.col("statistic") + SLACK
    running = s.where("b > 0").join(observed, keys).withColumn("hits", F.sum(beyond.cast("int")).over(Window.partitionBy(*keys).orderBy("b")))
    if rule == "adaptive":
        bounds = s.sparkSession.createDataFrame(stop_bounds(alpha, gamma, n, every) or [(-1, -1, 1)], "b int, low long, high long")  # a row per permutation
        ends = running.join(bounds, "b", "left").where((F.col("hits") <= F.col("low")) | (F.col("hits") >= F.col("high")) | (F.col("b") == n))
    elif rule == "simple":
        now, best = (F.col("hits") + 1) / (F.col("b") + 1), (F.col("hits") + 1) / F.lit(n + 1.0)
        late = F.col("b") >= math.ceil(1 / alpha)
        ends = running.where((late & ((now < alpha) | ((best >= alpha) & (F.col("hits") >= 3)))) | (F.col("b") == n))
    else:
        raise ValueError(f"unknown stopping rule {rule!r}")
    first = ends.groupBy(*keys).agg(F.first("statistic").alias("statistic"), F.min(F.struct("b", "hits")).alias("e"))
    return first.select(*keys, "statistic", F.col("e.b").alias("m"), F.col("e.hits").alias("hits"), ((F.col("e.hits") + 1) / (F.col("e.b") + 1)).alias("p_value"))


def sequential_test(long: DataFrame, n: int = 100, seed: int = 0, kind: str | Callable | tuple = "mc", alpha: float = 0.05, gamma: float = 0.95, every: int = 1, rule: str = "adaptive", by: list[str] | None = None) -> DataFrame:
    """(*by, feature, m, hits, p_value) with early stopping (see :func:`stopped`); at least ceil(1 / alpha) permutations; several kinds are tested as one."""
    n = max(n, math.ceil(1 / alpha))
    s = _largest(long, n, seed, kind, by or []) if isinstance(kind, tuple) else statistics(long, n, seed, kind, by)
    return stopped(s, n, [*(by or []), "feature"], rule, alpha, gamma, every).drop("statistic")


def bonferroni(tests: DataFrame, alpha: float, by: list[str] | None = None) -> DataFrame:
    """Each test with its group's corrected level and whether it is rejected."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    return tests.withColumn("level", F.lit(alpha) / F.count("*").over(w)).withColumn("reject", F.col("p_value") < F.col("level"))


def _binned(one: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """``one`` with ``bin``, the number of its feature's thresholds below x: x is right of those and left of the others."""
    marks = at.select(*keys, F.col("threshold").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(1).alias("mark"))
    points = one.select(*keys, F.col("x").cast("double").alias("v"), F.lit(0).alias("kind"), F.col("row_id").cast("string").alias("id"), F.lit(0).alias("mark"))
    line = marks.unionByName(points)
    blocks = blocks_for(line)
    counted = running(line, keys, ["v", "kind"], {"bin": F.col("mark")}, value_block(line, "v", blocks), blocks)
    return counted.where("kind = 0").select(*keys, F.col("id").alias("row_id"), "bin")


def threshold_statistics(one: DataFrame, at: DataFrame, n: int, seed: int, criterion: str = "gini", by: list[str] | None = None) -> DataFrame:
    """(*by, feature, threshold, b, t): weighted child impurity of each threshold of ``at`` (*by, feature, threshold) under each permutation.

    All thresholds of a group share its permutations.  Rows meet a permutation once: they are counted per stretch between thresholds,
    and the stretches are summed along the thresholds.  ``mae`` has no such sums and reads the rows of each threshold.
    """
    by = by or []
    keys = [*by, "feature"]
    if criterion in ("gini", "entropy"):
        found = resampling.statistics(one, n, seed, criterion, by, at)
        if found is not None:
            return found
    every = permuted(one.select(*by, "row_id", "y").distinct(), n, seed, by).withColumn("row_id", F.col("row_id").cast("string"))
    one = one.withColumn("row_id", F.col("row_id").cast("string"))
    if criterion == "mae":
        sided = one.select(*keys, "row_id", "x").join(at, keys).withColumn("side", (F.col("x") > F.col("threshold")).cast("int")).drop("x")
        moved = every.join(sided, [*by, "row_id"])
        cells = value_impurity(moved, [*keys, "threshold", "b", "side"], "y")
        t = cells.groupBy(*keys, "threshold", "b").agg((F.sum(F.col("n") * F.col("mae")) / F.sum("n")).alias("t"), F.count("*").alias("sides"))
        return t.select(*keys, "threshold", "b", F.when(F.col("sides") == 2, F.col("t")).otherwise(F.lit(float("inf"))).alias("t"))
    nth = Window.partitionBy(*keys).orderBy("threshold")
    numbered = at.select(*keys, "threshold").distinct().withColumn("nth", F.row_number().over(nth))
    moved = every.join(_binned(one, at, keys), [*by, "row_id"])
    if criterion in ("gini", "entropy"):
        cells = moved.groupBy(*keys, "b", "y", (F.col("bin") + 1).alias("nth")).agg(F.count("*").alias("c"))
        total = cells.groupBy(*keys, "b", "y").agg(F.sum("c").alias("ct"))
        along = Window.partitionBy(*keys, "b", "y").orderBy("nth")
        grid = numbered.join(total, keys).join(cells, [*keys, "b", "y", "nth"], "left")
        c = grid.withColumn("l", F.sum(F.coalesce("c", F.lit(0))).over(along))
        part = (lambda v: v * v) if criterion == "gini" else bits
        t = c.groupBy(*keys, "threshold", "b").agg(F.sum("l").alias("nl"), F.sum("ct").alias("n"), F.sum(part(F.col("l"))).alias("ql"), F.sum(part(F.col("ct") - F.col("l"))).alias("qr"))
        nr = F.col("n") - F.col("nl")
        cost = (lambda m, q: m - F.try_divide(q, m)) if criterion == "gini" else (lambda m, q: bits(m) - q)
        value = (cost(F.col("nl"), F.col("ql")) + cost(nr, F.col("qr"))) / F.col("n")
    elif criterion == "mse":
        y = F.col("y").cast("double")
        cells = moved.groupBy(*keys, "b", (F.col("bin") + 1).alias("nth")).agg(F.count("*").alias("c"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
        total = cells.groupBy(*keys, "b").agg(*(F.sum(v).alias(f"{v}t") for v in "csq"))
        along = Window.partitionBy(*keys, "b").orderBy("nth")
        t = numbered.join(total, keys).join(cells, [*keys, "b", "nth"], "left")
        t = t.select(*keys, "threshold", "b", "ct", "st", "qt", F.sum(F.coalesce("c", F.lit(0))).over(along).alias("nl"), F.sum(F.coalesce("s", F.lit(0.0))).over(along).alias("sl"))
        nr, sr = F.col("ct") - F.col("nl"), F.col("st") - F.col("sl")
        value = (F.col("qt") - F.try_divide(F.col("sl") * F.col("sl"), F.col("nl")) - F.try_divide(sr * sr, nr)) / F.col("ct")
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    return t.select(*keys, "threshold", "b", F.when((F.col("nl") > 0) & (nr > 0), value).otherwise(F.lit(float("inf"))).alias("t"))


def threshold_test(one: DataFrame, at: DataFrame, n: int = 100, seed: int = 0, criterion: str = "gini", by: list[str] | None = None, rule: str | None = None, alpha: float = 0.05, gamma: float = 0.95) -> DataFrame:
    """(*by, feature, threshold, statistic, m, hits, p_value): left-tailed tests of weighted child impurity; an empty side gives 1.

    ``rule`` stops early as :func:`stopped` does.
    """
    keys = [*(by or []), "feature", "threshold"]
    if rule:
        n = max(n, math.ceil(1 / alpha))
        return stopped(threshold_statistics(one, at, n, seed, criterion, by), n, keys, rule, alpha, gamma, tail="low")
    s = threshold_statistics(one, at, n, seed, criterion, by)
    observed = s.where("b = 0").select(*keys, F.col("t").alias("statistic"))
    t = s.where("b > 0").join(observed, keys).groupBy(*keys).agg(F.first("statistic").alias("statistic"), F.count_if(F.col("t") <= F.col("statistic") + SLACK).alias("hits"))
    return t.select(*keys, "statistic", F.lit(n).alias("m"), "hits", ((F.col("hits") + 1) / F.lit(n + 1.0)).alias("p_value"))


def first_accepted(tests: DataFrame, by: list[str], order: list, level: Column, stop: bool) -> DataFrame:
    """(*, tested, chosen): tests taken in ``order``; with ``stop`` none after the first p-value below ``level`` is taken.

    The chosen test is that first one, or else the one of least p-value, the first of equals.
    """
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    t = tests.withColumn("_i", F.row_number().over(w)).withColumn("_ok", F.col("p_value") < level)
    every = Window.partitionBy(*(by or [F.lit(1)]))
    t = t.withColumn("_first", F.min(F.when(F.col("_ok"), F.col("_i"))).over(every))
    tested = (F.col("_i") <= F.coalesce("_first", F.col("_i"))) if stop else F.lit(True)
    t = t.withColumn("tested", tested)
    best = F.min(F.when(F.col("tested"), F.struct("p_value", "_i"))).over(every)["_i"]
    chosen = F.col("_i") == (F.coalesce("_first", best) if stop else best)
    return t.withColumn("chosen", chosen).withColumn("reject", F.col("chosen") & F.col("_ok")).drop("_i", "_ok", "_first")
