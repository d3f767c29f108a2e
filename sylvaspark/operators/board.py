"""Leaderboard operators.  Column roles are arguments, so they run on any table of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_of_means(df: DataFrame, levels: list[list[str]], score: str) -> DataFrame:
    """Average over each level in turn, finest first; never a mean of raw rows."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(score).alias(score))
    return df


def average_rank(df: DataFrame, by: list[str], score: str, descending: bool = True, out: str = "rank") -> DataFrame:
    """Ranks with ties averaged."""
    order = F.desc(score) if descending else F.asc(score)
    tied = F.count("*").over(Window.partitionBy(*by, score))
    return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(order)) + (tied - 1) / 2)


def complete_cases(df: DataFrame, cell: list[str], method: str) -> DataFrame:
    """Rows of the cells in which every method is present."""
    wanted = df.select(method).distinct().agg(F.count("*").alias("_all"))
    full = df.groupBy(*cell).agg(F.countDistinct(method).alias("_n")).join(F.broadcast(wanted), F.col("_n") == F.col("_all")).select(*cell)
    return df.join(full, cell, "left_semi")


def fixed_panel(df: DataFrame, cell: list[str], dataset: str, method: str) -> DataFrame:
    """Datasets complete in all cells that the table has."""
    cells = df.select(*cell).distinct().agg(F.count("*").alias("_cells"))
    full = complete_cases(df, [dataset, *cell], method).select(dataset, *cell).distinct().groupBy(dataset).agg(F.count("*").alias("_n"))
    return full.join(F.broadcast(cells), F.col("_n") == F.col("_cells")).select(dataset)


def best_per_group(df: DataFrame, by: list[str], score: str, ties: list[str], descending: bool = True) -> DataFrame:
    """The best row of each group; ties by the given columns."""
    w = Window.partitionBy(*by).orderBy(F.desc(score) if descending else F.asc(score), *ties)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def keep_last(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """One row per key, the last by the ordinal."""
    return best_per_group(df, key, ordinal, [])


def pairwise(df: DataFrame, cell: list[str], method: str, score: str, tolerance: float = 1e-12) -> DataFrame:
    """Directed method pairs over shared cells: n, mean delta, wins, losses, ties."""
    a = df.select(*cell, F.col(method).alias("focus"), F.col(score).alias("_x"))
    b = df.select(*cell, F.col(method).alias("baseline"), F.col(score).alias("_y"))
    d = F.col("_x") - F.col("_y")
    return a.join(b, cell).where("focus <> baseline").groupBy("focus", "baseline").agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties"))


def ratio_to_baseline(df: DataFrame, cell: list[str], method: str, baseline: str, value: str) -> DataFrame:
    base = df.where(F.col(method) == baseline).select(*cell, F.col(value).alias("baseline_value"))
    return df.join(base, cell).withColumn("ratio", F.try_divide(F.col(value), F.col("baseline_value"))).withColumn("delta", F.col(value) - F.col("baseline_value"))


def leave_one_out(df: DataFrame, dataset: str, method: str, config: str, score: str) -> DataFrame:
    """For each held-out dataset and method, the configuration best on the others and its held-out score.

    A mean without one dataset is the total less that dataset's part, so no row is repeated per held-out dataset.
    """
    per = df.groupBy(dataset, method, config).agg(F.avg(score).alias("s"))
    total = per.groupBy(method, config).agg(F.sum("s").alias("t"), F.count("*").alias("n"))
    held = per.select(dataset).distinct()
    grid = held.join(total)  # datasets times configurations: both are small by construction
    grid = grid.join(per, [dataset, method, config], "left")
    rest = F.try_divide(F.col("t") - F.coalesce("s", F.lit(0.0)), F.col("n") - F.when(F.col("s").isNull(), 0).otherwise(1))
    grid = grid.withColumn("rest", F.round(rest, 9)).where("rest IS NOT NULL")
    best = best_per_group(grid, [dataset, method], "rest", [config])
    return best.select(dataset, method, F.col(config).alias("chosen"), "rest", F.col("s").alias("held_out_score"))


def selection_audit(df: DataFrame, method: str, config: str, score: str) -> DataFrame:
    """Per method: best configuration, gap to the runner-up, spread over configurations (ddof 0)."""
    per = df.groupBy(method, config).agg(F.avg(score).alias("s"))
    w = Window.partitionBy(method).orderBy(F.desc("s"), config)
    r = per.withColumn("r", F.row_number().over(w)).withColumn("gap", F.col("s") - F.lead("s").over(w)).withColumn("sd", F.stddev_pop("s").over(Window.partitionBy(method)))
    return r.where("r = 1").select(method, F.col(config).alias("best_config"), F.col("s").alias("best_score"), "gap", "sd")


def spread(df: DataFrame, by: list[str], method: str, score: str) -> DataFrame:
    """Standard deviation, least, greatest and range of the methods' means, per group."""
    m = df.groupBy(*by, method).agg(F.avg(score).alias("s"))
    return m.groupBy(*by).agg(F.stddev_samp("s").alias("sd"), F.min("s").alias("low"), F.max("s").alias("high"), (F.max("s") - F.min("s")).alias("range"))


def rollup_all(df: DataFrame, by: str, score: str) -> DataFrame:
    """Summary per value of ``by`` and for all together, in one pass."""
    return df.groupingSets([[by], []], by).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"))


def row_mean(*columns: str) -> Column:
    """Mean of the columns that are not null."""
    there = F.filter(F.array(*columns), lambda v: v.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there))


def union_named(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def completeness(df: DataFrame, axes: list[str]) -> DataFrame:
    """The full grid of the axes' values with how many rows each point has; axes are small dimensions."""
    grid = reduce(lambda a, b: a.crossJoin(b), [df.select(a).distinct() for a in axes])
    seen = df.groupBy(*axes).agg(F.count("*").alias("n"))
    return grid.join(seen, axes, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def unique_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A many-to-one join; raises if the right side repeats a key."""
    if right.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError(f"keys {on} are not unique on the right side")
    return left.join(right, on, how)


def to_best_observed(df: DataFrame, by: list[str], score: str, tolerance: float = 1e-12) -> DataFrame:
    """Delta to the group's best, and whether a row is the best within the tolerance."""
    top = F.max(score).over(Window.partitionBy(*by))
    return df.withColumn("delta_best", F.col(score) - top).withColumn("is_best", F.abs(F.col(score) - top) <= tolerance)


def first_per_group(df: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first value of each column that is not null, in order, per group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = df.select(*by, *(F.first(c, ignorenulls=True).over(w).alias(c) for c in columns), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_r"))
    return firsts.where("_r = 1").drop("_r")


def rank_of_means(df: DataFrame, by: list[str], cell: list[str], method: str, score: str) -> DataFrame:
    """(*by, method, mean_rank, position): the mean over cells of a method's rank in each cell, and its place by that mean."""
    ranked = average_rank(df, [*by, *cell], score)
    mean = ranked.groupBy(*by, method).agg(F.avg("rank").alias("mean_rank"))
    return average_rank(mean.withColumn("mean_rank", F.round("mean_rank", 12)), by, "mean_rank", descending=False, out="position")


def custom_order(column: str, values: list) -> Column:
    """A value's place in a list of values, those not in it last."""
    at = F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column))
    return F.when(at > 0, at).otherwise(F.lit(len(values) + 1))


def delta_to_default(df: DataFrame, by: list[str], variant: str, default: str, value: str) -> DataFrame:
    """Each variant's value less the default's, per group; null where a group has no default."""
    base = df.where(F.col(variant) == default).select(*by, F.col(value).alias("default_value"))
    return df.join(base, by, "left").withColumn("delta", F.col(value) - F.col("default_value"))


def seed_membership(df: DataFrame, cell: list[str], dataset: str, method: str, seed: str) -> DataFrame:
    """(dataset, n_complete_cells, n_observed_cells, required_cells, seed_complete): cells are a seed and ``cell``.

    A cell of a dataset is complete if it has every method; a dataset is if all seeds and cells of the table are.
    """
    axes = [seed, *cell]
    facts = df.agg(F.countDistinct(method).alias("_methods"), *(F.countDistinct(c).alias(f"_n_{c}") for c in axes))
    required = reduce(lambda a, b: a * b, [F.col(f"_n_{c}") for c in axes])
    per = df.groupBy(dataset, *axes).agg(F.countDistinct(method).alias("_n"))
    full = per.join(facts).withColumn("_full", F.col("_n") == F.col("_methods")).withColumn("required_cells", required)  # one row of facts
    out = full.groupBy(dataset).agg(F.count_if("_full").alias("n_complete_cells"), F.count("*").alias("n_observed_cells"), F.first("required_cells").alias("required_cells"))
    return out.withColumn("seed_complete", F.col("n_complete_cells") == F.col("required_cells"))


def seed_sensitivity(df: DataFrame, cell: list[str], dataset: str, method: str, seed: str, score: str) -> DataFrame:
    """(method, n_seeds, mean_position, best_position, worst_position, mean_rank) of the methods' places seed by seed, over the seed-complete datasets."""
    strict = df.join(seed_membership(df, cell, dataset, method, seed).where("seed_complete").select(dataset), dataset, "left_semi")
    by_seed = rank_of_means(strict, [seed], [*cell, dataset], method, score)
    return by_seed.groupBy(method).agg(F.countDistinct(seed).alias("n_seeds"), F.avg("position").alias("mean_position"), F.min("position").alias("best_position"), F.max("position").alias("worst_position"), F.avg("mean_rank").alias("mean_rank"))


def learner_sensitivity(df: DataFrame, learner: str, k: str, dataset: str, method: str, score: str, learners: list[str]) -> DataFrame:
    """(method, mean_position, mean_rank, best_position, worst_position, top3_cells, top5_cells, n_cells, <learner>_mean_position ...).

    A cell is a learner and a number of features; a method's place in it is by its mean rank over datasets.
    """
    places = rank_of_means(df, [learner, k], [dataset], method, score)
    summary = places.groupBy(method).agg(
        F.avg("position").alias("mean_position"), F.avg("mean_rank").alias("mean_rank"), F.min("position").alias("best_position"), F.max("position").alias("worst_position"),
        F.count_if(F.col("position") <= 3).alias("top3_cells"), F.count_if(F.col("position") <= 5).alias("top5_cells"), F.count("*").alias("n_cells"),
        *(F.avg(F.when(F.col(learner) == v, F.col("position"))).alias(f"{v}_mean_position") for v in learners))
    return summary


def grid(axes: dict[str, list], spark, exclude: DataFrame | None = None) -> DataFrame:
    """Every combination of the axes' values but those that match a row of ``exclude`` in the columns it has."""
    arrays = {name: F.array(*(F.lit(v) for v in values)) for name, values in axes.items()}
    out = spark.range(1).select()
    for name, values in arrays.items():
        out = out.select("*", F.explode(values).alias(name))
    return out if exclude is None else out.join(exclude, [c for c in exclude.columns if c in axes], "left_anti")


def aggregate_seeds(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """<metric>_mean and <metric>_std (ddof 0) per group, over the values that are numbers."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.groupBy(*by).agg(*(f(number(c)).alias(f"{c}_{n}") for c in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def with_config(df: DataFrame, configs: DataFrame, key: str = "config_id") -> DataFrame:
    """``df`` with its configuration's parameters; an unknown identifier raises."""
    unknown = df.join(configs, key, "left_anti").select(key).limit(1).collect()
    if unknown:
        raise KeyError(f"unknown configuration {unknown[0][0]!r}")
    return unique_join(df, configs, [key])


#: Families by what a synthetic dataset's settings say, the first that fits; and by words of its name.
FAMILIES = (("toeplitz", "toeplitz_rho > 0"), ("weak_signal", "weak_signal"), ("friedman", "friedman_variant IS NOT NULL"), ("nonlinear", "nonlinear"), ("heteroscedastic", "heteroscedastic"),
            ("bias", "n_high_cardinality_noise > 0"), ("confounder", "n_correlated_noise > 0"), ("redundant", "n_redundant > 0"))
NAMED_FAMILIES = (("bias", "bias"), ("friedman", "friedman"), ("nonlinear", "nonlinear"), ("heteroscedastic", "heteroscedastic"), ("corr_noise", "confounder"), ("redundant", "redundant"), ("toeplitz", "toeplitz"), ("weak", "weak_signal"))


def family_of_name(name: Column) -> Column:
    """A synthetic dataset's family by its name."""
    return reduce(lambda chain, rule: chain.when(F.contains(name, F.lit(rule[0])), rule[1]), NAMED_FAMILIES[1:], F.when(F.contains(name, F.lit(NAMED_FAMILIES[0][0])), NAMED_FAMILIES[0][1])).otherwise("standard")


def family_of_settings(otherwise: Column | None = None) -> Column:
    """A synthetic dataset's family by its settings as columns, or ``otherwise``."""
    chain = F.when(F.expr(FAMILIES[0][1]), FAMILIES[0][0])
    for name, rule in FAMILIES[1:]:
        chain = chain.when(F.expr(rule), name)
    return chain.otherwise(F.lit("standard") if otherwise is None else otherwise)
