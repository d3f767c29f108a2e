"""Apportionment and bootstrap samples, drawn by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import blocks_for, digest_block, number, value_block


def apportion(df: DataFrame, weight: str, total: int, order: str, out: str = "allocated") -> DataFrame:
    """Largest-remainder allocation of ``total``; zero weights share equally, remainders to the first."""
    every = Window.partitionBy(F.lit(1))
    w = F.col(weight).cast("double")
    share = F.when(F.sum(w).over(every) > 0, F.try_divide(w, F.sum(w).over(every))).otherwise(1 / F.count("*").over(every)) * total
    t = df.withColumn("_e", F.round(share, 9)).withColumn("_f", F.floor("_e")).withColumn("_left", total - F.sum("_f").over(every))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_e") - F.col("_f")), order))
    return t.withColumn(out, (F.col("_f") + (place <= F.col("_left")).cast("int")).cast("int")).drop("_e", "_f", "_left")


def _hash(seed: int, *parts: Column) -> Column:
    text = F.concat(F.lit(f"{seed}|d"), *(x for p in parts for x in (F.lit("|"), p.cast("string"))))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bootstrap(rows: DataFrame, row_id: str, trees: int, seed: int, label: str | None = None, kind: str = "classic", max_samples: int | None = None) -> DataFrame:
    """(tree_id, draw, row_id): samples with replacement.

    ``classic`` over all rows, ``stratified`` per class, ``undersample`` as many per class as the least,
    ``oversample`` class counts that differ by one at most and sum to the number of rows.

    ``max_samples`` caps a tree's sample.  A capped stratum keeps the draws that are first in hash order: ``classic`` that many,
    ``stratified`` its share by largest remainder, ``undersample`` and ``oversample`` shares as equal as possible.
    """
    group = [F.col(label).alias("_g")] if label and kind != "classic" else [F.lit(0).alias("_g")]
    base = rows.select(F.col(row_id).alias("row_id"), *group)
    blocks = blocks_for(base)
    base = number(base, ["_g"], ["row_id"], value_block(base, "row_id", blocks), blocks, "_i")
    sizes = base.groupBy("_g").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(1))  # a row per class
    k, place = F.count("*").over(every), F.row_number().over(Window.orderBy("_g"))
    even = lambda total: F.floor(total / k) + (place <= total % k).cast("int")
    if kind in ("classic", "stratified"):
        sizes = sizes.withColumn("_m", F.col("_n"))
    elif kind == "undersample":
        sizes = sizes.withColumn("_m", F.min("_n").over(every))
    elif kind == "oversample":
        sizes = sizes.withColumn("_m", even(F.sum("_n").over(every) if max_samples is None else F.lit(max_samples)))
    else:
        raise ValueError(f"unknown sampling method {kind!r}")
    sizes = sizes.withColumn("_keep", F.col("_m"))
    if max_samples is not None and kind != "oversample":
        if kind == "stratified":
            sizes = apportion(sizes, "_m", max_samples, "_g", "_share")
        else:
            sizes = sizes.withColumn("_share", even(F.lit(max_samples)))
        sizes = sizes.withColumn("_keep", F.when(F.sum("_m").over(every) > max_samples, F.least("_m", "_share")).otherwise(F.col("_m"))).drop("_share")
    spread = sizes.select("_g", "_n", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id"), F.col("_m").cast("long").alias("_m"), F.col("_keep").cast("long").alias("_keep"))
    spread = spread.where("_m > 0 AND _keep > 0").select("_g", "_n", "tree_id", "_m", "_keep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))).alias("draw"))
    if max_samples is not None:
        order = F.md5(F.concat_ws("|", F.lit(f"{seed}|k"), F.col("tree_id").cast("string"), F.col("_g").cast("string"), F.col("draw").cast("string")))
        spread = spread.withColumn("_d", order)
        spread = number(spread, ["tree_id", "_g"], ["_d", "draw"], digest_block(F.col("_d"), blocks), blocks, "_r").where(F.col("_r") <= F.col("_keep"))
    drawn = spread.withColumn("_i", _hash(seed, F.col("tree_id"), F.col("_g"), F.col("draw")) % F.col("_n") + 1)
    return drawn.join(base, ["_g", "_i"]).select("tree_id", F.col("_g").alias("stratum"), "draw", "row_id")


def unsampled(rows: DataFrame, row_id: str, sample: DataFrame, trees: int) -> DataFrame:
    """(tree_id, row_id): the rows that a tree did not draw."""
    every = rows.select(F.col(row_id).alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id"))
    return every.join(sample.select("tree_id", "row_id").distinct(), ["tree_id", "row_id"], "left_anti").select("tree_id", "row_id")
