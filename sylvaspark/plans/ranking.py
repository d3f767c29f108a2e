"""Feature-ranking plans: filter, permutation, forest importance, greedy relevance less redundancy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.association import correlation_ratio, distance_correlation, long_table, mutual_information, pearson, rdc
from ..operators.permutation import permutation_test
from ..operators.splits import best_split, gini_sweep, twelfth


def rank_by_score(scores: DataFrame, score: str) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(score, 12)), "feature")))


def rank_features(df: DataFrame, row_id: str, features: list[str], target: str) -> DataFrame:
    """(feature, eta, rank, threshold, impurity): association with a class, and each feature's best gini split."""
    long = long_table(df, row_id, features, target)
    ranked = rank_by_score(correlation_ratio(long).select("feature", "eta"), "eta")
    split = best_split(gini_sweep(long), ["feature"]).select("feature", "threshold", "impurity")
    return ranked.join(split, "feature", "left")


def filter_ranking(long: DataFrame, kind: str, task: str = "classification") -> DataFrame:
    """(feature, score, rank) by the size of one statistic: ``mc``, ``mi``, ``pc``, ``dc`` or ``rdc``."""
    one = {"mc": lambda: correlation_ratio(long).select("feature", "eta"), "mi": lambda: mutual_information(long), "pc": lambda: pearson(long), "dc": lambda: distance_correlation(long), "rdc": lambda: rdc(long, task=task)}[kind]()
    name = next(c for c in one.columns if c != "feature")
    return rank_by_score(one.select("feature", F.abs(name).alias("score")), "score")


def scan_thresholds(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A sweep's thresholds with ``rank``: the least impure first, equals by threshold."""
    w = Window.partitionBy(*(by or []), "feature").orderBy(twelfth(F.col("impurity")), "threshold")
    return sweep.withColumn("rank", F.row_number().over(w))


def permutation_ranking(long: DataFrame, n: int, seed: int, kind: str = "mc") -> DataFrame:
    """By p-value, then statistic, then name."""
    t = permutation_test(long, n, seed, kind)
    return t.withColumn("rank", F.row_number().over(Window.orderBy("p_value", F.desc(F.round("statistic", 12)), "feature")))


def correlations(df: DataFrame, features: list[str]) -> np.ndarray:
    """The correlation matrix of some columns; 0 where one does not vary.

    Rows become sums of products less the means, one matrix for each task; what reaches the driver is one matrix.
    """
    p = len(features)
    means = df.agg(*(F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features))).first()
    centre = np.array([means[f"m{i}"] or 0.0 for i in range(p)])

    def run(batches):
        total = np.zeros((p, p))
        for batch in batches:
            x = np.stack([np.array(c, dtype=float) for c in batch.columns], axis=1) - centre
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(p * p)), pa.array(total.ravel())], names=["at", "v"])

    rows = df.select(*(F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features))).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros(p * p)
    for r in rows:
        gram[r["at"]] = r["v"]
    gram = gram.reshape(p, p)
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    out = np.zeros((p, p))
    np.divide(gram, np.outer(scale, scale), out=out, where=np.outer(scale, scale) > 1e-300)
    return out


def correlated_pairs(df: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """(a, b, r): pairs of features whose absolute correlation is above the threshold."""
    r = correlations(df, features)
    rows = [(a, b, float(r[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j and abs(r[i, j]) > threshold]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def mrmr(df: DataFrame, row_id: str, features: list[str], target: str, k: int) -> list[str]:
    """Greedy relevance (eta) less mean redundancy (absolute correlation), over two small tables."""
    relevance = {r["feature"]: r["eta"] for r in correlation_ratio(long_table(df, row_id, features, target)).collect()}
    r = np.abs(correlations(df, features))
    link = lambda a, b: r[features.index(a), features.index(b)]
    chosen: list[str] = []
    while len(chosen) < min(k, len(features)):
        rest = [f for f in features if f not in chosen]
        chosen.append(max(rest, key=lambda f: (relevance[f] - (sum(link(f, c) for c in chosen) / len(chosen) if chosen else 0.0), -features.index(f))))
    return chosen


def split_counts(nodes: DataFrame) -> DataFrame:
    """(feature, splits, trees): how often each feature splits, and in how many trees."""
    return nodes.where("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("splits"), F.countDistinct("tree_id").alias("trees"))


def tree_shape(nodes: DataFrame) -> DataFrame:
    """(tree_id, depth, leaves, features)."""
    return nodes.groupBy("tree_id").agg(F.max("depth").alias("depth"), F.count_if(F.col("feature").isNull()).alias("leaves"), F.countDistinct("feature").alias("features"))


__all__ = ["correlated_pairs", "filter_ranking", "mrmr", "pearson", "permutation_ranking", "rank_by_score", "rank_features", "scan_thresholds", "split_counts", "tree_shape"]
