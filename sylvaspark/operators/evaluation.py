"""Folds and metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import blocks_for, digest_block, number, running, value_block


def folds(df: DataFrame, row_id: str, n: int, seed: int, label: str | None = None) -> DataFrame:
    """``df`` with ``fold``: hash order dealt round, within each class if a label is given."""
    digest = F.coalesce(F.md5(F.concat(F.lit(f"{seed}|c|"), F.col(row_id).cast("string"))), F.lit(""))
    blocks = blocks_for(df)
    dealt = number(df, [label] if label else [], [digest, row_id], F.coalesce(digest_block(digest, blocks), F.lit(0)), blocks, "fold")
    return dealt.withColumn("fold", ((F.col("fold") - 1) % n).cast("int"))


def standardize(df: DataFrame, columns: list[str], fold: str) -> DataFrame:
    """Each column, per held-out fold, by mean and population deviation of the other folds; constants keep scale 1.

    Statistics of the other folds are all less the fold's own, so no row is copied per fold.
    """
    per = df.groupBy(fold).agg(F.count("*").alias("_n"), *(a for c in columns for a in (F.sum(c).alias(f"_s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}"))))
    every = Window.partitionBy(F.lit(1))
    rest = per.select(fold, *((F.sum(c).over(every) - F.col(c)).alias(c) for c in per.columns if c != fold))
    out = df.join(F.broadcast(rest), fold)
    for c in columns:
        mean = F.col(f"_s_{c}") / F.col("_n")
        sd = F.sqrt(F.greatest(F.lit(0.0), F.col(f"_q_{c}") / F.col("_n") - mean * mean))
        out = out.withColumn(c, (F.col(c) - mean) / F.when(sd > 1e-12, sd).otherwise(1.0))
    return out.select(*df.columns)


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, f1_weighted, f1_macro, balanced_accuracy from the confusion cells; undefined parts count 0."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    sides = cells.select(F.col("t").alias("k"), F.col("c").alias("tc"), F.lit(0).alias("pc"), F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0).alias("hit"))
    sides = sides.unionByName(cells.select(F.col("p").alias("k"), F.lit(0).alias("tc"), F.col("c").alias("pc"), F.lit(0).alias("hit")))
    per = sides.groupBy("k").agg(F.sum("tc").alias("tc"), F.sum("pc").alias("pc"), F.sum("hit").alias("hit"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("tc") + F.col("pc")), F.lit(0.0))
    recall = F.try_divide(F.col("hit").cast("double"), F.col("tc"))
    return per.agg((F.sum("hit") / F.sum("tc")).alias("accuracy"), (F.sum(f1 * F.col("tc")) / F.sum("tc")).alias("f1_weighted"), F.avg(f1).alias("f1_macro"), F.avg(recall).alias("balanced_accuracy"))


def roc_auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(*by, auc): binary AUC from counts per distinct score, so ties are averaged; null where a class is missing.

    Counts are summed along the scores in blocks, so no task holds all of them.
    """
    by = by or []
    per = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("n"))
    blocks = blocks_for(df)
    t = running(per, by, ["_s"], {"_below": F.col("n")}, value_block(per, "_s", blocks), blocks)
    t = t.withColumn("u", F.col("p") * (F.col("_below") - F.col("n") / 2.0))
    return t.groupBy(*by).agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")).alias("auc"))


def roc_auc_ovr(df: DataFrame, truth: str, scores: str, classes: list) -> DataFrame:
    """(auc): each class against the rest by its place in the array ``scores``, weighted by the classes' rows; null where a class has no rows.

    Two classes are the AUC of the second.
    """
    if len(classes) == 2:
        return roc_auc(df.select((F.col(truth) == F.lit(classes[1])).cast("int").alias("_t"), F.col(scores)[1].alias("_p")), "_t", "_p")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), (F.col(truth) == F.lit(c)).cast("int").alias("t"), F.col(scores)[i].alias("p")) for i, c in enumerate(classes))))
    rows = df.select(each.alias("e")).select("e.*")
    auc = roc_auc(rows, "t", "p", ["c"])
    share = rows.groupBy("c").agg(F.sum("t").alias("w"))
    whole = F.when(F.count_if(F.col("auc").isNull()) == 0, F.sum(F.col("auc") * F.col("w")) / F.sum("w"))
    return auc.join(share, "c").agg(whole.alias("auc"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    t = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("v"))
    return t.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"))


def _hits(ranking: Column, truth: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(ranking, 1, k), truth)).cast("double")


def precision_at(ranking: Column, truth: Column, k: int) -> Column:
    if k < 0:
        raise ValueError("k must not be negative")
    return _hits(ranking, truth, k) / k if k else F.lit(0.0)


def recall_at(ranking: Column, truth: Column, k: int) -> Column:
    return F.when(F.size(truth) > 0, F.try_divide(_hits(ranking, truth, k), F.size(truth))).otherwise(0.0)


def f1_at(ranking: Column, truth: Column, k: int) -> Column:
    p, r = precision_at(ranking, truth, k), recall_at(ranking, truth, k)
    return F.when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(0.0)


def jaccard_at(ranking: Column, truth: Column, k: int) -> Column:
    both = F.size(F.array_union(F.slice(ranking, 1, k), truth))
    return F.when(both > 0, F.try_divide(_hits(ranking, truth, k), both)).otherwise(0.0)


def first_hit(ranking: DataFrame, key: str, column: str, truth: str) -> DataFrame:
    """(key, rank, mrr, top1): place of the first true feature; a miss is the length plus one and 0."""
    at = ranking.select(key, F.size(column).alias("n"), F.col(truth).alias("_t"), F.posexplode(column))
    hit = F.min(F.when(F.array_contains("_t", F.col("col")), F.col("pos") + 1))
    t = at.groupBy(key).agg(hit.alias("h"), F.first("n").alias("n"))
    return t.select(key, F.coalesce("h", F.col("n") + 1).alias("rank"), F.coalesce(1.0 / F.col("h"), F.lit(0.0)).alias("mrr"), (F.coalesce("h", F.lit(0)) == 1).alias("top1"))


def hits_at(ranking: Column, truth: Column, k: int) -> tuple[Column, Column]:
    """Whether any, and whether all, of the first k features are true; none of no features."""
    top = F.slice(ranking, 1, k)
    return F.arrays_overlap(top, truth), F.size(F.array_except(top, truth)) == 0


def noise_rate(ranking: Column, noise: Column, k: int) -> Column:
    """The share of the first k features that are noise; 0 without noise or features."""
    return F.when((F.size(noise) > 0) & (F.lit(k) > 0), F.size(F.array_intersect(F.slice(ranking, 1, k), noise)) / F.lit(float(max(k, 1)))).otherwise(0.0)


def index_spread(ranking: Column, n_features: Column, k: int) -> Column:
    """The range of the first k feature numbers over the range of all; null for fewer than two."""
    top = F.slice(ranking, 1, k)
    return F.when((F.size(top) > 1) & (n_features > 1), (F.array_max(top) - F.array_min(top)) / (n_features - 1))


def confounder_rate(ranking: Column, truth: Column, n_base: Column, k: int) -> Column:
    """The share of the first k feature numbers that are neither true nor among the first ``n_base``."""
    return F.size(F.filter(F.slice(ranking, 1, k), lambda f: (f >= n_base) & ~F.array_contains(truth, f))) / F.lit(float(k))


def composition(rankings: DataFrame, key: str, column: str, groups: DataFrame, k: int, p: int) -> DataFrame:
    """(key, grp, hits, share): how many of the first min(k, p) features are in each group of ``groups`` (feature, grp).

    Features without a group count as ``other``; places that a short ranking leaves empty count as ``missing``.
    """
    wide = min(k, p)
    top = rankings.select(key, F.slice(column, 1, wide).alias("_t"))
    found = top.select(key, F.explode("_t").alias("feature")).join(groups, "feature", "left").select(key, F.coalesce("grp", F.lit("other")).alias("grp"), F.lit(1).alias("hits"))
    empty = top.select(key, F.lit("missing").alias("grp"), (F.lit(wide) - F.size("_t")).alias("hits")).where("hits > 0")
    return found.unionByName(empty).groupBy(key, "grp").agg(F.sum("hits").alias("hits")).withColumn("share", F.col("hits") / F.lit(float(max(wide, 1))))


#: Rows of a block of ``train`` and of ``test`` that meet in one task.
NEAREST_ROWS = 4096


def nearest(train: DataFrame, test: DataFrame, row_id: str, features: list[str], target: str, k: int = 5, rows: int = NEAREST_ROWS) -> DataFrame:
    """(row_id, y, d): the k nearest rows of ``train`` for each row of ``test``, by distance and then identifier.

    Both tables are dealt to blocks of about ``rows`` rows; each pair of blocks is one task with bounded memory that
    returns k rows for each of its test rows, so neither pairs of rows nor whole tables are shuffled.
    """
    blocks = [max(1, -(-df.count() // rows)) for df in (train, test)]
    vector = F.array(*(F.col(f).cast("double") for f in features))
    deal = lambda n: F.pmod(F.xxhash64(row_id), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = dict(train.dtypes)
    a = test.select(F.lit(True).alias("asks"), F.col(row_id).alias("row_id"), F.lit(None).cast(kinds[target]).alias("y"), vector.alias("v"), deal(blocks[1]).alias("j")).withColumn("i", every(blocks[0]))
    b = train.select(F.lit(False).alias("asks"), F.col(row_id).alias("row_id"), F.col(target).alias("y"), vector.alias("v"), deal(blocks[0]).alias("i")).withColumn("j", every(blocks[1]))

    def look(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        v = np.array(group.column("v").combine_chunks().flatten(), dtype=float).reshape(len(asks), -1)
        q, t = np.flatnonzero(asks), np.flatnonzero(~asks)
        ids, y = group.column("row_id"), group.column("y")
        order = t[pc.sort_indices(ids.take(pa.array(t))).to_numpy()] if len(t) else t  # equal distances go by identifier
        found_q, found_t, found_d = [], [], []
        for i in q:
            off = v[order] - v[i]
            d = np.sqrt((off * off).sum(axis=1))
            near = np.argsort(d, kind="stable")[:k]
            found_q.append(np.full(len(near), i))
            found_t.append(order[near])
            found_d.append(d[near])
        at, to, d = (np.concatenate(x) if x else np.zeros(0) for x in (found_q, found_t, found_d))
        at, to = at.astype(np.int64), to.astype(np.int64)
        return pa.table({"row_id": ids.take(pa.array(at)), "_id": ids.take(pa.array(to)), "y": y.take(pa.array(to)), "d": pa.array(d, pa.float64())})

    schema = f"row_id {kinds[row_id]}, _id {kinds[row_id]}, y {kinds[target]}, d double"
    best = a.unionByName(b).groupBy("i", "j").applyInArrow(look, schema)
    w = Window.partitionBy("row_id").orderBy("d", "_id")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("row_id", "y", "d")


def neighbour_predict(train: DataFrame, test: DataFrame, row_id: str, features: list[str], target: str, k: int = 5, task: str = "classification") -> DataFrame:
    """(row_id, prediction): neighbours vote, or are averaged, by 1 / distance; rows at distance 0 decide alone."""
    near = nearest(train, test, row_id, features, target, k)
    zero = F.min("d").over(Window.partitionBy("row_id")) == 0
    near = near.withColumn("w", F.when(zero, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("d"))))
    if task == "regression":
        return near.groupBy("row_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
    votes = near.groupBy("row_id", "y").agg(F.round(F.sum("w"), 9).alias("v"))
    first = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("v"), "y"))
    return votes.withColumn("_r", first).where("_r = 1").select("row_id", F.col("y").alias("prediction"))


def k_values(p: int, extra: tuple[int, ...] = (), fractions: tuple[float, ...] = ()) -> list[int]:
    """Evaluated feature counts up to p; extras count only beyond 100 features."""
    base = {k for k in (5, 10, 25, 50, 100) if k <= p}
    if p > 100:
        base |= {k for k in (*extra, *(math.ceil(f * p) for f in fractions)) if 100 < k <= p}
    return sorted(base | {p})


def k_values_covered(metrics: DataFrame, by: list[str], wanted: list[int]) -> DataFrame:
    """(*by, covered): whether the feature counts in ``metrics`` (*by, k) take in all that are wanted."""
    need = F.array(*(F.lit(k) for k in wanted)).cast("array<int>")
    return metrics.groupBy(*by).agg((F.size(F.array_except(need, F.collect_set(F.col("k").cast("int")))) == 0).alias("covered"))
