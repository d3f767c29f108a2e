"""Rankings around a fitted model: importances, permutation importance, Boruta, elimination, folds.

Models are the distributed trees of ``pyspark.ml`` (or this library's own); a feature is
permuted by one window over hash order, so scoring stays in the JVM.  Only tables with one
row per feature reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import median

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.association import long_table
from ..functions.distributions import beta_cdf
from ..operators.evaluation import folds
from ..operators.numbering import blocks_for, digest_block
from ..operators.sampling import bootstrap
from ..operators.trees import TreeParams, grow
from ..sources.stages import stage
from .ranking import correlated_pairs, filter_ranking, mrmr, permutation_ranking

MODELS = {
    "classification": {"dt": DecisionTreeClassifier, "rf": RandomForestClassifier, "gbt": GBTClassifier},
    "regression": {"dt": DecisionTreeRegressor, "rf": RandomForestRegressor, "gbt": GBTRegressor},
}


def encoded(df: DataFrame, target: str, task: str) -> DataFrame:
    """``df`` with ``_y``: the class's place among the sorted classes, or the number itself."""
    if task == "regression":
        return df.withColumn("_y", F.col(target).cast("double"))
    names = sorted(r[0] for r in df.select(target).distinct().collect())
    return df.withColumn("_y", (F.array_position(F.array(*(F.lit(n) for n in names)), F.col(target)) - 1).cast("double"))


def fit(df: DataFrame, features: list[str], task: str, model: str = "rf", seed: int = 0, trees: int = 20, depth: int = 5):
    """A fitted tree model of ``_y`` (see :func:`encoded`)."""
    options = {"labelCol": "_y", "featuresCol": "_x", "maxDepth": depth, "seed": seed}
    if model == "rf":
        options["numTrees"] = trees
    elif model == "gbt":
        options["maxIter"] = trees
    return MODELS[task][model](**options).fit(VectorAssembler(inputCols=features, outputCol="_x").transform(df))


def importances(df: DataFrame, row_id: str, features: list[str], target: str, model: str, task: str = "classification", seed: int = 0, trees: int = 20, depth: int = 5) -> dict[str, float]:
    """Impurity importance of each feature in a fitted model.

    ``dt``, ``rf`` and ``gbt`` are Spark's; ``rt`` and ``et`` split at random thresholds; ``tree`` and ``forest`` are
    this library's.  Boosting of several classes is the mean of its one-against-rest models.
    """
    if model in ("rt", "et", "tree", "forest"):
        many, random = model in ("et", "forest"), model in ("rt", "et")
        params = TreeParams(task=task, trees=trees if many else 1, max_depth=depth, seed=seed, max_features="sqrt" if many else None, threshold_method="random" if random else "exact", max_thresholds=1 if random else 32)
        sample = bootstrap(df, row_id, trees, seed, target if task == "classification" else None, "stratified" if task == "classification" else "classic") if model == "forest" else None
        return grow(df, row_id, features, target, params, sample).importances()
    rows = encoded(df, target, task)
    many = int(rows.agg(F.max("_y")).first()[0]) + 1 if model == "gbt" and task == "classification" else 2
    if many > 2:
        each = [fit(rows.withColumn("_y", (F.col("_y") == c).cast("double")), features, task, model, seed, trees, depth) for c in range(many)]
    else:
        each = [fit(rows, features, task, model, seed, trees, depth)]
    return {f: sum(float(m.featureImportances[i]) for m in each) / len(each) for i, f in enumerate(features)}


def donated(df: DataFrame, row_id: str, features: list[str], seed: int, repeats: int = 1, strata: dict[str, Column] | None = None) -> DataFrame:
    """(feature, b, row_id, x): each row's value of each feature taken from the next row in hash order, per repeat.

    The order of (repeat, feature) is md5(seed|feature|b|row_id) and the last row takes the first one's value,
    so values are permuted in one cycle; with ``strata``, within each stratum.  A lone row keeps its value.
    """
    strata = strata or {}
    blocks = blocks_for(df)
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), strata.get(f, F.lit(0)).cast("long").alias("stratum")) for f in features)))
    t = df.select(F.col(row_id).alias("row_id"), cells.alias("c")).select("row_id", "c.*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("b"))
    t = t.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), "feature", F.col("b").cast("string"), F.col("row_id").cast("string"))))
    keys, x, order = ["feature", "b", "stratum"], F.struct("x"), ["_key", "row_id"]
    if blocks == 1:
        w = Window.partitionBy(*keys).orderBy(*order)
        return t.select("feature", "b", "row_id", F.coalesce(F.lead(x).over(w), F.first(x).over(w))["x"].alias("x"))
    # the last row of a block takes the first value of the next block that has rows, the last of all the first
    t = t.withColumn("_block", digest_block(F.col("_key"), blocks))
    first = t.groupBy(*keys, "_block").agg(F.min_by(x, F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_block")
    first = first.select(*(F.col(c).alias(f"_by_{c}") for c in keys), F.col("_block").alias("_at"), F.coalesce(F.lead("_first").over(w), F.first("_first").over(w)).alias("_next"))
    same = F.col("_block") == F.col("_at")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = t.withColumn("_lead", F.lead(x).over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    return inside.join(first, same).select("feature", "b", "row_id", F.coalesce("_lead", "_next")["x"].alias("x"))


def bins_of(df: DataFrame, columns: list[str], bins: int = 5) -> dict[str, Column]:
    """A row's bin of each column, between its distinct equal-share quantiles, and none for a column that does not vary."""
    if not columns:
        return {}
    at = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    cuts = df.agg(*(F.percentile(F.col(c).cast("double"), at).alias(c) for c in columns)).first()
    inner = {c: sorted(set(cuts[c] or [])) for c in columns}
    return {c: sum(((F.col(c) >= v).cast("long") for v in inner[c][1:-1]), F.lit(0).cast("long")) for c in columns if len(inner[c]) > 1}


def strata_code(digits: list[Column], bins: int = 5) -> Column:
    """One number for some bins: digits to base ``bins``, or their hash where a long has no room for them."""
    if len(digits) > 20:
        return F.xxhash64(*digits)
    out = F.lit(0).cast("long")
    for d in digits:
        out = out * bins + d
    return out


def strata(df: DataFrame, columns: list[str], bins: int = 5) -> Column:
    """A row's stratum: its bins of some columns as one number."""
    return strata_code([*bins_of(df, columns, bins).values()], bins)


def _score(rows: DataFrame, task: str, by: list[str]) -> DataFrame:
    """(*by, score): balanced accuracy, or the share of variance explained."""
    if task == "classification":
        return rows.groupBy(*by, "_y").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("r")).groupBy(*by).agg(F.avg("r").alias("score"))
    e = F.col("_y") - F.col("prediction")
    return rows.groupBy(*by).agg(F.coalesce(1 - F.try_divide(F.avg(e * e), F.var_pop("_y")), F.lit(0.0)).alias("score"))


def permutation_importance(df: DataFrame, row_id: str, features: list[str], target: str, task: str = "classification", seed: int = 0, repeats: int = 10, conditional: float | None = None, trees: int = 20, model: str = "rf") -> DataFrame:
    """(feature, importance, rank): the loss of held-out score when a feature is permuted.

    A model is fitted on four fifths of the rows: Spark's forest, or with ``model`` ``forest`` this library's.  With ``conditional`` a feature is permuted within strata of
    the features whose absolute correlation with it is above that threshold.
    """
    rows = encoded(df, target, task)
    rows = folds(rows, row_id, 5, seed, target if task == "classification" else None)
    train = rows.where("fold > 0")
    if model == "forest":
        sample = bootstrap(train, row_id, trees, seed, "_y" if task == "classification" else None, "stratified" if task == "classification" else "classic")
        fitted = grow(train, row_id, features, "_y", TreeParams(task=task, trees=trees, max_depth=4, min_leaf=5, max_features="sqrt", seed=seed, threshold_method="histogram", max_thresholds=16), sample)
        predicted = lambda t: t.withColumn("prediction", fitted.predict())
    else:
        vector, fitted = VectorAssembler(inputCols=features, outputCol="_x"), fit(train, features, task, model, seed, trees)
        predicted = lambda t: fitted.transform(vector.transform(t))
    held = rows.where("fold = 0").select(F.col(row_id).alias("row_id"), "_y", *features)
    within: dict[str, Column] = {}
    if conditional is not None and len(features) > 1:
        near: dict[str, list[str]] = {}
        for r in correlated_pairs(held, features, conditional).collect():
            near.setdefault(r["a"], []).append(r["b"])
            near.setdefault(r["b"], []).append(r["a"])
        digits = bins_of(held, sorted(near, key=features.index))
        held = stage(held.withColumns({f"_bin_{c}": d for c, d in digits.items()}), "binned")
        within = {f: strata_code([F.col(f"_bin_{c}") for c in sorted(cs, key=features.index) if c in digits]) for f, cs in near.items()}
    moved = donated(held, "row_id", features, seed, repeats, within).join(held, "row_id")
    moved = moved.select("feature", "b", "_y", *(F.when(F.col("feature") == f, F.col("x")).otherwise(F.col(f)).alias(f) for f in features))
    after = _score(predicted(moved), task, ["feature", "b"]).groupBy("feature").agg(F.avg("score").alias("after"))
    before = _score(predicted(held).withColumn("_k", F.lit(0)), task, ["_k"]).first()["score"]
    t = after.select("feature", (F.lit(before) - F.col("after")).alias("importance"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("importance", 12)), "feature")))


def split_count_ranking(df: DataFrame, row_id: str, features: list[str], target: str, params: TreeParams, sample: DataFrame | None = None) -> list[tuple[str, int, int]]:
    """(feature, splits, rank): how often this library's tree or forest splits on each feature; ties in the features' order."""
    used = dict.fromkeys(features, 0)
    for n in grow(df, row_id, features, target, params, sample).nodes.values():
        if n.feature is not None:
            used[n.feature] += 1
    order = sorted(features, key=lambda f: (-used[f], features.index(f)))
    return [(f, used[f], i + 1) for i, f in enumerate(order)]


def select(method: str, df: DataFrame, row_id: str, features: list[str], target: str, task: str = "classification", seed: int = 0, **options) -> list[str]:
    """Features from first to last by a named method: ``boruta``, ``pi``, ``cpi``, ``mrmr``, ``rfe``, ``tree``, ``forest``, ``varimp``, a model of
    :func:`importances`, a statistic of the filters (``mc``, ``mi``, ``pc``, ``dc``, ``rdc``), or its permutation test (``ptest_mc`` ...)."""
    by = lambda rows: [r["feature"] for r in rows.orderBy("rank", "feature").collect()]
    if method == "boruta":
        return [f for f, _, _, _ in sorted(boruta(df, row_id, features, target, task, seed, **options), key=lambda r: (r[3], features.index(r[0])))]
    if method in ("pi", "cpi", "varimp"):
        extra = {"conditional": 0.5} if method == "cpi" else {"model": "forest"} if method == "varimp" else {}
        return by(permutation_importance(df, row_id, features, target, task, seed, **(extra | options)))
    if method == "rfe":
        return [f for f, _ in sorted(eliminate(df, features, target, task, seed, **options), key=lambda r: (r[1], features.index(r[0])))]
    if method == "mrmr":
        first = mrmr(df, row_id, features, target, len(features))
        return first + [f for f in features if f not in first]
    name = method.removeprefix("ptest_")
    if name in ("mc", "mi", "pc", "dc", "rdc"):
        long = long_table(df, row_id, features, target)
        if method != name:
            kind = "rdc_class" if name == "rdc" and task == "classification" else name
            return by(permutation_ranking(long, options.pop("n", 100), seed, kind, **options))
        return by(filter_ranking(long, name, task))
    weight = importances(df, row_id, features, target, method, task, seed, **options)
    return sorted(features, key=lambda f: (-weight[f], features.index(f)))


def eliminate(df: DataFrame, features: list[str], target: str, task: str = "classification", seed: int = 0, step: float = 0.1, trees: int = 20) -> list[tuple[str, int]]:
    """(feature, rank) by recursive elimination: the least important share goes each round, until one is left."""
    rows = encoded(df, target, task)
    left, rounds, drop = list(features), [], max(1, int(step * len(features)))
    while len(left) > 1:
        model = fit(rows, left, task, "rf", seed, trees)
        weight = {f: float(model.featureImportances[i]) for i, f in enumerate(left)}
        out = sorted(left, key=lambda f: (weight[f], -features.index(f)))[: min(drop, len(left) - 1)]
        rounds.append(out)
        left = [f for f in left if f not in out]
    return [(left[0], 1)] + [(f, i + 2) for i, out in enumerate(reversed(rounds)) for f in out]


def _step_up(p: dict[str, float], alpha: float) -> set[str]:
    """Rejected by the step-up procedure of Benjamini and Hochberg."""
    order = sorted(p, key=p.get)
    last = max((i + 1 for i, f in enumerate(order) if p[f] <= alpha * (i + 1) / len(order)), default=0)
    return set(order[:last])


def boruta(df: DataFrame, row_id: str, features: list[str], target: str, task: str = "classification", seed: int = 0, rounds: int = 20, alpha: float = 0.05, trees: int = 20) -> list[tuple[str, str, int, int]]:
    """(feature, decision, hits, rank): features that beat the best permuted copy more often than by chance.

    Each round fits a forest on the features not rejected and on permuted copies of them.  Decisions need the
    step-up procedure over features and a level divided by the number of rounds.  Confirmed features
    rank 1, tentative ones 2, rejected ones follow by median importance.
    """
    rows = encoded(df, target, task)
    open_, confirmed, rejected = list(features), [], []
    hits, history = dict.fromkeys(features, 0), {f: [] for f in features}
    for i in range(1, rounds + 1):
        if not open_:
            break
        kept = [f for f in features if f not in rejected]
        other = donated(rows, row_id, kept, seed + i).groupBy("row_id").agg(*(F.max(F.when(F.col("feature") == f, F.col("x"))).alias(f"{f}__copy") for f in kept))
        both = rows.join(other.withColumnRenamed("row_id", row_id), row_id)
        model = fit(both, [*kept, *(f"{f}__copy" for f in kept)], task, "rf", seed + i, trees)
        weight = [float(v) for v in model.featureImportances.toArray()]
        bar = max(weight[len(kept) :])
        for f, v in zip(kept, weight):
            history[f].append(v)
            hits[f] += v > bar
        above = {f: beta_cdf(0.5, hits[f], i - hits[f] + 1) for f in open_}
        below = {f: 1 - beta_cdf(0.5, hits[f] + 1, i - hits[f]) for f in open_}
        yes, no = ({f for f in _step_up(p, alpha) if p[f] <= alpha / i} for p in (above, below))
        confirmed += [f for f in open_ if f in yes]
        rejected += [f for f in open_ if f in no]
        open_ = [f for f in open_ if f not in yes | no]
    last = sorted(rejected, key=lambda f: (-median(history[f]), features.index(f)))
    rank = {**dict.fromkeys(confirmed, 1), **dict.fromkeys(open_, 2), **{f: i + 3 for i, f in enumerate(last)}}
    name = lambda f: "confirmed" if f in confirmed else "tentative" if f in open_ else "rejected"
    return [(f, name(f), hits[f], rank[f]) for f in features]


def rank_over_folds(df: DataFrame, row_id: str, features: list[str], target: str, rank: Callable[[DataFrame, int], list[str]], n: int = 5, seed: int = 0, task: str = "classification") -> list[tuple[int, list[str]]]:
    """(fold, ranking): ``rank(train, seed)`` on each fold's other rows, standardised by their own mean and deviation."""
    dealt = folds(df, row_id, n, seed, target if task == "classification" else None)
    out = []
    for fold in range(n):
        train = dealt.where(F.col("fold") != fold)
        s = train.agg(*(a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")))).first()
        scaled = train.select(row_id, target, *(((F.col(f) - s[f"m_{f}"]) / (s[f"s_{f}"] or 1.0)).alias(f) for f in features))
        out.append((fold, rank(scaled, seed * 1000 + fold)))
    return out


def coverage_probability(p: int, looked_at: int, informative: int) -> float:
    """Chance that a random set of features of a node holds at least one informative one."""
    return 1.0 if looked_at >= p else 1 - math.comb(p - informative, looked_at) / math.comb(p, looked_at)
