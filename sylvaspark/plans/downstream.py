"""Evaluation of feature rankings by models fitted on their first features (stage 2 of the benchmark).

Linear models are Spark's; neighbours are :func:`~sylvaspark.operators.evaluation.nearest`.  Spark has no kernel
machines, so ``svm`` is a linear one for each class against the rest and ``svr`` a linear Huber regression.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation as E

MODELS = {"classification": ("lr", "svm", "knn"), "regression": ("ridge", "svr", "knn")}


def scaled(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables by the mean and population deviation of ``train``; constant columns keep scale 1."""
    s = train.agg(*(a for i, f in enumerate(features) for a in (F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}")))).first()
    columns = {f: (F.col(f) - (s[f"m{i}"] or 0.0)) / (s[f"s{i}"] or 1.0) for i, f in enumerate(features)}
    return train.withColumns(columns), test.withColumns(columns)


def _weighted(train: DataFrame) -> DataFrame:
    """``train`` with ``_w``: weights that give each class the same sum, rows over classes."""
    per = train.groupBy("_y").agg(F.count("*").alias("_c"))
    facts = per.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return train.join(per, "_y").join(facts).withColumn("_w", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def predict(model: str, train: DataFrame, test: DataFrame, row_id: str, features: list[str], task: str, classes: int = 2) -> DataFrame:
    """``test`` (row_id, _y) with ``prediction`` and, for models with probabilities, the array ``proba``; rows have ``_y`` and scaled features."""
    keep = [row_id, "_y"]
    if model == "knn":
        near = E.neighbour_predict(train, test, row_id, features, "_y", 5, task)
        out = test.select(*keep).join(near.withColumnRenamed("row_id", row_id), row_id)
        if task == "regression":
            return out
        votes = E.nearest(train, test, row_id, features, "_y", 5)
        zero = F.min("d").over(Window.partitionBy("row_id")) == 0
        votes = votes.withColumn("w", F.when(zero, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("d"))))
        share = votes.groupBy("row_id").agg(*(F.try_divide(F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)), F.sum("w")).alias(f"p{c}") for c in range(classes)))
        return out.join(share.select(F.col("row_id").alias(row_id), F.array(*(f"p{c}" for c in range(classes))).alias("proba")), row_id)
    vector = VectorAssembler(inputCols=features, outputCol="_x")
    a, b = vector.transform(train).select(*keep, "_x").cache(), vector.transform(test)  # read once for each step of a fit
    columns = {"featuresCol": "_x", "labelCol": "_y"}
    if model == "ridge":  # Spark's loss is a mean over the label's deviation, so a strength of 1 for the sum is sd / n
        facts = train.agg(F.count("*").alias("n"), F.stddev_pop("_y").alias("s")).first()
        fitted = LinearRegression(regParam=(facts["s"] or 1.0) / max(facts["n"], 1), elasticNetParam=0.0, standardization=False, solver="normal", **columns).fit(a)
        return fitted.transform(b).select(*keep, "prediction")
    if model == "svr":
        return LinearRegression(loss="huber", maxIter=100, tol=1e-3, **columns).fit(a).transform(b).select(*keep, "prediction")
    a = _weighted(a)
    if model == "lr":  # an inverse strength of 1 for the sum
        fitted = LogisticRegression(maxIter=1000, tol=1e-4, regParam=1.0 / max(train.count(), 1), standardization=False, weightCol="_w", family="multinomial", **columns).fit(a)
        return fitted.transform(b).select(*keep, "prediction", vector_to_array("probability").alias("proba"))
    one = LinearSVC(maxIter=50, tol=1e-3, regParam=0.01, weightCol="_w", **columns)
    fitted = one.fit(a) if classes == 2 else OneVsRest(classifier=one, weightCol="_w", **columns).fit(a)
    raw = fitted.transform(b)
    # margins stand in for probabilities: the curve only needs their order
    return raw.select(*keep, "prediction", vector_to_array("rawPrediction").alias("proba"))


def evaluate_fold(train: DataFrame, test: DataFrame, row_id: str, ranking: list[str], target: str, task: str = "classification", ks: list[int] | None = None, models: tuple[str, ...] | None = None) -> list[dict]:
    """A row for each number of first features and each model: k, downstream_model and the metrics of the test rows."""
    out = []
    names = sorted(r[0] for r in train.select(target).distinct().collect()) if task == "classification" else []
    code = (lambda df: df.withColumn("_y", (F.array_position(F.array(*(F.lit(n) for n in names)), F.col(target)) - 1).cast("double"))) if names else (lambda df: df.withColumn("_y", F.col(target).cast("double")))
    for k in ks or E.k_values(len(ranking)):
        features = ranking[:k]
        a, b = (code(t).select(row_id, "_y", *features) for t in (train, test))
        a, b = scaled(a, b, features)
        for model in models or MODELS[task]:
            found = predict(model, a, b, row_id, features, task, len(names)).cache()
            row = {"k": k, "n_features_selected": k, "downstream_model": model}
            if task == "classification":
                m = E.classification_metrics(found, "_y", "prediction").first().asDict()
                auc = E.roc_auc_ovr(found, "_y", "proba", [float(i) for i in range(len(names))]).first()["auc"]
                row |= {"accuracy": m["accuracy"], "f1": m["f1_weighted"], "f1_macro": m["f1_macro"], "balanced_accuracy": m["balanced_accuracy"], "roc_auc": auc, "auc": auc}
            else:
                row |= E.regression_metrics(found, "_y", "prediction").first().asDict()
            found.unpersist()
            out.append({c: v if v is None or not isinstance(v, float) or not math.isnan(v) else None for c, v in row.items()})
    return out


def run_evaluation(df: DataFrame, row_id: str, rankings: list[tuple[int, list[str]]], target: str, task: str = "classification", n: int = 5, seed: int = 0, ks: list[int] | None = None, models: tuple[str, ...] | None = None) -> list[dict]:
    """:func:`evaluate_fold` of each fold's ranking, on the folds that :func:`~sylvaspark.plans.wrappers.rank_over_folds` deals."""
    dealt = E.folds(df, row_id, n, seed, target if task == "classification" else None)
    rows = []
    for fold, ranking in rankings:
        rows += [{"fold": fold, **r} for r in evaluate_fold(dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold), row_id, ranking, target, task, ks, models)]
    return rows
