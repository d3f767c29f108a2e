"""Trees and forests with the usual protocol: keyword parameters, ``fit``, ``predict``, ``clone``, ``save`` and ``load``."""

from __future__ import annotations

from dataclasses import asdict, fields

from pyspark.sql import Column, DataFrame, SparkSession

from .operators import sampling
from .operators.trees import TreeModel, TreeParams, feature_count, grow, oob_score, validate_columns


def jobs(n: int | None, cores: int) -> int:
    """How many tasks run at once: negative numbers count back from all cores; 0 is an error."""
    if n == 0:
        raise ValueError("n_jobs=0 is invalid: 1 is one task at a time, -1 all cores")
    if n is None:
        return 1
    return min(n, cores) if n > 0 else max(1, cores + 1 + n)


class _Estimator:
    task = "classification"
    _own: dict = {}

    def __init__(self, **params):
        names = {f.name for f in fields(TreeParams)} - {"task"}
        if unknown := sorted(set(params) - names - set(self._own)):
            raise TypeError(f"unknown parameters {unknown}")
        self._params = {**self._defaults(), **params}
        self._tree_params()  # validates
        self.model: TreeModel | None = None

    @classmethod
    def _defaults(cls) -> dict:
        return dict(cls._own)

    def _tree_params(self) -> TreeParams:
        return TreeParams(task=self.task, **{k: v for k, v in self._params.items() if k not in self._own})

    def get_params(self) -> dict:
        """Every parameter with its value."""
        return {**{k: v for k, v in asdict(self._tree_params()).items() if k != "task"}, **{k: self._params[k] for k in self._own}}

    def set_params(self, **params):
        self.__init__(**{**self._params, **params})
        return self

    def clone(self):
        return type(self)(**self._params)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in sorted(self._params.items()))})"

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and self.get_params() == other.get_params()

    __hash__ = None

    def _fitted(self) -> TreeModel:
        if self.model is None:
            raise RuntimeError("fit first")
        return self.model

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        validate_columns(df, self._fitted())
        return df.withColumn(out, self.model.predict())

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        validate_columns(df, self._fitted())
        return df.withColumn(out, self.model.proba())

    def apply(self, df: DataFrame, row_id: str) -> DataFrame:
        return self._fitted().apply(df, row_id)

    def decision_path(self, df: DataFrame, row_id: str) -> DataFrame:
        return self._fitted().decision_path(df, row_id, None)

    def leaf(self, tree: int = 0) -> Column:
        return self._fitted().leaf(tree)

    @property
    def feature_importances(self) -> dict[str, float]:
        return self._fitted().importances()

    def save(self, spark: SparkSession, path: str) -> None:
        self._fitted().save(spark, path)

    def load(self, spark: SparkSession, path: str):
        self.model = TreeModel.load(spark, path)
        return self


class TreeClassifier(_Estimator):
    def fit(self, df: DataFrame, row_id: str, features: list[str], target: str):
        self.model = grow(df, row_id, features, target, self._tree_params())
        return self


class TreeRegressor(TreeClassifier):
    task = "regression"


class ForestClassifier(_Estimator):
    """``bootstrap`` draws each tree's rows by ``sampling_method``, at most ``max_samples`` (a number or share); ``oob_score`` scores the rows left out."""

    _own = {"bootstrap": True, "sampling_method": "stratified", "max_samples": None, "oob_score": False, "n_jobs": None}

    def __init__(self, **params):
        params = {"trees": 100, "max_features": "sqrt", **params}
        if not {**self._own, **params}["bootstrap"]:
            for name in ("max_samples", "oob_score"):
                if params.get(name):
                    raise ValueError(f"{name} needs bootstrap")
            if params.get("sampling_method") not in (None, self._own["sampling_method"]):
                raise ValueError("sampling_method needs bootstrap")
        if params.get("n_jobs") == 0:
            jobs(0, 1)
        super().__init__(**params)
        self.oob: float | None = None

    def fit(self, df: DataFrame, row_id: str, features: list[str], target: str):
        p, params = self._params, self._tree_params()
        sample = None
        if p["bootstrap"]:
            n = df.count()
            most = None if p["max_samples"] is None else feature_count(n, p["max_samples"])
            label = target if self.task == "classification" else None
            sample = sampling.bootstrap(df, row_id, params.trees, params.seed, label, p["sampling_method"], most)
        self.model = grow(df, row_id, features, target, params, sample)
        if p["oob_score"]:
            self.oob = oob_score(self.model, df, row_id, target, sampling.unsampled(df, row_id, sample, params.trees)).first()["score"]
        return self


class ForestRegressor(ForestClassifier):
    task = "regression"
    _own = {**ForestClassifier._own, "sampling_method": "classic"}


__all__ = ["ForestClassifier", "ForestRegressor", "TreeClassifier", "TreeRegressor", "jobs"]
