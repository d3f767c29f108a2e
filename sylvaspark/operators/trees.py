"""Conditional-inference trees and forests, grown level by level for all trees at once.

Each level is a few grouped aggregates over a long table keyed by (tree_id, node): stage A picks a feature by
association, stage B a threshold by weighted child impurity.  With resamples, both are permutation tests: stage A of all
features of a node, stage B of all thresholds of the chosen feature, each under Bonferroni, with budgets that grow as the
levels shrink.  With early stopping, tests are taken in order of promise (the strongest feature, the least impure
threshold first) and end at the first that is accepted; features that fail are muted for the node's descendants.

Rows are never copied: a level only writes each row's next node, to a stage of its own.  Rows go left iff x <= threshold;
a missing x goes right.  The model (node table, class shares, muted features) is on the driver; rows never are.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import asdict, dataclass, field
from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import association
from ..functions.distributions import budget
from ..functions.impurity import value_impurity
from ..sources.stages import release, small, stage
from . import permutation, resampling
from .splits import best_split, bits, entropy_sweep, gini_sweep, mae_sweep, mse_sweep, thresholds

SWEEPS = {"gini": gini_sweep, "entropy": entropy_sweep, "mse": mse_sweep, "mae": mae_sweep}
SELECTORS = {"classification": ("mc", "mi", "rdc"), "regression": ("pc", "dc", "rdc")}
_SLACK = 1e-12
#: Thresholds of a node, at most, that are tested from wide rows: they are part of a task.
PACKED_THRESHOLDS = 256


def feature_count(p: int, most: str | int | float | None) -> int:
    """How many of p features a node looks at."""
    if most is None:
        return p
    if most in ("sqrt", "log2"):
        return max(1, math.ceil(math.sqrt(p) if most == "sqrt" else math.log2(p)))
    return min(p, most) if isinstance(most, int) else max(1, math.ceil(most * p))


@dataclass
class Node:
    tree_id: int
    node: int
    depth: int
    n: int
    value: list[float]
    impurity: float
    feature: str | None = None
    threshold: float | None = None
    p_feature: float | None = None
    p_threshold: float | None = None
    decrease: float = 0.0
    parent: int | None = None
    left: int | None = None
    right: int | None = None


@dataclass
class TreeParams:
    """``n_resamples`` is for both stages where their own is not given: a number (times the tests of a node, where levels are
    corrected), ``minimum``, ``auto`` or ``maximum`` for the corrected level, or None for no tests."""

    task: str = "classification"
    trees: int = 1
    max_depth: int = 3
    min_split: int = 2
    min_leaf: int = 1
    min_decrease: float = 0.0
    selector: str | tuple[str, ...] | None = None
    alpha_feature: float = 0.05
    alpha_threshold: float = 0.05
    n_resamples: int | str | None = None
    n_resamples_feature: int | str | None = None
    n_resamples_threshold: int | str | None = None
    adjust_feature: bool = True
    adjust_threshold: bool = True
    early_stopping: str | None = None
    confidence: float = 0.95
    muting: bool = True
    feature_scanning: bool = True
    threshold_scanning: bool = True
    max_features: str | int | float | None = None
    threshold_method: str = "exact"
    max_thresholds: int | None = 32
    honesty: bool = False
    honesty_fraction: float = 0.5
    seed: int = 0
    criterion: str | None = None

    def __post_init__(self):
        if self.task not in ("classification", "regression"):
            raise ValueError("task is classification or regression")
        allowed = ("gini", "entropy") if self.task == "classification" else ("mse", "mae")
        self.criterion = self.criterion or allowed[0]
        if self.criterion not in allowed:
            raise ValueError(f"criterion of {self.task} is one of {', '.join(allowed)}")
        names = SELECTORS[self.task]
        self.selector = names[0] if self.selector is None else self.selector
        chosen = (self.selector,) if isinstance(self.selector, str) else tuple(self.selector)
        if not chosen or len(set(chosen)) < len(chosen) or not set(chosen) <= set(names):
            raise ValueError(f"selectors of {self.task} are different ones of {', '.join(names)}")
        if len(chosen) > 1 and "mi" in chosen:
            raise ValueError("mi cannot be one of several selectors: its scale differs")
        self.selector = chosen[0] if len(chosen) == 1 else chosen
        if not (0 < self.alpha_feature <= 1 and 0 < self.alpha_threshold <= 1):
            raise ValueError("alpha is in (0, 1]")
        if not 0.5 < self.confidence < 1 or not 0 < self.honesty_fraction < 1:
            raise ValueError("confidence is in (0.5, 1) and honesty_fraction in (0, 1)")
        for alpha, n in ((self.alpha_feature, self.feature_budget), (self.alpha_threshold, self.threshold_budget)):
            if isinstance(n, str) and n not in ("minimum", "auto", "maximum"):
                raise ValueError("resamples are a number, minimum, auto or maximum")
            if isinstance(n, int) and n < math.ceil(1 / alpha):
                raise ValueError("n_resamples must be at least ceil(1 / alpha)")
        if self.early_stopping not in (None, "adaptive", "simple"):
            raise ValueError("early_stopping is adaptive, simple or None")
        if self.min_split < 2 or self.min_leaf < 1 or self.max_depth < 0 or self.min_decrease < 0:
            raise ValueError("min_split >= 2, min_leaf >= 1, max_depth >= 0, min_decrease >= 0")
        for n in (self.max_features, self.max_thresholds):
            if isinstance(n, bool) or (isinstance(n, float) and not 0 < n <= 1) or (isinstance(n, int) and n < 1):
                raise ValueError("shares are in (0, 1], numbers at least 1")
        for message in self.ineffective():
            warnings.warn(message, stacklevel=3)

    @property
    def feature_budget(self) -> int | str | None:
        return self.n_resamples if self.n_resamples_feature is None else self.n_resamples_feature

    @property
    def threshold_budget(self) -> int | str | None:
        return self.n_resamples if self.n_resamples_threshold is None else self.n_resamples_threshold

    def ineffective(self) -> list[str]:
        """Parameters that have no effect beside the others."""
        default, out = {f.name: f.default for f in self.__dataclass_fields__.values()}, []
        changed = lambda name: getattr(self, name) != default[name]
        if self.feature_budget is None and self.threshold_budget is None:
            out += [f"{x} has no effect without resamples" for x in ("early_stopping", "adjust_feature", "adjust_threshold", "alpha_feature", "alpha_threshold") if changed(x)]
        elif self.early_stopping is None:
            out += [f"{x} has no effect without early stopping" for x in ("confidence", "feature_scanning", "threshold_scanning") if changed(x)]
        if not self.honesty and changed("honesty_fraction"):
            out.append("honesty_fraction has no effect without honesty")
        if self.threshold_method == "exact" and changed("max_thresholds") and self.max_thresholds is not None:
            out.append("max_thresholds has no effect with exact thresholds")
        return out


@dataclass
class TreeModel:
    params: TreeParams
    features: list[str]
    classes: list
    nodes: dict[tuple[int, int], Node] = field(default_factory=dict)

    def order(self, tree: int) -> list[int]:
        """A tree's nodes, each before its children, left before right."""
        out, stack = [], [1]
        while stack:
            node = self.nodes[tree, stack.pop()]
            out.append(node.node)
            if node.feature is not None:
                stack += [node.right, node.left]
        return out

    def node_ids(self) -> dict[tuple[int, int], int]:
        """Preorder numbers from 0 of each tree's nodes."""
        return {(t, n): i for t in range(self.params.trees) for i, n in enumerate(self.order(t))}

    def n_nodes_ptr(self) -> list[int]:
        """Where each tree's nodes begin when the trees' paths are put side by side, and the number of all."""
        out = [0]
        for t in range(self.params.trees):
            out.append(out[-1] + len(self.order(t)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The node table, one row a node."""
        ids = self.node_ids()
        rows = [(n.tree_id, n.node, n.parent, ids[n.tree_id, n.node], n.depth, n.feature, n.threshold, n.p_feature, n.p_threshold, n.impurity, n.decrease, n.n, [float(v) for v in n.value], n.left, n.right) for n in self.nodes.values()]
        return spark.createDataFrame(rows, "tree_id int, node long, parent long, node_id int, depth int, feature string, threshold double, p_feature double, p_threshold double, impurity double, decrease double, n long, value array<double>, left long, right long")

    def save(self, spark: SparkSession, path: str) -> None:
        """The node table and the parameters as two Parquet tables."""
        self.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        state = json.dumps({"params": asdict(self.params), "features": self.features, "classes": self.classes})
        spark.createDataFrame([(state,)], "state string").write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            params = TreeParams(**state["params"])
        model = cls(params, state["features"], state["classes"])
        for r in spark.read.parquet(f"{path}/nodes").collect():
            model.nodes[r["tree_id"], r["node"]] = Node(r["tree_id"], r["node"], r["depth"], r["n"], list(r["value"]), r["impurity"], r["feature"], r["threshold"], r["p_feature"], r["p_threshold"], r["decrease"], r["parent"], r["left"], r["right"])
        return model

    def importances(self) -> dict[str, float]:
        total = {f: 0.0 for f in self.features}
        for t in range(self.params.trees):
            own = {f: 0.0 for f in self.features}
            for (tree, _), n in self.nodes.items():
                if tree == t and n.feature:
                    own[n.feature] += n.decrease
            s = sum(own.values())
            for f, v in own.items():
                total[f] += v / s if s else 0.0
        s = sum(total.values())
        return {f: v / s if s else 0.0 for f, v in total.items()}

    def _route(self, tree: int, leaf, node: int = 1) -> Column:
        n = self.nodes[tree, node]
        if n.feature is None:
            return leaf(n)
        left = F.coalesce(F.col(n.feature).cast("double"), F.lit(float("nan"))) <= n.threshold
        return F.when(left, self._route(tree, leaf, n.left)).otherwise(self._route(tree, leaf, n.right))

    def leaf(self, tree: int = 0) -> Column:
        """The leaf's node number as an expression."""
        return self._route(tree, lambda n: F.lit(n.node).cast("long"))

    def apply(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row_id, tree_id, leaf): the leaf of each row in each tree."""
        leaves = F.array(*(self.leaf(t) for t in range(self.params.trees)))
        return df.select(F.col(row_id).alias("row_id"), F.posexplode(leaves).alias("tree_id", "leaf"))

    def proba(self) -> Column:
        """Mean leaf value over the trees."""
        values = [self._route(t, lambda n: F.array(*(F.lit(float(v)) for v in n.value))) for t in range(self.params.trees)]
        out = values[0]
        for v in values[1:]:
            out = F.zip_with(out, v, lambda a, b: a + b)
        return F.transform(out, lambda v: v / len(values))

    def predict(self) -> Column:
        if self.params.task == "regression":
            return self.proba()[0]
        names = F.array(*(F.lit(c) for c in self.classes))
        p = self.proba()
        return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))

    def _path(self, tree: int, node: int) -> list[int]:
        out = []
        at: int | None = node
        while at is not None:
            out.append(at)
            at = self.nodes[tree, at].parent
        return out[::-1]

    def decision_path(self, df: DataFrame, row_id: str, tree: int | None = 0) -> DataFrame:
        """(row_id, node): the nodes that each row visits, from the root to its leaf; for all trees (row_id, tree_id, node) with ``tree`` None."""
        trees = range(self.params.trees) if tree is None else [tree]
        paths = F.array(*(self._route(t, lambda n: F.array(*(F.lit(v).cast("long") for v in self._path(n.tree_id, n.node)))) for t in trees))
        rows = df.select(F.col(row_id).alias("row_id"), F.posexplode(paths).alias("tree_id", "path"))
        rows = rows.select("row_id", "tree_id", F.explode("path").alias("node"))
        return rows if tree is None else rows.drop("tree_id")


def _validate(df: DataFrame, features: list[str], target: str, task: str) -> list:
    """The classes in order, none for numeric targets."""
    clf = task == "classification"
    values = F.array(*(F.col(c).cast("double") for c in [*features, *([] if clf else [target])]))
    odd = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # one expression over an array: a condition for each column takes longer to plan than to run
    found = df.groupBy(*([target] if clf else [])).agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).collect()  # a leaf holds a share of each class
    if not sum(r["n"] for r in found):
        raise ValueError("no rows")
    if sum(r["odd"] for r in found):
        raise ValueError("features and numeric targets must be finite")
    return sorted(r[0] for r in found) if clf else []


def validate_columns(df: DataFrame, model: TreeModel) -> None:
    """Rows to predict must have all features of the fit."""
    missing = [f for f in model.features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")


def honest_parts(rows: DataFrame, params: TreeParams) -> DataFrame:
    """``rows`` (tree_id, row_id, ...) with ``estimates``: the share ``honesty_fraction`` of each tree's rows, first by hash, that gives leaves their values."""
    digest = F.md5(F.concat_ws("|", F.lit(f"{params.seed}|h"), "tree_id", "row_id"))
    blocks = permutation.blocks_for(rows)
    placed = permutation.number(rows.withColumn("_d", digest), ["tree_id"], ["_d", "row_id"], permutation.digest_block(F.col("_d"), blocks), blocks, "_i")
    sizes = rows.groupBy("tree_id").agg(F.ceil(F.count("*") * F.lit(params.honesty_fraction)).alias("_m"))
    return placed.join(sizes, "tree_id").withColumn("estimates", F.col("_i") <= F.col("_m")).drop("_d", "_i", "_m")


def grow(df: DataFrame, row_id: str, features: list[str], target: str, params: TreeParams, sample: DataFrame | None = None) -> TreeModel:
    """Fit ``params.trees`` trees; ``sample`` (tree_id, draw, row_id) gives each tree's rows, else all rows."""
    classes = _validate(df, features, target, params.task)
    spark = df.sparkSession
    clf = params.task == "classification"
    base = df.select(F.col(row_id).alias("_id"), F.col(target).alias("y"), *(F.col(f).cast("double").alias(f) for f in features))
    if sample is None:
        rows = base.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(params.trees - 1)))).withColumn("row_id", F.col("_id").cast("string"))
    else:
        rows = sample.withColumnRenamed("row_id", "_id").join(base, "_id").withColumn("row_id", F.concat_ws(":", *(c for c in ("stratum", "draw") if c in sample.columns)))
    rows = rows.select("tree_id", "row_id", "y", *features)
    if params.honesty:
        parted = stage(honest_parts(rows, params), "honest")
        rows, estimates = parted.where("NOT estimates").drop("estimates"), parted.where("estimates").drop("estimates")
    model = TreeModel(params, list(features), classes)
    by = ["tree_id", "node"]
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    if clf and params.selector == "mc" and params.feature_budget is not None:
        # tests by products read rows as they are, which need a block and the number of their class
        drawn = rows if sample is None or params.honesty else stage(rows, "drawn")
        packed = resampling.blocked(drawn, by, classes)
        assigned = stage(drawn if packed is None else packed.select(*by, "row_id", "y", "code", "block", F.array(*features).alias("xs")), "level")
        release(*([] if drawn is rows else [drawn]))
    else:
        assigned = stage(rows, "level")
    written = assigned
    muted: dict[tuple[int, int], frozenset] = {}
    following = {t: 2 for t in range(params.trees)}
    fresh = [(t, 1, None) for t in range(params.trees)]
    for depth in range(params.max_depth + 1):
        _leaves(model, assigned, by, depth, classes, clf, {(t, n): p for t, n, p in fresh})
        if depth == params.max_depth:
            break
        open_nodes = [(n.tree_id, n.node) for n in model.nodes.values() if n.depth == depth and n.n >= params.min_split and n.impurity > _SLACK]
        if not open_nodes:
            break
        chosen, failed = _choose(spark, model, assigned, by, open_nodes, features, params, clf, muted)
        if not chosen:
            break
        fresh, plan = [], []
        for (t, n), (feature, threshold) in sorted(chosen.items()):
            node = model.nodes[t, n]
            node.left, node.right = following[t], following[t] + 1
            following[t] += 2
            plan.append((t, n, feature, threshold, node.left, node.right))
            for child in (node.left, node.right):
                fresh.append((t, child, n))
                muted[t, child] = muted.get((t, n), frozenset()) | failed.get((t, n), frozenset())
        plan = small(spark, [(*r[:2], features.index(r[2]) + 1, *r[2:]) for r in plan], "tree_id int, node long, _at int, feature string, threshold double, _l long, _r long")
        routed = assigned.join(F.broadcast(plan), by)
        routed = routed.withColumn("node", F.when(_value(assigned, features) <= F.col("threshold"), F.col("_l")).otherwise(F.col("_r"))).drop("_at", "feature", "threshold", "_l", "_r")
        if depth + 1 == params.max_depth:
            assigned = routed.select(*by, "y")  # read once, for the last leaves
        else:
            assigned = stage(routed, "level")
            release(written)
            written = assigned
    release(written)
    if params.honesty:
        reestimate(model, estimates, "y", None)
        release(parted)
    return model


def _value(rows: DataFrame, features: list[str]) -> Column:
    """The value of the feature that a row names, by its name or, where rows hold an array, by its place ``_at``."""
    if "xs" in rows.columns:
        return F.element_at("xs", F.col("_at"))
    return F.element_at(F.create_map(*(v for f in features for v in (F.lit(f), F.col(f)))), F.col("feature"))


def _leaves(model: TreeModel, rows: DataFrame, by: list[str], depth: int, classes: list, clf: bool, parents: dict) -> None:
    """Nodes of a level, from one row per node and class: they are the model, which is on the driver."""
    if clf:
        counts: dict[tuple[int, int], dict] = {}
        for r in rows.groupBy(*by, "y").count().collect():
            counts.setdefault((r["tree_id"], r["node"]), {})[r["y"]] = r["count"]
        for (t, node), c in counts.items():
            n = sum(c.values())
            p = [v / n for v in c.values()]
            impurity = 1 - sum(v * v for v in p) if model.params.criterion == "gini" else -sum(v * math.log2(v) for v in p)
            model.nodes[t, node] = Node(t, node, depth, n, [c.get(k, 0) / n for k in classes], impurity, parent=parents[t, node])
    else:
        stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
        if model.params.criterion == "mae":
            stats = stats.drop("v").join(value_impurity(rows, by, "y").select(*by, F.col("mae").alias("v")), by)
        for r in stats.collect():
            at = r["tree_id"], r["node"]
            model.nodes[at] = Node(*at, depth, r["n"], [r["m"]], r["v"], parent=parents[at])


def _scores(long: DataFrame, selector: str | tuple, task: str, by: list[str]) -> DataFrame:
    """(*by, feature, s): the strength of each feature, the largest of several selectors."""
    parts = []
    for name in (selector,) if isinstance(selector, str) else selector:
        if name == "mc":
            s = association.correlation_ratio(long, by).select(*by, "feature", F.col("eta").alias("s"))
        elif name == "pc":
            s = association.pearson(long, True, by).select(*by, "feature", F.abs("pearson").alias("s"))
        elif name == "mi":
            s = association.mutual_information(long, by=by).select(*by, "feature", F.col("mi").alias("s"))
        elif name == "dc":
            s = association.distance_correlation(long, by).select(*by, "feature", F.col("dcor").alias("s"))
        else:
            s = association.rdc(long, by=by, task=task).select(*by, "feature", F.col("rdc").alias("s"))
        parts.append(s)
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy(*by, "feature").agg(F.max("s").alias("s"))


def _resamples(kind: int | str, alpha: float, tests: int, adjust: bool) -> tuple[int, float]:
    """Permutations of one test, and its level, where a node takes ``tests`` of them."""
    tests = max(1, tests) if adjust else 1
    return (kind * tests if isinstance(kind, int) else budget(alpha / tests, kind)), alpha / tests


def _choose(spark, model, rows, by, open_nodes, features, params, clf, muted) -> tuple[dict, dict]:
    """Stage A and stage B of all open nodes of a level: (tree, node) to (feature, threshold), and to the features that failed."""
    if "block" in rows.columns:
        return _choose_packed(spark, model, rows, by, open_nodes, features, params, muted)
    todo = spark.createDataFrame(open_nodes, "tree_id int, node long")
    rows = rows.join(F.broadcast(todo), by)  # by key, all rows of a node would meet in one task
    gone = [(t, n, f) for t, n in open_nodes for f in muted.get((t, n), ())]
    gone = spark.createDataFrame(gone, "tree_id int, node long, feature string") if gone else None
    long = rows.unpivot(["tree_id", "node", "row_id", "y"], features, "feature", "x")
    long = long if gone is None else long.join(gone, [*by, "feature"], "left_anti")
    varied = long.groupBy(*by, "feature").agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a < z").select(*by, "feature")
    left = varied.groupBy(*by).agg(F.count("*").alias("_p"))
    order = F.md5(F.concat_ws("|", F.lit(f"{params.seed}|f"), "tree_id", "node", "feature"))
    pool = varied.join(left, by).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    # at most p different sizes, so the number of features to look at is a case of the number left
    most = F.element_at(F.array(*(F.lit(feature_count(p, params.max_features)) for p in range(1, len(features) + 1))), F.col("_p").cast("int"))
    pool = pool.where(F.col("_r") <= most).select(*by, "feature")
    long = stage(long.join(pool, [*by, "feature"]), "pool")
    tie = F.md5(F.concat_ws("|", F.lit(f"{params.seed}|t"), "tree_id", "node", "feature"))
    failed: dict[tuple[int, int], frozenset] = {}
    scores = _scores(long, params.selector, params.task, by)
    if params.feature_budget is not None:
        tests = stage(_feature_tests(spark, long, params, clf, by, scores), "tests")
        scan = [F.desc(F.round("s", 12)), tie] if params.feature_scanning else [tie]
        order = scan if params.early_stopping else ["p_value", *scan]
        taken = permutation.first_accepted(tests, by, order, F.col("level"), params.early_stopping is not None)
        best_rows = taken.where("reject").select(*by, "feature", "p_value").collect()
        if params.muting:
            for r in taken.where("tested AND p_value >= level").select(*by, "feature").collect():  # the model's own state
                failed.setdefault((r["tree_id"], r["node"]), set()).add(r["feature"])
        failed = {k: frozenset(v) for k, v in failed.items()}
        release(tests)
    else:
        w = Window.partitionBy(*by).orderBy(F.desc(F.round("s", 12)), tie)
        best_rows = scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "feature", F.lit(None).cast("double").alias("p_value")).collect()
    if not best_rows:
        release(long)
        return {}, failed
    best = spark.createDataFrame([tuple(r) for r in best_rows], "tree_id int, node long, feature string, p_value double")
    one = stage(long.join(F.broadcast(best.select(*by, "feature")), [*by, "feature"]), "feature")
    release(long)
    return _split(spark, model, one, by, params, {(r["tree_id"], r["node"]): (r["feature"], r["p_value"]) for r in best_rows}), failed


def _split(spark, model, one, by, params, p_feature) -> dict:
    """Stage B of the nodes' chosen features ``p_feature``, whose values are ``one`` (*by, row_id, y, feature, x): (tree, node) to (feature, threshold)."""
    if params.threshold_method == "exact":
        sweep = SWEEPS[params.criterion](one, by)
    else:
        # thresholds between two values split rows as the midpoint of these values does
        at = thresholds(one, params.threshold_method, params.max_thresholds or 256, params.seed, by)
        sweep = mae_sweep(one, by, at) if params.criterion == "mae" else _sweep_at(one, at, by, params.criterion)
    if params.threshold_budget is None:
        split = best_split(sweep, by, params.min_leaf).select(*by, "feature", "threshold", "impurity", F.lit(None).cast("double").alias("p_value")).collect()
    else:
        split = _threshold_tests(spark, model, one, sweep, params, by)
    release(one)
    chosen = {}
    for r in split:
        at = r["tree_id"], r["node"]
        node = model.nodes[at]
        if node.impurity - r["impurity"] < params.min_decrease - _SLACK:
            continue
        node.feature, node.threshold, node.p_feature = r["feature"], r["threshold"], p_feature[at][1]
        node.p_threshold, node.decrease = r["p_value"], max(0.0, node.impurity - r["impurity"])
        chosen[at] = (r["feature"], r["threshold"])
    return chosen


def _feature_tests(spark, long, params, clf, by, scores) -> DataFrame:
    """(*by, feature, p_value, level, s): tests of the nodes' features, with the budget and level of a node of as many features."""
    names = {"mc": "mc", "pc": "pc", "mi": "mi", "dc": "dc", "rdc": "rdc_class" if clf else "rdc"}
    kinds = (params.selector,) if isinstance(params.selector, str) else params.selector
    kind = names[kinds[0]] if len(kinds) == 1 else tuple(names[k] for k in kinds)
    sizes: dict[int, list] = {}
    for r in long.select(*by, "feature").distinct().groupBy(*by).count().collect():
        sizes.setdefault(r["count"], []).append((r["tree_id"], r["node"]))
    tests = []
    for k, nodes in sorted(sizes.items()) or [(1, [])]:
        some = long.join(spark.createDataFrame(nodes, "tree_id int, node long"), by)
        n, level = _resamples(params.feature_budget, params.alpha_feature, k, params.adjust_feature)
        if params.early_stopping:
            t = permutation.sequential_test(some, n, params.seed, kind, level, params.confidence, 32, params.early_stopping, by)
        elif isinstance(kind, tuple):
            t = permutation.max_t_test(some, n, params.seed, kind, by)
        else:
            t = permutation.permutation_test(some, n, params.seed, kind, by)
        tests.append(t.select(*by, "feature", "p_value", F.lit(level).alias("level")))
    return reduce(DataFrame.unionByName, tests).join(scores, [*by, "feature"])


def _digest(*parts) -> str:
    return md5("|".join(map(str, parts)).encode()).hexdigest()


def _choose_packed(spark, model, rows, by, open_nodes, features, params, muted) -> tuple[dict, dict]:
    """:func:`_choose` from wide rows and all nodes at once; what is known of a node's features is part of the model, and on the driver."""
    cells = rows.select(*by, F.posexplode("xs").alias("_at", "x")).groupBy(*by, "_at").agg(F.min("x").alias("a"), F.max("x").alias("z"))
    tests: dict[tuple, list] = {at: [] for at in open_nodes}
    for r in cells.where("a < z").select(*by, "_at").collect():
        if (r["tree_id"], r["node"]) in tests:
            tests[r["tree_id"], r["node"]].append(features[r["_at"]])
    plans, budgets = {}, {}
    for at, varied in list(tests.items()):
        left = [f for f in varied if f not in muted.get(at, ())]
        some = sorted(left, key=lambda f: _digest(params.seed, "f", *at, f))[: feature_count(len(left), params.max_features)] if left else []
        if not some:
            del tests[at]
            continue
        tests[at] = [(f, None) for f in sorted(some)]
        n, level = _resamples(params.feature_budget, params.alpha_feature, len(some), params.adjust_feature)
        plans.setdefault((n, level), []).append(at)
        budgets[at] = max(n, math.ceil(1 / level)) if params.early_stopping else n
    if not tests:
        return {}, {}
    most = max(model.nodes[at].n for at in tests)
    found = resampling.in_blocks(rows, by, features, tests, budgets, most, len(model.classes), params.seed, "mc")
    best, failed = {}, {}
    for at, of in _pvalues(spark, found, "feature", plans, params, by, 32, "high").items():
        scan = lambda r: ((-r[1],) if params.feature_scanning else ()) + (_digest(params.seed, "t", *at, r[0]),)  # noqa: E731, B023
        accepted, out = _first_accepted(of, scan, params.early_stopping is not None)
        if accepted:
            best[at] = (accepted[0], accepted[2])
        if params.muting and out:
            failed[at] = frozenset(r[0] for r in out)
    if not best:
        return {}, failed
    chosen = small(spark, [(*at, features.index(f) + 1, f) for at, (f, _) in best.items()], "tree_id int, node long, _at int, feature string")
    one = rows.join(F.broadcast(chosen), by).select(*by, "row_id", "y", "code", "block", "feature", _value(rows, features).alias("x"))
    return _split(spark, model, stage(one, "feature"), by, params, best), failed


def _pvalues(spark, found, key, plans, params, by, every, tail) -> dict[tuple, list[tuple]]:
    """(tree, node) to its tests (key, statistic to 12 digits, p-value, level) of statistics (*by, key, b, t); ``plans`` has the nodes of each budget and level."""
    keys, out = [*by, key], {}
    if params.early_stopping is None:
        # a test's statistics meet in one array, so they are read once and never written
        seen = found.groupBy(*keys).agg(F.max(F.when(F.col("b") == 0, F.col("t"))).alias("s"), F.collect_list(F.when(F.col("b") > 0, F.col("t"))).alias("_t"))
        beyond = (lambda t: t >= F.col("s") - permutation.SLACK) if tail == "high" else (lambda t: t <= F.col("s") + permutation.SLACK)
        of = {at: plan for plan, nodes in plans.items() for at in nodes}
        for r in seen.select(*keys, F.round("s", 12).alias("s"), F.size(F.filter("_t", beyond)).alias("hits")).collect():
            n, level = of[r["tree_id"], r["node"]]
            out.setdefault((r["tree_id"], r["node"]), []).append((r[key], r["s"], (r["hits"] + 1) / (n + 1.0), level))
        return out
    found, parts = stage(found, "statistics"), []
    for (n, level), nodes in sorted(plans.items()):
        some = found.join(F.broadcast(spark.createDataFrame(nodes, "tree_id int, node long")), by)
        t = permutation.stopped(some, max(n, math.ceil(1 / level)), keys, params.early_stopping, level, params.confidence, every, tail)
        parts.append(t.select(*keys, F.round("statistic", 12).alias("s"), "p_value", F.lit(level).alias("level")))
    for r in reduce(DataFrame.unionByName, parts).collect():
        out.setdefault((r["tree_id"], r["node"]), []).append((r[key], r["s"], r["p_value"], r["level"]))
    release(found)
    return out


def _first_accepted(tests: list[tuple], order, stop: bool) -> tuple[tuple | None, list[tuple]]:
    """What :func:`permutation.first_accepted` rejects of a node's tests (key, statistic, p-value, level), and the tests taken that fail."""
    tests = sorted(tests, key=order if stop else lambda r: (r[2], *order(r)))
    first = next((i for i, r in enumerate(tests) if r[2] < r[3]), None)
    taken = tests[: first + 1] if stop and first is not None else tests
    return None if first is None else tests[first], [r for r in taken if r[2] >= r[3]]


def _threshold_tests(spark, model, one, sweep, params, by) -> list[dict]:
    """tree_id, node, feature, threshold, impurity and p_value of the accepted thresholds: all of a node's are tested under its level."""
    sweep = stage(sweep.where((F.col("n_left") >= params.min_leaf) & (F.col("n_right") >= params.min_leaf)).select(*by, "feature", "threshold", "impurity"), "sweep")
    sizes: dict[int, list] = {}
    for r in sweep.groupBy(*by).count().collect():
        sizes.setdefault(r["count"], []).append((r["tree_id"], r["node"]))
    fit = [k for k in sizes if "block" in one.columns and 0 < k <= PACKED_THRESHOLDS]
    out, parts = _packed_threshold_tests(spark, model, one, sweep, {k: sizes.pop(k) for k in fit}, params, by) if fit else [], []
    for k, nodes in sorted(sizes.items()) or ([] if fit else [(1, [])]):
        some = spark.createDataFrame(nodes, "tree_id int, node long")
        n, level = _resamples(params.threshold_budget, params.alpha_threshold, k, params.adjust_threshold)
        at = sweep.join(some, by).select(*by, "feature", "threshold")
        t = permutation.threshold_test(one.join(F.broadcast(some), by), at, n, params.seed + 1, params.criterion, by, params.early_stopping, level, params.confidence)
        parts.append(t.select(*by, "feature", "threshold", "p_value", F.lit(level).alias("level")))
    if parts:
        tests = reduce(DataFrame.unionByName, parts).join(sweep, [*by, "feature", "threshold"])
        least = [F.round("impurity", 12), "threshold"]
        random = [F.md5(F.concat_ws("|", F.lit(f"{params.seed}|s"), *by, F.col("threshold").cast("string")))]
        order = (least if params.threshold_scanning else random) if params.early_stopping else ["p_value", *least]
        taken = permutation.first_accepted(tests, by, order, F.col("level"), params.early_stopping is not None)
        out += [r.asDict() for r in taken.where("reject").select(*by, "feature", "threshold", "impurity", "p_value").collect()]
    release(sweep)
    return out


def _packed_threshold_tests(spark, model, one, sweep, sizes, params, by) -> list[dict]:
    """:func:`_threshold_tests` of the nodes ``sizes``, by their numbers of thresholds, from rows in blocks and all nodes at once."""
    plans, of = {}, {}
    for k, nodes in sizes.items():
        plans.setdefault(_resamples(params.threshold_budget, params.alpha_threshold, k, params.adjust_threshold), []).extend(nodes)
    nodes = small(spark, [at for v in plans.values() for at in v], "tree_id int, node long")
    random = F.md5(F.concat_ws("|", F.lit(f"{params.seed}|s"), *by, F.col("threshold").cast("string")))
    for r in sweep.join(F.broadcast(nodes), by).withColumns({"_least": F.round("impurity", 12), "_random": random}).collect():
        of.setdefault((r["tree_id"], r["node"]), {})[r["threshold"]] = r.asDict()
    budgets = {at: max(n, math.ceil(1 / level)) if params.early_stopping else n for (n, level), v in plans.items() for at in v}
    tests = {at: [("x", t) for t in sorted(v)] for at, v in of.items()}
    rows = one.join(F.broadcast(nodes), by).withColumn("xs", F.array("x"))
    found = resampling.in_blocks(rows, by, ["x"], tests, budgets, max(model.nodes[at].n for at in tests), len(model.classes), params.seed + 1, params.criterion)
    out = []
    for at, v in _pvalues(spark, found, "threshold", plans, params, by, 1, "low").items():
        scan = lambda r: (of[at][r[0]]["_random"],) if params.early_stopping and not params.threshold_scanning else (of[at][r[0]]["_least"], r[0])  # noqa: E731, B023
        accepted, _ = _first_accepted(v, scan, params.early_stopping is not None)
        if accepted:
            out.append(of[at][accepted[0]] | {"p_value": accepted[2]})
    return out


def _impurity_at(rows: DataFrame, keys: list[str], criterion: str) -> DataFrame:
    """(*keys, n_left, n_right, impurity) of rows that carry ``side`` (0 left, 1 right) and y."""
    if criterion in ("gini", "entropy"):
        each = F.col("c") * F.col("c") if criterion == "gini" else bits(F.col("c"))
        c = rows.groupBy(*keys, "side", "y").agg(F.count("*").alias("c")).groupBy(*keys, "side").agg(F.sum("c").alias("n"), F.sum(each).alias("q"))
        part = F.col("n") - F.col("q") / F.col("n") if criterion == "gini" else bits(F.col("n")) - F.col("q")
    elif criterion == "mae":
        c = value_impurity(rows, [*keys, "side"], "y")
        part = F.col("n") * F.col("mae")
    else:
        c = rows.groupBy(*keys, "side").agg(F.count("*").alias("n"), F.var_pop("y").alias("v"))
        part = F.col("n") * F.col("v")
    return c.groupBy(*keys).agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("n_left"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("n_right"), (F.sum(part) / F.sum("n")).alias("impurity"))


def _sweep_at(one: DataFrame, at: DataFrame, by: list[str], criterion: str) -> DataFrame:
    sided = one.join(F.broadcast(at), [*by, "feature"]).withColumn("side", (F.col("x") > F.col("threshold")).cast("int"))
    return _impurity_at(sided, [*by, "feature", "threshold"], criterion)


def reestimate(model: TreeModel, df: DataFrame, target: str, tree: int | None = 0) -> TreeModel:
    """Honest leaves: values and sizes from the rows of ``df``; a leaf without rows keeps its own.

    With ``tree`` None all trees take theirs, from the rows of ``df`` that have their ``tree_id`` where it has that column.
    """
    clf = model.params.task == "classification"
    trees = range(model.params.trees) if tree is None else [tree]
    leaves = F.array(*(F.struct(F.lit(t).alias("tree_id"), model.leaf(t).alias("leaf")) for t in trees))
    own = "tree_id" in df.columns and tree is None
    at = df.withColumn("_at", F.explode(leaves))
    if own:
        at = at.where(F.col("_at.tree_id") == F.col("tree_id"))
    at = at.select("_at.*", F.col(target).alias("y"))
    if clf:
        counts: dict[tuple[int, int], dict] = {}
        for r in at.groupBy("tree_id", "leaf", "y").count().collect():
            counts.setdefault((r["tree_id"], r["leaf"]), {})[r["y"]] = r["count"]
        for key, c in counts.items():
            n = sum(c.values())
            model.nodes[key].value, model.nodes[key].n = [c.get(k, 0) / n for k in model.classes], n
    else:
        for r in at.groupBy("tree_id", "leaf").agg(F.avg("y").alias("m"), F.count("*").alias("n")).collect():
            model.nodes[r["tree_id"], r["leaf"]].value, model.nodes[r["tree_id"], r["leaf"]].n = [r["m"]], r["n"]
    return model


def out_of_bag(model: TreeModel, df: DataFrame, row_id: str, target: str, oob: DataFrame) -> DataFrame:
    """(row_id, y, value): mean value over the trees that did not draw the row (``oob``: tree_id, row_id)."""
    t = model.params.trees
    values = F.array(*(model._route(i, lambda n: F.array(*(F.lit(float(v)) for v in n.value))) for i in range(t)))
    scored = df.select(F.col(row_id).alias("row_id"), F.col(target).alias("y"), values.alias("v"))
    one = oob.join(scored, "row_id").select("row_id", "y", F.posexplode(F.col("v")[F.col("tree_id")]))
    mean = one.groupBy("row_id", "y", "pos").agg(F.avg("col").alias("p"))
    return mean.groupBy("row_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("value"))


def oob_score(model: TreeModel, df: DataFrame, row_id: str, target: str, oob: DataFrame) -> DataFrame:
    """(n, score): accuracy, or r2, of the out-of-bag values over the ``n`` rows that have one; rows without one give a warning."""
    found = out_of_bag(model, df, row_id, target, oob)
    if model.params.task == "classification":
        names = F.array(*(F.lit(c) for c in model.classes))
        guess = F.element_at(names, F.array_position("value", F.array_max("value")).cast("int"))
        score = found.agg(F.count("*").alias("n"), F.avg((guess == F.col("y")).cast("double")).alias("score"))
    else:
        e = F.col("y") - F.col("value")[0]
        score = found.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.var_pop("y").alias("v")).select("n", (1 - F.try_divide("mse", "v")).alias("score"))
    if score.first()["n"] < df.count():
        warnings.warn("some rows have no out-of-bag value: more trees are needed", stacklevel=2)
    return score
