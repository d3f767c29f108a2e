"""Experiments as tables: grids, a store of artifacts, queues of pending work, runners, calibration and ablations."""

from __future__ import annotations

import hashlib
import json
import time
import traceback
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import board, permutation
from ..operators.trees import TreeParams, grow
from ..sources import files

KEY = ["method", "dataset", "seed"]

#: The methods' parameter grids; a method without one has a single empty configuration.
GRIDS: dict[str, dict[str, list]] = {
    "tree": {"selector": ["mc", "rdc"], "n_resamples": ["auto"], "early_stopping": ["adaptive"], "threshold_method": ["exact", "histogram"], "max_thresholds": [None, 128, 256]},
    "forest": {"selector": ["mc", "rdc"], "n_resamples": ["auto"], "early_stopping": ["adaptive"], "trees": [100], "max_features": ["sqrt"]},
    "ptest_mc": {"n": [1000]}, "ptest_pc": {"n": [1000]}, "ptest_rdc": {"n": [1000]},
    "pi": {"repeats": [10]}, "cpi": {"repeats": [10]}, "boruta": {"rounds": [200]}, "rfe": {}, "mrmr": {}, "rf": {"trees": [100]}, "et": {"trees": [100]}, "gbt": {"trees": [100]},
}
#: Numbers of thresholds that go with each threshold method.
THRESHOLDS = {"exact": [None], "random": [128, 256], "percentile": [128, 256], "histogram": [128, 256]}


def configurations(method: str, fits: Callable[[dict], bool] | None = None) -> list[dict]:
    """Every combination of a method's grid that fits."""
    axes = GRIDS.get(method, {})
    fits = fits or (lambda c: "threshold_method" not in c or c.get("max_thresholds") in THRESHOLDS[c["threshold_method"]])
    return [c for c in (dict(zip(axes, values)) for values in product(*axes.values())) if fits(c)]


@dataclass(frozen=True)
class Experiment:
    method: str
    dataset: str
    seed: int
    task: str
    params: str = "{}"

    @property
    def key(self) -> tuple[str, str, int]:
        return files.config_id(self.method, json.loads(self.params)), self.dataset, self.seed


@dataclass
class Grid:
    """Methods (name and parameters), datasets and seeds of a task, less what is excluded: (method, dataset) or a whole key."""

    task: str
    methods: list[tuple[str, dict]]
    datasets: list[str]
    seeds: list[int]
    excluded: frozenset = frozenset()

    def __iter__(self) -> Iterator[Experiment]:
        for (name, params), dataset, seed in product(self.methods, self.datasets, self.seeds):
            e = Experiment(name, dataset, seed, self.task, json.dumps(params, sort_keys=True))
            if (name, dataset) not in self.excluded and e.key not in self.excluded:
                yield e

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def table(self, spark: SparkSession) -> DataFrame:
        """(method, dataset, seed, task, config_id, params): the grid as a cross join of its axes with an anti join of what is excluded."""
        rows = [(n, files.config_id(n, p), json.dumps(p, sort_keys=True)) for n, p in self.methods]
        methods = spark.createDataFrame(rows, "method string, config_id string, params string")
        axes = board.grid({"dataset": self.datasets, "seed": self.seeds}, spark)
        out = methods.join(axes).withColumn("task", F.lit(self.task))
        pairs = [x for x in self.excluded if len(x) == 2]
        keys = [x for x in self.excluded if len(x) == 3]
        if pairs:
            out = out.join(spark.createDataFrame(pairs, "method string, dataset string"), ["method", "dataset"], "left_anti")
        if keys:
            out = out.join(spark.createDataFrame(keys, "config_id string, dataset string, seed int"), ["config_id", "dataset", "seed"], "left_anti")
        return out

    def pending(self, completed: Iterable[tuple[str, str, int]]) -> list[Experiment]:
        done = set(completed)
        return [e for e in self if e.key not in done]

    def summary(self) -> dict[str, int]:
        return {"methods": len(self.methods), "datasets": len(self.datasets), "seeds": len(self.seeds), "total": len(self)}

    @classmethod
    def of(cls, task: str, methods: str | None, datasets: list[str], only: str | None = None, seeds: str | None = None, n_seeds: int = 5, most: int | None = None) -> Grid:
        """A grid from comma-separated filters; unknown names and seeds out of range raise."""
        names = [m.strip() for m in methods.split(",") if m.strip()] if methods else list(GRIDS)
        if unknown := sorted(set(names) - set(GRIDS)):
            raise ValueError(f"unknown methods {unknown}; there are {sorted(GRIDS)}")
        chosen = [d.strip() for d in only.split(",") if d.strip()] if only else datasets
        if unknown := sorted(set(chosen) - set(datasets)):
            raise ValueError(f"unknown datasets {unknown}")
        numbers = [int(s) for s in seeds.split(",") if s.strip()] if seeds else list(range(n_seeds))
        if bad := [s for s in numbers if not 0 <= s < n_seeds]:
            raise ValueError(f"seeds out of range (0..{n_seeds - 1}): {bad}")
        return cls(task, [(m, c) for m in names for c in configurations(m)[:most]], [d for d in datasets if d in chosen], numbers)


class Store:
    """Artifacts of experiments as Parquet folders: stage/task/dataset/config_seedN.parquet, written whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str, force: bool = False):
        self.spark, self.folder, self.force = spark, folder, force

    def path(self, stage: str, e: Experiment) -> str:
        config, dataset, seed = e.key
        return f"{self.folder}/{stage}/{e.task}/{dataset}/{config}_seed{seed}.parquet"

    def exists(self, stage: str, e: Experiment) -> bool:
        return not self.force and files.exists(self.spark, self.path(stage, e))

    def save(self, stage: str, e: Experiment, df: DataFrame) -> None:
        at = self.path(stage, e)
        rows = df.count()
        files.save(df, at, mode="overwrite" if self.force else "errorifexists")
        files.validated(self.spark, at, rows)

    def load(self, stage: str, e: Experiment) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, e))

    def completed(self, stage: str, task: str) -> set[tuple[str, str, int]]:
        """(config_id, dataset, seed) of the artifacts of a stage."""
        at = f"{self.folder}/{stage}/{task}"
        if not files.exists(self.spark, at):
            return set()
        named = files.listed(self.spark, at).select(F.regexp_extract("path", r"/([^/]+)/([^/]+)_seed(\d+)\.parquet/", 1).alias("d"), F.regexp_extract("path", r"/([^/]+)/([^/]+)_seed(\d+)\.parquet/", 2).alias("c"), F.regexp_extract("path", r"/([^/]+)/([^/]+)_seed(\d+)\.parquet/", 3).alias("s"))
        return {(r["c"], r["d"], int(r["s"])) for r in named.where("c <> ''").distinct().collect()}


@dataclass
class Queue:
    """Pending rankings and metrics of all tasks in hash order: nine of ten go to rankings while there are any, tasks in turn."""

    grids: list[Grid]
    store: Store
    covers: Callable[[Store, Experiment], bool] = lambda store, e: True
    seed: int = 0
    given: int = 0
    waiting: dict = field(default_factory=dict)

    def refresh(self) -> None:
        """Look at the store: rankings that are not there, and metrics that are missing or do not cover what is asked."""
        order = lambda e: hashlib.md5(f"{self.seed}|{e.key}".encode()).hexdigest()
        for grid in self.grids:
            ranked, measured = (self.store.completed(s, grid.task) for s in ("rankings", "metrics"))
            self.waiting["rankings", grid.task] = sorted((e for e in grid if e.key not in ranked), key=order)
            self.waiting["metrics", grid.task] = sorted((e for e in grid if e.key in ranked and (e.key not in measured or not self.covers(self.store, e))), key=order)

    def next(self) -> tuple[str, Experiment] | None:
        self.given += 1
        first = "metrics" if self.given % 10 == 0 else "rankings"
        tasks = [g.task for g in self.grids]
        turn = tasks[self.given % len(tasks) :] + tasks[: self.given % len(tasks)]
        for stage in (first, "rankings" if first == "metrics" else "metrics"):
            for task in turn:
                if self.waiting.get((stage, task)):
                    return stage, self.waiting[stage, task].pop(0)
        return None

    def status(self) -> dict[str, int]:
        return {f"{stage}/{task}": len(v) for (stage, task), v in self.waiting.items()}


@dataclass
class Result:
    experiment: Experiment
    stage: str
    status: str  # done, failed, skipped, no_rankings
    seconds: float = 0.0
    error: str | None = None
    trace: str | None = None


def run_one(stage: str, e: Experiment, store: Store, run: Callable[[Experiment, Store], DataFrame]) -> Result:
    """One experiment: skipped if it is there, no_rankings if metrics lack their rankings, failed with its error if it raises."""
    if store.exists(stage, e):
        return Result(e, stage, "skipped")
    if stage == "metrics" and not files.exists(store.spark, store.path("rankings", e)):
        return Result(e, stage, "no_rankings")
    began = time.time()
    try:
        store.save(stage, e, run(e, store))
        return Result(e, stage, "done", time.time() - began)
    except Exception as error:  # noqa: BLE001 - a result of its own
        return Result(e, stage, "failed", time.time() - began, str(error), traceback.format_exc())


def run_all(stage: str, experiments: Iterable[Experiment], store: Store, run: Callable[[Experiment, Store], DataFrame], on_complete: Callable[[Result], None] | None = None) -> list[Result]:
    """One after the other; each is a Spark job of its own."""
    out = []
    for e in experiments:
        out.append(run_one(stage, e, store, run))
        if on_complete:
            on_complete(out[-1])
    return out


def work(queue: Queue, runs: dict[str, Callable[[Experiment, Store], DataFrame]], most: int | None = None) -> list[Result]:
    """Take from the queue until it is empty, or ``most`` times; the queue is looked at anew when it runs dry."""
    out: list[Result] = []
    queue.refresh()
    while most is None or len(out) < most:
        taken = queue.next()
        if taken is None:
            queue.refresh()
            taken = queue.next()
            if taken is None or any(r.experiment == taken[1] and r.stage == taken[0] for r in out):
                break
        out.append(run_one(*taken, queue.store, runs[taken[0]]))
    return out


# --- calibration ---------------------------------------------------------------------------


def null_p_values(spark: SparkSession, simulations: int, n: int, kind: str = "mc", resamples: int = 99, seed: int = 0, rule: str | None = None) -> DataFrame:
    """(feature, p_value): permutation tests of features that have nothing to do with the target, all simulations in one job."""
    from ..sources.generators import normal, uniform

    rows = spark.range(simulations * n).withColumnRenamed("id", "row_id")
    y = (uniform(seed, "y") < 0.5).cast("int") if kind in ("mc", "mi", "rdc_class") else normal(seed, "y")
    long = rows.select("row_id", F.floor(F.col("row_id") / n).alias("sim"), F.lit("x").alias("feature"), normal(seed, "x").alias("x"), y.alias("y"))
    if rule:
        t = permutation.sequential_test(long, resamples, seed, kind, rule=rule, by=["sim"])
    else:
        t = permutation.permutation_test(long, resamples, seed, kind, by=["sim"])
    return t.select(F.concat(F.lit("sim"), "sim").alias("feature"), "p_value")


def calibration(p_values: DataFrame, levels: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5)) -> DataFrame:
    """(level, rejected): the share of p-values at or below each level."""
    each = F.explode(F.array(*(F.lit(v) for v in levels))).alias("level")
    return p_values.select("p_value", each).groupBy("level").agg(F.avg((F.col("p_value") <= F.col("level")).cast("double")).alias("rejected"))


def root_split_rate(spark: SparkSession, simulations: int, n: int, p: int, alpha: float = 0.05, resamples: int = 40, seed: int = 0) -> float:
    """The share of trees grown on noise that split at all: all simulations are the trees of one model."""
    from ..sources.generators import normal, uniform

    rows = spark.range(simulations * n).withColumnRenamed("id", "row_id")
    features = [f"x{i}" for i in range(p)]
    df = rows.withColumns({f: normal(seed, f) for f in features} | {"y": (uniform(seed, "y") < 0.5).cast("int")})
    sample = df.select(F.floor(F.col("row_id") / n).cast("int").alias("tree_id"), F.lit(0).alias("stratum"), F.col("row_id").alias("draw"), "row_id")
    params = TreeParams(trees=simulations, max_depth=1, alpha_feature=alpha, n_resamples_feature=max(resamples, int(1 / alpha) + 1), seed=seed)
    m = grow(df, "row_id", features, "y", params, sample)
    return sum(m.nodes[t, 1].feature is not None for t in range(simulations)) / simulations


def stopping_study(spark: SparkSession, simulations: int, most: int = 200, alpha: float = 0.05, gamma: float = 0.95, batches: tuple[int, ...] = (1, 8, 32), seed: int = 0) -> DataFrame:
    """(every, rejected, accepted, went_on, mean_stop): adaptive stopping looked at after every so many permutations, on the same simulated streams.

    A stream's exceedances have a chance of their own, drawn uniformly, as under the null hypothesis.
    """
    from ..sources.generators import uniform

    rows = spark.range(simulations).withColumnRenamed("id", "row_id").withColumn("chance", uniform(seed, "chance"))
    steps = rows.select(F.col("row_id").alias("sim"), "chance", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("b")).withColumn("row_id", F.col("sim") * most + F.col("b"))
    stream = steps.select("sim", "b", F.when(uniform(seed, "step") < F.col("chance"), 1.0).otherwise(0.0).alias("t"))
    start = rows.select(F.col("row_id").alias("sim"), F.lit(0).alias("b"), F.lit(1.0).alias("t"))
    out = None
    for every in batches:
        ends = permutation.stopped(stream.unionByName(start), most, ["sim"], "adaptive", alpha, gamma, every)
        rejected = F.col("p_value") < alpha
        one = ends.agg(F.avg((rejected & (F.col("m") < most)).cast("double")).alias("rejected"), F.avg((~rejected & (F.col("m") < most)).cast("double")).alias("accepted"), F.avg((F.col("m") == most).cast("double")).alias("went_on"), F.avg("m").alias("mean_stop"))
        one = one.select(F.lit(every).alias("every"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# --- ablations -----------------------------------------------------------------------------

#: Variants of the tree: what each changes.
KNOBS: dict[str, dict] = {
    "default": {}, "no_muting": {"muting": False}, "no_scanning": {"feature_scanning": False, "threshold_scanning": False}, "fixed_budget": {"early_stopping": None},
    "no_correction": {"adjust_feature": False, "adjust_threshold": False}, "histogram": {"threshold_method": "histogram", "max_thresholds": 16}, "percentile": {"threshold_method": "percentile", "max_thresholds": 16},
    "random": {"threshold_method": "random", "max_thresholds": 16}, "all_features": {"max_features": None}, "no_tests": {"n_resamples": None, "early_stopping": None},
}


def ablate(datasets: dict[str, tuple[DataFrame, str, list[str], str, list[str] | None]], variants: dict[str, dict], base: dict, seeds: Iterable[int] = (0,)) -> list[dict]:
    """A row for each dataset, variant and seed: seconds, depth, features used, and hits among the first true features.

    ``datasets`` are (rows, row_id, features, target, true features or None).  Rows feed the ratio, delta and win/loss operators of
    the leaderboard.
    """
    out = []
    for (dataset, (df, row_id, features, target, truth)), (variant, changes), seed in product(datasets.items(), variants.items(), seeds):
        began = time.time()
        m = grow(df, row_id, features, target, TreeParams(**(base | changes | {"seed": seed})))
        seconds = time.time() - began
        weight = m.importances()
        ranking = sorted(features, key=lambda f: (-weight[f], features.index(f)))
        row = {"dataset": dataset, "variant": variant, "seed": seed, "elapsed_seconds": seconds, "mean_depth": float(max(n.depth for n in m.nodes.values())), "features_used": float(sum(v > 0 for v in weight.values()))}
        if truth:
            row["precision"] = len(set(ranking[: len(truth)]) & set(truth)) / len(truth)
        out.append(row)
    return out
