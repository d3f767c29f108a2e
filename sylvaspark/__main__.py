"""python -m sylvaspark COMMAND: run, smoke, check, list, generate."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import experiments as X
from .plans import wrappers
from .sources import files, generators


def _session() -> SparkSession:
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rank(spark: SparkSession, data: str):
    """The run of the ranking stage: a row for each fold."""

    def run(e: X.Experiment, store: X.Store):
        prefix = "clf" if e.task == "classification" else "reg"
        df = spark.read.parquet(f"{data}/{e.task}/synthetic/{prefix}_{e.dataset}.parquet")
        features = generators.order_of(df.columns)
        params = json.loads(e.params)
        names = {"tree": "tree", "forest": "forest"}
        options = {} if e.method in names else params
        found = wrappers.rank_over_folds(df, "row_id", features, "y", lambda train, seed: wrappers.select(e.method, train, "row_id", features, "y", e.task, seed, **options), seed=e.seed, task=e.task)
        rows = [(fold, [int(f[1:]) for f in order], e.dataset, e.task, e.seed, e.key[0], e.method) for fold, order in found]
        return spark.createDataFrame(rows, "fold_idx int, feature_ranking array<int>, dataset string, task string, seed int, method_id string, method string")

    return run


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sylvaspark")
    p.add_argument("command", choices=("run", "smoke", "check", "list", "generate"))
    p.add_argument("--task", default="classification", choices=("classification", "regression"))
    p.add_argument("--data", required=True, help="folder of datasets")
    p.add_argument("--store", help="folder of artifacts")
    p.add_argument("--methods")
    p.add_argument("--datasets")
    p.add_argument("--seeds")
    p.add_argument("--most", type=int, help="configurations of a method at most")
    a = p.parse_args(arguments)
    spark = _session()
    prefix = "clf_" if a.task == "classification" else "reg_"
    if a.command == "generate":
        for s in generators.CLASSIFICATION if a.task == "classification" else generators.REGRESSION:
            if not a.datasets or s.name in a.datasets.split(","):
                print(generators.write(spark, s, a.data))
        return 0
    folder = f"{a.data}/{a.task}/synthetic"
    known = files.datasets(spark, folder, prefix)
    if a.command == "list":
        print("\n".join([*(f"dataset {d}" for d in known), *(f"method {m} {len(X.configurations(m))}" for m in X.GRIDS)]))
        return 0
    grid = X.Grid.of(a.task, a.methods, known, a.datasets, a.seeds, most=1 if a.command == "smoke" else a.most)
    store = X.Store(spark, a.store or f"{a.data}/artifacts")
    done = store.completed("rankings", a.task)
    if a.command == "check":
        print(json.dumps({**grid.summary(), "pending": len(grid.pending(done))}))
        return 0
    pending = grid.pending(done)[: 1 if a.command == "smoke" else None]
    results = X.run_all("rankings", pending, store, rank(spark, a.data), lambda r: print(r.status, *r.experiment.key, f"{r.seconds:.1f} s", r.error or ""))
    return int(any(r.status == "failed" for r in results))


if __name__ == "__main__":
    raise SystemExit(main())
