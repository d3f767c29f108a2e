"""Synthetic datasets with known informative features, made in Spark from hashed normal numbers.

Every number is a function of (seed, name, row), so a dataset is the same however it is partitioned and can be of any
size.  :func:`write` puts the ground truth beside the rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    name: str
    n_samples: int = 1000
    n_features: int = 100
    n_informative: int = 10
    task: str = "classification"
    seed: int = 0
    class_sep: float = 1.0
    flip_y: float = 0.0
    noise: float = 1.0
    toeplitz_rho: float = 0.0
    n_redundant: int = 0
    n_correlated_noise: int = 0
    correlated_noise_strength: float = 0.9
    n_high_cardinality_noise: int = 0
    high_cardinality_levels: int = 500
    nonlinear: bool = False
    friedman_variant: int | None = None
    heteroscedastic: bool = False
    heteroscedastic_scale: float = 1.0
    weak_signal: bool = False


@dataclass
class Truth:
    informative: list[str]
    redundant: list[str]
    noise: list[str]
    correlated_noise: list[str]


#: The benchmark's datasets: names, sizes and strengths are fixed values.
CLASSIFICATION = (
    Settings("toeplitz", toeplitz_rho=0.95), Settings("corr_noise", n_correlated_noise=20), Settings("nonlinear", n_informative=5, nonlinear=True), Settings("weak", class_sep=0.1, flip_y=0.1, weak_signal=True),
    Settings("bias", n_features=50, n_high_cardinality_noise=50), Settings("redundant", n_features=50, n_redundant=20), Settings("easy", class_sep=2.0), Settings("hard", n_samples=200, n_features=1000, n_informative=5, class_sep=0.5),
)
REGRESSION = tuple(
    replace(s, task="regression") for s in (
        Settings("toeplitz", toeplitz_rho=0.95), Settings("corr_noise", n_correlated_noise=20), Settings("friedman1", n_informative=5, friedman_variant=1), Settings("weak", noise=50.0, weak_signal=True),
        Settings("heteroscedastic", n_features=50, heteroscedastic=True, heteroscedastic_scale=4.0, noise=5.0), Settings("redundant", n_features=50, n_redundant=20), Settings("easy"), Settings("hard", n_samples=200, n_features=500, n_informative=5, noise=10.0),
    )
)


def uniform(seed: int, name: str) -> Column:
    """A number in (0, 1) for each row's ``row_id``."""
    h = F.xxhash64(F.lit(f"{seed}|{name}"), F.col("row_id"))
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(2**53))


def normal(seed: int, name: str) -> Column:
    """A standard normal number for each row, from two uniform ones."""
    return F.sqrt(-2.0 * F.log(uniform(seed, name + "|r"))) * F.cos(2 * math.pi * uniform(seed, name + "|a"))


def _coefficient(seed: int, name: str) -> float:
    """A standard normal constant."""
    import random

    return random.Random(f"{seed}|{name}").gauss(0, 1)


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def make(spark: SparkSession, s: Settings) -> tuple[DataFrame, Truth]:
    """(row_id, x0 ..., y) and which features are what; columns are shuffled by hash."""
    seed, k = s.seed, 5 if s.nonlinear or s.friedman_variant else s.n_informative
    rows = spark.range(s.n_samples).withColumnRenamed("id", "row_id")
    base = s.n_features - s.n_redundant
    names = [f"b{i}" for i in range(base)]
    if s.toeplitz_rho:
        # an autoregression has the covariance rho ** |i - j|
        rows = rows.withColumn("b0", normal(seed, "b0"))
        for i in range(1, base):
            rows = rows.withColumn(f"b{i}", F.col(f"b{i - 1}") * s.toeplitz_rho + normal(seed, f"b{i}") * math.sqrt(1 - s.toeplitz_rho**2))
    elif s.nonlinear or s.friedman_variant:
        rows = rows.withColumns({n: uniform(seed, n) for n in names})
    else:
        rows = rows.withColumns({n: normal(seed, n) for n in names})
    b = [F.col(n) for n in names]
    if s.nonlinear or s.friedman_variant:
        signal = 10 * F.sin(math.pi * b[0] * b[1]) + 20 * (b[2] - 0.5) * (b[2] - 0.5) + 10 * b[3] + 5 * b[4]
        spread = F.lit(1.0 if s.nonlinear else s.noise)
    else:
        signal = _sum([b[i] * _coefficient(seed, f"beta{i}") for i in range(k)])
        spread = F.lit(s.noise)
        if s.heteroscedastic:
            spread = (1 + s.heteroscedastic_scale * F.abs(b[0])) * s.noise
    plain = s.task == "classification" and not (s.toeplitz_rho or s.n_redundant or s.nonlinear)
    if plain:
        # two classes a distance apart along the informative features, and a share of labels dealt at random
        side = (uniform(seed, "class") < 0.5).cast("int")
        rows = rows.withColumn("_side", side).withColumns({names[i]: b[i] + (2 * F.col("_side") - 1) * s.class_sep / math.sqrt(k) * 2 for i in range(k)})
        y = F.when(uniform(seed, "flip") < s.flip_y, (uniform(seed, "flipped") < 0.5).cast("int")).otherwise(F.col("_side"))
        rows = rows.withColumn("y", y.cast("long")).drop("_side")
    else:
        noisy = signal if s.n_redundant and s.task == "classification" else signal + normal(seed, "noise") * spread
        rows = rows.withColumn("_s", noisy)
        if s.task == "classification":
            middle = rows.agg(F.median("_s")).first()[0]
            rows = rows.withColumn("y", (F.col("_s") >= F.lit(middle)).cast("long")).drop("_s")
        else:
            rows = rows.withColumnRenamed("_s", "y")
    redundant = [f"r{j}" for j in range(s.n_redundant)]
    if redundant:
        rows = rows.withColumns({r: _sum([F.col(names[i]) * _coefficient(seed, f"{r}|{i}") for i in range(k)]) + normal(seed, r) * 0.1 for r in redundant})
    import random

    order = [*names, *redundant]
    random.Random(f"{seed}|columns").shuffle(order)
    called = {n: f"x{i}" for i, n in enumerate(order)}
    noise = [f"x{len(order) + j}" for j in range(s.n_high_cardinality_noise)]
    near = [f"x{len(order) + len(noise) + j}" for j in range(s.n_correlated_noise)]
    informative = [called[n] for n in names[:k]]
    out = rows.select("row_id", *(F.col(n).alias(called[n]) for n in order), "y")
    out = out.withColumns({n: F.floor(uniform(seed + 1, n) * s.high_cardinality_levels).cast("double") for n in noise}) if noise else out
    r = s.correlated_noise_strength
    out = out.withColumns({n: F.col(informative[j % k]) * r + normal(seed + 3, n) * math.sqrt(1 - r * r) for j, n in enumerate(near)}) if near else out
    truth = Truth(sorted(informative, key=lambda f: int(f[1:])), sorted((called[n] for n in redundant), key=lambda f: int(f[1:])), noise, near)
    return out.select("row_id", *order_of(out.columns), "y"), truth


def order_of(columns: list[str]) -> list[str]:
    return sorted((c for c in columns if c.startswith("x")), key=lambda c: int(c[1:]))


def write(spark: SparkSession, s: Settings, folder: str) -> str:
    """A dataset and its ground truth as Parquet; the path of the rows."""
    df, truth = make(spark, s)
    prefix = "clf" if s.task == "classification" else "reg"
    at = f"{folder}/{s.task}/synthetic/{prefix}_{s.name}.parquet"
    df.write.mode("overwrite").parquet(at)
    facts = {"synthetic": True, "task": s.task, "settings": json.dumps(asdict(s)), **{k: json.dumps(v) for k, v in asdict(truth).items()}}
    spark.createDataFrame([(s.name, json.dumps(facts))], "name string, facts string").write.mode("overwrite").parquet(f"{folder}/{s.task}/truth/{prefix}_{s.name}.parquet")
    return at
