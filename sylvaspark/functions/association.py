"""Association statistics over a long table (row_id, feature, x, y): one pre-aggregated pass for all features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import numbering
from ..operators.numbering import ROWS, blocks_for, number, running, value_block
from ..sources.stages import stage


def long_table(df: DataFrame, row_id: str, features: list[str], target: str, keep: list[str] | None = None) -> DataFrame:
    """(row_id, *keep, feature, x, y): one row per row and feature, x double."""
    keep = keep or []
    wide = df.select(F.col(row_id).alias("row_id"), *keep, F.col(target).alias("y"), *(F.col(f).cast("double").alias(f) for f in features))
    return wide.unpivot(["row_id", "y", *keep], features, "feature", "x")


def encode_labels(df: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """Labels to 0..K-1 in sorted order; the mapping is a small distinct table joined back."""
    codes = df.select(F.col(label).alias("_l")).distinct().withColumn(out, F.dense_rank().over(Window.orderBy("_l")) - 1)
    return df.join(codes, F.col(label) == F.col("_l")).drop("_l")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(0.0)


def correlation_ratio(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """eta = sqrt(SSB / SST) per feature; 0 where SST is not positive."""
    by = by or []
    cells = long.groupBy(*by, "feature", "y").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    t = cells.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    centre = F.col("s") * F.col("s") / F.col("n")
    sst, ssb = F.col("q") - centre, F.col("b") - centre
    # a constant column leaves only rounding in SST
    eta = F.when(sst > F.col("q") * 1e-12, F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ssb / sst)))).otherwise(0.0)
    return t.select(*by, "feature", F.col("n"), eta.alias("eta"))


def pearson(long: DataFrame, standardize: bool = True, by: list[str] | None = None) -> DataFrame:
    """Signed correlation, or population covariance, of x with numeric y per feature; 0 where undefined."""
    by = by or []
    y = F.col("y").cast("double")
    t = long.groupBy(*by, "feature").agg(F.covar_pop("x", y).alias("c"), F.var_pop("x").alias("vx"), F.var_pop(y).alias("vy"))
    value = _ratio(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))) if standardize else F.coalesce("c", F.lit(0.0))
    return t.select(*by, "feature", value.alias("pearson" if standardize else "covariance"))


def _products(x: np.ndarray, y: np.ndarray, block: int = 1024) -> float:
    """The sum over all pairs of |x - x'| |y - y'|; blocks bound the memory."""
    total = 0.0
    for i in range(0, len(x), block):
        total += float((np.abs(x[i : i + block, None] - x) * np.abs(y[i : i + block, None] - y)).sum())
    return total


def _pairs(x: np.ndarray, y: np.ndarray, width: int = 64) -> float:
    """As :func:`_products`, in n log n steps: pairs inside ``width`` places of x directly, others where they part in a binary tree, as in :func:`_cross`."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    x, y = x[order] - x.mean(), y[order] - y.mean()
    rank, place, total = np.empty(n, np.int64), np.arange(n), 0.0
    rank[np.argsort(y, kind="stable")] = place
    for s in range(0, n, width * 256):
        whole = (min(n, s + width * 256) - s) // width * width
        a, b = (v[s : s + whole].reshape(-1, width) for v in (x, y))
        total += float((np.abs(a[:, :, None] - a[:, None]) * np.abs(b[:, :, None] - b[:, None])).sum())
        total += _products(x[s + whole : s + width * 256], y[s + whole : s + width * 256]) if whole < width * 256 else 0.0
    while width < n:
        at = np.argsort(place // (2 * width) * n + rank)
        left, xs, ys = (at // width % 2 == 0).astype(float), x[at], y[at]
        first = place // (2 * width) * (2 * width)
        cum = [np.concatenate([[0.0], np.cumsum(left * v)]) for v in (1.0, xs, ys, xs * ys)]
        (c, sx, sy, sxy), (tc, tx, ty, txy) = ([k[e] - k[first] for k in cum] for e in (place + 1, np.minimum(first + 2 * width, n)))
        far = xs * ys * c - xs * sy - ys * sx + sxy + xs * (ty - sy) - xs * ys * (tc - c) - (txy - sxy) + ys * (tx - sx)
        total += 2 * float(far[left == 0].sum())
        width *= 2
    return total


def _row_distances(v: np.ndarray) -> np.ndarray:
    """The sum of each value's distances from all values."""
    order = np.argsort(v, kind="stable")
    s, out, n = v[order], np.empty(len(v)), len(v)
    out[order] = s * (2 * np.arange(1, n + 1) - n) + s.sum() - 2 * np.cumsum(s)
    return out


def _distance_value(x: np.ndarray, y: np.ndarray, standardize: bool) -> float:
    n, a, b = float(len(x)), _row_distances(x - x.mean()), _row_distances(y - y.mean())
    square = lambda products, p, q: products - 2 * (p @ q) / n**3 + p.sum() * q.sum() / n**4
    xy = max(0.0, square(_pairs(x, y) / n**2, a, b))
    if not standardize:
        return float(np.sqrt(xy))
    bottom = np.sqrt(max(0.0, square(2 * x.var(), a, a)) * max(0.0, square(2 * y.var(), b, b)))
    return float(np.sqrt(xy / bottom)) if bottom > 1e-15 else 0.0


#: Rows of a feature that meet in one task, in the pairwise sums of distance correlation and in random waves.
KERNEL_ROWS = 8192


def _distances(rows: DataFrame, keys: list[str], c: str, blocks: int) -> DataFrame:
    """``rows`` (*keys, row_id, ...) with ``r_c``, the place of c in its group, and ``d_c``, the sum of its distances from all values of the group."""
    at = value_block(rows, c, blocks)
    t = number(rows, keys, [c, "row_id"], at, blocks, f"r_{c}")
    t = running(t, keys, [c, "row_id"], {"_p": F.col(c)}, at, blocks)
    group = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(c).alias("_s"))
    far = F.col(c) * (2 * F.col(f"r_{c}") - F.col("_n")) + F.col("_s") - 2 * F.col("_p")
    return t.join(group, keys).withColumn(f"d_{c}", far).drop("_p", "_n", "_s")


def _cross(t: DataFrame, keys: list[str], kernel_rows: int, blocks: int) -> DataFrame:
    """(*keys, xy): the sum over all ordered pairs of a group of |x - x'| |y - y'|.

    Pairs inside a stretch of ``kernel_rows`` places of x meet in one task.  Others part at one level of a binary tree
    of stretches, where the left ones' running sums in order of y give each right row its share.
    """

    def inside(key, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "xy": [_products(g["x"].to_numpy(float), g["y"].to_numpy(float))]})

    place = F.col("r_x") - 1
    kinds = dict(t.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "xy double"])
    parts = t.withColumn("_stretch", F.floor(place / kernel_rows)).groupBy(*keys, "_stretch").applyInPandas(inside, schema)
    most = t.agg(F.max("r_x").alias("m")).first()["m"] or 0
    width = kernel_rows
    while width < most:
        side = t.withColumn("_pair", F.floor(place / (2 * width))).withColumn("_left", (F.floor(place / width) % 2 == 0).cast("double"))
        sums = {"_c": F.col("_left"), "_x": F.col("_left") * F.col("x"), "_y": F.col("_left") * F.col("y"), "_xy": F.col("_left") * F.col("x") * F.col("y")}
        run = running(side, [*keys, "_pair"], ["r_y"], sums, value_block(side, "r_y", blocks), blocks)
        total = side.groupBy(*keys, "_pair").agg(*(F.sum(v).alias(f"t{k}") for k, v in sums.items()))
        x, y = F.col("x"), F.col("y")
        below = x * y * F.col("_c") - x * F.col("_y") - y * F.col("_x") + F.col("_xy")
        above = x * (F.col("t_y") - F.col("_y")) - x * y * (F.col("t_c") - F.col("_c")) - (F.col("t_xy") - F.col("_xy")) + y * (F.col("t_x") - F.col("_x"))
        parts = parts.unionByName(run.where("_left = 0").join(total, [*keys, "_pair"]).select(*keys, (2 * (below + above)).alias("xy")))
        width *= 2
    return parts.groupBy(*keys).agg(F.sum("xy").alias("xy"))


def distance_correlation(long: DataFrame, by: list[str] | None = None, standardize: bool = True, kernel_rows: int = KERNEL_ROWS, most: int | None = None) -> DataFrame:
    """Distance correlation, or covariance, of x and numeric y per feature; ``most`` is the rows of the largest group, where known.

    A feature of no more rows than a block of :mod:`numbering` is one task's.  Of larger ones row means come from running sums
    along the sorted values and the mean product from :func:`_cross`; no task holds them.
    """
    keys = [*(by or []), "feature"]
    rows = long.select(*keys, "row_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if most is None and kernel_rows == KERNEL_ROWS:
        most = rows.groupBy(*keys).count().agg(F.max("count").alias("m")).first()["m"] or 0
    if most is not None and most <= numbering.ROWS:
        name, kinds = "dcor" if standardize else "dcov", dict(rows.dtypes)

        def whole(key, g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, name: [_distance_value(g["x"].to_numpy(float), g["y"].to_numpy(float), standardize)]})

        return rows.groupBy(*keys).applyInPandas(whole, "".join(f"`{k}` {kinds[k]}, " for k in keys) + f"{name} double")
    blocks = blocks_for(rows)
    # each step reads its rows several times: written, or plans would grow as a power of the steps
    written = (lambda t: stage(t, "distances")) if blocks > 1 else (lambda t: t)
    t = written(_distances(written(_distances(written(rows), keys, "x", blocks)), keys, "y", blocks))
    cross = _cross(t, keys, kernel_rows, blocks)
    a, b = F.col("d_x"), F.col("d_y")
    m = t.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"), F.sum(a).alias("_a"), F.sum(b).alias("_b"), F.sum(a * b).alias("_ab"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"))
    n = F.col("_n")

    def square(products: Column, p: str, q: str, pq: str) -> Column:
        return products - 2 * F.col(pq) / (n * n * n) + F.col(p) * F.col(q) / (n * n * n * n)

    xy = square(F.col("xy") / (n * n), "_a", "_b", "_ab")
    if not standardize:
        return m.join(cross, keys).select(*keys, F.sqrt(F.greatest(F.lit(0.0), xy)).alias("dcov"))
    xx, yy = square(2 * F.col("_vx"), "_a", "_a", "_aa"), square(2 * F.col("_vy"), "_b", "_b", "_bb")
    bottom = F.sqrt(F.greatest(F.lit(0.0), xx) * F.greatest(F.lit(0.0), yy))
    value = F.when(bottom > 1e-15, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(xy, bottom)))).otherwise(0.0)
    return m.join(cross, keys).select(*keys, value.alias("dcor"))


def digamma(x: Column) -> Column:
    """The digamma function of a number from 1 on: its asymptotic series eight steps up."""
    up = x + 8.0
    r = 1.0 / (up * up)
    steps = sum((1.0 / (x + float(i)) for i in range(8)), F.lit(0.0))
    return F.log(up) - 0.5 / up - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240))) - steps


def mutual_information(long: DataFrame, neighbours: int = 3, by: list[str] | None = None) -> DataFrame:
    """Mutual information of continuous x and a class, by nearest neighbours in x; 0 at least.

    A row's neighbours of its class are the rows a few places before and behind it; how many rows of any class are
    nearer than the last of them is the difference of two running counts.
    """
    keys = [*(by or []), "feature"]
    rows = long.select(*keys, "y", "row_id", F.col("x").cast("double").alias("x"))
    sizes = rows.groupBy(*keys, "y").agg(F.count("*").alias("nc")).where("nc > 1")
    rows = rows.join(sizes, [*keys, "y"])
    blocks = blocks_for(rows)
    placed = number(rows, [*keys, "y"], ["x", "row_id"], value_block(rows, "x", blocks), blocks, "r")
    placed = placed.withColumn("k", F.least(F.lit(neighbours).cast("long"), F.col("nc") - 1))
    steps = F.array(*(F.lit(s).cast("long") for s in range(-neighbours, neighbours + 1) if s))
    shifted = placed.select(*keys, "y", F.explode(steps).alias("s"), "r", F.col("x").alias("nx")).select(*keys, "y", (F.col("r") + F.col("s")).alias("r"), "nx")
    pairs = placed.join(shifted, [*keys, "y", "r"])
    near = pairs.groupBy(*keys, "y", "r").agg(F.first("x").alias("x"), F.first("k").alias("k"), F.first("nc").alias("nc"), F.sort_array(F.collect_list(F.abs(F.col("nx") - F.col("x")))).alias("d"))
    d = F.element_at("d", F.col("k").cast("int")) * (1 - 1e-10)  # nearer than the last neighbour
    near = near.select(*keys, "y", "r", "k", "nc", (F.col("x") - d).alias("low"), (F.col("x") + d).alias("high"))
    lows = near.select(*keys, "y", "r", F.col("low").alias("v"), F.lit(0).alias("kind"), F.lit(0).alias("one"))
    points = rows.select(*keys, "y", F.lit(None).cast("long").alias("r"), F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(1).alias("one"))
    highs = near.select(*keys, "y", "r", F.col("high").alias("v"), F.lit(2).alias("kind"), F.lit(0).alias("one"))
    line = lows.unionByName(points).unionByName(highs)
    counted = running(line, keys, ["v", "kind"], {"c": F.col("one")}, value_block(line, "v", blocks), blocks).where("kind <> 1")
    m = counted.groupBy(*keys, "y", "r").agg(F.sum(F.when(F.col("kind") == 2, F.col("c")).otherwise(-F.col("c"))).alias("m"))
    t = near.join(m, [*keys, "y", "r"]).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(digamma(F.col("k"))).alias("pk"), F.avg(digamma(F.col("nc"))).alias("pc"), F.avg(digamma(F.greatest(F.col("m"), F.lit(1)))).alias("pm"))
    value = F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("pk") - F.col("pc") - F.col("pm"))
    every = long.select(*keys).distinct()
    return every.join(t.select(*keys, value.alias("mi")), keys, "left").select(*keys, F.coalesce("mi", F.lit(0.0)).alias("mi"))


def _weights(k: int, s: float, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).normal(0.0, s, (k, 2))


def weights_from(seed: int, k: int = 10, s: float = 1 / 6):
    """The weights of the waves of each class, and from 1000 on of the classes' own places."""
    return lambda c: _weights(k, s, seed + c)


def ordinal(rows: DataFrame, keys: list[str], column: str, out: str, blocks: int) -> DataFrame:
    """``rows`` with the empirical distribution function of a column at each row: ordinal places over n, ties by row_id."""
    placed = number(rows, keys, [column, "row_id"], value_block(rows, column, blocks), blocks, "_r")
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return placed.join(n, keys).withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n")


def waves(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The random features of places v: cosines and sines of v w0 + w1."""
    at = np.outer(v, weights[:, 0]) + weights[:, 1]
    return np.concatenate([np.cos(at), np.sin(at)], axis=1)


def _wave_table(n: int, weights: np.ndarray, width: int = 512) -> np.ndarray:
    """The waves of the places 1/n, 2/n, ..., 1: those of every ``width``-th place, turned by the first few."""
    far, near = np.arange(0, n + 1, width) / n, np.arange(width) / n
    a, b = np.outer(far, weights[:, 0]) + weights[:, 1], np.outer(near, weights[:, 0])
    ca, sa, cb, sb = np.cos(a)[:, None], np.sin(a)[:, None], np.cos(b), np.sin(b)
    both = np.concatenate([ca * cb - sa * sb, sa * cb + ca * sb], axis=2)
    return both.reshape(-1, 2 * len(weights))[1 : n + 1]


def _class_dependence(features: list[tuple[np.ndarray, np.ndarray]], classes: int, weights) -> list[float]:
    """Dependences of features on a class, each of the rows' order by x and the classes of rows by identifier; tables of waves are shared."""
    best, shared = [0.0] * len(features), {len(codes) for _, codes in features}
    for n in shared:
        for c in range(classes) if classes > 2 else [0]:
            a, b = _wave_table(n, weights(c)), _wave_table(n, weights(c + 1000))
            (ma, qa), (mb, qb) = ((w.mean(0), np.einsum("ij,ij->j", w, w) / n) for w in (a, b))
            sa, sb = (np.where(n * (q - m * m) > 1e-10, np.sqrt(np.maximum(n * (q - m * m), 1e-300)), 1.0) for q, m in ((qa, ma), (qb, mb)))
            for i, (order, codes) in enumerate(features):
                ind = codes == (c if classes > 2 else classes - 1)
                if len(codes) != n or not 0 < ind.sum() < n:
                    continue
                v, products = np.empty(n, np.int64), np.zeros((a.shape[1], b.shape[1]))
                v[np.argsort(ind, kind="stable")] = np.arange(n)
                v = v[order]
                for r in range(0, n, KERNEL_ROWS):
                    products += a[r : r + KERNEL_ROWS].T @ b[v[r : r + KERNEL_ROWS]]
                best[i] = max(best[i], min(1.0, float(np.abs((products - n * np.outer(ma, mb)) / np.outer(sa, sb)).max())))
    return best


def whole_rdc(long: DataFrame, keys: list[str], weights) -> DataFrame | None:
    """Dependence on a class of features that each fit a task, or None where one does not, values are missing or classes are many."""
    rows = long.select(*keys, "row_id", F.col("x").cast("double").alias("x"), "y")
    kinds = dict(rows.dtypes)
    if kinds["row_id"] not in ("string", "bigint", "int", "smallint", "tinyint"):
        return None
    found = [r["y"] for r in rows.select("y").distinct().limit(257).collect()]
    if not found or len(found) > 256 or any(v is None or v != v for v in found):
        return None
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("m"))
    fit = sizes.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("groups")).first()
    if fit["n"] > numbering.ROWS or fit["m"]:
        return None
    codes = F.array(*(F.lit(v) for v in sorted(found))).cast(f"array<{kinds['y']}>")
    rows = rows.select(*keys, "row_id", "x", (F.array_position(codes, F.col("y")) - 1).cast("int").alias("code"))

    def whole(key, g: pd.DataFrame) -> pd.DataFrame:
        at, found_at, features = [], [], []
        for _, f in g.groupby(keys, sort=False, dropna=False):
            ids = f["row_id"].to_numpy()
            by_id = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64) if ids.dtype == object else np.argsort(ids, kind="stable")
            x, at = f["x"].to_numpy(float)[by_id], [*at, f[keys].iloc[:1]]
            if len(x) >= 3 and not np.isnan(x).all() and (np.isnan(x).any() or x.max() > x.min()):
                found_at.append(len(at) - 1)
                features.append((np.argsort(x, kind="stable"), f["code"].to_numpy()[by_id]))
        out, values = pd.concat(at), np.zeros(len(at))
        values[found_at] = _class_dependence(features, len(found), weights)
        return out.assign(rdc=values)

    # a task takes some features, of about as many rows as a block, as they share tables of waves
    buckets = max(4 * long.sparkSession.sparkContext.defaultParallelism, -(-2 * fit["groups"] * fit["n"] // numbering.ROWS))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets))).repartition(min(200, 3 * buckets), "_b")
    return dealt.groupBy("_b").applyInPandas(whole, "".join(f"`{c}` {kinds[c]}, " for c in keys) + "rdc double")


def rdc(long: DataFrame, k: int = 10, s: float = 1 / 6, seed: int = 42, by: list[str] | None = None, task: str = "regression") -> DataFrame:
    """Randomised dependence of x and y: the largest absolute correlation between random waves of their ordinal places.

    ``classification`` takes classes: two as their number, more as the largest over one class against the others.
    Products are summed over stretches of rows; what leaves a task is one vector of fixed length.
    """
    keys = [*(by or []), "feature"]
    if task == "classification":
        from ..operators import resampling

        found = resampling.statistics(long, 0, 0, "rdc_class", by or [], weights=weights_from(seed, k, s))
        if found is not None:
            return found.select(*keys, F.col("t").alias("rdc"))
    rows = long.select(*keys, "row_id", F.col("x").cast("double").alias("x"), "y")
    if task == "classification":
        classes = sorted(r[0] for r in rows.select("y").distinct().collect())
        if len(classes) > 2:
            each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.lit(c).alias("y")) for i, c in enumerate(classes))))
            rows = rows.withColumn("_e", each).withColumn("y", (F.col("y") == F.col("_e.y")).cast("double")).withColumn("_c", F.col("_e.c"))
        else:
            rows = rows.withColumn("y", (F.col("y") == F.lit(classes[-1] if classes else 0)).cast("double")).withColumn("_c", F.lit(0))
    else:
        rows = rows.withColumn("y", F.col("y").cast("double")).withColumn("_c", F.lit(0))
    keyed = [*keys, "_c"]
    rows = rows.select(*keyed, "row_id", "x", "y")
    blocks = blocks_for(rows)
    both = ordinal(ordinal(rows, keyed, "x", "u", blocks), keyed, "y", "v", blocks)
    fixed = rows.groupBy(*keyed).agg(F.count("*").alias("_n"), ((F.max("x") > F.min("x")) & (F.max("y") > F.min("y"))).alias("_varies"))

    def sums(key, g: pd.DataFrame) -> pd.DataFrame:
        c = int(key[len(keyed) - 1])
        a, b = waves(g["u"].to_numpy(float), _weights(k, s, seed + c)), waves(g["v"].to_numpy(float), _weights(k, s, seed + c + 1000))
        total = np.concatenate([a.sum(0), b.sum(0), (a * a).sum(0), (b * b).sum(0), (a.T @ b).ravel()])
        return pd.DataFrame({**{name: [v] for name, v in zip(keyed, key)}, "sums": [total.tolist()]})

    kinds = dict(both.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keyed)
    part = both.withColumn("_stretch", F.pmod(F.xxhash64("row_id"), F.lit(max(1, -(-blocks * ROWS // KERNEL_ROWS)) if blocks > 1 else 1)))
    part = part.groupBy(*keyed, "_stretch").applyInPandas(sums, f"{named}, sums array<double>")
    summed = part.select(*keyed, F.posexplode("sums").alias("pos", "v")).groupBy(*keyed, "pos").agg(F.sum("v").alias("v"))
    gathered = summed.groupBy(*keyed).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s")).join(fixed, keyed)

    @F.pandas_udf("double")
    def best(vectors: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for v, m in zip(vectors, n):
            v, w = np.asarray(v, float), 2 * k
            ma, mb, qa, qb = (v[i * w : (i + 1) * w] / m for i in range(4))
            products = v[4 * w :].reshape(w, w) - m * np.outer(ma, mb)
            # columns that do not vary are left as they are, centred
            sa, sb = (np.where(m * (q - c * c) > 1e-10, np.sqrt(np.maximum(m * (q - c * c), 1e-300)), 1.0) for q, c in ((qa, ma), (qb, mb)))
            out.append(min(1.0, float(np.abs(products / np.outer(sa, sb)).max())))
        return pd.Series(out)

    value = F.when((F.col("_n") >= 3) & F.col("_varies"), best(F.transform("_s", lambda p: p["v"]), F.col("_n"))).otherwise(0.0)
    return gathered.withColumn("rdc", value).groupBy(*keys).agg(F.max("rdc").alias("rdc"))


def strongest(*scores: DataFrame) -> DataFrame:
    """(feature, score, name): the largest absolute score over several statistics; ties go to the first name."""
    parts = []
    for s in scores:
        name = next(c for c in s.columns if c not in ("feature", "n"))
        parts.append(s.select("feature", F.abs(name).alias("score"), F.lit(name).alias("name")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("feature").orderBy(F.desc("score"), "name")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
