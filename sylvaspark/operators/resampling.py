"""Statistics of many permutations of a class, as products of blocks of rows with blocks of permuted classes.

A task permutes the classes of a group for a few permutations; its rows are identifiers and classes only.  Then blocks of the
group's values meet these classes, and what leaves a block is one vector of sums per feature and permutation.  The permutations
are those of :func:`permutation.permuted`.  Groups of more rows than a block of :mod:`numbering` take the way of plain windows.
:func:`statistics` takes long tables, :func:`in_blocks` wide rows.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import release, small, stage
from . import numbering

#: Permutations that a task makes at most, and classes at most.
CHUNK, CLASSES = 64, 64
#: Rows of a block, at least, and blocks of a group, at most.
BLOCK, BLOCKS = 8192, 32
#: Rows, and columns of a product, that are in memory at once; rows of a product with classes.
SLICE, COLUMNS, SUMMED = 4096, 320, 1024
#: Partitions of groups, at most.
SPREAD = 200
#: Messages that are digested at once.
LANES = 16384
#: Bytes of sums that leave a block in one piece, at most.
PIECE = 1 << 26

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(np.sin(i + 1.0)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = {k: (np.array(k, np.uint32), np.array(32 - k, np.uint32)) for k in set(_SHIFTS)}
_ADDED = [np.array(v, np.uint32) for v in _SINES]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else (7 * i) % 16 for i in range(64)]


def _rounds(words: list, first: bool = False) -> list[np.ndarray]:
    """The four words of MD5 of messages of one block, or the first of them; a word that all messages share is a number."""
    n = next(len(w) for w in words if not isinstance(w, int))
    xor, both, add = np.bitwise_xor, np.bitwise_and, np.add
    a, b, c, d = (np.array(v, np.uint32) for v in _START)
    # what all messages share is one number, until a word differs
    f, t, u = (np.empty((), np.uint32) for _ in range(3))
    for i in range(61 if first else 64):
        w = words[_WORD[i]]
        if not f.ndim and not isinstance(w, int):
            f, t, u = (np.empty(n, np.uint32) for _ in range(3))
        if i < 16:
            xor(c, d, f)
            both(f, b, f)
            xor(f, d, f)
        elif i < 32:
            xor(b, c, f)
            both(f, d, f)
            xor(f, c, f)
        elif i < 48:
            if i % 2:
                xor(u, b, f)
            else:
                xor(b, c, u)
                xor(u, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            xor(f, c, f)
        add(f, a, f)
        if isinstance(w, int):
            add(f, np.array((_SINES[i] + w) & 0xFFFFFFFF, np.uint32) if w else _ADDED[i], f)
        else:
            add(f, _ADDED[i], f)
            add(f, w, f)
        left, right = _TURNS[_SHIFTS[i]]
        np.left_shift(f, left, t)
        np.right_shift(f, right, f)
        np.bitwise_or(f, t, f)
        a = a if a.ndim else np.empty_like(f)
        add(f, b, a)
        a, b, c, d = d, a, b, c
    if first:  # three rounds more would only move it
        return [b + np.uint32(_START[0])]
    return [v + np.uint32(s) for v, s in zip((a, b, c, d), _START)]


class Digests:
    """MD5 of a prefix and each of some texts, as pairs of numbers that sort as the hexadecimal digests do."""

    def __init__(self, texts: list[bytes] | np.ndarray):
        lengths = np.char.str_len(texts) if isinstance(texts, np.ndarray) else np.fromiter(map(len, texts), np.int64, len(texts))
        self.n, self.texts, self.groups, self.laid = len(texts), texts, [], {}
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            chosen = b"".join(texts[at].tolist() if isinstance(texts, np.ndarray) else [texts[i] for i in at])
            self.groups.append((int(size), at, np.frombuffer(chosen, np.uint8).reshape(len(at), int(size))))

    def _words(self, before: int) -> list:
        """Of each length of text, the words of messages behind ``before`` bytes of zeros; the words that all share are numbers."""
        out = []
        for size, _, block in self.groups:
            length = before + size
            if length > 55 or not size:
                out.append(None)
                continue
            m = np.zeros((len(block), 64), np.uint8)
            m[:, before:length] = block
            m[:, length] = 128
            m[:, 56:58] = (length * 8 & 255, length * 8 >> 8)
            words = m.view("<u4")
            varied = range(before // 4, (length - 1) // 4 + 1)
            out.append([np.ascontiguousarray(words[:, w]) if w in varied else int(words[0, w]) for w in range(16)])
        return out

    def _each(self, prefix: bytes, first: bool):
        """Places, and words of their digests or None where a message does not fit one block."""
        if len(prefix) not in self.laid:
            self.laid[len(prefix)] = self._words(len(prefix))
        start = np.frombuffer(prefix + bytes(-len(prefix) % 4), "<u4")
        for (_, at, _), words in zip(self.groups, self.laid[len(prefix)]):
            if words is None:
                yield at, None
                continue
            for s in range(0, len(at), LANES):
                some = [w if isinstance(w, int) else w[s : s + LANES] for w in words]
                some[: len(start)] = [w | int(f) if isinstance(w, int) else w | f for w, f in zip(some, start)]
                yield at[s : s + LANES], _rounds(some, first)

    def of(self, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The halves of the digests."""
        high, low = np.empty(self.n, np.uint64), np.empty(self.n, np.uint64)
        for at, words in self._each(prefix, False):
            if words is None:
                for i in at:
                    found = self._one(prefix, i)
                    high[i], low[i] = int.from_bytes(found[:8]), int.from_bytes(found[8:])
            else:
                high[at], low[at] = _joint(*words[:2]), _joint(*words[2:])
        return high, low

    def _one(self, prefix: bytes, i: int) -> bytes:
        return md5(prefix + bytes(self.texts[i])).digest()

    def order(self, prefix: bytes) -> np.ndarray:
        """Places in order of the digests, equal ones as they come."""
        keys = np.empty(self.n, np.uint64)
        for at, words in self._each(prefix, True):
            keys[at] = [int.from_bytes(self._one(prefix, i)[:4]) for i in at] if words is None else words[0].byteswap()
        # digests by their first words, with the places behind: this takes less than half the time of an argsort
        bits = np.uint64(max(1, (self.n - 1).bit_length()))
        keys <<= bits
        keys |= np.arange(self.n, dtype=np.uint64)
        keys.sort()
        order = (keys & np.uint64((1 << int(bits)) - 1)).astype(np.intp)
        keys >>= bits
        tied = np.flatnonzero(keys[1:] == keys[:-1])
        for run in np.split(tied, np.flatnonzero(np.diff(tied) > 1) + 1) if len(tied) else []:
            s = slice(run[0], run[-1] + 2)
            order[s] = sorted(order[s], key=lambda i: self._one(prefix, i))
        return order


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def _by_id(ids: np.ndarray) -> tuple[np.ndarray, list[bytes] | np.ndarray]:
    """Places in order of identifiers, and their texts in this order."""
    if ids.dtype == object:
        texts = [i.encode() for i in ids]
        if max(map(len, texts)) <= 64 and not any(t.endswith(b"\0") for t in texts):
            at = np.argsort(np.array(texts), kind="stable")
        else:
            at = np.array(sorted(range(len(ids)), key=texts.__getitem__), np.int64)
        return at, [texts[i] for i in at]
    at = np.argsort(ids, kind="stable")
    return at, ids[at].astype("S")


def _relabelled(codes: np.ndarray, texts: list[bytes] | np.ndarray, seed: int, bs: range) -> np.ndarray:
    """(permutation, row): the classes of rows, which are in order of their identifiers, under some permutations."""
    labels, digests = np.empty((len(bs), len(codes)), np.uint8), Digests(texts)
    for j, b in enumerate(bs):
        labels[j, digests.order(f"{seed}|{b}|".encode()) if b else slice(None)] = codes
    return labels


def _permuter(by: list[str], seed: int, n: int, chunk: int, block: int, classes: int, per_part: int, placed: bool):
    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        at, texts = _by_id(g["row_id"].to_numpy())
        codes, k = g["code"].to_numpy(np.uint8)[at], int(key[-1])
        labels = _relabelled(codes, texts, seed, range(k * chunk, min((k + 1) * chunk, n + 1)))
        starts = np.arange(0, len(codes), block)
        if placed:
            counts = np.stack([np.add.reduceat((labels == c).astype(np.int32), starts, axis=1) for c in range(classes)], axis=-1).astype(np.int64)
            before = [v.tobytes() for v in (np.cumsum(counts, axis=1) - counts).transpose(1, 0, 2)]
        total = np.bincount(codes, minlength=classes).astype(np.int64).tobytes()
        out = {name: [v] * len(starts) for name, v in zip(by, key)}
        out |= {"chunk": k, "part": k // per_part, "block": np.arange(len(starts)), "labels": [labels[:, s : s + block].tobytes() for s in starts], "before": before if placed else [b""] * len(starts), "total": [total] * len(starts)}
        return pd.DataFrame(out)

    return run


def _places(ind: np.ndarray, before: np.ndarray, start: int, n: int, members: int) -> np.ndarray:
    """The places over n of rows (permutation, row) by whether they are of a class, ties by identifier."""
    seen = before[:, None] + np.cumsum(ind, axis=1)
    return np.where(ind, n - members + seen, np.arange(start + 1, start + ind.shape[1] + 1) - seen) / n


def _targets(classes: int) -> list[tuple[int, int]]:
    """Number and class of the pairs of one class against the others; of two classes the last one."""
    return [(i, i) for i in range(classes)] if classes > 2 else [(0, classes - 1)]


def _summed(x: np.ndarray, labels: np.ndarray, classes: int) -> np.ndarray:
    """(feature, permutation, class): sums of the values (row, feature) of each class."""
    p, out, ones = len(labels), np.zeros((x.shape[1], len(labels), classes)), np.eye(classes)
    step = max(1, COLUMNS // classes)
    for r in range(0, len(x), SUMMED):
        part = np.ascontiguousarray(x[r : r + SUMMED].T)
        for b in range(0, p, step):
            some = np.ascontiguousarray(labels[b : b + step, r : r + SUMMED].T)
            out[:, b : b + step] += (part @ ones.take(some, axis=0).reshape(len(some), -1)).reshape(len(part), -1, classes)
    return out


def _waved(u: np.ndarray, labels: np.ndarray, before: np.ndarray, total: np.ndarray, start: int, weights) -> np.ndarray:
    """(feature, permutation, target, 4 w + w w): sums of the waves of the places u (row, feature) and of the classes, of their squares and products."""
    from ..functions.association import waves

    targets = _targets(len(total))
    w = 2 * len(weights(0))
    out = np.zeros((u.shape[1], len(labels), len(targets), 4 * w + w * w))
    step, n = max(1, COLUMNS // w), int(total.sum())
    turn = lambda places, at: waves(places.T.ravel(), at).reshape(places.shape[1], -1)
    for t, (c, k) in enumerate(targets):
        seen = before[:, k].copy()
        for r in range(0, len(u), SLICE):
            ind = labels[:, r : r + SLICE] == k
            v = _places(ind, seen, start + r, n, int(total[k]))
            seen += ind.sum(1)
            for i in range(0, u.shape[1], step):
                a = turn(u[r : r + SLICE, i : i + step].T, weights(c))
                f = a.shape[1] // w
                for b in range(0, len(labels), step):
                    q = turn(v[b : b + step], weights(c + 1000))
                    p = q.shape[1] // w
                    o = out[i : i + f, b : b + p, t]
                    o[..., :w] += a.sum(0).reshape(f, 1, w)
                    o[..., w : 2 * w] += q.sum(0).reshape(1, p, w)
                    o[..., 2 * w : 3 * w] += (a * a).sum(0).reshape(f, 1, w)
                    o[..., 3 * w : 4 * w] += (q * q).sum(0).reshape(1, p, w)
                    o[..., 4 * w :] += (a.T @ q).reshape(f, w, p, w).transpose(0, 2, 1, 3).reshape(f, p, w * w)
    return out


def _bits(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0.0)


def _ended(kind: str, sums: np.ndarray, q: np.ndarray, varied: np.ndarray, total: np.ndarray) -> np.ndarray:
    """(feature, permutation): the statistic of the sums over all blocks."""
    n = int(total.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "mc":
            s = sums.sum(2)
            g = np.where(total > 0, sums * sums / np.maximum(total, 1), 0.0).sum(2)
            centre = s * s / n
            sst = q[:, None] - centre
            return np.where(sst > q[:, None] * 1e-12, np.sqrt(np.maximum(0.0, (g - centre) / sst)), 0.0)
        if kind == "rdc_class":
            w = int(np.sqrt(sums.shape[3] + 4)) - 2
            ma, mb, qa, qb = (sums[..., i * w : (i + 1) * w] / n for i in range(4))
            products = sums[..., 4 * w :].reshape(*sums.shape[:3], w, w) - n * ma[..., :, None] * mb[..., None, :]
            sa, sb = (np.where(n * (p - c * c) > 1e-10, np.sqrt(np.maximum(n * (p - c * c), 1e-300)), 1.0) for p, c in ((qa, ma), (qb, mb)))
            t = np.minimum(1.0, np.abs(products / (sa[..., :, None] * sb[..., None, :])).max((3, 4)))
            both = np.array([0 < total[k] < n for _, k in _targets(len(total))])
            return np.where(varied[:, None, None] & both & (n >= 3), t, 0.0).max(2)
        right = np.rint(sums)
        left = total - right
        nl, nr = left.sum(2), right.sum(2)
        if kind == "gini":
            t = (nl - (left * left).sum(2) / nl + nr - (right * right).sum(2) / nr) / n
        else:
            t = (_bits(nl) - _bits(left).sum(2) + _bits(nr) - _bits(right).sum(2)) / n
        return np.where((nl > 0) & (nr > 0), t, np.inf)


KINDS = ("mc", "rdc_class", "gini", "entropy")


def statistics(long: DataFrame, n: int, seed: int, kind: str, by: list[str], at: DataFrame | None = None, weights=None) -> DataFrame | None:
    """(*by, feature, b, t) of ``long`` (*by, row_id, feature, x, y) under permutations 0..n, or None where rows do not fit this way:
    more than ``numbering.ROWS`` in a group, many classes, missing targets, identifiers that repeat, or features without some of the rows.

    ``mc`` is the correlation ratio, ``rdc_class`` the randomised dependence on a class, ``gini`` and ``entropy`` the weighted impurity
    of the sides of each threshold ``at`` (*by, feature, threshold), which the result names.  Without permutations the dependence of
    a feature is one task's.
    """
    kinds = dict(long.dtypes)
    if kinds["row_id"] not in ("string", "bigint", "int", "smallint", "tinyint"):
        return None
    if kind == "rdc_class" and not n:
        from ..functions.association import whole_rdc

        found = whole_rdc(long, [*by, "feature"], weights)
        if found is not None:
            return found.select(*by, "feature", F.lit(0).alias("b"), F.col("rdc").alias("t"))
    kept = stage(long.select(*by, "row_id", "feature", "x", "y"), "resampled")
    out = _statistics(kept, n, seed, kind, by, at, weights)
    out = None if out is None else stage(out, "statistics")
    release(kept)
    return out


def _whole(long: DataFrame, one: DataFrame, by: list[str]) -> tuple[int, int] | None:
    """Rows of the largest group and features of the widest, or None unless each feature has each identifier of its group once."""
    h = F.xxhash64("row_id")
    of = lambda t, *keys: t.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("p"), F.sum(F.shiftrightunsigned(h, 32)).alias("q"))
    rows = of(one, *by).join(one.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.countDistinct("row_id").alias("d")), _same(by))
    rows = rows.select(*(F.col(c).alias(f"_{c}") for c in by), F.struct("n", "p", "q").alias("_rows"), "d")
    facts = of(long, *by, "feature").groupBy(*by).agg(F.min(F.struct("n", "p", "q")).alias("a"), F.max(F.struct("n", "p", "q")).alias("z"), F.count("*").alias("f"))
    same = (F.col("a") == F.col("z")) & (F.col("a") == F.col("_rows")) & (F.col("d") == F.col("z.n"))
    fit = facts.join(rows, _same(by)).agg(F.max("z.n").alias("most"), F.max("f").alias("features"), F.min(same).alias("whole")).first()
    return (fit["most"], fit["features"]) if fit["whole"] else None


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return same


def _statistics(long: DataFrame, n: int, seed: int, kind: str, by: list[str], at: DataFrame | None, weights) -> DataFrame | None:
    kinds = dict(long.dtypes)
    one = long.select(*by, "row_id", "y").distinct()
    values = one.select("y").distinct().limit(CLASSES + 1).collect()
    if not values or len(values) > CLASSES or any(r["y"] is None or r["y"] != r["y"] for r in values):
        return None
    classes = sorted(r["y"] for r in values)
    fit = _whole(long, one, by)
    if fit is None or fit[0] > numbering.ROWS:
        return None
    (most, features), columns = fit, ["feature"]
    block = BLOCK * max(1, -(-most // (BLOCK * BLOCKS)))
    chunk = max(1, min(CHUNK, (1 << 25) // most))
    x = long.select(*by, "row_id", "feature", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))
    marks = 1
    if kind in ("gini", "entropy"):
        columns = ["feature", "threshold"]
        at = at.select(*by, "feature", "threshold").distinct()
        marks = at.groupBy(*by).count().agg(F.max("count").alias("m")).first()["m"] or 1
        x = x.join(at, [*by, "feature"]).withColumn("x", (F.col("x") > F.col("threshold")).cast("double"))
    elif kind == "rdc_class":
        x = long.select(*by, "row_id", "feature", F.col("x").cast("double").alias("x"))
        place = F.row_number().over(Window.partitionBy(*by, "feature").orderBy("x", "row_id"))
        x = x.withColumn("_u", place / F.count("*").over(Window.partitionBy(*by, "feature")))
    w = 2 * len(weights(0)) if weights else 0
    lengths = (4 * w + w * w) * len(_targets(len(classes))) if kind == "rdc_class" else len(classes)
    per_part = max(1, PIECE // (8 * lengths * chunk * features * marks))
    chunks = -(-(n + 1) // chunk)
    parts = -(-chunks // per_part)
    tasks = max(2 * long.sparkSession.sparkContext.defaultParallelism, int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = "".join(f"`{c}` {kinds[c]}, " for c in by)

    coded = one.select(*by, "row_id", (F.array_position(F.array(*map(F.lit, classes)).cast(f"array<{kinds['y']}>"), F.col("y")) - 1).cast("int").alias("code"))
    spread = coded.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(tasks, *by, "chunk")
    run = _permuter(by, seed, n, chunk, block, len(classes), per_part, kind == "rdc_class")
    permuted = spread.groupBy(*by, "chunk").applyInPandas(run, f"{named}chunk int, part int, block int, labels binary, before binary, total binary")

    place = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("row_id")) - 1
    placed = one.select(*by, "row_id").withColumn("_i", place)
    value = F.col("_u") if kind == "rdc_class" else F.col("x")
    packed = _joined(x, placed, by).withColumn("block", F.expr(f"_i div {block}").cast("int")).groupBy(*by, *columns, "block").agg(F.sort_array(F.collect_list(F.struct("_i", value.alias("v")))).alias("v"), F.min("x").alias("low"), F.max("x").alias("high"))
    packed = packed.select(*by, *columns, "block", F.transform("v", lambda v: v["v"]).alias("v"), "low", "high").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = [*by, "part", "block"]

    def multiply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v = np.stack(right["v"].to_numpy(), axis=1).astype(float)
            q = (v * v).sum(0)
            fixed = {name: right[name] for name in (*by, *columns, "low", "high")}
            for r in left.itertuples():
                labels = np.frombuffer(r.labels, np.uint8).reshape(-1, len(v))
                total = np.frombuffer(r.total, np.int64)
                if kind == "rdc_class":
                    before = np.frombuffer(r.before, np.int64).reshape(len(labels), -1)
                    sums = _waved(v, labels, before, total, int(key[-1]) * block, weights)
                else:
                    sums = _summed(v, labels, len(total))
                out.append(pd.DataFrame(fixed | {"chunk": r.chunk, "q": q, "sums": [s.tobytes() for s in sums], "total": [r.total] * len(q)}))
        return pd.concat(out) if out else pd.DataFrame({name: [] for name in (*by, *columns, "low", "high", "chunk", "q", "sums", "total")})

    def end(key, g: pd.DataFrame) -> pd.DataFrame:
        total, out, first = np.frombuffer(g["total"].iloc[0], np.int64), [], int(g["chunk"].iloc[0]) * chunk
        width = lengths // len(_targets(len(classes))) if kind == "rdc_class" else 0
        for name, f in g.groupby(columns, sort=False):
            sums = sum(np.frombuffer(s, float) for s in f["sums"])
            shape = (1, -1, len(_targets(len(classes))), width) if width else (1, -1, len(total))
            t = _ended(kind, sums.reshape(shape), np.array([f["q"].sum()]), np.array([f["high"].max() > f["low"].min()]), total)[0]
            out.append(pd.DataFrame({c: [v] * len(t) for c, v in zip([*by, *columns], [*key[: len(by)], *name])} | {"b": np.arange(first, first + len(t)), "t": t}))
        return pd.concat(out)

    schema = named + "".join(f"`{c}` {'string' if c == 'feature' else 'double'}, " for c in columns)
    sums = permuted.repartition(tasks, *keys).groupBy(*keys).cogroup(packed.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(multiply, f"{schema}low double, high double, chunk int, q double, sums binary, total binary")
    sums = sums.withColumn("_f", F.pmod(F.xxhash64(*columns), F.lit(16)))
    return sums.groupBy(*by, "chunk", "_f").applyInPandas(end, f"{schema}b int, t double")


def _joined(x: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """Cells with the places of their rows; groups may be null."""
    right = placed.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("row_id").alias("_id"), "_i")
    return x.join(right, _same(by) & (F.col("row_id") == F.col("_id"))).drop(*(f"_{c}" for c in by), "_id")


def in_blocks(rows: DataFrame, by: list[str], columns: list[str], tests: dict[tuple, list[tuple]], budgets: dict[tuple, int], most: int, classes: int, seed: int, kind: str) -> DataFrame:
    """(*by, feature, threshold, b, t) of groups under their ``budgets`` of permutations, as :func:`statistics` has them, from wide rows.

    ``rows`` (*by, row_id, code, block, xs): ``xs`` has the values of ``columns``, ``code`` numbers the classes, ``block`` rises with
    ``row_id``, which names one row of a group; nothing is missing.  ``tests`` has each group's (feature, threshold), the threshold None where ``kind`` is ``mc``.
    ``most`` is the rows of the largest group.  A row meets all features at once, so no long table is made.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    named = "".join(f"`{c}` {kinds[c]}, " for c in by)
    one = 8 * classes * max(map(len, tests.values()))
    chunk = max(1, min(CHUNK, (1 << 25) // most, PIECE // (one * BLOCKS)))
    per_part = max(1, PIECE // (one * chunk))
    # products of few blocks are cut into parts, so that all cores have some
    blocks = min(BLOCKS, -(-most // BLOCK)) * len(budgets)
    per_part = min(per_part, max(1, (max(budgets.values()) // chunk + 1) * blocks // (4 * spark.sparkContext.defaultParallelism)))
    chunks = {k: -(-(n + 1) // chunk) for k, n in budgets.items()}
    plan = small(spark, [(*k, n) for k, n in chunks.items()], f"{named}_chunks int")
    rows = rows.join(F.broadcast(plan), by)
    # more partitions than groups: few of them meet in one task
    spread = min(SPREAD, max(2 * spark.sparkContext.defaultParallelism, 3 * sum(chunks.values())))
    empty, place = [*by, "block", "chunk", "q", "sums", "total"], {f: i for i, f in enumerate(columns)}

    def permute(key, g: pd.DataFrame) -> pd.DataFrame:
        at, texts = _by_id(g["row_id"].to_numpy())
        codes, blocks, k = g["code"].to_numpy(np.uint8)[at], g["block"].to_numpy()[at], int(key[-1])
        labels = _relabelled(codes, texts, seed, range(k * chunk, min((k + 1) * chunk, budgets[tuple(key[:-1])] + 1)))
        cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
        total = np.bincount(codes, minlength=classes).astype(np.int64).tobytes()
        out = {name: [v] * len(cuts) for name, v in zip(by, key)}
        pieces = [labels[:, s:e].tobytes() for s, e in zip(cuts, [*cuts[1:], len(blocks)])]
        return pd.DataFrame(out | {"part": k // per_part, "block": blocks[cuts], "chunk": k, "labels": pieces, "total": [total] * len(cuts)})

    def multiply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, group = {}, tuple(key[: len(by)])
        if len(left) and len(right):
            of, marks = tests[group], [t for _, t in tests[group]]
            v = np.stack(right["xs"].to_numpy()[_by_id(right["row_id"].to_numpy())[0]])[:, [place[f] for f, _ in of]]
            v = v if kind == "mc" else (v > np.array(marks, float)).astype(float)
            q = (v * v).sum(0).tobytes()
            sums = [_summed(v, np.frombuffer(r, np.uint8).reshape(-1, len(v)), classes).tobytes() for r in left["labels"]]
            out = {c: [k] * len(left) for c, k in zip(by, group)} | {"block": int(key[-1]), "chunk": left["chunk"].to_numpy(), "q": [q] * len(left), "sums": sums, "total": left["total"].to_numpy()}
        return pd.DataFrame(out) if out else pd.DataFrame({name: [] for name in empty})

    def end(key, g: pd.DataFrame) -> pd.DataFrame:
        group, first, g = tuple(key[:-1]), int(key[-1]) * chunk, g.sort_values("block")
        of = tests[group]
        sums = sum(np.frombuffer(s, float) for s in g["sums"]).reshape(len(of), -1, classes)
        t = _ended(kind, sums, sum(np.frombuffer(q, float) for q in g["q"]), None, np.frombuffer(g["total"].iloc[0], np.int64))
        n = t.shape[1]
        out = {c: [k] * t.size for c, k in zip(by, group)} | {"feature": np.repeat([f for f, _ in of], n), "threshold": np.repeat([np.nan if m is None else m for _, m in of], n)}
        return pd.DataFrame(out | {"b": np.tile(np.arange(first, first + n), len(of)), "t": t.ravel()})

    dealt = rows.select(*by, "row_id", "code", "block", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk")).repartition(spread, *by, "chunk")
    permuted = dealt.groupBy(*by, "chunk").applyInPandas(permute, f"{named}part int, block int, chunk int, labels binary, total binary")
    keys = [*by, "part", "block"]
    packed = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_chunks - 1) div {per_part} as int)")))).select(*keys, "row_id", "xs")
    met = permuted.repartition(spread, *keys).groupBy(*keys).cogroup(packed.repartition(spread, *keys).groupBy(*keys))
    sums = met.applyInPandas(multiply, f"{named}block int, chunk int, q binary, sums binary, total binary")
    return sums.groupBy(*by, "chunk").applyInPandas(end, f"{named}feature string, threshold double, b int, t double")


def blocked(rows: DataFrame, by: list[str], classes: list | None = None) -> DataFrame | None:
    """``rows`` (*by, row_id, y, ...) with ``code`` and ``block`` for :func:`in_blocks`, or None where they do not fit; ``classes`` has all y, where known."""
    values = [r["y"] for r in rows.select("y").distinct().limit(CLASSES + 1).collect()] if classes is None else classes
    if not values or len(values) > CLASSES or any(v is None or v != v for v in values):
        return None
    fit = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d")).agg(F.max("n").alias("most"), F.min(F.col("n") == F.col("d")).alias("own"), F.sum("n").alias("all")).first()
    if not fit["own"] or fit["most"] > numbering.ROWS:
        return None
    codes = F.array(*(F.lit(v) for v in sorted(values))).cast(f"array<{dict(rows.dtypes)['y']}>")
    block = numbering.value_block(rows, "row_id", max(1, min(BLOCKS, -(-fit["most"] // BLOCK))), fit["all"])
    return rows.withColumn("code", (F.array_position(codes, F.col("y")) - 1).cast("int")).withColumn("block", block.cast("int"))
