"""Quality classifier [operator 4].

Statistics of a document (shares of kinds of characters and words, repetition,
line shapes) become random Fourier features of a Gaussian kernel; ridge regression
on them is fitted from normal equations that each partition sums; isotonic
regression on labelled rows that the ridge did not see turns its output into a
score between 0 and 1.

The features are rounded to multiples of 2**-11, so that all sums are exact and the
model does not depend on how rows are dealt to partitions.  What reaches the driver
is one matrix of fixed size and one histogram of fixed size.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0: 1 to 3
for the ridge, 4 for the calibration.  Labels, language, source and doc_id are no
inputs.  Nulls and the like: a null text counts as empty and is scored like one; a null label or
label id is no label; several labels of a document count as their maximum; without
labels all scores are ``DEFAULT`` and nothing is rejected; equal texts have equal scores; texts of any length are
read whole; an empty table gives an empty result; columns of any other name are not read, and :func:`keep_good` returns them
unchanged.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_bytes

FEATURES, GAMMA, RIDGE, SEED, BINS, DEFAULT = 192, 2.0, 1e-3, 7, 1024, 0.5
_UNIT = 2048.0
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS = b"#$%&*@^~+=|<>{}[]\\_"


def statistics(body: bytes) -> list[float]:
    """Bounded statistics of one text."""
    n = len(body)
    if not n:
        return [0.0] * 17
    words = body.split()
    w = max(1, len(words))
    kinds = Counter(words)
    top = max(kinds.values(), default=0)
    letters_off = n - len(body.translate(None, _PUNCT))
    marks = n - len(body.translate(None, _MARKS))
    upper = n - len(body.translate(None, _UPPER))
    digits = n - len(body.translate(None, _DIGIT))
    lines = body.split(b"\n")
    filled = [x for x in lines if x.strip()]
    pairs = set(zip(words, words[1:]))
    same = sum(a == b for a, b in zip(words, words[1:]))
    ends = sum(x[-1:] in b".!?" for x in filled)
    return [
        min(1.0, math.log1p(w) / 10),
        min(1.0, n / w / 20),
        len(kinds) / w,
        top / w,
        same / w,
        len(pairs) / max(1, w - 1),
        min(1.0, 4 * letters_off / n),
        min(1.0, 8 * marks / n),
        upper / n,
        min(1.0, 4 * digits / n),
        min(1.0, 8 * body.count(b"|") / n),
        min(1.0, 8 * body.count(b"!") / n),
        min(1.0, 4 * (body.count(b".") + body.count(b",")) / w),
        ends / max(1, len(filled)),
        len(set(filled)) / max(1, len(filled)),
        min(1.0, math.log1p(n / max(1, len(lines))) / 8),
        sum(len(x) == 1 for x in words) / w,
    ]


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def featurize(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, stats array<float>, *carry) for each row of ``docs``."""
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(key).cast("long").alias("doc_id"), *carry)

    def run(batches):
        for batch in slices(batches):
            stats = [statistics(b) for b in text_bytes(batch.column(0))]
            yield pa.record_batch([*batch.columns[1:], pa.array(stats, pa.list_(pa.float32()))], names=[*batch.schema.names[1:], "stats"])

    from pyspark.sql.types import ArrayType, FloatType

    return rows.mapInArrow(run, rows.drop("_text").schema.add("stats", ArrayType(FloatType())))


class Kernel:
    """Random Fourier features of exp(-gamma |x - y|**2), rounded to multiples of 2**-11, with a constant."""

    def __init__(self, inputs: int = 17, size: int = FEATURES, gamma: float = GAMMA, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w = rng.normal(0.0, math.sqrt(2 * gamma), (inputs, size))
        self.b = rng.uniform(0, 2 * math.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(x.astype(np.float64) @ self.w + self.b)
        z = np.concatenate([z, np.ones((len(x), 1))], axis=1)
        return np.rint(z * _UNIT) / _UNIT


def _stats(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _sums(rows: DataFrame, of) -> np.ndarray | None:
    """The sum over all rows of ``of(stats, label)``, a vector of fixed length, per partition and then per place."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = of(_stats(batch.column(0)), np.array(batch.column(1), dtype=np.float64))
                total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["place", "value"])

    found = rows.select("stats", "label").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value")).collect()
    if not found:
        return None
    out = np.zeros(len(found))
    for place, value in found:
        out[place] = value
    return out


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising means nearest to positive/n; empty bins are filled by interpolation."""
    blocks: list[list[float]] = []  # weight, sum, first, last
    for i in np.flatnonzero(n):
        blocks.append([n[i], positive[i], i, i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    at = [(f + last) / 2 for _, _, f, last in blocks]
    # half a row of each class keeps the ends off 0 and 1
    return np.interp(np.arange(len(n)), at, [(s + 0.5) / (w + 1) for w, s, *_ in blocks]) if blocks else np.full(len(n), DEFAULT)


class Model:
    def __init__(self, kernel: Kernel, beta: np.ndarray | None = None, curve: np.ndarray | None = None):
        self.kernel, self.beta, self.curve = kernel, beta, curve

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.beta

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Places on the histogram, which spans -0.5 to 1.5."""
        return np.clip((self.raw(x) + 0.5) / 2 * (BINS - 1), 0, BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None or not len(x):
            return np.full(len(x), DEFAULT)
        if self.curve is None:
            return np.round(np.clip(self.raw(x), 0, 1), 6)
        return np.round(np.clip(np.interp(self.bins(x), np.arange(BINS), self.curve), 0, 1), 6)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id") -> Model:
    """``stats`` (doc_id, stats) from :func:`featurize` and a table of labels to a model."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    rows = stats.join(known, "doc_id").withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0").select("stats", "label", "fold")
    kernel = Kernel()
    size = FEATURES + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = kernel(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    total = _sums(rows.where("fold <> 4"), equations)
    if total is None:
        return Model(kernel)
    a, b, n = total[: size * size].reshape(size, size), total[size * size : -1], total[-1]
    model = Model(kernel, np.linalg.solve(a / n + RIDGE * np.eye(size), b / n))

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.rint(model.bins(x)).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    counts = _sums(rows.where("fold = 4"), histogram)
    if counts is not None:
        model.curve = isotonic(counts[:BINS], counts[BINS:])
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, held_out, score, predicted): one row for each row of ``docs``."""
    stats = materialize(featurize(docs, key, text, carry), "stats")
    model = fit(stats, labels, label, key)

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            s = model.score(_stats(x) if batch.num_rows else np.zeros((0, 17)))
            yield pa.record_batch([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    from pyspark.sql.types import DoubleType

    scored = stats.mapInArrow(run, stats.drop("stats").schema.add("score", DoubleType()))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", *carry, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; columns unchanged."""
    columns = docs.columns
    stats = materialize(featurize(docs, key, text), "stats")
    model = fit(stats, labels, key=key, **options)
    # the text is read where it stands in the row; a column of another type goes beside it as a string
    inside = dict(docs.dtypes)[text] == "string"
    packed = docs.select(F.struct(*columns).alias("_row"), *([] if inside else [F.col(text).cast("string").alias("_text")]))

    def run(batches):
        for batch in slices(batches):
            body = batch.column(0).field(text) if inside else batch.column(1)
            s = model.score(np.array([statistics(b) for b in text_bytes(body)], dtype=np.float32))
            yield batch.filter(pa.array(s >= threshold))

    return packed.mapInArrow(run, packed.schema).select("_row.*")
