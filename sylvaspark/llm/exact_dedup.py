"""Exact dedup [operator 2]: a log-structured merge index of text digests.

Level 0.  Each task keeps a memtable, digest -> (smallest order key, rows); when it holds
``memtable_rows`` digests it is flushed as a run: entries in order of digest, cut into
``buckets`` digest ranges, each range with a Bloom filter of its digests.  Copies inside
a task collapse before anything is shuffled.

Compaction.  ``FAN`` runs of a range are merged into one run of the next level, until one
is left.  A merge streams: the runs' filters come first, then all entries in order
of digest, and only the new run's filter and one entry are held.  Entries that no other
run's filter has are passed on as they are; hits are merged with their neighbours, and the entry keeps the smallest
order key and the sum of the rows.

Verification.  The digests of several rows form a filter of bounded size.  Rows that it
lets through are hits: they alone travel with their texts, and are grouped by digest and
bytes, each task's copies first, so a hot text is one row per task.  A digest with two
texts (a collision) is grouped by its texts instead.

The order key is the identifier, or its complement where the largest is to stay, then the
row's own number.  Nulls: a null text counts as empty; a null identifier
sorts last, so it is kept only where all are null (keep_id is then null).  Of equal rows with the kept identifier exactly one is kept.
Texts of any length are digested and compared whole.  An empty table gives an empty result.
Columns of any other name are never looked at; :func:`deduplicate` returns them unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_bytes

#: Runs that a compaction merges into one.
FAN = 8
#: Bits of the filter of repeated digests at most (32 MiB, the most that is ever broadcast); beyond 2**24 of them more single rows travel, none is lost.
FILTER_BITS = 1 << 28
_RUN = "bucket int, run long, kind int, digest binary, missing int, key long, ref long, n long, filter binary"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [c.split()[0] for c in _RUN.split(", ")]


class Bloom:
    """Four probes into a bitmap, taken from the digest's own bytes."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.map = np.zeros(bits // 8, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)

    def at(self, digests: np.ndarray) -> np.ndarray:
        return digests.view(">u4").reshape(len(digests), -1)[:, 1:5].astype(np.int64) % self.bits

    def add(self, digests: np.ndarray) -> None:
        at = self.at(digests).ravel()
        np.bitwise_or.at(self.map, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, digests: np.ndarray) -> np.ndarray:
        at = self.at(digests)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def _width(n: int) -> int:
    return max(64, 1 << (10 * n - 1).bit_length())


def _raw(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)


def _entries(bucket, run, digests, missing, key, ref, n) -> pa.RecordBatch:
    size = len(digests)
    columns = [bucket, np.full(size, run), np.ones(size, np.int32), digests, missing, key, ref, n, [None] * size]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _filters(rows: list[tuple[int, int, Bloom]]) -> pa.RecordBatch:
    size = len(rows)
    columns = [[r[0] for r in rows], [r[1] for r in rows], [0] * size, *[[None] * size] * 5, [r[2].map.tobytes() for r in rows]]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def flush(table: dict[bytes, tuple], run: int, buckets: int):
    """The memtable as one sorted run: a filter for each range, then the entries."""
    order = sorted(table)
    raw = _raw(order)
    bucket = (raw[:, :4].copy().view(">u4").ravel().astype(np.int64) * buckets) >> 32
    filters = []
    for b in np.unique(bucket):
        mine = raw[bucket == b]
        bloom = Bloom(_width(len(mine)))
        bloom.add(mine)
        filters.append((int(b), run, bloom))
    yield _filters(filters)
    for i in range(0, len(order), 10_000):
        some = order[i : i + 10_000]
        yield _entries(bucket[i : i + 10_000], run, some, *zip(*(table[d] for d in some)))


def level0(digests: DataFrame, buckets: int, memtable_rows: int) -> DataFrame:
    """(digest, missing, key, ref) rows to the runs of all tasks' memtables."""

    def run(batches):
        from pyspark import TaskContext

        name, table = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for d, *key in zip(*(c.to_pylist() for c in batch.columns)):
                old = table.get(d)
                table[d] = (*key, 1) if old is None else (*min(old[:3], tuple(key)), old[3] + 1)
            if len(table) >= memtable_rows:
                yield from flush(table, name, buckets)
                name, table = name + 1, {}
        if table:
            yield from flush(table, name, buckets)

    return digests.select("digest", "missing", "key", "ref").mapInArrow(run, _RUN)


def merge_runs(batches):
    """Merge the runs of each (bucket, group), which come filters first and then by digest and order key."""
    at, filters, bloom, last = None, {}, None, None  # the segment, its runs' filters, the new run's filter, the entry that may go on

    def close():
        if last is not None:
            bloom.add(_raw([last[0]]))
            yield _entries([at[0]], at[1], *([x] for x in last))
        if bloom is not None:
            yield _filters([(*at, bloom)])

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, group, kind, run = (batch.column(i).to_numpy() for i in range(4))
        edge = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(group) != 0)) + 1
        for lo, hi in zip([0, *edge], [*edge, len(bucket)]):
            if (here := (int(bucket[lo]), int(group[lo]))) != at:
                yield from close()
                at, filters, bloom, last = here, {}, None, None
            entries = lo + int(np.searchsorted(kind[lo:hi], 1))
            for i in range(lo, entries):
                data = batch.column(9)[i].as_py()
                filters[int(run[i])] = Bloom(8 * len(data), data)
            if entries == hi:
                continue
            if bloom is None:
                bloom = Bloom(sum(f.bits for f in filters.values()))
            part = batch.slice(entries, hi - entries)
            digests = part.column(4).to_pylist()
            raw, mine = _raw(digests), run[entries:hi]
            hit = np.zeros(len(raw), dtype=bool)
            for name, f in filters.items():
                hit |= f.has(raw) & (mine != name)
            columns = [part.column(i).to_pylist() for i in range(5, 9)]
            out = []
            for i, d in enumerate(digests):
                if last is not None and (hit[i] and last[0] == d):  # the first has the smallest key
                    last = (*last[:4], last[4] + columns[3][i])
                    continue
                if last is not None:
                    out.append(last)
                last = (d, *(c[i] for c in columns))
            if out:
                bloom.add(_raw([e[0] for e in out]))
                yield _entries([at[0]] * len(out), at[1], *zip(*out))
    yield from close()


def build_index(digests: DataFrame, buckets: int, memtable_rows: int) -> DataFrame:
    """(digest, missing, key, ref) rows to the last level: (digest, missing, key, ref, n), one row per digest."""
    runs = materialize(level0(digests, buckets, memtable_rows), "level")
    flushes = (runs.agg(F.max(F.col("run").bitwiseAND(0xFFFFFFFF)).alias("m")).first()["m"] or 0) + 1
    runs = runs.withColumn("run", F.shiftright("run", 32) * flushes + F.col("run").bitwiseAND(0xFFFFFFFF))
    most = runs.agg(F.max("run").alias("m")).first()["m"] or 0
    while most > 0:
        dealt = runs.select("bucket", F.floor(F.col("run") / FAN).alias("group"), "kind", "run", "digest", "missing", "key", "ref", "n", "filter")
        dealt = dealt.repartition("bucket", "group").sortWithinPartitions("bucket", "group", "kind", "digest", "missing", "key", "ref")
        above = materialize(dealt.mapInArrow(merge_runs, _RUN), "level")
        runs, most = above, most // FAN
    return runs.where("kind = 1").select("digest", "missing", "key", "ref", "n")


def normalized(body: bytes) -> bytes:
    """A-Z lower-cased and nothing else changed."""
    return body.lower()


def _digested(docs: DataFrame, digest_bytes: int, keep: str, seen: "Hits | None" = None, inside: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, ..., sha, digest, missing, key), and for ``seen`` the text of its hits as ``body``.

    ``inside`` names the text's field in a column ``row`` instead.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for batch in slices(batches):
            text = batch.column(batch.schema.get_field_index("row")).field(inside) if inside else batch.column(batch.schema.get_field_index("text"))
            bodies = [normalized(b) for b in text_bytes(text)]
            digests = [hashlib.sha256(b).digest() for b in bodies]
            short = digests if digest_bytes == 32 else [d[:digest_bytes].ljust(32, b"\0") for d in digests]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in others] + [pa.array(digests, pa.binary()), pa.array(short, pa.binary())]
            names = [*(f.name for f in others), "sha", "digest"]
            if seen is not None and short:
                hit = seen.filter.has(_raw(short))
                if not seen.only:
                    columns, names = [*columns, pa.array(hit)], [*names, "hit"]
                    bodies = [b if h else None for b, h in zip(bodies, hit)]
                columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "body"]
                batch = pa.record_batch(columns, names=names)
                yield batch.filter(pa.array(hit)) if seen.only else batch
            elif short:
                yield pa.record_batch(columns, names=names)

    from pyspark.sql.types import BinaryType, BooleanType, StructType

    schema = StructType(list(others)).add("sha", BinaryType()).add("digest", BinaryType())
    if seen is not None:
        schema = (schema if seen.only else schema.add("hit", BooleanType())).add("body", BinaryType())
    found = docs.mapInArrow(run, schema)
    # the complement turns the order of all longs round, the least one's too
    order = F.col("doc_id") if keep == "min" else F.bitwise_not("doc_id")
    return found.withColumn("missing", F.col("doc_id").isNull().cast("int")).withColumn("key", F.coalesce(order, F.lit(0).cast("long")))


class Hits:
    """The filter of the digests of several rows, of bounded size; ``only`` leaves hits alone, else they are flagged."""

    def __init__(self, several: DataFrame, only: bool):
        count = several.count()
        bits = min(FILTER_BITS, 1 << max(12, (16 * count).bit_length()))
        self.only, self.filter = only, Bloom(bits)

        def probe(batches):
            for batch in batches:
                if batch.num_rows:
                    at = np.unique(self.filter.at(_raw(batch.column(0).to_pylist())).ravel())
                    word, which = np.unique(at >> 5, return_inverse=True)
                    value = np.zeros(len(word), np.int64)
                    np.bitwise_or.at(value, which, 1 << (at & 31))
                    yield pa.record_batch([pa.array(word), pa.array(value)], names=["word", "value"])

        # at most FILTER_BITS / 32 words reach the driver
        words = several.select("digest").mapInArrow(probe, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
        filled = np.zeros(bits // 32, dtype="<u4")
        filled[words.column("word").to_numpy()] = words.column("value").to_numpy().astype(np.uint32)
        self.filter.map = filled.view(np.uint8)


def _index(docs: DataFrame, keep: str, buckets: int | None, memtable_rows: int, digest_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The digested rows, numbered, and their index."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _digested(docs, digest_bytes, keep).withColumn("ref", F.monotonically_increasing_id())
    rows = materialize(rows, "digests")  # from here on the numbers stand
    return rows, build_index(rows, buckets, memtable_rows)


def exact_dedup(docs: DataFrame, keep: str = "min", key: str = "doc_id", text: str = "text", buckets: int | None = None, memtable_rows: int = 100_000, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``.

    ``keep`` is ``min`` or ``max``.  ``digest_bytes`` shortens the index's digest, for tests of collisions.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, index = _index(docs, keep, buckets, memtable_rows, digest_bytes)
    several = materialize(index.where("n > 1").select("digest", F.col("missing").alias("m"), F.col("key").alias("k"), F.col("ref").alias("r"), "n"), "several")
    hits = _digested(docs, digest_bytes, keep, Hits(several, only=True))
    # bytes decide: each digest of several rows must be one text
    texts = materialize(hits.groupBy("digest", "body").agg(F.count("*").alias("rows")).groupBy("digest").agg(F.count("*").alias("texts"), F.sum("rows").alias("rows")), "verified")
    clash = texts.where("texts > 1").select("digest")
    if clash.isEmpty():
        found = rows.join(several, "digest", "left")
    else:
        found = _collided(docs, rows, several, clash, keep, digest_bytes)
    alone = F.col("n").isNull()
    none = F.when(alone, F.col("missing")).otherwise(F.col("m")) == 1
    kept = F.when(alone, F.col("key")).otherwise(F.col("k"))
    return found.select(
        "doc_id",
        F.when(~none, kept if keep == "min" else F.bitwise_not(kept)).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("ref") == F.col("r"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _collided(docs: DataFrame, rows: DataFrame, several: DataFrame, clash: DataFrame, keep: str, digest_bytes: int) -> DataFrame:
    """As the join of rows and index, with rows of digests that several texts share grouped by their texts."""
    again = _digested(docs, digest_bytes, keep, Hits(clash, only=True)).join(clash, "digest", "left_semi")
    again = materialize(again.withColumn("ref", F.monotonically_increasing_id()), "collided")
    least = again.groupBy("digest", "body").agg(F.min(F.struct("missing", "key", "ref")).alias("_least"), F.count("*").alias("n"))
    least = least.select("digest", "body", F.col("_least.missing").alias("m"), F.col("_least.key").alias("k"), F.col("_least.ref").alias("r"), "n")
    apart = again.join(least, ["digest", "body"]).select("doc_id", "sha", "missing", "key", "ref", "m", "k", "r", "n")
    rest = rows.join(clash, "digest", "left_anti").join(several, "digest", "left")
    return rest.select(*apart.columns).unionByName(apart)


def deduplicate(docs: DataFrame, keep: str = "min", key: str = "doc_id", text: str = "text", buckets: int | None = None, memtable_rows: int = 100_000, digest_bytes: int = 32) -> DataFrame:
    """``docs`` without the rows whose text an earlier (``keep`` = min) or later (max) row has; columns unchanged.

    Rows whose digest the index has once pass by; the others are grouped by digest and bytes, where the least order key stays.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    _, index = _index(plain, keep, buckets, memtable_rows, digest_bytes)
    hits = Hits(index.where("n > 1"), only=False)
    row = docs.select(F.col(key).cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row"))
    inside = text if dict(docs.dtypes)[text] == "string" else None
    named = row if inside else docs.select(F.col(key).cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    flagged = _digested(named, digest_bytes, keep, hits, inside)
    single = flagged.where("NOT hit").select("row.*")
    kept = flagged.where("hit").groupBy("digest", "body").agg(F.min_by("row", F.struct("missing", "key")).alias("row"))
    return single.unionByName(kept.select("row.*"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)
"""
