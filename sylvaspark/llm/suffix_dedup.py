"""Suffix-array dedup [operator 8]: repeated byte strings from merged Burrows-Wheeler transforms.

A byte is removed when a string of ``length`` bytes that covers it also starts
earlier: in a text with a smaller identifier, or earlier in the same text.

Dealing.  Equal strings have to meet.  Every window of ``length`` bytes has an anchor,
the least hash of its 24-byte grams (the leftmost of ties), so equal windows have
equal anchors at equal places.  Neighbouring windows with the same anchor form one
segment.  Segments whose anchor occurs once in the corpus hold no repeated window and
stop there; the others travel with their bytes to a bucket by anchor.  Of equal segments only a task's earliest
travels with its bytes: the others start later and are removed whole.  Segments of an anchor
with more than ``HOT`` rows are dealt window by window, by the hash of the window's bytes, so no
bucket grows with a hot passage.

Search.  The strings of a bucket are cut into shards.  Each shard gets a
Burrows-Wheeler transform of its strings (rotations sorted by prefix doubling,
bounded by the window's length); shards are merged by iterative interleave
refinement (Holt and McMillan, 2014): starting from the plain concatenation of the
shards' orders, a stable sort by the transforms' symbols refines the interleave, up to
four symbols a round, without sorting suffixes again; it holds the suffixes that windows are ordered by, and
ends with the windows.  The round at which two neighbours part, told from the transforms' own symbols, gives their common prefix; neighbours whose common prefix
reaches ``length`` are in one repeated interval.  In each interval all occurrences but the earliest are marked.

Marked windows return to their texts as intervals, and the remaining bytes are
joined.  Copies of a whole text are collapsed by digest before, and get their result
from the first copy.  Texts are numbered by 64 bits of their digest; texts that share these take the next 64.

Nulls and the like: a null text is empty; a null identifier counts as the largest;
rows that repeat an identifier are not earlier than each other; equal rows lose the same bytes; texts shorter than
the length lose nothing; texts of any length are read whole; an empty table gives an empty result; no column but
those named is read, so names cannot clash.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, signed, text_bytes
from .texthash import U, mix

GRAM = 24
LENGTH = 100
#: Windows hashed at once; bytes of a shard (its ranks must fit 16 bits), and of the shards that are merged into one.
BLOCK, SHARD, MERGED = 1 << 16, 1 << 15, 1 << 17
#: Bytes of segments that a task remembers while it looks for equal ones.
KEPT = 48_000_000
#: Rows of an anchor from which on its segments are dealt window by window.
HOT = 100_000
_LAST = 2**63 - 1
_TABLE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_power = np.ones(1, dtype=np.uint64)
_unpower = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse.  The hash deals windows; strings are compared by their bytes."""
    global _power, _unpower
    if len(_power) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _power, _unpower = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (_BASE, _INVERSE))
    return _power[:n], _unpower[:n]


def segments(body: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the segments of one text."""
    data = np.frombuffer(body, np.uint8)
    windows = len(data) - length + 1
    anchors, firsts, sizes = [], [], []
    span = length - GRAM + 1
    for at in range(0, windows, BLOCK):
        n = min(BLOCK, windows - at)
        part = data[at : at + n + length - 1]
        power, unpower = _powers(len(part) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(_TABLE[part] * power[: len(part)], dtype=np.uint64)])
        gram = mix((total[GRAM:] - total[:-GRAM]) * unpower[: len(part) - GRAM + 1])
        # the place in the low bits makes the leftmost of equal grams the least
        key = (gram & ~U(0x1FFFF)) | np.arange(len(gram), dtype=np.uint64)
        least, width = key, 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & U(0x1FFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        anchors.append(gram[place[new]])
        firsts.append(new + at)
        sizes.append(np.diff(np.append(new, n)))
    if not anchors:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(sizes)


def _ranked(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of positions that stand in ``order`` by their keys, and the number of ranks."""
    new = np.zeros(len(order) - 1, bool)
    for k in keys:
        held = k[order]
        new |= held[1:] != held[:-1]
    place = np.zeros(len(order), np.int64)
    np.cumsum(new, out=place[1:])
    rank = np.empty(len(order), np.uint16 if place[-1] < 1 << 16 else np.int64)
    rank[order] = place
    return rank, int(place[-1]) + 1


def _pairs(symbols: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, int]:
    """Two symbols at once, ``after`` being those that follow, as dense codes that sort as they do; and the number of codes."""
    code = symbols.astype(np.int64) * 257 + after
    there = np.zeros(257 * 257, bool)
    there[code] = True
    dense = np.cumsum(there) - 1
    n = int(dense[-1]) + 1
    return dense.astype(np.uint16 if n <= 1 << 16 else np.int64)[code], n


def _codes(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols from each position on, several at once, as dense codes that sort as they do, and how many.

    That number is the largest of 4, 2 and 1 with at most 65,536 codes, which NumPy sorts by radix.  Codes past the end are padded.
    """
    pair, n = _pairs(symbols, np.append(symbols[1:], 0))
    if n > 1 << 16:
        return symbols, 1
    after = np.append(pair[2:], [0] * min(2, len(pair))).astype(np.uint16)
    order = np.argsort(after, kind="stable")
    four, n = _ranked(order[np.argsort(pair[order], kind="stable")], pair, after)
    return (pair, 2) if n > 1 << 16 else (four, 4)


class Shard:
    """A set of strings, their suffixes in the order of the first ``depth`` symbols, and the transform of that order.

    Symbols are bytes plus 1; 0 ends each string, and strings are taken round.
    """

    def __init__(self, texts: list[bytes], depth: int):
        joined = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + np.uint16(1)
        cut = np.cumsum([len(t) for t in texts])
        self.symbols = np.insert(joined, cut, 0)
        n = len(self.symbols)
        self.ends = cut + np.arange(len(texts))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.before = np.arange(-1, n - 1)
        self.before[self.starts] = self.ends
        after = np.arange(1, n + 1)
        after[self.ends] = self.starts
        rank, different = _pairs(self.symbols, self.symbols[after])
        order, width = np.argsort(rank, kind="stable"), 2
        before, after = self.before[self.before], after[after]
        while width < depth and different < n:  # prefix doubling
            # in front of the ordered suffixes stand suffixes that are in the order of their second halves
            order = before[order]
            order = order[np.argsort(rank[order], kind="stable")]
            rank, different = _ranked(order, rank, rank[after])
            before, after, width = before[before], after[after], width * 2
        self.order = order


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, common) of all windows of ``depth`` symbols in merged order; a place counts through the shards' symbols one after the other.

    The interleave starts as the shards' orders one after the other and is refined by the
    transforms: in each round the suffixes stand in the order of their first r symbols, each
    is preceded by the symbols of its transform, and a stable sort by these gives the order
    of the suffixes that begin there.  The shards' suffixes are never compared to order them.  A window's order comes from
    the suffixes that begin in it and behind it, so it starts with those that have ``depth`` symbols of their string in front and
    takes no other along: none of them passes its string's beginning, and the positions in front are counted, not looked up.
    In the end neighbours are compared by the same codes, a round's symbols at a time and as long as they agree: ``common`` is the
    number of symbols that a window shares with the one before it, rounded down to a round's symbols.
    """
    sizes = np.array([len(s.symbols) for s in shards])
    base = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.concatenate([s.symbols for s in shards])
    code, width = _codes(symbols)
    if depth % width:
        code, width = symbols, 1
    begin = np.concatenate([s.starts + b for s, b in zip(shards, base)])
    inner = np.arange(len(symbols)) - np.repeat(begin, np.diff(np.append(begin, len(symbols)))) >= depth
    now = np.concatenate([s.order + b for s, b in zip(shards, base)])
    now = now[inner[now]]
    for _ in range(depth // width):
        now -= width
        now = now[np.argsort(code[now], kind="stable")]
    common = np.full(len(now), depth, np.int32)
    common[:1] = 0
    alike, left, right = np.arange(1, len(now)), now[:-1], now[1:]
    for r in range(depth // width):
        agree = code[left] == code[right]
        if not agree.all():
            common[alike[~agree]] = r * width
            alike, left, right = alike[agree], left[agree], right[agree]
        left, right = left + width, right + width
    return now, common


def windows(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, interval) of all windows of ``length`` bytes, by text and start; equal windows, and only they, share an interval."""
    shards, held, at = [], [], 0
    for t in texts:
        if held and at + len(t) + len(held) > SHARD:
            shards.append(Shard(held, length))
            held, at = [], 0
        held.append(t)
        at += len(t)
    if held:
        shards.append(Shard(held, length))
    place, common = merge(shards, length)
    sizes = np.array([len(t) for t in texts])
    n = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), n)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    shared = np.empty(int((sizes + 1).sum()), np.int64)
    shared[place] = np.cumsum(common < length) - 1
    return text, start, shared[np.repeat(np.cumsum(sizes + 1) - sizes - 1, n) + start]


def marked(segment: np.ndarray, texts: list[bytes], tid: np.ndarray, first_id: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tid, from, to) byte ranges of windows that also start earlier.

    Occurrence i is text ``segment[i]`` in document ``tid[i]`` (of identifier ``first_id[i]``) from byte ``at[i]``.
    """
    sizes = np.array([len(t) for t in texts])
    least = np.full(len(texts), _LAST)
    np.minimum.at(least, segment, first_id)
    later = first_id > least[segment]  # all of its windows are in an earlier document
    out = [(tid[later], at[later], at[later] + sizes[segment[later]])]
    text, start, interval = windows(texts, length)
    smallest = np.full(int(interval.max()) + 1, _LAST)
    np.minimum.at(smallest, interval, least[text])
    # each window of the segments' earliest occurrences
    cut = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
    mine = np.flatnonzero(~later)
    n = np.diff(cut)[segment[mine]]
    occurrence = np.repeat(mine, n)
    window = np.repeat(cut[segment[mine]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    v, place = interval[window], at[occurrence] + start[window]
    flag = first_id[occurrence] > smallest[v]
    # the rest are in documents of the smallest identifier: there, all but the first place in each
    rest = np.flatnonzero(~flag)
    often = rest[np.bincount(v[rest], minlength=len(smallest))[v[rest]] > 1]
    order = often[np.lexsort((place[often], tid[occurrence[often]], v[often]))]
    owner = tid[occurrence[order]]
    same = (v[order][1:] == v[order][:-1]) & (owner[1:] == owner[:-1]) & (place[order][1:] > place[order][:-1])
    flag[order[1:][same]] = True
    hit = np.flatnonzero(flag)
    if len(hit):
        new = np.concatenate([[True], (occurrence[hit][1:] != occurrence[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)])
        begin = hit[new]
        end = hit[np.concatenate([new[1:], [True]])]
        out.append((tid[occurrence[begin]], place[begin], place[end] + length))
    return tuple(np.concatenate(x) for x in zip(*out))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, doc_id, text, one, two): the identifier with null last, and two halves of the text's digest."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.col(key).cast("long").alias("doc_id"), body.alias("text"))
    sha = F.sha2("text", 256)
    return d.withColumn("one", signed(sha)).withColumn("two", signed(F.substring(sha, 17, 16)))


def _numbered(texts: DataFrame) -> DataFrame:
    """``texts`` with ``tid`` instead of the halves: the first, or the second where two texts share the first."""
    # N * N / 2**65 shared halves are to be expected, 300 among 10**11 texts
    clash = [r["one"] for r in texts.groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("high")).where("low <> high").select("one").collect()]
    tid = F.when(F.col("one").isin(clash), F.col("two")).otherwise(F.col("one")) if clash else F.col("one")
    return texts.select("id", "doc_id", "text", tid.alias("tid"))


def _anchored(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, tid, first, size) of every text's segments, once per task."""

    def run(batches):
        seen: set[int] = set()
        held: list[tuple] = []

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            return pa.record_batch([pa.array(x) for x in columns], names=["anchor", "tid", "first", "size"])

        for batch in batches:
            for tid, body in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if len(body) >= length and tid not in seen:
                    seen.add(tid)
                    a, first, size = segments(body, length)
                    held.append((a.view(np.int64), np.full(len(a), tid), first.astype(np.int32), size.astype(np.int32)))
                    if len(held) == 256:
                        yield flush()
        if held:
            yield flush()

    return texts.select("tid", "text").mapInArrow(run, "anchor long, tid long, first int, size int")


def _several(rows: DataFrame) -> DataFrame:
    """The segments whose anchor occurs more than once; a sorted scan that holds one row between batches."""

    def run(batches):
        last = None
        names = ["anchor", "tid", "first", "size"]
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            before = False
            if last is not None:
                c, before = [np.concatenate([x, y]) for x, y in zip(last[0], c)], last[1]
            a, t, f, _ = c
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1]) | (f[1:] != f[:-1])])  # copies met in several tasks
            c = [x[new] for x in c]
            a = c[0]
            follows = np.concatenate([[before], a[1:] == a[:-1]])
            keep = follows | np.concatenate([a[1:] == a[:-1], [False]])
            last = [x[-1:] for x in c], bool(follows[-1])
            keep[-1] = False
            if keep.any():
                yield pa.record_batch([pa.array(x[keep]) for x in c], names=names)
        if last is not None and last[1]:
            yield pa.record_batch([pa.array(x) for x in last[0]], names=names)

    return rows.repartition(F.col("anchor")).sortWithinPartitions("anchor", "tid", "first").mapInArrow(run, "anchor long, tid long, first int, size int")


def _cut_out(packs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, tid, id, first, size, body): the bytes of the segments of each text's first copy, as far as a task meets them first.

    A later occurrence of the same bytes has no body: all of it is removed.  Segments of hot anchors are cut into windows.
    """

    def run(batches):
        seen: dict[tuple[int, bytes], int] = {}
        held: list[tuple] = []
        size = 0

        def flush():
            columns = zip(*held)
            out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            held.clear()
            return out

        def put(anchor, tid, i, first, body) -> bool:
            """Whether the task meets these bytes for the first time."""
            nonlocal size
            before = seen.get((anchor, body))
            if before is not None and before < i:
                held.append((mix(np.array([tid], np.int64).view(np.uint64)).view(np.int64)[0] ^ first, tid, i, first, len(body), None))
                return False
            if before is None:
                size += len(body) + 200
            seen[anchor, body] = i
            held.append((anchor, tid, i, first, len(body), body))
            return True

        for batch in batches:
            tids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for tid, i, body, rows in zip(tids, ids, text_bytes(batch.column(2)), batch.column(3)):
                for anchor, first, n, hot in zip(*(rows.values.field(x).to_pylist() for x in range(4))):
                    part = body[first : first + n + length - 1]
                    if not hot:
                        put(anchor, tid, i, first, part)
                    elif seen.get((anchor, part), i) >= i:
                        seen[anchor, part] = i
                        size += len(part) + 200
                        for j in range(n):
                            window = part[j : j + length]
                            put(int.from_bytes(blake2b(window, digest_size=8).digest(), "little", signed=True), tid, i, first + j, window)
                    else:
                        held.append((tid ^ first, tid, i, first, len(part), None))
                if len(held) > 10_000:
                    yield flush()
                if size > KEPT:
                    seen.clear()
                    size = 0
        if held:
            yield flush()

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["anchor", "tid", "id", "first", "size", "body"]
    joined = texts.join(packs, ["tid", "id"]).select("tid", "id", "text", "rows")
    return joined.mapInArrow(run, "anchor long, tid long, id long, first int, size int, body binary")


def _search(rows: DataFrame, length: int) -> DataFrame:
    """(tid, a, b): byte ranges to remove, from the segments dealt by anchor."""

    def run(batches):
        texts: list[bytes] = []
        group: dict[bytes, int] = {}
        held: list[list] = [[], [], [], []]
        size, last = 0, None

        def flush():
            nonlocal size
            seg, tid, ids, first = (np.array(x, np.int64) for x in held)
            out = marked(seg, texts, tid, ids, first, length)
            for x in (texts, *held):
                x.clear()
            size = 0
            return pa.record_batch([pa.array(x.astype(np.int64)) for x in out], names=["tid", "a", "b"])

        for batch in batches:
            gone = batch.filter(batch.column(5).is_null())
            if gone.num_rows:
                tid, first, n = (gone.column(i).to_numpy().astype(np.int64) for i in (1, 3, 4))
                yield pa.record_batch([pa.array(tid), pa.array(first), pa.array(first + n)], names=["tid", "a", "b"])
                batch = batch.filter(batch.column(5).is_valid())
            anchors, tids, ids, firsts = (batch.column(i).to_pylist() for i in range(4))
            for anchor, tid, i, first, body in zip(anchors, tids, ids, firsts, batch.column(5).to_pylist()):
                if anchor != last:
                    group.clear()
                    if size > MERGED:
                        yield flush()
                    last = anchor
                at = group.get(body)
                if at is None:
                    at = group[body] = len(texts)
                    texts.append(body)
                    size += len(body)
                size += 32
                for x, v in zip(held, (at, tid, i, first)):
                    x.append(v)
        if held[0]:
            yield flush()

    dealt = rows.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "tid long, a long, b long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): one row for each row of ``docs``; kept is the remaining bytes."""
    if length % 4 or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of 4 and at least {2 * GRAM}")
    texts = _numbered(_identified(docs, key, text))
    firsts = materialize(texts.groupBy("tid").agg(F.min("id").alias("id")), "firsts")
    found = materialize(_several(_anchored(texts, length)), "segments")
    hot = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
    if hot.isEmpty():
        flagged = found.withColumn("hot", F.lit(False))
    else:
        flagged = found.join(hot.withColumn("_hot", F.lit(True)), "anchor", "left").withColumn("hot", F.coalesce("_hot", F.lit(False)))
    packs = flagged.groupBy("tid").agg(F.collect_list(F.struct("anchor", "first", "size", "hot")).alias("rows")).join(firsts, "tid")
    ranges = materialize(_search(_cut_out(packs, texts, length), length), "ranges")
    release(found)
    per_text = ranges.groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    # read from a table, so that the join of a text with very many copies can be split
    facts = materialize(firsts.withColumnRenamed("id", "first_id").join(per_text, "tid", "left"), "facts")
    release(ranges)

    def run(batches):
        for batch in batches:
            rows = []
            for i, first, body, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3)), batch.column(4)):
                if i > first:
                    spans = [(0, len(body))] if len(body) >= length else []
                elif not r.is_valid:
                    spans = []
                else:
                    a, b = (r.values.field(x).to_numpy() for x in range(2))
                    order = np.argsort(a, kind="stable")
                    a, reach = a[order], np.maximum.accumulate(b[order])
                    new = np.concatenate([[True], a[1:] > reach[:-1]])
                    spans = list(zip(a[new].tolist(), reach[np.concatenate([new[1:], [True]])].tolist()))
                kept, at = [], 0
                for x, y in spans:
                    kept.append(body[at:x])
                    at = y
                kept.append(body[at:])
                left = b"".join(kept)
                rows.append((len(body), len(body) - len(left), len(spans), [{"a": x, "b": y} for x, y in spans], left))
            types = [pa.int64()] * 3 + [pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = texts.join(facts, "tid").select("doc_id", "id", "first_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<a: long, b: long>>, kept binary")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
