"""LM scoring [operator 10]: stupid backoff, computed from n-gram count tables dealt by hash.

Words are runs other than white space, A-Z lower-cased, and every word keeps its own
count.  An n-gram seen ``min_count`` times or more scores its count over its context's; any other
takes ``backoff`` times the score of the n-gram without its first word, down to c(w) / N.

:func:`score` is the plan for order two.  Unigram counts are one pre-aggregated table over all documents.  Words with a
share of 1/``VOCABULARY`` or more of all words, at most that many, have their counts
broadcast; the others are rare words, whose counts are dealt by hash.  Bigrams with a share of
``HOT_SHARE`` or more, at most 2 / ``HOT_SHARE``, are found in the same pass, counted in a second one and scored where they
stand, so that no bucket has a hot key.  This steers the work and never the result.

All other bigrams of the documents, counted per document, are dealt by the hash of the
bigram: the part of the count table with that hash is summed where it is joined to
the exploded bigrams, so neither the table nor its join is shuffled a second time.
They travel as blocks of a few hundred documents, a bigram in six bytes and its
count.  A bigram with one rare word is dealt by that word instead, as fingerprint, and
meets the word's count in its bucket; bigrams of two rare words are rows of their own,
joined by hash with the one count they need.  A rare word has few occurrences, so no
key of these is frequent.  Logarithms are rounded to
millionths, so that sums are exact and agree in every order; a bucket returns each
block's sums as one row, and they are added per block and then per document.

:func:`score_by_tables` has any order, on plain DataFrames: n-grams exploded to rows, one count table per order,
and joins by n-gram and context.  Rows, not blocks, travel in it.

Nulls and the like: a null or blank text has no words, logprob 0 and a null average;
rows that repeat an identifier, null included, are one document, and their sums add
up; texts of any length are read whole; an empty table gives an empty result; no column but those named is read, so names
cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize, slices, text_bytes
from .texthash import U, mix, words

VOCABULARY = 1_000_000
HOT_SHARE = 1 / 16384
BLOCK = 1_000_000
#: Parts that a bucket is counted in, for the sake of memory.
PARTS = 4
_BITS = 21  # ids of frequent words, of any rare one and of the start
_MICRO = 1e6


def _blocks(column: pa.Array):
    """(first row, last row, fingerprints of all words, where each text's begin) of blocks of texts."""
    bodies = list(text_bytes(column))
    for a, b in chunks(np.array([len(x) for x in bodies]), BLOCK):
        (h,), at = words(bodies[a:b], 1)
        yield a, b, h, at


def unigrams(docs: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """(word, after, n): the fingerprint and count of every word of all texts, and with ``after`` what a block counts of bigrams frequent in it.

    A bigram with a share of ``hot_share`` has half of its occurrences at least in blocks where it has half that share.
    """

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            w, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return w, np.bincount(at, np.concatenate([x[1] for x in held])).astype(np.int64)

        def out(w, n, after=None):
            follows = pa.nulls(len(w), pa.int64()) if after is None else pa.array(after.view(np.int64))
            return pa.record_batch([pa.array(w.view(np.int64)), follows, pa.array(n)], names=["word", "after", "n"])

        for batch in slices(batches):
            for _, _, h, at in _blocks(batch.column(0)):
                held.append(np.unique(h, return_counts=True))
                if len(h) > 1:
                    inside = np.ones(len(h), dtype=bool)
                    inside[at[:-1][at[:-1] < len(h)]] = False
                    second = np.flatnonzero(inside)
                    pair = mix(h[second - 1] * U(0x9E3779B97F4A7C15) + h[second] * U(0xC2B2AE3D27D4EB4F))
                    _, first, n = np.unique(pair, return_index=True, return_counts=True)
                    often = 2 * n >= hot_share * len(h)
                    here = second[first[often]]
                    yield out(h[here - 1], n[often].astype(np.int64), h[here])
            if sum(len(x[0]) for x in held) > 2_000_000:
                held = [merged()]
        if held:
            w, n = merged()
            for i in range(0, len(w), 100_000):
                yield out(w[i : i + 100_000], n[i : i + 100_000])

    return docs.select("text").mapInArrow(run, "word long, after long, n long").groupBy("word", "after").agg(F.sum("n").alias("n"))


def hot_bigrams(docs: DataFrame, vocabulary, hot: np.ndarray) -> dict[int, int]:
    """The counts of the bigrams ``hot`` (sorted keys of two ids) over all texts."""

    def run(batches):
        vocab = vocabulary.value[0]
        total = np.zeros(len(hot), np.int64)
        for batch in slices(batches):
            for _, _, h, at in _blocks(batch.column(0)):
                if len(h):
                    _, ids, before, _ = _pairs(h, at, vocab)
                    place, known = _among((before << _BITS) | ids, hot)
                    total += np.bincount(place[known], minlength=len(hot))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hot[seen]), pa.array(total[seen])], names=["key", "n"])

    if not len(hot):
        return {}
    rows = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"]: r["n"] for r in rows}


def _among(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, table[place] == keys


class Rule:
    """Scores of bigrams in millionths of a natural logarithm, and whether they backed off."""

    def __init__(self, total: int, backoff: float, min_count: int):
        self.total, self.backoff, self.min_count = total, backoff, min_count

    def __call__(self, seen: np.ndarray, first: np.ndarray, cv: np.ndarray, cw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = (seen >= self.min_count) & ~first
        s = np.where(hit, seen / cv, np.where(first, 1.0, self.backoff) * cw / self.total)
        return np.rint(np.log(s) * _MICRO).astype(np.int64), ~hit & ~first


def _sums(doc: np.ndarray, n: np.ndarray, units: np.ndarray, missed: np.ndarray, size: int) -> np.ndarray:
    """(3 x documents) words, backed off and millionths; sums of millionths stay whole numbers below 2**53."""
    n = n.astype(float)
    return np.stack([np.bincount(doc, n * x, size) for x in (np.ones(len(n)), missed.astype(float), units.astype(float))]).astype(np.int64)


_BUCKET = "bucket long, block string, docs array<long>, doc binary, low binary, high binary, n binary, rare binary"
_PAIR = "doc_id long, v long, w long, n long"


def _deal(words_: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(words_) % U(buckets)).astype(np.int32)


def _distinct(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each document's distinct keys with their counts: (doc, *keys, n)."""
    order = np.lexsort((*keys, doc))
    columns = [x[order] for x in (doc, *keys)]
    new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)])) if len(order) else order
    return *(x[new] for x in columns), np.diff(np.append(new, len(order)))


def _pairs(h: np.ndarray, at: np.ndarray, vocab: np.ndarray):
    """Every word's document, id, fingerprint, and the same of the word before it."""
    unknown, start = len(vocab), len(vocab) + 1
    ids = np.full(len(h), unknown, np.int64)
    if len(vocab):
        place = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        ids = np.where(vocab[place] == h, place, unknown)
    before = np.concatenate([[start], ids[:-1]])
    begins = at[:-1][at[1:] > at[:-1]]
    before[begins] = start
    return np.repeat(np.arange(len(at) - 1), np.diff(at)), ids, before, np.concatenate([h[:1], h[:-1]])


def bigrams(docs: DataFrame, vocabulary, hot, rule: Rule, buckets: int) -> DataFrame:
    """Blocks of the documents' bigrams, dealt by hash: each document's distinct bigrams with their counts, but for those of two rare words.

    What the broadcast counts can score (hot bigrams, and frequent words at the start) is a row of sums per block, in a bucket of its own below 0.
    """

    def run(batches):
        from pyspark import TaskContext

        task, blocks = TaskContext.get().partitionId(), 0
        vocab, count = vocabulary.value
        hot_keys, hot_seen = hot.value
        unknown, start = len(vocab), len(vocab) + 1
        for batch in slices(batches):
            who = batch.column(0).to_pylist()
            for a, b, h, at in _blocks(batch.column(1)):
                if not len(h):
                    continue
                doc, ids, before, last = _pairs(h, at, vocab)
                key = (before << _BITS) | ids
                second, first = ids == unknown, before == unknown
                plain, mixed = ~(second | first), second ^ first
                doc1, key1, n1 = _distinct(doc[plain], key[plain])
                v, w = key1 >> _BITS, key1 & ((1 << _BITS) - 1)
                place, known = _among(key1, hot_keys)
                known |= v == start
                seen = hot_seen[np.where(known & (v != start), place, len(hot_seen) - 1)]
                units, missed = rule(seen[known], v[known] == start, count[v[known]], count[w[known]])
                sums = _sums(doc1[known], n1[known], units, missed, b - a)
                doc1, key1, n1 = doc1[~known], key1[~known], n1[~known]
                doc2, key2, rare, n2 = _distinct(doc[mixed], key[mixed], np.where(second, h, last)[mixed])
                doc, key, n = np.concatenate([doc1, doc2]), np.concatenate([key1, key2]).astype(np.uint64), np.concatenate([n1, n2]).astype(np.uint32)
                bucket = np.concatenate([_deal(key1.astype(np.uint64), buckets), _deal(rare, buckets)])
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                name, blocks = f"{task}-{blocks}", blocks + 1
                rows = [(-1 - ((task << 24) | blocks), name, who[a:b], sums.tobytes(), b"", b"", b"", b"")]
                for i in np.flatnonzero(np.diff(cut)):
                    one = order[cut[i] : cut[i + 1]]
                    present, local = np.unique(doc[one], return_inverse=True)
                    k, late = key[one], one[one >= len(key1)] - len(key1)
                    rows.append((int(i), name, [who[a + d] for d in present], local.astype(np.uint16).tobytes(), (k & U(0xFFFFFFFF)).astype(np.uint32).tobytes(), (k >> U(32)).astype(np.uint16).tobytes(), n[one].tobytes(), rare[late].tobytes()))
                types = [pa.int64(), pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 5]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _BUCKET.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _BUCKET)


def rare_bigrams(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, v, w, n): the distinct bigrams of two rare words, as fingerprints."""

    def run(batches):
        vocab = vocabulary.value[0]
        for batch in slices(batches):
            for a, _, h, at in _blocks(batch.column(1)):
                if not len(h):
                    continue
                doc, ids, before, last = _pairs(h, at, vocab)
                both = (ids == len(vocab)) & (before == len(vocab))
                doc, v, w, n = _distinct(doc[both], last[both], h[both])
                yield pa.record_batch([batch.column(0).take(pa.array(doc + a)), pa.array(v.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["doc_id", "v", "w", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, _PAIR)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", backoff: float = 0.4, min_count: int = 2, most: int = VOCABULARY, hot_share: float = HOT_SHARE, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_backoff, logprob, avg_logprob): one row for each identifier of ``docs``."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = materialize(unigrams(docs, hot_share), "unigrams")
    counts = found.where("after IS NULL").select("word", "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * most >= total
    known = counts.where(frequent).toArrow()  # at most ``most`` words
    h, c = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(h)
    vocab, c = h[order], c[order]
    vocabulary = spark.sparkContext.broadcast((vocab, np.append(c, [0, 1]).astype(np.float64)))
    rare_counts = counts.where(~frequent)
    rule = Rule(total, backoff, min_count)

    pairs = found.where("after IS NOT NULL").where(F.col("n") * 2 >= hot_share * total).select("word", "after").toArrow()  # at most 2 / hot_share
    sides = [_among(pairs.column(x).to_numpy().view(np.uint64), vocab) for x in ("word", "after")]
    both = sides[0][1] & sides[1][1]
    hot = np.sort(((sides[0][0] << _BITS) | sides[1][0])[both]) if len(both) else np.zeros(0, np.int64)
    exact = hot_bigrams(docs, vocabulary, hot)
    hot_counts = spark.sparkContext.broadcast((hot, np.array([*(exact.get(k, 0) for k in hot.tolist()), 0], dtype=np.float64)))

    def dealt(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(_deal(batch.column(0).to_numpy().view(np.uint64), buckets).astype(np.int64)), batch.column(0), batch.column(1)], names=["bucket", "word", "n"])

    def join(group: pa.Table, rare: pa.Table) -> pa.Table:
        if not group.num_rows:  # rare words that only follow or precede rare words
            return pa.table({"block": pa.array([], pa.string()), "docs": pa.array([], pa.list_(pa.int64())), "sums": pa.array([], pa.binary())})
        if group.column("bucket")[0].as_py() < 0:
            return pa.table({"block": group.column("block"), "docs": group.column("docs"), "sums": group.column("doc")})
        count = vocabulary.value[1]
        unknown, start = len(count) - 2, len(count) - 1
        word, times = rare.column("word").to_numpy().view(np.uint64), rare.column("n").to_numpy().astype(np.float64)
        order = np.argsort(word)
        word, times = word[order], np.append(times[order], 0.0)
        parts, sizes = [], []
        for docs_, doc, low, high, n, fingerprints in zip(*(group.column(x) for x in ("docs", "doc", "low", "high", "n", "rare"))):
            k = np.frombuffer(low.as_py(), np.uint32).astype(np.int64) | (np.frombuffer(high.as_py(), np.uint16).astype(np.int64) << 32)
            v, w = k >> _BITS, k & ((1 << _BITS) - 1)
            mixed = (v == unknown) | (w == unknown)
            if mixed.any():  # the rare word's place in this bucket, the other word and the side
                v, w = v[mixed], w[mixed]
                place = np.searchsorted(word, np.frombuffer(fingerprints.as_py(), np.uint64))
                k[mixed] = (1 << 62) | (place << (_BITS + 1)) | (np.where(w == unknown, v, w) << 1) | (w == unknown)
            parts.append((k, np.frombuffer(n.as_py(), np.uint32), np.frombuffer(doc.as_py(), np.uint16).astype(np.int32) + np.int32(sum(sizes[-1:]))))
            sizes.append(sum(sizes[-1:]) + len(docs_))
        k, n, doc = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        part = (mix(k.view(np.uint64)) & U(PARTS - 1)).astype(np.uint8)
        sums = np.zeros((3, sizes[-1]), np.int64)
        for i in range(PARTS):  # this hash range of the bigram table, a part at a time
            here = part == i
            distinct, place = np.unique(k[here], return_inverse=True)
            seen = np.bincount(place, n[here], len(distinct))
            mixed, second = distinct >> 62 == 1, (distinct & 1).astype(bool)
            other = (distinct >> 1) & ((1 << _BITS) - 1)
            own = times[np.where(mixed, (distinct & ~(1 << 62)) >> (_BITS + 1), -1)]
            v = np.where(mixed, np.where(second, other, unknown), distinct >> _BITS)
            w = np.where(mixed, np.where(second, unknown, other), distinct & ((1 << _BITS) - 1))
            cv, cw = np.where(mixed & ~second, own, count[v]), np.where(mixed & second, own, count[w])
            units, missed = rule(seen, v == start, cv, cw)
            sums += _sums(doc[here], n[here], units[place], missed[place], sizes[-1])
        packed = [sums[:, x:y].tobytes() for x, y in zip([0, *sizes[:-1]], sizes)]
        return pa.table({"block": group.column("block"), "docs": group.column("docs"), "sums": pa.array(packed, pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        found: dict = {}
        for docs_, sums in zip(group.column("docs"), group.column("sums")):
            for who, *x in zip(docs_.as_py(), *np.frombuffer(sums.as_py(), np.int64).reshape(3, -1).tolist()):
                if who in found:
                    found[who] = [a + b for a, b in zip(found[who], x)]
                else:
                    found[who] = x
        columns = zip(*found.values())
        return pa.table({"doc_id": pa.array(list(found), pa.int64()), **{c: pa.array(x, pa.int64()) for c, x in zip(("words", "missed", "units"), columns)}})

    table = rare_counts.mapInArrow(dealt, "bucket long, word long, n long")
    parts = bigrams(docs, vocabulary, hot_counts, rule, buckets).groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(join, "block string, docs array<long>, sums binary")
    partial = parts.groupBy("block").applyInArrow(add, "doc_id long, words long, missed long, units long")
    blank = docs.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("words", "missed", "units")))
    seen = rare_bigrams(docs, vocabulary).withColumn("seen", F.sum("n").over(Window.partitionBy("v", "w")))
    hit = F.col("seen") >= min_count
    met = seen.withColumn("word", F.when(hit, F.col("v")).otherwise(F.col("w"))).join(rare_counts.select("word", F.col("n").cast("double").alias("c")), "word")
    s = F.when(hit, F.col("seen") / F.col("c")).otherwise(F.lit(float(backoff)) * F.col("c") / F.lit(float(total)))
    units = F.rint(F.log(s) * _MICRO).cast("long")
    rare = met.groupBy("doc_id").agg(F.sum("n").alias("words"), F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("missed"), F.sum(F.col("n") * units).alias("units"))
    return _result(materialize(_added(partial.unionByName(rare).unionByName(blank)), "scores"))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("doc_id").agg(F.sum("words").alias("n_words"), F.sum("missed").alias("n_backoff"), F.sum("units").alias("units"))


def _result(sums: DataFrame) -> DataFrame:
    logprob = F.col("units") / F.lit(_MICRO)
    return sums.select("doc_id", "n_words", "n_backoff", logprob.alias("logprob"), F.when(F.col("n_words") > 0, logprob / F.col("n_words")).alias("avg_logprob"))


def exploded(docs: DataFrame, order: int) -> DataFrame:
    """(doc_id, size, gram, context, shorter, n): each document's distinct n-grams of its words, the longest that each word ends.

    A word has as many words before it as ``order`` and the text allow; ``shorter`` is the n-gram without its first word.
    """
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("ws")).select("doc_id", "ws", F.posexplode("ws").alias("i", "w"))
    size = F.least(F.col("i") + 1, F.lit(order))
    return rows.select("doc_id", size.alias("size"), F.slice("ws", F.col("i") + 2 - size, size).alias("gram")).groupBy("doc_id", "size", "gram").agg(F.count("*").alias("n"))


def score_by_tables(docs: DataFrame, order: int = 3, key: str = "doc_id", text: str = "text", backoff: float = 0.4, min_count: int = 2) -> DataFrame:
    """As :func:`score`, of any order: n-grams exploded to rows, one count table per order, joins by n-gram and by context.

    ``n_backoff`` counts the words that backed off at least once from the longest n-gram that ends in them.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    grams = materialize(exploded(docs, order), "grams")
    tables = {}
    for k in range(1, order + 1):  # an n-gram of k words is the end of every longer row
        tail = grams.where(F.col("size") >= k).select(F.slice("gram", F.col("size") - k + 1, F.lit(k)).alias("gram"), "n")
        tables[k] = materialize(tail.groupBy("gram").agg(F.sum("n").cast("double").alias("c")), f"counts{k}")
    total = tables[1].agg(F.sum("c")).first()[0] or 1.0
    left = grams.select("doc_id", "size", "gram", "n", F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("s"))
    done = None
    for k in range(order, 0, -1):
        here = left.where(F.col("size") == k)
        rest = left.where(F.col("size") < k)
        at = here.join(tables[k].withColumnRenamed("c", "seen"), "gram")
        if k > 1:
            context = tables[k - 1].select(F.col("gram").alias("context"), F.col("c").alias("of"))
            at = at.withColumn("context", F.slice("gram", 1, k - 1)).join(context, "context")
            hit = at.where(F.col("seen") >= min_count).withColumn("s", F.col("weight") * F.col("seen") / F.col("of"))
            miss = at.where(F.col("seen") < min_count).withColumn("weight", F.col("weight") * backoff).withColumn("gram", F.slice("gram", 2, k - 1)).withColumn("size", F.lit(k - 1))
            left = rest.unionByName(miss.select(*rest.columns))
        else:
            hit = at.withColumn("s", F.col("weight") * F.col("seen") / total)
        part = hit.select("doc_id", "n", (F.col("weight") < 1).alias("missed"), F.rint(F.log("s") * _MICRO).cast("long").alias("units"))
        done = part if done is None else done.unionByName(part)
    parts = done.select("doc_id", F.col("n").alias("words"), F.when(F.col("missed"), F.col("n")).otherwise(0).alias("missed"), (F.col("n") * F.col("units")).alias("units"))
    blank = docs.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("words", "missed", "units")))
    return _result(_added(parts.unionByName(blank)))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
u AS (SELECT w, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY w),
tot AS (SELECT CAST(sum(c) AS DOUBLE) AS total FROM u),
p AS (SELECT doc_id, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, w FROM t),
b AS (SELECT v, w, count(*) AS n FROM p GROUP BY v, w),
s AS (SELECT b.v, b.w, b.v IS NOT NULL AND b.n < 2 AS missed,
      CAST(round_even(ln(CASE WHEN b.v IS NULL THEN 1.0::DOUBLE * uw.c / total WHEN b.n >= 2 THEN b.n / uv.c ELSE 0.4::DOUBLE * uw.c / total END) * 1000000, 0) AS BIGINT) AS units
      FROM b JOIN u uw ON uw.w = b.w LEFT JOIN u uv ON uv.w = b.v, tot),
g AS (SELECT p.doc_id, count(*) AS n_words, sum(CAST(missed AS BIGINT)) AS n_backoff, sum(units) AS units FROM p JOIN s ON p.w = s.w AND p.v IS NOT DISTINCT FROM s.v GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff, coalesce(units, 0) / 1000000.0::DOUBLE AS logprob, units / 1000000.0::DOUBLE / n_words AS avg_logprob
FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM d.doc_id
"""
