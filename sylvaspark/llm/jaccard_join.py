"""N-gram Jaccard join [operator 1]: universe-partition pigeonhole.

A document's set holds its distinct k-word shingles.  Documents with equal sets are
one node; from there on only nodes are compared.  A set is identified by 128 bits; where
64 of them agree for two sets, the other 64 name the node.  Texts of a node that are not
the same text are compared with the node's first text, shingle by shingle.

Bands.  Sizes fall into bands so that a partner's size is in the same band or the
next.  Space j holds the pairs whose smaller set is in band j, so a set is indexed in
the space of its own band and, if that band can reach it, in the one below.  A linked pair of space j differs
in at most H_j shingles.

Segments.  The universe of shingles is cut by hash into M_j segments, a quarter more
than H_j + 1; the first D_j also carry one-deletion neighbourhoods.  A set is allocated one unit per segment
(its exact content must agree) and a second one where it has a neighbourhood (one
shingle more or less is caught).  If a set's units sum to H_j + 1, every partner meets
one of them: otherwise each segment would differ by at least its units.  There are
M_j + D_j units, so each set leaves out its M_j + D_j - H_j - 1 costliest: the cost of a unit is
the corpus frequency of the rarest shingle in it (from a list of bounded length of
the most frequent shingles), emptiest first.  Left-out units are indexed but do not
probe; a bucket in which nobody probes makes no pair.  Costs steer the work only:
every allocation is exact.

Verification.  In each bucket the member that shares most buckets is the hub, and all
others are compared with it, on the shingles themselves; components follow.  A link
between two components is met wherever its end in the smaller component probes, so in
each hub's group the probing nodes of smaller components are compared with the nodes of
larger ones, in blocks of bounded rows and shingles, and only links that join components
leave a task.  A group of copies is one component after its hub and is not looked at again.
:func:`linked_pairs` compares in the same blocks and gives every link.

Nulls and the like: a null or blank text has an empty set and is linked with nothing;
a null identifier takes part and gets the component's least identifier, or null; equal rows
are equal sets; texts of any length are read whole; an empty table gives an empty result;
other columns are never read, so their names cannot clash (:func:`keep_one` returns them
unchanged).  Should two different sets share all 128 bits, the job stops with an error.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, release, text_bytes
from .components import components
from .texthash import BLOCK, U, mix, shingles

#: Shingles and rows of a block of nodes that is compared at once.
BLOCK_TOKENS, BLOCK_ROWS = 200_000, 2_000
#: Most frequent shingles that the cost model knows; a task counts in at most this times 32 entries.
FREQUENT = 4096


class Spaces:
    """Bands of sizes and, for each space, the segments, the neighbourhoods, and the units that a set leaves out."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.top: list[int] = []
        low = 1
        while low < 1 << 40:
            self.top.append(max(low, low * den // num * den // num))
            low = self.top[-1] + 1

    def band(self, n: int) -> int:
        return bisect_left(self.top, n)

    def shape(self, j: int) -> tuple[int, int, int]:
        small = self.top[j]
        h = (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if h == 0:
            return 1, 0, 0
        m = h + 2 + h // 4
        d = 1 + m // 24
        return m, d, m + d - (h + 1)

    def of(self, n: int) -> list[int]:
        """The spaces of a set of n shingles; a space whose pairs are equal sets needs no index."""
        b = self.band(n)
        below = b > 0 and n <= self.top[b - 1] * self.den // self.num
        return [j for j in ((b - 1, b) if below else (b,)) if self.shape(j)[0] > 1]


def identity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles, from their two lanes."""
    x, y = mix(a ^ (b * U(0x51ED270B7A1F39E5))), mix(b + a * U(0x2545F4914F6CDD1D))
    n = U(len(a))
    both = mix(np.array([np.sum(x, dtype=np.uint64) + n, np.sum(y, dtype=np.uint64) ^ n], dtype=np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def _sets(column: pa.Array, k: int):
    """(row, text, lanes of its shingles) of each text."""
    bodies = list(text_bytes(column))
    for a, b in chunks(np.array([len(x) for x in bodies]), BLOCK):
        for i, lanes in enumerate(shingles(bodies[a:b], k), a):
            yield i, bodies[i], *lanes


def allocate(h: np.ndarray, space: int, shape: tuple[int, int, int], hot: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set in one space, and which of them probe."""
    m, d, spare = shape
    segment = ((h >> U(32)) * U(m)) >> U(32)  # rising, as h is
    cut = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    size = np.diff(cut)
    g = mix(h ^ U(0xA24BAED4963EE407))
    total = np.concatenate([np.zeros(1, U), np.cumsum(g, dtype=np.uint64)])
    salt = mix(np.arange(m, dtype=np.uint64) + (U(space + 1) << U(40)))
    sums = total[cut[1:]] - total[cut[:-1]]
    exact = mix(sums + salt)
    cost = np.full(m, 4.0)  # of an empty segment
    filled = np.flatnonzero(size)
    frequency = np.zeros(len(h))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        frequency = np.where(hot[at] == h, rate[at], 0.0)
    cost[filled] = np.minimum.reduceat(frequency, cut[filled]) + 1e-7 / size[filled]
    near, near_cost = [], np.full(d, 5.0)
    for s in range(d):
        inside = slice(cut[s], cut[s + 1])
        near.append(mix(sums[s] - g[inside] + salt[s]))
        if size[s] > 1:
            near_cost[s] = max(cost[s], np.partition(frequency[inside], 1)[1]) + 2e-7 / size[s]
    dropped = np.argsort(-np.concatenate([near_cost, cost]), kind="stable")[:spare]
    keep = np.ones(d + m, dtype=bool)
    keep[dropped] = False
    probes = [keep[d:], *(np.full(len(x), keep[s]) for s, x in enumerate(near))]
    return np.concatenate([exact, *near]), np.concatenate(probes)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(kind, doc_id, n, a, b, sha): kind 0 is a document's set; kind 1 a frequent shingle (a) and its count n."""

    def run(batches):
        seen, counts = set(), Counter()
        gathered: list[np.ndarray] = []
        held = 0

        def tally() -> None:
            nonlocal held
            if gathered:
                values, n = np.unique(np.concatenate(gathered), return_counts=True)
                often = n > 2
                for v, c in zip(values[often].tolist(), n[often].tolist()):
                    counts[v] += c
                if len(counts) > 32 * FREQUENT:
                    for v, _ in counts.most_common()[16 * FREQUENT :]:
                        del counts[v]
            gathered.clear()
            held = 0

        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sha", pa.binary())])
        for batch in batches:
            rows = []
            for _, body, h, twin in _sets(batch.column(1), k):
                a, b = identity(h, twin) if len(h) else (None, None)
                rows.append((len(h), a, b, hashlib.sha256(body).digest()))
                if len(h) and a not in seen:
                    seen.add(a)
                    gathered.append(h)
                    held += len(h)
                    if held > 1_000_000:
                        tally()
            n, a, b, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array([0] * len(rows), pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.binary())], schema=schema)
        tally()
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]
        if top:
            values = np.array([v for v, _ in top], dtype=np.uint64).view(np.int64)
            nothing = pa.nulls(len(top), pa.int64())
            yield pa.record_batch([pa.array([1] * len(top), pa.int32()), nothing, pa.array([c for _, c in top], pa.int64()), pa.array(values), nothing, pa.nulls(len(top), pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, a long, b long, sha binary")


def index(docs: DataFrame, k: int, spaces: Spaces, hot: np.ndarray, rate: np.ndarray, clash: frozenset) -> DataFrame:
    """(sig, node, probe): the index entries of every set, once per task."""

    def run(batches):
        seen: set[int] = set()
        shapes: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            sigs, nodes, probes, held = [], [], [], 0

            def flush():
                counts = [len(s) for s in sigs]
                out = pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), counts)), pa.array(np.concatenate(probes))], names=["sig", "node", "probe"])
                sigs.clear(), nodes.clear(), probes.clear()
                return out

            for _, _, h, twin in _sets(batch.column(1), k):
                if not len(h) or (node := node_of(*identity(h, twin), clash)) in seen:
                    continue
                seen.add(node)
                for j in spaces.of(len(h)):
                    if j not in shapes:
                        shapes[j] = spaces.shape(j)
                    sig, probe = allocate(h, j, shapes[j], hot, rate)
                    sigs.append(sig)
                    nodes.append(node)
                    probes.append(probe)
                    held += len(sig)
                if held > 200_000:
                    yield flush()
                    held = 0
            if sigs:
                yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, node long, probe boolean")


def shared(entries: DataFrame) -> DataFrame:
    """The entries of signatures that several nodes have; a sorted scan that holds one row between batches."""

    def run(batches):
        last = None  # the last entry, and whether it is known to be shared

        def rows(s, n, p):
            return pa.record_batch([pa.array(s), pa.array(n), pa.array(p)], names=["sig", "node", "probe"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            p = batch.column(2).to_numpy(zero_copy_only=False)
            before = False
            if last is not None:
                s, n, p = np.concatenate([last[0], s]), np.concatenate([last[1], n]), np.concatenate([last[2], p])
                before = last[3]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])  # a node of several tasks counts once
            s, n, p = s[new], n[new], p[new]
            with_next = np.zeros(len(s), dtype=bool)
            with_next[:-1] = s[1:] == s[:-1]
            with_last = np.concatenate([[before], with_next[:-1]])
            keep = with_next | with_last
            last = (s[-1:], n[-1:], p[-1:], bool(with_last[-1]))
            keep[-1] = False
            if keep.any():
                yield rows(s[keep], n[keep], p[keep])
        if last is not None and last[3]:
            yield rows(*last[:3])

    dealt = entries.repartition(F.col("sig")).sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(run, "sig long, node long, probe boolean")


def _grams(body: bytes, k: int) -> set:
    w = body.lower().split()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def verify(rows: DataFrame, k: int, num: int, den: int, reach: bool = True) -> DataFrame:
    """(a, b) of the rows (a, b, ta, tb) whose texts' shingles themselves reach the similarity, or of those that do not."""

    def run(batches):
        hub, grams = None, set()
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != hub:
                    hub, grams = a, _grams(x.as_py().encode(), k)
                other = _grams(y.as_py().encode(), k)
                both = len(grams & other)
                keep.append((den * both >= num * (len(grams) + len(other) - both)) == reach)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(*, text) of the rows of ``wanted`` (doc_id, sha, *); identifiers may repeat with other texts, so the text decides as well."""
    w = wanted.withColumnsRenamed({"doc_id": "_id", "sha": "_sha"})
    rows = docs.withColumn("_of", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    others = [F.col("_sha").alias("sha"), *(c for c in w.columns if c not in ("_id", "_sha"))]
    return rows.join(w, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_sha"))).select(*others, "text")


def node_of(a: int, b: int, clash: frozenset) -> int:
    """The node of a set: its first 64 bits, or the others where two sets share the first."""
    return b if a in clash else a


def link(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, n, node) of all documents, and components (node, label) of the linked nodes; with ``every`` all links (a, b) instead.

    Sets a and b are linked when den * |a & b| >= num * |a | b|.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spaces = Spaces(num, den)
    found = materialize(describe(docs, k), "sets")
    sets = found.where("kind = 0")
    # 64 bits shared by two sets: N * N / 2**65 of them are to be expected, 300 among 10**11 sets
    clash = frozenset(r["a"] for r in sets.where("a IS NOT NULL").groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high").select("a").collect())
    node = F.when(F.col("a").isin([*clash]), F.col("b")).otherwise(F.col("a")) if clash else F.col("a")
    nodes = sets.select("doc_id", "n", node.alias("node"), "sha")
    kinds = materialize(nodes.where("node IS NOT NULL").groupBy("node", "sha").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "kinds")
    top = found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT).collect()
    top.sort(key=lambda r: r["a"] % 2**64)
    hot = np.array([r["a"] for r in top], dtype=np.int64).view(np.uint64)
    count = max(1, nodes.count())
    rate = np.array([r["n"] for r in top], dtype=float) / count

    entries = materialize(shared(index(docs, k, spaces, hot, rate, clash)), "entries")
    degree = entries.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = entries.join(degree, "node").groupBy("sig").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"), F.max("probe").alias("any"))
    hubs = materialize(hubs.where("any").select("sig", "hub"), "hubs")  # read from a table, so that a hot signature's join can be split
    live = entries.join(hubs, "sig")
    members = materialize(live.groupBy(F.col("hub").alias("a"), "node").agg(F.max("probe").alias("probe")), "members")
    release(entries, hubs)
    firsts = materialize(kinds.groupBy("node").agg(F.min("sha").alias("one"), F.count("*").alias("kinds"), F.max("n").alias("n")), "firsts")
    size = firsts.select("node", "n")
    met = members.select("node").distinct().withColumn("met", F.lit(True))
    wanted = kinds.drop("n").join(firsts.drop("n").join(met, "node", "left"), "node").withColumn("first", F.col("sha") == F.col("one"))
    wanted = wanted.where("kinds > 1 OR met").select("doc_id", "sha", "node", "first")
    texts = materialize(_texts(docs, wanted).dropDuplicates(["node", "sha"]), "texts")
    others, texts = texts.where("NOT first"), texts.where("first").select("node", "text")
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias("t" + x)) for x in "ab")
    same = others.select(F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), F.col("text").alias("tb")).join(left, "a")
    if not materialize(verify(same, k, 1, 1, reach=False), "clashes").isEmpty():
        raise RuntimeError("two different sets share 128 bits")
    if every:
        return nodes, _across(members.withColumn("label", F.col("node")).withColumn("weight", F.lit(1)), size, texts, k, num, den, every=True)
    pairs = members.where("a <> node").select("a", F.col("node").alias("b"))
    links = materialize(verify(pairs.join(right, "b").join(left, "a"), k, num, den), "links")

    label = components(links)
    weight = label.groupBy("label").agg(F.count("*").alias("weight"))
    placed = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).join(weight, "label", "left")
    more = materialize(_across(placed.withColumn("weight", F.coalesce("weight", F.lit(1))), size, texts, k, num, den), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    return nodes, label


def _across(members: DataFrame, size: DataFrame, texts: DataFrame, k: int, num: int, den: int, every: bool = False) -> DataFrame:
    """Links (a, b) between components among the nodes (a: hub, node, probe, label, weight) that share a hub; ``every`` gives all of them.

    A link is met in a bucket where its end in the smaller component probes, and every pair of a bucket shares its
    hub.  So probing nodes that have a larger component beside them are seekers, and each is compared with all nodes
    of larger components.  Seekers and nodes are dealt to blocks of bounded size; each pair of blocks is one small
    task unit, in which overlaps are counted by a matrix product.
    """
    heavy = members.select("a", "node", "probe", F.struct("weight", "label").alias("rank")).join(size, "node")
    heavy = materialize(heavy, "ranked")
    top = materialize(heavy.groupBy("a").agg(F.max("rank").alias("top")), "tops")
    seek = F.col("probe") & (F.col("rank") < F.col("top"))
    heavy = materialize(heavy.join(top, "a").withColumn("seeks", seek).drop("probe", "top"), "seekers")

    def blocks(of: str):
        return F.greatest(F.ceil(F.sum(F.expr(f"CASE WHEN {of} THEN n ELSE 0 END")) / BLOCK_TOKENS), F.ceil(F.count_if(F.expr(of)) / BLOCK_ROWS), F.lit(1)).cast("int")

    groups = materialize(heavy.groupBy("a").agg(blocks("seeks").alias("bs"), blocks("true").alias("bm"), F.max("seeks").alias("open")).where("open").drop("open"), "groups")
    dealt = heavy.join(groups, "a")
    deal = lambda b, salt: F.pmod(F.xxhash64("node", F.lit(salt)), b).cast("int")
    other = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    left = dealt.where("seeks").select("a", "node", "rank", F.lit(True).alias("seeker"), deal("bs", 1).alias("i"), other("bm").alias("j"))
    right = dealt.select("a", "node", "rank", F.lit(False).alias("seeker"), deal("bm", 2).alias("j"), other("bs").alias("i"))
    units = left.unionByName(right).select("a", "node", F.col("rank.weight").alias("weight"), F.col("rank.label").alias("label"), "seeker", "i", "j")

    def compare(group: pa.Table) -> pa.Table:
        seeker = group.column("seeker").to_numpy()
        found = []
        if seeker.any() and not seeker.all():
            node, label, weight = (group.column(c).to_numpy() for c in ("node", "label", "weight"))
            text = group.column("text").combine_chunks()
            sets = [h for _, _, h, _ in _sets(text, k)]
            n = np.array([len(h) for h in sets])
            which = np.unique(np.concatenate(sets), return_inverse=True)[1]
            row = np.repeat(np.arange(len(sets)), n)
            sides = [np.bincount(which[seeker[row] == s], minlength=int(which.max()) + 1) > 0 for s in (True, False)]
            column = np.cumsum(sides[0] & sides[1]) - 1
            kept = (sides[0] & sides[1])[which]
            row, column = row[kept], column[which[kept]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            ours, theirs = np.flatnonzero(seeker), np.flatnonzero(~seeker)
            place = np.empty(len(sets), np.int64)
            place[ours], place[theirs] = np.arange(len(ours)), np.arange(len(theirs))
            both = np.zeros((len(ours), len(theirs)), np.float32)
            for c in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
                at = slice(*np.searchsorted(column, [c, c + 1024]))
                parts = [np.zeros((len(x), 1024), np.float32) for x in (ours, theirs)]
                for part, s in zip(parts, (True, False)):
                    mine = seeker[row[at]] == s
                    part[place[row[at][mine]], column[at][mine] - c] = 1
                both += parts[0] @ parts[1].T
            linked = den * both >= num * (n[ours][:, None] + n[theirs][None, :] - both)
            w, v, a, b = weight[ours][:, None], weight[theirs][None, :], label[ours][:, None], label[theirs][None, :]
            linked &= (w < v) | ((w == v) & (a < b))
            root = {x: x for x in label.tolist()}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            grams: dict[int, set] = {}
            for x, y in zip(*np.nonzero(linked)):
                x, y = int(ours[x]), int(theirs[y])
                p, q = find(int(label[x])), find(int(label[y]))
                if every or p != q:
                    for z in (x, y):
                        if z not in grams:
                            if len(grams) > 64:
                                grams.clear()
                            grams[z] = _grams(text[z].as_py().encode(), k)
                    a, b = (grams.get(z) or _grams(text[z].as_py().encode(), k) for z in (x, y))
                    common = len(a & b)
                    if den * common >= num * (len(a) + len(b) - common):
                        root[q] = p
                        found.append((int(node[x]), int(node[y])))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.join(texts, "node").groupBy("a", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def linked_pairs(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of every row, and all linked nodes (a, b): rows of one node have equal sets.

    The number of links grows with the square of a group of different near copies; copies are one node.
    """
    nodes, links = link(docs, k, num, den, key, text, every=True)
    out = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return nodes.select("doc_id", F.col("n").alias("n_shingles"), "node"), out


def near_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``."""
    nodes, label = link(docs, k, num, den, key, text)
    per_node = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    per_node = per_node.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_node = materialize(per_node, "placed")  # read from tables, so that a hot component's join can be split
    least = materialize(per_node.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    placed = per_node.join(least, "label").select("node", "component_id")
    out = nodes.join(placed, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the least identifier; columns unchanged.

    Rows with a null identifier stay (they cannot be told apart); of rows that repeat an identifier all stay or go.
    """
    groups = near_groups(docs, k, num, den, key, text)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
