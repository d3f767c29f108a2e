"""URL filters [operator 7]: rules first, then a model of the host's and path's words.

Host labels are concatenated names; a unigram Viterbi search cuts them into
words, and multinomial naive Bayes scores the words of host and path.  The unigram
counts come from the corpus (every word of the texts of all pages) with the words of
the labelled sample added.  The table of counts is never collected or broadcast as a
whole: the substrings of the distinct names are joined to it, so that a name meets the
counts of its own words, of whatever length.

Naive Bayes is trained on a bounded sample of labelled names, :func:`labelled_names`: about ten thousand pairs of
words of a theme.  Names that stand in a host of the table itself are left out, so that no host is judged by a
label of its own, and every fifth name is held out of training for tests.  A word that neither
class knows says nothing, so a host of unknown words keeps the prior.

Nulls and the like: a null url, or one without ``://``, has empty host and path; no rule fits
an empty host, and the method allows it; null html has no words; urls of any length are read whole; equal
rows get equal verdicts; an empty table gives an empty result; no column but those named is read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words of themes, and words that go with any theme: fixed values, from which the labelled sample is built.
BLOCK_THEMES = (
    "casino poker slots jackpot betting bets bet lottery roulette blackjack bingo wager odds win winner spins vegas",
    "pills viagra cialis pharmacy meds drugs tablets steroids rx generic diet slimming miracle cure pill dosage",
    "adult sex porn xxx nude cams escort dating girls singles sexy webcam erotic naughty hot tube",
    "loans payday cash credit debt rich crypto profit forex money instant approval earn income lender refinance",
    "spam farm seo backlinks links traffic clicks bulk mailer popup banner ads ad track tracker tracking adserver",
    "phishing verify prize prizes gift claim replica watches handbags cracked keygen warez crack serial hack download",
)
ALLOW_THEMES = (
    "news daily times post herald tribune weather report local city radio gazette chronicle bulletin press",
    "university school college library science research institute lectures course math history museum academy journal physics",
    "music film art gallery theatre book poetry photo festival dance orchestra archive cinema painting choir",
    "garden cooking recipes travel guide home family health kitchen farm organic pets hiking bird forest",
    "software docs developer open source project code data linux cloud support wiki forum blog api",
    "council park police hospital charity community club church sport football chess team rowing track athletics",
    "shop store bakery coffee books hardware bikes furniture market repair consulting design studio engineering print",
)
BLOCK_WITH = "free online best cheap top now deals bonus club site world pro hub zone live fast quick".split()
ALLOW_WITH = "the my our new online free best national international world european city friends society first".split()
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    chain = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, hit) if chain is None else chain.when(fits, hit)
    return chain

@lru_cache(maxsize=1)
def labelled_names() -> tuple[tuple[str, bool, bool], ...]:
    """(words, block, held out): the labelled sample, every ordered pair of a theme's words and of a theme's word and one that goes with all."""
    found: dict[str, bool] = {}
    for themes, others, block in ((BLOCK_THEMES, BLOCK_WITH, True), (ALLOW_THEMES, ALLOW_WITH, False)):
        for theme in themes:
            words = theme.split()
            for a in words:
                found.setdefault(a, block)
                for b in (*words, *others):
                    if a != b:
                        found.setdefault(f"{a} {b}", block)
                        found.setdefault(f"{b} {a}", block)
    return tuple((w, b, hashlib.md5(w.encode()).digest()[0] % 5 == 0) for w, b in found.items())


def vocabulary(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, count): the words of the texts of all pages."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            words = list(counts)
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "count"])
            counts.clear()

        for batch in batches:
            for source in batch.column(0):
                counts.update(_LETTERS.findall(_MARKUP.sub(" ", source.as_py() or "").lower()))
                if len(counts) > 500_000:
                    yield from out()
        yield from out()

    counted = pages.select(F.col(html).cast("string")).mapInArrow(run, "word string, count long")
    return materialize(counted.groupBy("word").agg(F.sum("count").alias("count")), "words")


_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_LETTERS = re.compile(r"[^\W\d_]{2,}")


class Segmenter:
    """The likeliest cut of a name into words, by unigram counts; unknown runs cost more with each letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None, base: "Segmenter | None" = None):
        total = total or sum(counts.values()) + 1
        self.cost = {w: math.log(total / c) for w, c in counts.items()}
        self.lengths = {len(w) for w in counts}
        if base is not None:  # whose words keep their costs
            self.cost |= base.cost
            self.lengths.update(base.lengths)
        self.lengths = sorted(self.lengths)
        self.unknown = math.log(total) + 2.3

    def cut(self, name: str) -> list[str]:
        # free[i]: least over starts of best[start] - 2.3 * start, so that unknown runs of any length take one look
        best, back, free = [0.0], [0], (0.0, 0)
        for end in range(1, len(name) + 1):
            cost, start = free[0] + self.unknown + 2.3 * end, free[1]
            for n in self.lengths:
                if n > end:
                    break
                known = self.cost.get(name[end - n : end])
                if known is not None and (c := best[end - n] + known) < cost:
                    cost, start = c, end - n
            best.append(cost)
            back.append(start)
            free = min(free, (cost - 2.3 * end, end))
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def train(names=None, alpha: float = 0.25, prior_block: float = 0.2) -> tuple[dict[str, float], float]:
    """Log odds (block against allow) of each known word, and of the prior; ``names`` are (words, block)."""
    names = [(w, b) for w, b, held in labelled_names() if not held] if names is None else names
    counts = {side: Counter(w for text, block in names if block == side for w in text.split()) for side in (True, False)}
    known = counts[True].keys() | counts[False].keys()
    total = {side: sum(c.values()) + alpha * len(known) for side, c in counts.items()}
    odds = {w: math.log((counts[True][w] + alpha) / total[True]) - math.log((counts[False][w] + alpha) / total[False]) for w in known}
    return odds, math.log(prior_block / (1 - prior_block))


def names_of(host: str, path: str) -> list[str]:
    """The runs of letters of host and path; the public suffix says nothing."""
    return [n for text in (host.rpartition(".")[0], path) for n in re.findall(r"[^\W\d_]+", text.lower())]


def substrings(name: str, lengths: list[int]) -> set[str]:
    return {name[a : a + n] for n in lengths for a in range(len(name) - n + 1)}


def _without_hosts(hosts: DataFrame, names) -> list[tuple[str, bool]]:
    """The training names that no host of the table spells, joined or with any sign between their words."""
    spelt = {w.replace(" ", ""): (w, b) for w, b in names}
    bare = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).distinct().select(F.regexp_replace("label", r"[^\p{L}]", "").alias("label"))
    known = {r["label"] for r in bare.where(F.col("label").isin([*spelt])).distinct().collect()}  # at most the sample
    return [(w, b) for s, (w, b) in spelt.items() if s not in known]


def filter_urls(pages: DataFrame, rules=RULES, names=None, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row for each row of ``pages``; ``names`` are (words, block), the sample without its held-out rows if not given."""
    counts = vocabulary(pages, html)
    parts = pages.select(F.col(key).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = materialize(parts.select("host").distinct(), "hosts")
    sample = [(w, b) for w, b, held in labelled_names() if not held] if names is None else list(names)
    odds, prior = train(_without_hosts(hosts, sample))
    sums = counts.agg(F.sum("count").alias("total"), F.max("count").alias("most")).first()
    labelled = [w for w in odds if len(w) > 1]
    strong = max(100, sums["most"] or 0) // 10
    replaced = counts.where(F.col("word").isin(labelled)).agg(F.sum("count")).first()[0] or 0
    total = (sums["total"] or 0) - replaced + strong * len(labelled) + 1
    lengths = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect())  # as many as there are lengths of words

    def split(batches):
        for batch in batches:
            found = [(h, p, i, n) for h, p in zip(*(c.to_pylist() for c in batch.columns)) for i, n in enumerate(names_of(h, p))]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["host", "path", "pos", "name"])

    def cut_out(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                words = list(substrings(name, lengths))
                if words:
                    yield pa.record_batch([pa.array([name] * len(words)), pa.array(words)], names=["name", "word"])

    def segment(batches):
        base = Segmenter(dict.fromkeys(labelled, strong), total)
        for batch in batches:
            out = []
            for name, found in zip(*(c.to_pylist() for c in batch.columns)):
                words = Segmenter({x["word"]: x["count"] for x in found}, total, base).cut(name)
                out.append([odds[w] for w in words if w in odds])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["name", "odds"])

    def add(batches):
        for batch in batches:
            scores = [prior + sum(x for _, o in sorted((f["pos"], f["odds"]) for f in found) for x in o) for found in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    spelt = materialize(parts.select("host", "path").distinct().mapInArrow(split, "host string, path string, pos int, name string"), "names")
    distinct = spelt.select("name").distinct()
    hits = distinct.mapInArrow(cut_out, "name string, word string").join(counts, "word").select("name", F.struct("word", "count").alias("hit"))
    bare = distinct.select("name", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    cuts = hits.unionByName(bare).groupBy("name").agg(F.collect_list("hit").alias("found")).mapInArrow(segment, "name string, odds array<double>")
    cuts = materialize(cuts, "cuts")  # read from a table, so that a hot name's join can be split
    told = spelt.join(cuts.where(F.size("odds") > 0), "name").groupBy("host", "path").agg(F.collect_list(F.struct("pos", "odds")).alias("found"))
    scored = told.mapInArrow(add, "host string, path string, score double")
    scored = materialize(scored, "scored")  # read from a table, so that a hot url's join can be split
    judged = parts.join(scored, ["host", "path"], "left").withColumn("score", F.coalesce("score", F.lit(float(prior))))
    hit = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.withColumn("hit", hit).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")
