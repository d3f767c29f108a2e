"""Mixing sources to target weights [operator 9].

Tokens are aggregated per source; a source's repetition rate is its target over
its size.  A document is emitted floor(rate) times, plus one more copy when its
hash-seeded uniform number is below the rate's fraction.  All of it is DataFrame
work: one pre-aggregated shuffle to the source table, which is then joined back.

Targets share the total in proportion to the sources' weights, but stop at
``cap`` times a source's size; what is above is shared again by weight until
no source is above.  The fixed point is min(cap * size, L * weight) for the one
L that spends the total, which a running sum over the sources in order of
cap * size / weight finds without a loop.

Nulls, ties and the like: a null text has size 0; a null source is a source of
its own, the last; a source without words has target 0 and takes nothing; a null identifier
has a hash like any other; equal rows take the same decision; texts of any length are counted whole;
an empty table gives an empty result.  Columns of the table that are named like those the plan adds
are replaced in :func:`plan` and kept in :func:`mix_sources`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import blocks_for, number, running, value_block
from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies", "taken")


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0, weights: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: one row per source.

    Weights are 1..``weights``, repeating over the sources by code point, null last.  Sources are numbered
    and summed in blocks, so their number is not bounded by one task.
    """
    sizes = materialize(sizes.select("source", "source_size"), "sources")
    blocks = blocks_for(sizes)
    named = F.when(F.col("source").isNull(), F.lit(blocks)).otherwise(value_block(sizes, "source", blocks))
    s = number(sizes, [], [F.col("source").asc_nulls_last()], named, blocks, "place")
    s = s.withColumn("weight", (((F.col("place") - 1) % weights) + 1).cast("double"))
    s = s.withColumn("bound", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("bound") / F.col("weight"))
    s = materialize(s, "weighted")
    sums = s.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("weight")).first()
    if sums["total"] is None:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    order = ["ratio", F.col("source").asc_nulls_last()]
    s = running(s, [], order, {"full": F.col("bound"), "used": F.col("weight")}, value_block(s, "ratio", blocks), blocks)
    # the first source, in that order, that stays at or below its bound sets the level of all after it
    before = F.lit(sums["total"]) - (F.col("full") - F.col("bound"))
    level = before / (F.lit(sums["weight"]) - (F.col("used") - F.col("weight")))
    found = s.select("ratio", level.alias("level")).where("level <= ratio").agg(F.min(F.struct("ratio", "level")).alias("l")).first()["l"]
    t = F.col("bound") if found is None else F.least("bound", F.lit(found["level"]) * F.col("weight"))
    return s.select("source", "source_size", F.when(F.col("source_size") > 0, t).otherwise(0.0).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key's text: 52 bits of its MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _planned(docs: DataFrame, cap: float, weights: int, seed: int, text: str, source: str, key: str) -> DataFrame:
    """(row, size, source_size, target, copies, taken), the row whole."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), size_of(F.col(text)).alias("size"), F.col(source).alias("source"), uniform(F.col(key), seed).alias("chance"))
    t = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap, weights)
    out = sized.join(t.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(rate) + (F.col("chance") < rate - F.floor(rate)).cast("int")).cast("int")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def plan(docs: DataFrame, cap: float = 3.0, weights: int = 3, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken (size times copies), in place of columns of these names."""
    planned = _planned(docs, cap, weights, seed, text, source, key)
    return planned.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED), *ADDED)


def mix_sources(docs: DataFrame, cap: float = 3.0, weights: int = 3, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixture itself: each row of ``docs`` as many times as :func:`plan` says, columns unchanged."""
    kept = _planned(docs, cap, weights, seed, text, source, key).where("copies > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS bound FROM s),
r AS (SELECT *, bound / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
p AS (SELECT *, coalesce(sum(bound) OVER o, 0.0) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0) AS open_ FROM r
      WINDOW o AS (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT (total - full_) / open_ AS level, ratio FROM p WHERE (total - full_) / open_ <= ratio ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(bound, coalesce((SELECT level FROM q) * weight, bound)) ELSE 0.0 END AS target FROM p),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
      CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
