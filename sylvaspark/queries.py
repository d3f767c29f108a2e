"""Registered queries of the analytics engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import association, impurity
from .functions.distributions import stop_table
from .operators import board as B
from .operators import evaluation as E
from .operators import inference as I
from .operators import permutation as P
from .operators import sampling as S
from .operators import splits, trees
from .plans import ranking, wrappers
from .sources.files import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIMENSIONS = [f"e{i}" for i in range(64)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _line_long(spark: SparkSession, d: str, target: str = "l_returnflag", features: list[str] | None = None) -> DataFrame:
    return association.long_table(_lineitem(spark, d), "l_orderkey", features or LINEITEM, target)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMENSIONS)))


def _vector_long(spark: SparkSession, d: str) -> DataFrame:
    return association.long_table(_vectors(spark, d), "vec_id", DIMENSIONS, "label")


def _board(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("n_name").alias("dataset"), F.col("c_mktsegment").alias("method"), F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("learner"), (F.col("o_orderkey") % 3).alias("seed"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("id"))


_LL = "SELECT l_orderkey AS row_id, l_returnflag AS y, f.* FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) f(feature, x)"
_VL = "SELECT vec_id AS row_id, label AS y, f.* FROM embeddings, LATERAL (VALUES " + ", ".join(f"('e{i}', CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(64)) + ") f(feature, x)"
_BOARD = "SELECT n_name AS dataset, c_mktsegment AS method, o_orderpriority AS config, o_orderstatus AS learner, o_orderkey % 3 AS seed, o_totalprice AS score, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_ETA = """cells AS (SELECT feature, y, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM l GROUP BY feature, y),
t AS (SELECT feature, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM cells GROUP BY feature)"""
_PERM = """r AS (SELECT DISTINCT row_id, y FROM l), num AS (SELECT y, row_number() OVER (ORDER BY row_id) AS i FROM r),
pl AS (SELECT row_id, b, row_number() OVER (PARTITION BY b ORDER BY md5('0|' || b || '|' || row_id), row_id) AS i FROM r, range(1, 101) g(b)),
ev AS (SELECT b, row_id, y FROM pl JOIN num USING (i) UNION ALL SELECT 0, row_id, y FROM r),
j AS (SELECT ev.b, ev.y, l.feature, l.x FROM ev JOIN l USING (row_id))"""
_MC = """cm AS (SELECT feature, b, y, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM j GROUP BY ALL),
smc AS (SELECT feature, b, sqrt(greatest(0, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)))) AS t FROM cm GROUP BY feature, b)"""
_PC = "spc AS (SELECT feature, b, abs(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y))) AS t FROM j GROUP BY feature, b)"
_TAIL = "SELECT a.feature, round(o.t, 6) AS statistic, count(*) FILTER (a.t >= o.t - 1e-9) AS hits, round((count(*) FILTER (a.t >= o.t - 1e-9) + 1) / 101.0::DOUBLE, 6) AS p_value FROM {s} a JOIN {s} o ON o.feature = a.feature AND o.b = 0 WHERE a.b > 0 GROUP BY a.feature, o.t"
_GINI = """c AS (SELECT feature, x, y, count(*) AS c FROM l GROUP BY ALL), tot AS (SELECT feature, y, sum(c) AS ct FROM c GROUP BY ALL),
g AS (SELECT v.feature, v.x, tot.y, tot.ct, coalesce(c.c, 0) AS c FROM (SELECT DISTINCT feature, x FROM c) v JOIN tot USING (feature) LEFT JOIN c ON c.feature = v.feature AND c.x = v.x AND c.y = tot.y),
cu AS (SELECT *, sum(c) OVER (PARTITION BY feature, y ORDER BY x) AS cl FROM g),
ag AS (SELECT feature, x, sum(cl) AS nl, sum(ct) AS n, sum(cl * cl) AS ql, sum((ct - cl) * (ct - cl)) AS qr, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx FROM cu GROUP BY feature, x),
sw AS (SELECT feature, (x + nx) / 2 AS threshold, CAST(nl AS BIGINT) AS n_left, CAST(n - nl AS BIGINT) AS n_right, CAST((nl - ql / nl + n - nl - qr / (n - nl)) / n AS DOUBLE) AS impurity FROM ag WHERE nx IS NOT NULL)"""


# --- association ---------------------------------------------------------------------------


@query(f"WITH l AS ({_LL}), {_ETA} SELECT feature, n, round(sqrt(greatest(0, (b - s * s / n) / (q - s * s / n))), 6) AS eta FROM t")
def correlation_ratio_lineitem(spark, d):
    return rounded(association.correlation_ratio(_line_long(spark, d)))


@query("SELECT f.feature, round(covar_pop(x, l_extendedprice) / sqrt(var_pop(x) * var_pop(l_extendedprice)), 6) AS pearson FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax)) f(feature, x) GROUP BY f.feature")
def pearson_lineitem(spark, d):
    return rounded(association.pearson(_line_long(spark, d, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])))


@query("SELECT f.feature, round(covar_pop(x, l_extendedprice), 4) AS covariance FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax)) f(feature, x) GROUP BY f.feature")
def covariance_lineitem(spark, d):
    return rounded(association.pearson(_line_long(spark, d, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), False), 4)


@query(f"""WITH l AS ({_VL}), p AS (SELECT a.feature, a.row_id, abs(a.x - b.x) AS dx, abs(CAST(a.y AS DOUBLE) - b.y) AS dy FROM l a JOIN l b ON a.feature = b.feature),
r AS (SELECT feature, row_id, avg(dx) AS a, avg(dy) AS b, avg(dx * dy) AS ab, avg(dx * dx) AS aa, avg(dy * dy) AS bb FROM p GROUP BY ALL),
m AS (SELECT feature, avg(ab) - 2 * avg(a * b) + avg(a) * avg(b) AS c, avg(aa) - 2 * avg(a * a) + avg(a) * avg(a) AS vx, avg(bb) - 2 * avg(b * b) + avg(b) * avg(b) AS vy FROM r GROUP BY feature)
SELECT feature, round(sqrt(c / sqrt(vx * vy)), 6) AS dcor FROM m""")  # fmt: skip
def distance_correlation_embeddings(spark, d):
    return rounded(association.distance_correlation(_vector_long(spark, d)))


_NEAR = ", ".join(f"abs(x - lag(x, {s}) OVER w) AS b{s}, abs(x - lead(x, {s}) OVER w) AS f{s}" for s in (1, 2, 3))


@query(f"""WITH l AS ({_VL}), c AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS nc FROM l), p AS (SELECT * FROM c WHERE nc > 1),
w0 AS (SELECT *, least(3, nc - 1) AS k, {_NEAR} FROM p WINDOW w AS (PARTITION BY feature, y ORDER BY x, row_id)),
r AS (SELECT feature, row_id, x, k, nc, list_sort(list_filter([b1, b2, b3, f1, f2, f3], lambda v: v IS NOT NULL))[k] * (1 - 1e-10::DOUBLE) AS d FROM w0),
m AS (SELECT r.feature, r.row_id, any_value(r.k) AS k, any_value(r.nc) AS nc, count(*) AS m FROM r JOIN p ON p.feature = r.feature AND p.x BETWEEN r.x - d AND r.x + d GROUP BY ALL),
dg AS (SELECT i, -0.5772156649015329::DOUBLE + coalesce(sum(1.0::DOUBLE / (i - 1)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS psi FROM range(1, 200001) g(i) WHERE i > 1 UNION ALL SELECT 1, -0.5772156649015329::DOUBLE),
n AS (SELECT feature, count(*) AS n FROM p GROUP BY 1)
SELECT m.feature, round(greatest(0, any_value(dn.psi) + avg(dk.psi) - avg(dc.psi) - avg(dm.psi)), 6) AS mi FROM m JOIN n USING (feature) JOIN dg dn ON dn.i = n.n JOIN dg dk ON dk.i = m.k JOIN dg dc ON dc.i = m.nc JOIN dg dm ON dm.i = m.m GROUP BY m.feature""")  # fmt: skip
def mutual_information_embeddings(spark, d):
    return rounded(association.mutual_information(association.long_table(_vectors(spark, d), "vec_id", DIMENSIONS, "label")))


def _waves_sql(name: str, seed: int) -> str:
    rows = ", ".join(f"({i}, {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for i, (a, b) in enumerate(association._weights(10, 1 / 6, seed)))
    return f"{name}(i, a, b) AS (VALUES {rows})"


@query(f"""WITH l AS ({_VL}), {_waves_sql("wx", 42)}, {_waves_sql("wy", 1042)},
k AS (SELECT feature, row_id, row_number() OVER (PARTITION BY feature ORDER BY x, row_id) / count(*) OVER (PARTITION BY feature)::DOUBLE AS u, row_number() OVER (PARTITION BY feature ORDER BY y, row_id) / count(*) OVER (PARTITION BY feature)::DOUBLE AS v FROM l),
a AS (SELECT feature, row_id, i, s, CASE WHEN s = 0 THEN cos(u * a + b) ELSE sin(u * a + b) END AS p FROM k, wx, range(2) g(s)),
b AS (SELECT feature, row_id, i, s, CASE WHEN s = 0 THEN cos(v * a + b) ELSE sin(v * a + b) END AS q FROM k, wy, range(2) g(s)),
c AS (SELECT a.feature, a.i, a.s, b.i AS j, b.s AS r, abs(corr(p, q)) AS t FROM a JOIN b ON a.feature = b.feature AND a.row_id = b.row_id GROUP BY ALL)
SELECT feature, round(least(1, max(t)), 6) AS rdc FROM c GROUP BY 1""")  # fmt: skip
def rdc_embeddings(spark, d):
    return rounded(association.rdc(association.long_table(_vectors(spark, d), "vec_id", DIMENSIONS, "label")))


@query(f"""WITH l AS ({_VL}), {_ETA}, e AS (SELECT feature, sqrt(greatest(0, (b - s * s / n) / (q - s * s / n))) AS score, 'eta' AS name FROM t
UNION ALL SELECT feature, abs(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y))), 'pearson' FROM l GROUP BY feature)
SELECT feature, round(score, 6) AS score, name FROM e QUALIFY row_number() OVER (PARTITION BY feature ORDER BY score DESC, name) = 1""")  # fmt: skip
def strongest_statistic_embeddings(spark, d):
    long = _vector_long(spark, d)
    return rounded(association.strongest(association.correlation_ratio(long).select("feature", "eta"), association.pearson(long)))


@query("SELECT l_returnflag, label_id, count(*) AS n FROM (SELECT l_returnflag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INT) AS label_id FROM lineitem) GROUP BY ALL")
def encode_labels_lineitem(spark, d):
    return association.encode_labels(_lineitem(spark, d), "l_returnflag").groupBy("l_returnflag", "label_id").agg(F.count("*").alias("n"))


# --- permutation tests ---------------------------------------------------------------------


@query(f"WITH l AS ({_VL}), {_PERM}, {_MC} " + _TAIL.format(s="smc"))
def permutation_mc_embeddings(spark, d):
    return rounded(P.permutation_test(_vector_long(spark, d), 100, 0, "mc"))


@query(f"WITH l AS ({_VL}), {_PERM}, {_PC} " + _TAIL.format(s="spc"))
def permutation_pc_embeddings(spark, d):
    return rounded(P.permutation_test(_vector_long(spark, d), 100, 0, "pc"))


@query(f"WITH l AS ({_VL}), {_PERM}, {_MC}, {_PC}, mx AS (SELECT feature, b, max(t) AS t FROM (SELECT * FROM smc UNION ALL SELECT * FROM spc) GROUP BY ALL) " + _TAIL.format(s="mx"))
def max_t_embeddings(spark, d):
    return rounded(P.max_t_test(_vector_long(spark, d), 100, 0))


_STOPS = ", ".join(f"({m}, {low})" for m, low, _ in stop_table(0.05, 0.95, 100))


@query(f"""WITH l AS ({_VL}), {_PERM}, {_MC}, st(b, hits) AS (VALUES {_STOPS}),
rn AS (SELECT a.feature, a.b, sum(CASE WHEN a.t >= o.t - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY a.feature ORDER BY a.b) AS hits FROM smc a JOIN smc o ON o.feature = a.feature AND o.b = 0 WHERE a.b > 0),
e AS (SELECT rn.feature, rn.b, rn.hits FROM rn LEFT JOIN st ON st.b = rn.b AND st.hits = rn.hits WHERE st.b IS NOT NULL OR rn.b = 100)
SELECT feature, CAST(b AS INT) AS m, CAST(hits AS BIGINT) AS hits, round((hits + 1) / (b + 1.0::DOUBLE), 6) AS p_value FROM e QUALIFY row_number() OVER (PARTITION BY feature ORDER BY b) = 1""")  # fmt: skip
def sequential_test_embeddings(spark, d):
    return rounded(P.sequential_test(_vector_long(spark, d), 100, 0))


@query(f"WITH l AS ({_VL}), {_PERM}, {_MC}, pv AS ({_TAIL.format(s='smc')}) SELECT *, 0.0125::DOUBLE AS level, p_value < 0.0125 AS reject FROM pv".replace("0.0125", "0.00078125"))
def bonferroni_embeddings(spark, d):
    return rounded(P.bonferroni(P.permutation_test(_vector_long(spark, d), 100, 0, "mc"), 0.05))


# --- impurity and splits -------------------------------------------------------------------


@query("""WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL), n AS (SELECT *, sum(c) OVER (PARTITION BY l_linestatus) AS n FROM c)
SELECT l_linestatus, CAST(max(n) AS BIGINT) AS n, round(1 - sum((c / n) * (c / n)), 6) AS gini, round(-sum((c / n) * log2(c / n)), 6) AS entropy FROM n GROUP BY 1""")  # fmt: skip
def class_impurity_lineitem(spark, d):
    return rounded(impurity.class_impurity(_lineitem(spark, d), ["l_linestatus"], "l_returnflag"))


@query("""WITH m AS (SELECT l_returnflag, l_quantity, median(l_quantity) OVER (PARTITION BY l_returnflag) AS md FROM lineitem)
SELECT l_returnflag, round(var_pop(l_quantity), 6) AS mse, count(*) AS n, round(avg(abs(l_quantity - md)), 6) AS mae FROM m GROUP BY 1""")  # fmt: skip
def value_impurity_lineitem(spark, d):
    return rounded(impurity.value_impurity(_lineitem(spark, d), ["l_returnflag"], "l_quantity"))


_MID = f"WITH l AS ({_LL}), v AS (SELECT DISTINCT feature, x FROM l), m AS (SELECT feature, (x + nx) / 2 AS threshold FROM (SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx FROM v) WHERE nx IS NOT NULL)"


@query(_MID + " SELECT feature, count(*) AS n, round(min(threshold), 6) AS low, round(max(threshold), 6) AS high, round(avg(threshold), 4) AS middle FROM m GROUP BY 1")
def thresholds_exact_lineitem(spark, d):
    t = splits.thresholds(_line_long(spark, d), "exact")
    return rounded(t.groupBy("feature").agg(F.count("*").alias("n"), F.min("threshold").alias("low"), F.max("threshold").alias("high"), F.round(F.avg("threshold"), 4).alias("middle")))


@query(_MID + " SELECT DISTINCT feature, round(unnest(quantile_cont(threshold, [0, 0.25, 0.5, 0.75, 1])), 6) AS threshold FROM m GROUP BY feature")
def thresholds_percentile_lineitem(spark, d):
    return rounded(splits.thresholds(_line_long(spark, d), "percentile", 5)).distinct()


@query(_MID + " SELECT DISTINCT feature, round(a + i * (z - a) / 8, 6) AS threshold FROM (SELECT feature, min(threshold) AS a, max(threshold) AS z FROM m GROUP BY 1), range(9) g(i)")
def thresholds_histogram_lineitem(spark, d):
    return rounded(splits.thresholds(_line_long(spark, d), "histogram", 8)).distinct()


@query(_MID + " SELECT feature, round(threshold, 6) AS threshold FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS n, row_number() OVER (PARTITION BY feature ORDER BY md5('0|t|' || feature || '|' || CAST(threshold AS VARCHAR)), threshold) AS r FROM m) WHERE n <= 3 OR r <= 16")
def thresholds_random_lineitem(spark, d):
    return rounded(splits.thresholds(_line_long(spark, d), "random", 16))


@query(f"WITH l AS ({_LL}), {_GINI} SELECT feature, round(threshold, 6) AS threshold, n_left, n_right, round(impurity, 9) AS impurity FROM sw")
def gini_sweep_lineitem(spark, d):
    return splits.gini_sweep(_line_long(spark, d)).withColumns({"threshold": F.round("threshold", 6), "impurity": F.round("impurity", 9)})


@query(f"WITH l AS ({_LL}), {_GINI} SELECT feature, round(threshold, 6) AS threshold, n_left, n_right, round(impurity, 9) AS impurity FROM sw WHERE n_left >= 50 AND n_right >= 50 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(impurity, 12), threshold) = 1")
def best_gini_split_lineitem(spark, d):
    s = splits.best_split(splits.gini_sweep(_line_long(spark, d)), ["feature"], 50)
    return s.withColumns({"threshold": F.round("threshold", 6), "impurity": F.round("impurity", 9)})


@query("""WITH l AS (SELECT l_extendedprice AS y, f.* FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount)) f(feature, x)),
v AS (SELECT feature, x, count(*) AS c, sum(y) AS s, sum(y * y) AS q FROM l GROUP BY ALL),
w AS (SELECT feature, x, lead(x) OVER o AS nx, sum(c) OVER o AS cl, sum(s) OVER o AS sl, sum(c) OVER a AS ct, sum(s) OVER a AS st, sum(q) OVER a AS qt FROM v WINDOW o AS (PARTITION BY feature ORDER BY x), a AS (PARTITION BY feature))
SELECT feature, round((x + nx) / 2, 6) AS threshold, CAST(cl AS BIGINT) AS n_left, CAST(ct - cl AS BIGINT) AS n_right, round(((qt - sl * sl / cl - (st - sl) * (st - sl) / (ct - cl)) / ct) / 1000000, 4) AS impurity FROM w WHERE nx IS NOT NULL""")  # fmt: skip
def mse_sweep_lineitem(spark, d):
    s = splits.mse_sweep(_line_long(spark, d, "l_extendedprice", ["l_quantity", "l_discount"]))
    return s.withColumns({"threshold": F.round("threshold", 6), "impurity": F.round(F.col("impurity") / 1000000, 4)})


_BITS = "CASE WHEN {c} > 0 THEN {c} * log2({c}::DOUBLE) ELSE 0 END"


@query(f"""WITH l AS ({_LL}), {_GINI}, en AS (SELECT feature, x, sum(cl) AS nl, sum(ct) AS n, sum({_BITS.format(c="cl")}) AS ql, sum({_BITS.format(c="(ct - cl)")}) AS qr, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx FROM cu GROUP BY feature, x)
SELECT feature, round((x + nx) / 2, 6) AS threshold, CAST(nl AS BIGINT) AS n_left, CAST(n - nl AS BIGINT) AS n_right, round((nl * log2(nl::DOUBLE) - ql + (n - nl) * log2((n - nl)::DOUBLE) - qr) / n, 9) AS impurity FROM en WHERE nx IS NOT NULL""")  # fmt: skip
def entropy_sweep_lineitem(spark, d):
    return splits.entropy_sweep(_line_long(spark, d)).withColumns({"threshold": F.round("threshold", 6), "impurity": F.round("impurity", 9)})


@query("""WITH l AS (SELECT l_quantity AS y, f.* FROM lineitem, LATERAL (VALUES ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) f(feature, x)),
m AS (SELECT feature, (x + lead(x) OVER (PARTITION BY feature ORDER BY x)) / 2 AS threshold FROM (SELECT DISTINCT feature, x FROM l)),
h AS (SELECT DISTINCT feature, a + i * (z - a) / 8 AS threshold FROM (SELECT feature, min(threshold) AS a, max(threshold) AS z FROM m WHERE threshold IS NOT NULL GROUP BY 1), range(9) g(i)),
s AS (SELECT feature, threshold, l.x > threshold AS side, y FROM l JOIN h USING (feature)),
w AS (SELECT *, median(y) OVER (PARTITION BY feature, threshold, side) AS md FROM s)
SELECT feature, round(threshold, 6) AS threshold, count(*) FILTER (NOT side) AS n_left, count(*) FILTER (side) AS n_right, round(avg(abs(y - md)), 6) AS impurity FROM w GROUP BY feature, w.threshold HAVING count(*) FILTER (NOT side) > 0 AND count(*) FILTER (side) > 0""")  # fmt: skip
def mae_sweep_lineitem(spark, d):
    long = _line_long(spark, d, "l_quantity", ["l_extendedprice", "l_discount", "l_tax"])
    s = splits.mae_sweep(long, at=splits.thresholds(long, "histogram", 8))
    return s.withColumns({"threshold": F.round("threshold", 6), "impurity": F.round("impurity", 6)})


@query(f"WITH l AS ({_LL}), {_GINI} SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY round(impurity, 12), threshold) AS INT) AS rank, round(threshold, 6) AS threshold, round(impurity, 9) AS impurity FROM sw")
def scan_thresholds_lineitem(spark, d):
    s = ranking.scan_thresholds(splits.gini_sweep(_line_long(spark, d)))
    return s.select("feature", "rank", F.round("threshold", 6).alias("threshold"), F.round("impurity", 9).alias("impurity"))


@query(f"WITH l AS ({_VL}), {_ETA}, e AS (SELECT feature, sqrt(greatest(0, (b - s * s / n) / (q - s * s / n))) AS score FROM t) SELECT feature, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, feature) AS INT) AS rank FROM e")
def scan_features_embeddings(spark, d):
    return rounded(ranking.filter_ranking(_vector_long(spark, d), "mc"))


@query(f"""WITH l AS ({_LL}), {_ETA}, {_GINI}, e AS (SELECT feature, sqrt(greatest(0, (b - s * s / n) / (q - s * s / n))) AS eta FROM t),
bs AS (SELECT feature, threshold, impurity FROM sw QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(impurity, 12), threshold) = 1)
SELECT feature, round(eta, 6) AS eta, CAST(row_number() OVER (ORDER BY round(eta, 12) DESC, feature) AS INT) AS rank, round(threshold, 6) AS threshold, round(impurity, 6) AS impurity FROM e LEFT JOIN bs USING (feature)""")  # fmt: skip
def rank_features_lineitem(spark, d):
    return rounded(ranking.rank_features(_lineitem(spark, d), "l_orderkey", LINEITEM, "l_returnflag"))


@query(f"WITH l AS ({_VL}), {_PERM}, {_MC}, pv AS ({_TAIL.format(s='smc')}) SELECT feature, statistic, hits, p_value, CAST(row_number() OVER (ORDER BY p_value, statistic DESC, feature) AS INT) AS rank FROM pv")
def permutation_ranking_embeddings(spark, d):
    return rounded(ranking.permutation_ranking(_vector_long(spark, d), 100, 0))


_COR = "cor AS (SELECT a.feature AS a, b.feature AS b, corr(a.x, b.x) AS r FROM l a JOIN l b ON a.row_id = b.row_id AND a.feature <> b.feature GROUP BY ALL)"


@query(f"WITH l AS ({_VL}), {_COR} SELECT a, b, round(r, 6) AS r FROM cor WHERE CAST(a[2:] AS INT) < CAST(b[2:] AS INT) AND abs(r) > 0.05")
def correlated_pairs_embeddings(spark, d):
    return rounded(ranking.correlated_pairs(_vectors(spark, d), DIMENSIONS, 0.05))


def _greedy(steps: int) -> str:
    """SQL of the greedy choice of :func:`ranking.mrmr`, a table for each step."""
    out = []
    for i in range(1, steps + 1):
        before = " UNION ALL ".join(f"SELECT feature FROM s{j}" for j in range(1, i))
        off = f" WHERE rel.feature NOT IN ({before})" if i > 1 else ""
        cost = f" - (SELECT avg(abs(r)) FROM cor WHERE cor.a = rel.feature AND cor.b IN ({before}))" if i > 1 else ""
        out.append(f"s{i} AS (SELECT rel.feature FROM rel{off} ORDER BY round(eta{cost}, 12) DESC, CAST(rel.feature[2:] AS INT) LIMIT 1)")
    return ", ".join(out)


@query(f"WITH l AS ({_VL}), {_ETA}, rel AS (SELECT feature, sqrt(greatest(0, (b - s * s / n) / (q - s * s / n))) AS eta FROM t), {_COR}, {_greedy(5)} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS rank, feature FROM s{i}" for i in range(1, 6)))
def mrmr_embeddings(spark, d):
    chosen = ranking.mrmr(_vectors(spark, d), "vec_id", DIMENSIONS, "label", 5)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(chosen)], "rank int, feature string")


# --- trees ---------------------------------------------------------------------------------


@query()
def tree_nodes_embeddings(spark, d):
    m = trees.grow(_vectors(spark, d), "vec_id", DIMENSIONS, "label", trees.TreeParams(max_depth=3, min_leaf=5))
    return rounded(m.table(spark))


@query()
def tree_permutation_embeddings(spark, d):
    m = trees.grow(_vectors(spark, d), "vec_id", DIMENSIONS, "label", trees.TreeParams(max_depth=2, min_leaf=5, n_resamples=40, threshold_method="histogram", max_thresholds=8))
    return rounded(m.table(spark))


@query()
def forest_importance_embeddings(spark, d):
    v = _vectors(spark, d)
    sample = S.bootstrap(v, "vec_id", 5, 1, "label", "stratified")
    m = trees.grow(v, "vec_id", DIMENSIONS, "label", trees.TreeParams(trees=5, max_depth=3, min_leaf=5, max_features="sqrt"), sample)
    return spark.createDataFrame([(f, round(v, 6)) for f, v in m.importances().items()], "feature string, importance double")


@query()
def tree_regression_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 100).cast("double").alias("c"), F.month("o_orderdate").cast("double").alias("m"))
    m = trees.grow(o, "o_orderkey", ["c", "m"], "o_totalprice", trees.TreeParams(task="regression", max_depth=2, min_leaf=20, threshold_method="histogram", max_thresholds=16))
    return rounded(E.regression_metrics(o.withColumn("p", m.predict()), "o_totalprice", "p"))


# --- sampling ------------------------------------------------------------------------------


@query("""WITH w AS (SELECT n_name, n_nationkey + 1.0::DOUBLE AS weight FROM nation), s AS (SELECT *, round(weight / sum(weight) OVER () * 100, 9) AS e FROM w),
f AS (SELECT *, floor(e) AS fl, 100 - sum(floor(e)) OVER () AS rest, row_number() OVER (ORDER BY e - floor(e) DESC, n_name) AS p FROM s)
SELECT n_name, weight, CAST(fl + CASE WHEN p <= rest THEN 1 ELSE 0 END AS INT) AS allocated FROM f""")  # fmt: skip
def apportion_nation(spark, d):
    n = table(spark, d, "nation").select("n_name", (F.col("n_nationkey") + F.lit(1.0)).alias("weight"))
    return S.apportion(n, "weight", 100, "n_name")


_BOOT = """WITH b AS (SELECT {g} AS g, vec_id, row_number() OVER (PARTITION BY {g} ORDER BY vec_id) AS i FROM embeddings), s AS (SELECT g, count(*) AS n FROM b GROUP BY g), z AS (SELECT *, {m} AS m FROM s),
d AS (SELECT g, n, t, k, CAST('0x' || substr(md5('1|d|' || t || '|' || g || '|' || k), 1, 8) AS BIGINT) % n + 1 AS i FROM z, range(3) a(t), range(1, 500001) c(k) WHERE k <= m)
SELECT CAST(t AS INT) AS tree_id, vec_id AS row_id, count(*) AS n FROM d JOIN b USING (g, i) GROUP BY ALL"""


def _boot(spark, d, kind):
    s = S.bootstrap(_vectors(spark, d), "vec_id", 3, 1, "label", kind)
    return s.groupBy("tree_id", "row_id").agg(F.count("*").alias("n"))


@query(_BOOT.format(g="0", m="n"))
def bootstrap_classic_embeddings(spark, d):
    return _boot(spark, d, "classic")


@query(_BOOT.format(g="label", m="n"))
def bootstrap_stratified_embeddings(spark, d):
    return _boot(spark, d, "stratified")


@query(_BOOT.format(g="label", m="min(n) OVER ()"))
def bootstrap_undersample_embeddings(spark, d):
    return _boot(spark, d, "undersample")


@query(_BOOT.format(g="label", m="sum(n) OVER () // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY g) <= sum(n) OVER () % count(*) OVER () THEN 1 ELSE 0 END"))
def bootstrap_oversample_embeddings(spark, d):
    return _boot(spark, d, "oversample")


@query("WITH smp AS (" + _BOOT.format(g="0", m="n") + ") SELECT CAST(t AS INT) AS tree_id, vec_id AS row_id FROM embeddings, range(3) a(t) WHERE NOT EXISTS (SELECT 1 FROM smp WHERE smp.tree_id = t AND smp.row_id = vec_id)")
def unsampled_embeddings(spark, d):
    v = _vectors(spark, d)
    return S.unsampled(v, "vec_id", S.bootstrap(v, "vec_id", 3, 1), 3)


# --- evaluation ----------------------------------------------------------------------------


@query("SELECT label, CAST(fold AS INT) AS fold, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('7|c|' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings) GROUP BY ALL")
def stratified_folds_embeddings(spark, d):
    return E.folds(_vectors(spark, d), "vec_id", 5, 7, "label").groupBy("label", "fold").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query(f"""WITH b AS (SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY md5('7|c|' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings), l AS ({_VL}), c AS (SELECT l.*, fold FROM l JOIN b ON vec_id = row_id),
s AS (SELECT f.fold, feature, avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT DISTINCT fold FROM b) f JOIN c ON c.fold <> f.fold GROUP BY ALL)
SELECT row_id AS vec_id, feature, round((x - m) / sd, 6) AS x FROM c JOIN s USING (fold, feature)""")  # fmt: skip
def standardize_embeddings(spark, d):
    v = E.folds(_vectors(spark, d), "vec_id", 5, 7, "label")
    return rounded(E.standardize(v, DIMENSIONS, "fold").unpivot("vec_id", DIMENSIONS, "feature", "x"))


_GUESS = "CASE WHEN l_quantity > 25 THEN 'A' WHEN l_discount > 0.05 THEN 'N' ELSE 'R' END"


@query(f"""WITH p AS (SELECT l_returnflag AS t, {_GUESS} AS p FROM lineitem), k AS (SELECT t AS k, count(*) AS tc, count(*) FILTER (t = p) AS hit FROM p GROUP BY 1), q AS (SELECT p AS k, count(*) AS pc FROM p GROUP BY 1),
f AS (SELECT coalesce(tc, 0) AS tc, coalesce(hit, 0) AS hit, 2.0::DOUBLE * coalesce(hit, 0) / (coalesce(tc, 0) + coalesce(pc, 0)) AS f1 FROM k FULL JOIN q USING (k))
SELECT round(sum(hit) / sum(tc), 6) AS accuracy, round(sum(f1 * tc) / sum(tc), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro, round(avg(CASE WHEN tc > 0 THEN hit / tc END), 6) AS balanced_accuracy FROM f""")  # fmt: skip
def classification_metrics_lineitem(spark, d):
    return rounded(E.classification_metrics(_lineitem(spark, d).withColumn("p", F.expr(_GUESS)), "l_returnflag", "p"))


@query("""WITH r AS (SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem)
SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")  # fmt: skip
def roc_auc_lineitem(spark, d):
    return rounded(E.roc_auc(_lineitem(spark, d).withColumn("y", (F.col("l_linestatus") == "O").cast("int")), "y", "l_quantity"))


@query("""WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)
SELECT round(avg((y - p) * (y - p)) / 1000000, 4) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM e""")  # fmt: skip
def regression_metrics_lineitem(spark, d):
    m = E.regression_metrics(_lineitem(spark, d).withColumn("p", F.col("l_quantity") * 1000), "l_extendedprice", "p")
    return m.select(F.round(F.col("mse") / 1000000, 4).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


def _rankings(spark, d):
    s = table(spark, d, "supplier")
    g = s.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s_acctbal")).alias("o"), "s_suppkey"))), lambda x: x["s_suppkey"]).alias("ranking"), F.array_sort(F.collect_list(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")))).alias("truth"))
    return g


_RANK = "WITH g AS (SELECT s_nationkey, list(s_suppkey ORDER BY s_acctbal DESC, s_suppkey) AS r, coalesce(list(s_suppkey) FILTER (s_suppkey % 3 = 0), []) AS t FROM supplier GROUP BY 1), h AS (SELECT *, len(list_intersect(r[1:2], t))::DOUBLE AS hit FROM g)"


@query(_RANK + " SELECT s_nationkey, round(hit / 2, 6) AS precision, round(CASE WHEN len(t) > 0 THEN hit / len(t) ELSE 0 END, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * (hit / 2) * (hit / len(t)) / (hit / 2 + hit / len(t)) ELSE 0 END, 6) AS f1, round(hit / (len(r[1:2]) + len(t) - hit), 6) AS jaccard FROM h")
def ranking_metrics_supplier(spark, d):
    r, t = F.col("ranking"), F.col("truth")
    return rounded(_rankings(spark, d).select("s_nationkey", E.precision_at(r, t, 2).alias("precision"), E.recall_at(r, t, 2).alias("recall"), E.f1_at(r, t, 2).alias("f1"), E.jaccard_at(r, t, 2).alias("jaccard")))


@query(_RANK + " , m AS (SELECT s_nationkey, len(r) AS n, list_min(list_filter(range(1, len(r) + 1), lambda i: list_contains(t, r[i]))) AS h FROM g) SELECT s_nationkey, CAST(coalesce(h, n + 1) AS INT) AS rank, round(coalesce(1.0::DOUBLE / h, 0), 6) AS mrr, coalesce(h, 0) = 1 AS top1 FROM m")
def first_hit_supplier(spark, d):
    return rounded(E.first_hit(_rankings(spark, d), "s_nationkey", "ranking", "truth"))


# --- leaderboard ---------------------------------------------------------------------------


@query(f"WITH b AS ({_BOARD}), s1 AS (SELECT dataset, method, learner, avg(score) AS score FROM b GROUP BY ALL), s2 AS (SELECT dataset, method, avg(score) AS score FROM s1 GROUP BY ALL) SELECT method, round(avg(score), 4) AS score FROM s2 GROUP BY 1")
def mean_of_means_board(spark, d):
    return rounded(B.mean_of_means(_board(spark, d), [["dataset", "method", "learner"], ["dataset", "method"], ["method"]], "score"), 4)


@query(f"WITH b AS ({_BOARD}), s AS (SELECT dataset, method, count(*) AS score FROM b GROUP BY ALL) SELECT dataset, method, score, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS rank FROM s")
def average_rank_board(spark, d):
    s = _board(spark, d).groupBy("dataset", "method").agg(F.count("*").alias("score"))
    return B.average_rank(s, ["dataset"], "score")


@query(f"WITH b AS ({_BOARD}), n AS (SELECT dataset, config, learner FROM b GROUP BY ALL HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM b)) SELECT b.learner, count(*) AS n FROM b SEMI JOIN n USING (dataset, config, learner) GROUP BY 1")
def complete_cases_board(spark, d):
    return B.complete_cases(_board(spark, d), ["dataset", "config", "learner"], "method").groupBy("learner").agg(F.count("*").alias("n"))


@query(f"WITH b AS ({_BOARD}), f AS (SELECT dataset, config, learner FROM b GROUP BY ALL HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM b)) SELECT dataset FROM f GROUP BY dataset HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT config, learner FROM b))")
def fixed_panel_board(spark, d):
    return B.fixed_panel(_board(spark, d), ["config", "learner"], "dataset", "method")


@query(f"WITH b AS ({_BOARD}), s AS (SELECT method, config, avg(score) AS score FROM b GROUP BY ALL) SELECT method, config, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY method ORDER BY score DESC, config) = 1")
def best_config_board(spark, d):
    s = _board(spark, d).groupBy("method", "config").agg(F.avg("score").alias("score"))
    return rounded(B.best_per_group(s, ["method"], "score", ["config"]), 4)


@query(f"WITH b AS ({_BOARD}) SELECT dataset, id, round(score, 4) AS score FROM b QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, id) <= 3")
def top_rows_board(spark, d):
    return rounded(B.top_n(_board(spark, d), ["dataset"], [F.desc("score"), F.asc("id")], 3).select("dataset", "id", "score"), 4)


@query(f"WITH b AS ({_BOARD}) SELECT dataset, method, config, id FROM b QUALIFY row_number() OVER (PARTITION BY dataset, method, config ORDER BY id DESC) = 1")
def keep_last_board(spark, d):
    return B.keep_last(_board(spark, d), ["dataset", "method", "config"], "id").select("dataset", "method", "config", "id")


@query(f"""WITH b AS ({_BOARD}), s AS (SELECT dataset, learner, method, count(*)::DOUBLE AS score FROM b GROUP BY ALL)
SELECT x.method AS focus, y.method AS baseline, count(*) AS n, round(avg(x.score - y.score), 6) AS mean_delta, count(*) FILTER (x.score - y.score > 1e-12) AS wins, count(*) FILTER (x.score - y.score < -1e-12) AS losses, count(*) FILTER (abs(x.score - y.score) <= 1e-12) AS ties
FROM s x JOIN s y ON x.dataset = y.dataset AND x.learner = y.learner AND x.method <> y.method GROUP BY ALL""")  # fmt: skip
def pairwise_board(spark, d):
    s = _board(spark, d).groupBy("dataset", "learner", "method").agg(F.count("*").cast("double").alias("score"))
    return rounded(B.pairwise(s, ["dataset", "learner"], "method", "score"))


@query(f"WITH b AS ({_BOARD}), s AS (SELECT dataset, method, count(*)::DOUBLE AS score FROM b GROUP BY ALL) SELECT s.dataset, s.method, s.score, z.score AS baseline_value, round(s.score / z.score, 6) AS ratio, s.score - z.score AS delta FROM s JOIN s z ON z.dataset = s.dataset AND z.method = 'BUILDING'")
def ratio_to_baseline_board(spark, d):
    s = _board(spark, d).groupBy("dataset", "method").agg(F.count("*").cast("double").alias("score"))
    return rounded(B.ratio_to_baseline(s, ["dataset"], "method", "BUILDING", "score"))


@query(f"""WITH b AS ({_BOARD}), p AS (SELECT dataset, method, config, avg(score) AS s FROM b GROUP BY ALL), h AS (SELECT DISTINCT dataset FROM p),
r AS (SELECT h.dataset, p.method, p.config, round(avg(p.s), 9) AS rest FROM h JOIN p ON p.dataset <> h.dataset GROUP BY ALL),
c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY dataset, method ORDER BY rest DESC, config) = 1)
SELECT c.dataset, c.method, c.config AS chosen, round(c.rest, 4) AS rest, round(p.s, 4) AS held_out_score FROM c LEFT JOIN p USING (dataset, method, config)""")  # fmt: skip
def leave_one_out_board(spark, d):
    return rounded(B.leave_one_out(_board(spark, d), "dataset", "method", "config", "score"), 4)


@query(f"""WITH b AS ({_BOARD}), p AS (SELECT method, config, avg(score) AS s FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS r, s - lead(s) OVER w AS gap, stddev_pop(s) OVER (PARTITION BY method) AS sd FROM p WINDOW w AS (PARTITION BY method ORDER BY s DESC, config))
SELECT method, config AS best_config, round(s, 4) AS best_score, round(gap, 4) AS gap, round(sd, 4) AS sd FROM r WHERE r = 1""")  # fmt: skip
def selection_audit_board(spark, d):
    return rounded(B.selection_audit(_board(spark, d), "method", "config", "score"), 4)


@query(f"WITH b AS ({_BOARD}), m AS (SELECT config, method, avg(score) AS s FROM b GROUP BY ALL) SELECT config, round(stddev_samp(s), 4) AS sd, round(min(s), 4) AS low, round(max(s), 4) AS high, round(max(s) - min(s), 4) AS range FROM m GROUP BY 1")
def spread_board(spark, d):
    return rounded(B.spread(_board(spark, d), ["config"], "method", "score"), 4)


@query(f"WITH b AS ({_BOARD}) SELECT learner, count(*) AS n, round(avg(score), 4) AS mean, round(min(score), 4) AS low, round(max(score), 4) AS high FROM b GROUP BY GROUPING SETS ((learner), ())")
def rollup_all_board(spark, d):
    return rounded(B.rollup_all(_board(spark, d), "learner", "score"), 4)


@query(f"WITH b AS ({_BOARD}) SELECT dataset, round(avg(score) FILTER (learner = 'F'), 4) AS f, round(avg(score) FILTER (learner = 'O'), 4) AS o, round(avg(score) FILTER (learner = 'P'), 4) AS p FROM b GROUP BY 1")
def pivot_board(spark, d):
    p = _board(spark, d).groupBy("dataset").pivot("learner", ["F", "O", "P"]).agg(F.avg("score"))
    return rounded(p.select("dataset", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p")), 4)


@query(f"WITH b AS ({_BOARD}), s AS (SELECT dataset, method, learner, count(*) AS n FROM b GROUP BY ALL) SELECT dataset, method, learner, coalesce(n, 0) AS n FROM (SELECT DISTINCT dataset FROM b) CROSS JOIN (SELECT DISTINCT method FROM b) CROSS JOIN (SELECT DISTINCT learner FROM b) LEFT JOIN s USING (dataset, method, learner)")
def completeness_board(spark, d):
    return B.completeness(_board(spark, d), ["dataset", "method", "learner"])


@query("""WITH b AS (SELECT p_type AS part, n_name AS nation, l_linestatus AS status, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT part, nation, status, line, count(*) AS n FROM b GROUP BY ALL)
SELECT part, nation, status, line, coalesce(n, 0) AS n FROM (SELECT DISTINCT part FROM b) CROSS JOIN (SELECT DISTINCT nation FROM b) CROSS JOIN (SELECT DISTINCT status FROM b) CROSS JOIN (SELECT DISTINCT line FROM b) LEFT JOIN s USING (part, nation, status, line)""")
def completeness_lines(spark, d):
    p, s, n = (table(spark, d, t) for t in ("part", "supplier", "nation"))
    j = _lineitem(spark, d).join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    b = j.select(F.col("p_type").alias("part"), F.col("n_name").alias("nation"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"))
    return B.completeness(b, ["part", "nation", "status", "line"])


@query(f"WITH b AS ({_BOARD}) SELECT method, count(*) AS n, round(median(score), 4) AS p50, round(quantile_cont(score, 0.25), 4) AS p25, round(quantile_cont(score, 0.75), 4) AS p75, round(stddev_samp(score), 4) AS sd, count(DISTINCT dataset) AS datasets FROM b GROUP BY 1")
def quantiles_board(spark, d):
    return rounded(_board(spark, d).groupBy("method").agg(F.count("*").alias("n"), F.median("score").alias("p50"), F.percentile("score", F.lit(0.25)).alias("p25"), F.percentile("score", F.lit(0.75)).alias("p75"), F.stddev_samp("score").alias("sd"), F.countDistinct("dataset").alias("datasets")), 4)


@query(f"WITH b AS ({_BOARD}), s AS (SELECT dataset, method, count(*)::DOUBLE AS score FROM b GROUP BY ALL) SELECT dataset, method, score, score - max(score) OVER (PARTITION BY dataset) AS delta_best, abs(score - max(score) OVER (PARTITION BY dataset)) <= 1e-12 AS is_best FROM s")
def best_observed_board(spark, d):
    s = _board(spark, d).groupBy("dataset", "method").agg(F.count("*").cast("double").alias("score"))
    return B.to_best_observed(s, ["dataset"], "score")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def pending_customers(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(o.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_operations_orders(spark, d):
    o = table(spark, d, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("F").intersect(of("P")).exceptAll(of("O").distinct())


@query("SELECT 'customer' AS kind, c_nationkey AS nation, round(avg(c_acctbal), 4) AS customer_balance, NULL::DOUBLE AS supplier_balance FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, NULL, round(avg(s_acctbal), 4) FROM supplier GROUP BY 2")
def union_by_name(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.avg("c_acctbal"), 4).alias("customer_balance")).withColumn("kind", F.lit("customer"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.avg("s_acctbal"), 4).alias("supplier_balance")).withColumn("kind", F.lit("supplier"))
    return B.union_named([c, s]).select("kind", "nation", "customer_balance", "supplier_balance")


@query("SELECT p_partkey, round((coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 4) AS mean FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_retailprice END AS a, p_size::DOUBLE AS b FROM part)")
def row_mean_part(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("a"), F.col("p_size").cast("double").alias("b"))
    return rounded(p.select("p_partkey", B.row_mean("a", "b").alias("mean")), 4)


@query("SELECT n_name, r_name, CASE WHEN n_nationkey < 8 THEN 'low' WHEN n_nationkey < 16 THEN 'middle' ELSE 'high' END AS bucket FROM nation JOIN region ON n_regionkey = r_regionkey")
def validated_join_nation(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    k = F.col("n_nationkey")
    return B.unique_join(n, r, ["n_regionkey"]).select("n_name", "r_name", F.when(k < 8, "low").when(k < 16, "middle").otherwise("high").alias("bucket"))


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS element FROM embeddings")
def explode_rankings_embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "element")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("element").cast("double").alias("element"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_events(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


# --- inference -----------------------------------------------------------------------------


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))) AS v FROM embeddings), n AS (SELECT count(*) AS n FROM r),
d AS (SELECT b, CAST('0x' || substr(md5('3|d|' || b || '|' || j), 1, 8) AS BIGINT) % n + 1 AS i FROM n, range(1, 101) x(b), range(1, 500001) y(j) WHERE j <= n), m AS (SELECT b, avg(v) AS m FROM d JOIN r USING (i) GROUP BY b)
SELECT (SELECT round(avg(v), 6) FROM r) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")  # fmt: skip
def bootstrap_mean_embeddings(spark, d):
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return rounded(I.bootstrap_mean(table(spark, d, "embeddings").select("vec_id", squares.alias("v")), "vec_id", "v", 100, 3))


_RANKED = f"WITH b AS ({_BOARD}), s AS (SELECT dataset, method, count(*) AS score FROM b GROUP BY ALL), r AS (SELECT dataset, method, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS rank FROM s)"


@query(_RANKED + """, k AS (SELECT count(DISTINCT method)::DOUBLE AS k, count(DISTINCT dataset)::DOUBLE AS n FROM r), q AS (SELECT sum(r * r) AS rr FROM (SELECT sum(rank) AS r FROM r GROUP BY method)), t AS (SELECT sum(c * c * c - c)::DOUBLE AS tt FROM (SELECT count(*) AS c FROM r GROUP BY dataset, rank)),
z AS (SELECT n, k, (12.0::DOUBLE / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - tt / (n * k * (k * k - 1))) AS chi2 FROM k, q, t) SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(chi2, 6) AS chi2, round(chi2 / (n * (k - 1)), 6) AS w FROM z""")  # fmt: skip
def friedman_board(spark, d):
    s = _board(spark, d).groupBy("dataset", "method").agg(F.count("*").alias("score"))
    return rounded(I.friedman(B.average_rank(s, ["dataset"], "score"), "dataset", "method", "rank"))


_PHI = "1.0::DOUBLE"
for _k in range(60, 0, -1):
    _PHI = f"(1 + x * x / {2 * _k + 1}.0::DOUBLE * {_PHI})"
_DELTA = f"WITH b AS ({_BOARD}), s AS (SELECT dataset, method, count(*)::DOUBLE AS score FROM b GROUP BY ALL), p AS (SELECT x.method, x.dataset, x.score - y.score AS delta FROM s x JOIN s y ON x.dataset = y.dataset AND y.method = 'BUILDING' AND x.method <> 'BUILDING'), d AS (SELECT method, delta, rank() OVER (PARTITION BY method ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY method, abs(delta)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY method, abs(delta))::DOUBLE AS t FROM p WHERE delta <> 0), w AS (SELECT method, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_plus, sum(t * t - 1) AS tt FROM d GROUP BY method), z0 AS (SELECT method, n, w_plus, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2.0::DOUBLE * n + 1) / 24 - tt / 48) AS z FROM w), z1 AS (SELECT *, abs(z) AS x FROM z0), z AS (SELECT method, n, w_plus, round(z, 6) AS z, round(greatest(0, 1 - 2 * exp(-x * x / 2) / sqrt(2 * pi()) * x * {_PHI}), 6) AS p_value FROM z1)"


def _signed(spark, d):
    s = _board(spark, d).groupBy("dataset", "method").agg(F.count("*").cast("double").alias("score"))
    pairs = B.ratio_to_baseline(s, ["dataset"], "method", "BUILDING", "score").where("method <> 'BUILDING'")
    return rounded(I.wilcoxon(pairs, ["method"], "delta"))


@query(_DELTA + " SELECT * FROM z")
def wilcoxon_board(spark, d):
    return _signed(spark, d)


@query(_DELTA + " , o AS (SELECT method, p, row_number() OVER (ORDER BY p, method) AS i, count(*) OVER () AS m FROM (SELECT method, p_value AS p FROM z)) SELECT method, round(p, 6) AS p, round(max(least(1.0::DOUBLE, p * (m - i + 1))) OVER (ORDER BY i), 6) AS holm FROM o")
def holm_board(spark, d):
    t = _signed(spark, d).select("method", F.col("p_value").alias("p"))
    return rounded(I.holm(t, "p", ["method"]))


@query("WITH s AS (SELECT l_linestatus AS g, avg(l_quantity) AS m, var_samp(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d FROM s a, s b WHERE a.g = 'O' AND b.g = 'F'")
def cohens_d_lineitem(spark, d):
    return rounded(I.cohens_d(_lineitem(spark, d), "l_linestatus", "O", "F", "l_quantity"))




# --- rankings around a model -----------------------------------------------------------------


def _named(spark, rows, schema):
    return rounded(spark.createDataFrame(rows, schema))


@query()
def permutation_importance_embeddings(spark, d):
    return rounded(wrappers.permutation_importance(_vectors(spark, d), "vec_id", DIMENSIONS, "label", seed=3, repeats=5))


@query()
def conditional_importance_embeddings(spark, d):
    return rounded(wrappers.permutation_importance(_vectors(spark, d), "vec_id", DIMENSIONS, "label", seed=3, repeats=5, conditional=0.2))


@query()
def permutation_importance_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 100).cast("double").alias("c"), F.month("o_orderdate").cast("double").alias("m"))
    return rounded(wrappers.permutation_importance(o, "o_orderkey", ["c", "m"], "o_totalprice", "regression", seed=3, repeats=3))


@query()
def boruta_embeddings(spark, d):
    return _named(spark, wrappers.boruta(_vectors(spark, d), "vec_id", DIMENSIONS, "label", seed=1, rounds=10), "feature string, decision string, hits int, rank int")


@query()
def elimination_embeddings(spark, d):
    return _named(spark, wrappers.eliminate(_vectors(spark, d), DIMENSIONS, "label", seed=1), "feature string, rank int")


@query()
def model_importance_embeddings(spark, d):
    rows = [(m, f, float(v)) for m in ("dt", "rf") for f, v in wrappers.importances(_vectors(spark, d), "vec_id", DIMENSIONS, "label", m).items()]
    return _named(spark, rows, "model string, feature string, importance double")


@query()
def split_counts_embeddings(spark, d):
    v = _vectors(spark, d)
    m = trees.grow(v, "vec_id", DIMENSIONS, "label", trees.TreeParams(trees=3, max_depth=2, min_leaf=5, max_features="sqrt"), S.bootstrap(v, "vec_id", 3, 1, "label", "stratified"))
    return ranking.split_counts(m.table(spark))


@query(f"""WITH v AS (SELECT row_id, feature, x FROM ({_VL})),
r AS (SELECT v.*, b, label, md5('5|' || feature || '|' || b || '|' || row_id) AS h FROM v JOIN embeddings ON vec_id = row_id, range(1, 4) g(b))
SELECT feature, CAST(b AS INT) AS b, row_id, round(coalesce(lead(x) OVER w, first(x) OVER w), 6) AS x FROM r WINDOW w AS (PARTITION BY feature, b, label ORDER BY h, row_id)""")
def donated_embeddings(spark, d):
    within = dict.fromkeys(DIMENSIONS, F.col("label"))
    return rounded(wrappers.donated(_vectors(spark, d), "vec_id", DIMENSIONS, 5, 3, within))


@query("""WITH c AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS a, list_sort(list_distinct(quantile_cont(l_discount, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS z FROM lineitem),
s AS (SELECT 5 * len(list_filter(a[2:-2], lambda t: t <= l_quantity)) + len(list_filter(z[2:-2], lambda t: t <= l_discount)) AS stratum FROM lineitem, c)
SELECT CAST(stratum AS BIGINT) AS stratum, count(*) AS n FROM s GROUP BY ALL""")
def strata_lineitem(spark, d):
    rows = _lineitem(spark, d)
    return rows.groupBy(wrappers.strata(rows, ["l_quantity", "l_discount"]).alias("stratum")).agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY md5('2|c|' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings), all_l AS ({_VL}),
l0 AS (SELECT g.f AS held, a.* FROM all_l a JOIN d ON vec_id = row_id JOIN range(5) g(f) ON g.f <> fold),
cells AS (SELECT held, feature, y, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM l0 GROUP BY ALL),
e AS (SELECT held, feature, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) AS eta FROM cells GROUP BY held, feature)
SELECT CAST(held AS INT) AS fold, CAST(row_number() OVER (PARTITION BY held ORDER BY eta DESC, feature) AS INT) AS rank, feature FROM e""")
def ranking_over_folds_embeddings(spark, d):
    def rank(train, seed):
        t = ranking.rank_by_score(association.correlation_ratio(association.long_table(train, "vec_id", DIMENSIONS, "label")), "eta")
        return [r["feature"] for r in t.orderBy("rank").collect()]

    rows = [(fold, i + 1, f) for fold, order in wrappers.rank_over_folds(_vectors(spark, d), "vec_id", DIMENSIONS, "label", rank, seed=2) for i, f in enumerate(order)]
    return spark.createDataFrame(rows, "fold int, rank int, feature string")


_KNN = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, (row_number() OVER (PARTITION BY label ORDER BY md5('7|c|' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings), j AS (SELECT q.vec_id AS row_id, t.vec_id AS id, t.label AS y, list_distance(q.v[1:{n}], t.v[1:{n}]) AS d FROM v q JOIN v t ON q.fold = 0 AND t.fold > 0), n AS (SELECT *, min(d) OVER (PARTITION BY row_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, id) AS r FROM j) WHERE r <= 5), s AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1 / d END AS w FROM n) "


def _knn(spark, d, features, target, task):
    f = E.folds(_vectors(spark, d), "vec_id", 5, 7, "label")
    return E.neighbour_predict(f.where("fold > 0"), f.where("fold = 0"), "vec_id", features, target, 5, task)


@query(_KNN.format(n=64) + "SELECT row_id, y AS prediction FROM (SELECT row_id, y, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, y) AS r FROM (SELECT row_id, y, round(sum(w), 9) AS v FROM s GROUP BY ALL)) WHERE r = 1")
def neighbour_class_embeddings(spark, d):
    return _knn(spark, d, DIMENSIONS, "label", "classification")


@query(_KNN.format(n=63) + "SELECT row_id, round(sum(w * e63) / sum(w), 6) AS prediction FROM s JOIN (SELECT vec_id AS id, CAST(embedding[64] AS DOUBLE) AS e63 FROM embeddings) USING (id) GROUP BY row_id")
def neighbour_value_embeddings(spark, d):
    return rounded(_knn(spark, d, DIMENSIONS[:63], "e63", "regression"))


@query(_RANK + ", p AS (SELECT s_nationkey, unnest(r[1:6]) AS f FROM g), u AS (SELECT s_nationkey, CASE f % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'other' END AS grp, 1 AS hits FROM p UNION ALL SELECT s_nationkey, 'missing', 6 - len(r[1:6]) FROM g WHERE len(r) < 6) SELECT s_nationkey, grp, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) / 6.0::DOUBLE, 6) AS share FROM u GROUP BY ALL")
def composition_supplier(spark, d):
    groups = table(spark, d, "supplier").where("s_suppkey % 4 < 3").select(F.col("s_suppkey").alias("feature"), F.element_at(F.array(*(F.lit(g) for g in "abc")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("grp"))
    return rounded(E.composition(_rankings(spark, d), "s_nationkey", "ranking", groups, 6, 100))


from . import more_queries  # noqa: E402,F401 - registers its queries
