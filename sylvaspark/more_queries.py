"""Further registered queries: tests by other statistics and rules, threshold tests, capped samples, honest trees, models on
rankings, sensitivity tables and generated data.  Importing this module adds them to :mod:`sylvaspark.queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import association
from .functions.distributions import stop_table
from .operators import board as B
from .operators import evaluation as E
from .operators import inference as I
from .operators import permutation as P
from .operators import sampling as S
from .operators import splits, trees
from .plans import downstream, experiments, ranking, wrappers
from .queries import _BOARD, _BOOT, _MC, _PERM, _PHI, _RANK, _TAIL, _VL, DIMENSIONS, _board, _lineitem, _rankings, _vector_long, _vectors, query, rounded
from .sources import files, generators
from .sources.files import table

# --- permutation tests -----------------------------------------------------------------------


def _judged(spark, d, target: str = "quality", features=("n_chars", "n_words", "n_lines")):
    """Documents with a label, long: sizes of the text against the label, or against another size."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    sizes = t.select("doc_id", "quality", "toxic", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("double").alias("n_words"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("double").alias("n_lines"))
    return association.long_table(sizes, "doc_id", [f for f in features if f != target], target)


_JL = "SELECT doc_id AS row_id, {y} AS y, f.* FROM documents JOIN labels USING (doc_id), LATERAL (VALUES ('n_chars', n_chars::DOUBLE), ('n_words', len(string_split(coalesce(text, ''), ' '))::DOUBLE), ('n_lines', len(string_split(coalesce(text, ''), chr(10)))::DOUBLE)) f(feature, x)"


def _stopped_sql(ends: str) -> str:
    return f"""WITH l AS ({_VL}), {_PERM}, {_MC}, rn AS (SELECT a.feature, a.b, sum(CASE WHEN a.t >= o.t - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY a.feature ORDER BY a.b) AS hits FROM smc a JOIN smc o ON o.feature = a.feature AND o.b = 0 WHERE a.b > 0),
    {ends} SELECT feature, CAST(b AS INT) AS m, CAST(hits AS BIGINT) AS hits, round((hits + 1) / (b + 1.0::DOUBLE), 6) AS p_value FROM e QUALIFY row_number() OVER (PARTITION BY feature ORDER BY b) = 1"""


_BATCHED = ", ".join(f"({m}, {c})" for m, c, _ in stop_table(0.05, 0.95, 100, 32))


@query(_stopped_sql(f"st(b, hits) AS (VALUES {_BATCHED}), e AS (SELECT rn.feature, rn.b, rn.hits FROM rn LEFT JOIN st ON st.b = rn.b AND st.hits = rn.hits WHERE st.b IS NOT NULL OR rn.b = 100)"))
def sequential_batched_embeddings(spark, d):
    return rounded(P.sequential_test(_vector_long(spark, d), 100, 0, every=32))


@query(_stopped_sql("e AS (SELECT * FROM rn WHERE b = 100 OR (b >= 20 AND ((hits + 1) / (b + 1.0::DOUBLE) < 0.05 OR ((hits + 1) / 101.0::DOUBLE >= 0.05 AND hits >= 3))))"))
def sequential_simple_embeddings(spark, d):
    return rounded(P.sequential_test(_vector_long(spark, d), 100, 0, rule="simple"))


_PAIRS = """dx AS (SELECT b, feature, a_id, avg(dx) AS a, avg(dy) AS c, avg(dx * dy) AS ac, avg(dx * dx) AS aa, avg(dy * dy) AS cc FROM
  (SELECT p.b, p.feature, p.row_id AS a_id, abs(p.x - q.x) AS dx, abs(CAST(p.y AS DOUBLE) - q.y) AS dy FROM j p JOIN j q ON p.b = q.b AND p.feature = q.feature) GROUP BY ALL),
sdc AS (SELECT b, feature, avg(ac) - 2 * avg(a * c) + avg(a) * avg(c) AS xy, avg(aa) - 2 * avg(a * a) + avg(a) * avg(a) AS xx, avg(cc) - 2 * avg(c * c) + avg(c) * avg(c) AS yy FROM dx GROUP BY ALL),
sd AS (SELECT feature, b, CASE WHEN sqrt(greatest(0, xx) * greatest(0, yy)) > 1e-15 THEN sqrt(greatest(0, xy) / sqrt(greatest(0, xx) * greatest(0, yy))) ELSE 0 END AS t FROM sdc)"""


@query(f"WITH l AS (SELECT * FROM ({_JL.format(y='n_chars')}) WHERE feature <> 'n_chars'), {_PERM.replace('range(1, 101)', 'range(1, 20)').replace('j AS (SELECT ev.b,', 'j AS (SELECT ev.b, ev.row_id,')}, {_PAIRS} " + _TAIL.format(s="sd").replace("101.0", "20.0"))
def permutation_dc_documents(spark, d):
    return rounded(P.permutation_test(_judged(spark, d, "n_chars"), 19, 0, "dc"))


@query()
def permutation_mi_documents(spark, d):
    return rounded(P.permutation_test(_judged(spark, d), 39, 0, "mi"))


@query()
def permutation_rdc_documents(spark, d):
    return rounded(P.permutation_test(_judged(spark, d, "n_chars"), 39, 0, "rdc"))


@query()
def permutation_rdc_class_documents(spark, d):
    return rounded(P.permutation_test(_judged(spark, d), 39, 0, "rdc_class"))


@query()
def rdc_sequential_documents(spark, d):
    return rounded(P.sequential_test(_judged(spark, d, "toxic"), 64, 0, "rdc_class", every=32))


@query()
def rdc_class_embeddings(spark, d):
    return rounded(association.rdc(_vector_long(spark, d), task="classification"))


@query(f"WITH l AS ({_VL}), {_PERM}, {_MC}, pv AS ({_TAIL.format(s='smc')}), o AS (SELECT *, row_number() OVER (ORDER BY round(statistic, 6) DESC, feature) AS i FROM pv), f AS (SELECT min(i) AS i FROM o WHERE p_value < 0.05) SELECT o.feature, statistic, p_value, o.i <= coalesce(f.i, o.i) AS tested, CAST(o.i AS INT) AS place, o.i = f.i AS reject FROM o, f WHERE o.i <= coalesce(f.i, o.i)")
def features_until_accepted_embeddings(spark, d):
    t = rounded(P.permutation_test(_vector_long(spark, d), 100, 0, "mc"))
    order = [F.desc(F.round("statistic", 6)), "feature"]
    out = P.first_accepted(t, [], order, F.lit(0.05), True)
    w = F.row_number().over(P.Window.partitionBy(F.lit(1)).orderBy(*order))
    return out.withColumn("place", w).where("tested").select("feature", "statistic", "p_value", "tested", "place", "reject")


# --- threshold tests -------------------------------------------------------------------------

_AT = """m AS (SELECT feature, (x + nx) / 2 AS t FROM (SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx FROM (SELECT DISTINCT feature, x FROM l)) WHERE nx IS NOT NULL),
h AS (SELECT DISTINCT feature, a + i * (z - a) / 4 AS threshold FROM (SELECT feature, min(t) AS a, max(t) AS z, count(*) AS n FROM m GROUP BY 1), range(5) g(i) WHERE n > 3 UNION SELECT feature, t FROM m QUALIFY count(*) OVER (PARTITION BY feature) <= 3),
pp AS (SELECT j.b, j.y, j.feature, h.threshold, j.x > h.threshold AS side FROM j JOIN h ON h.feature = j.feature)"""
_END = "SELECT o.feature, round(o.threshold, 6) AS threshold, round(any_value(o.t), {r}) AS statistic, count(*) FILTER (a.t <= o.t + 1e-9) AS hits, round((count(*) FILTER (a.t <= o.t + 1e-9) + 1) / 50.0::DOUBLE, 6) AS p_value FROM st a JOIN st o ON o.feature = a.feature AND o.threshold = a.threshold AND o.b = 0 WHERE a.b > 0 GROUP BY o.feature, o.threshold"


def _threshold_sql(y: str, impurity: str, digits: int) -> str:
    l = f"SELECT * FROM ({_JL.format(y=y)})" + (" WHERE feature <> 'n_chars'" if y == "n_chars" else "")
    return f"WITH l AS ({l}), {_PERM.replace('range(1, 101)', 'range(1, 50)')}, {_AT}, {impurity} {_END.format(r=digits)}"


def _class_sql(f: str) -> str:
    return f"c AS (SELECT feature, threshold, b, side, y, count(*) AS c FROM pp GROUP BY ALL), s AS (SELECT feature, threshold, b, side, sum(c)::DOUBLE AS n, {f} AS q FROM c GROUP BY ALL), st AS (SELECT feature, threshold, b, CASE WHEN count(*) = 2 THEN sum(q) / sum(n) ELSE 'inf'::DOUBLE END AS t FROM s GROUP BY ALL)"


def _thresholds_tested(spark, d, criterion, target, digits=6):
    long = _judged(spark, d, target)
    t = P.threshold_test(long, splits.thresholds(long, "histogram", 4), 49, 0, criterion)
    return t.select("feature", F.round("threshold", 6).alias("threshold"), F.round("statistic", digits).alias("statistic"), "hits", F.round("p_value", 6).alias("p_value"))


@query(_threshold_sql("quality", _class_sql("sum(c) - sum(c * c) / sum(c)"), 6))
def threshold_test_gini_documents(spark, d):
    return _thresholds_tested(spark, d, "gini", "quality")


@query(_threshold_sql("quality", _class_sql("sum(c) * log2(sum(c)::DOUBLE) - sum(c * log2(c::DOUBLE))"), 6))
def threshold_test_entropy_documents(spark, d):
    return _thresholds_tested(spark, d, "entropy", "quality")


@query(_threshold_sql("n_chars", "s AS (SELECT feature, threshold, b, side, count(*) AS n, var_pop(y::DOUBLE) AS v FROM pp GROUP BY ALL), st AS (SELECT feature, threshold, b, CASE WHEN count(*) = 2 THEN sum(n * v) / sum(n) / 1000000 ELSE 'inf'::DOUBLE END AS t FROM s GROUP BY ALL)", 3))
def threshold_test_mse_documents(spark, d):
    long = _judged(spark, d, "n_chars").withColumn("y", F.col("y") / 1000)
    t = P.threshold_test(long, splits.thresholds(long, "histogram", 4), 49, 0, "mse")
    return t.select("feature", F.round("threshold", 6).alias("threshold"), F.round("statistic", 3).alias("statistic"), "hits", F.round("p_value", 6).alias("p_value"))


@query(_threshold_sql("n_chars", "w AS (SELECT *, median(y) OVER (PARTITION BY feature, threshold, b, side) AS md FROM pp), s AS (SELECT feature, threshold, b, side, count(*) AS n, avg(abs(y - md)) AS v FROM w GROUP BY ALL), st AS (SELECT feature, threshold, b, CASE WHEN count(*) = 2 THEN sum(n * v) / sum(n) ELSE 'inf'::DOUBLE END AS t FROM s GROUP BY ALL)", 4))
def threshold_test_mae_documents(spark, d):
    return _thresholds_tested(spark, d, "mae", "n_chars", 4)


# --- samples and trees -----------------------------------------------------------------------

_KEPT = _BOOT.replace("k, CAST('0x'", "k, keep, CAST('0x'").replace("z AS (SELECT *, {m} AS m FROM s)", "z AS (SELECT *, {m} AS m, {keep} AS keep FROM s)").replace("d AS (SELECT g, n, t, k,", "d AS (SELECT g, n, t, k,").replace("SELECT CAST(t AS INT) AS tree_id", "SELECT CAST(t AS INT) AS tree_id").replace(
    "FROM d JOIN b USING (g, i) GROUP BY ALL", "FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY t, g ORDER BY md5('1|k|' || t || '|' || g || '|' || k), k) <= keep) d JOIN b USING (g, i) GROUP BY ALL")
_EVEN = "100 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY g) <= 100 % count(*) OVER () THEN 1 ELSE 0 END"
_SHARED = "(SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, g) <= 100 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS share FROM (SELECT *, round(n::DOUBLE / sum(n) OVER () * 100, 9) AS e, n AS m FROM s))"


def _capped(spark, d, kind):
    s = S.bootstrap(_vectors(spark, d), "vec_id", 3, 1, "label", kind, max_samples=100)
    return s.groupBy("tree_id", "row_id").agg(F.count("*").alias("n"))


def _kept_sql(g: str, m: str, keep: str) -> str:
    return _KEPT.format(g=g, m=m, keep=keep).replace("SELECT *, " + m + " AS m, " + keep + " AS keep FROM s", f"SELECT *, {keep} AS keep FROM (SELECT *, {m} AS m FROM s)")


@query(_kept_sql("0", "n", "least(n, 100)"))
def bootstrap_classic_capped_embeddings(spark, d):
    return _capped(spark, d, "classic")


@query(_kept_sql("label", "n", "least(n, share)").replace("(SELECT *, n AS m FROM s)", _SHARED))
def bootstrap_stratified_capped_embeddings(spark, d):
    return _capped(spark, d, "stratified")


@query(_kept_sql("label", "min(n) OVER ()", f"CASE WHEN sum(m) OVER () > 100 THEN least(m, {_EVEN}) ELSE m END"))
def bootstrap_undersample_capped_embeddings(spark, d):
    return _capped(spark, d, "undersample")


@query(_kept_sql("label", _EVEN, "m"))
def bootstrap_oversample_capped_embeddings(spark, d):
    return _capped(spark, d, "oversample")


@query()
def honest_tree_embeddings(spark, d):
    m = trees.grow(_vectors(spark, d), "vec_id", DIMENSIONS, "label", trees.TreeParams(max_depth=3, min_leaf=5, honesty=True))
    return rounded(m.table(spark))


@query()
def sequential_tree_embeddings(spark, d):
    m = trees.grow(_vectors(spark, d), "vec_id", DIMENSIONS, "label", trees.TreeParams(max_depth=2, min_leaf=5, n_resamples_feature=20, n_resamples_threshold=20, early_stopping="adaptive", threshold_method="histogram", max_thresholds=8))
    return rounded(m.table(spark))


@query()
def out_of_bag_embeddings(spark, d):
    v = _vectors(spark, d)
    sample = S.bootstrap(v, "vec_id", 5, 1, "label", "stratified")
    m = trees.grow(v, "vec_id", DIMENSIONS, "label", trees.TreeParams(trees=5, max_depth=3, min_leaf=5, max_features="sqrt"), sample)
    return rounded(trees.oob_score(m, v, "vec_id", "label", S.unsampled(v, "vec_id", sample, 5)))


@query()
def forest_paths_embeddings(spark, d):
    v = _vectors(spark, d)
    m = trees.grow(v, "vec_id", DIMENSIONS, "label", trees.TreeParams(trees=2, max_depth=2, min_leaf=5, max_features="sqrt"))
    return m.decision_path(v, "vec_id", None)


# --- models on rankings ----------------------------------------------------------------------


@query()
def evaluate_fold_embeddings(spark, d):
    v = E.folds(_vectors(spark, d), "vec_id", 5, 7, "label")
    rows = downstream.evaluate_fold(v.where("fold > 0"), v.where("fold = 0"), "vec_id", DIMENSIONS, "label", ks=[64], models=("lr", "knn"))
    names = list(rows[0])
    return rounded(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "k int, n_features_selected int, downstream_model string, accuracy double, f1 double, f1_macro double, balanced_accuracy double, roc_auc double, auc double"))


@query()
def evaluate_fold_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 100).cast("double").alias("c"), F.month("o_orderdate").cast("double").alias("m"), F.year("o_orderdate").cast("double").alias("y"))
    v = E.folds(o, "o_orderkey", 5, 7)
    rows = downstream.evaluate_fold(v.where("fold > 0"), v.where("fold = 0"), "o_orderkey", ["c", "m", "y"], "o_totalprice", "regression", ks=[2, 3], models=("ridge", "svr"))
    names = list(rows[0])
    return rounded(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "k int, n_features_selected int, downstream_model string, mse double, rmse double, mae double, r2 double"), 2)


@query("""WITH c AS (SELECT c, CASE WHEN l_returnflag = c THEN 1 ELSE 0 END AS t, CASE c WHEN 'A' THEN l_discount WHEN 'N' THEN l_tax ELSE l_quantity / 50 END AS p FROM lineitem, (VALUES ('A'), ('N'), ('R')) v(c)),
r AS (SELECT c, t, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2.0::DOUBLE AS r FROM c),
a AS (SELECT c, sum(t) AS w, (sum(r) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2.0::DOUBLE) / (sum(t) * sum(1 - t)) AS auc FROM r GROUP BY c) SELECT round(sum(auc * w) / sum(w), 6) AS auc FROM a""")  # fmt: skip
def roc_auc_ovr_lineitem(spark, d):
    scores = F.array("l_discount", "l_tax", F.col("l_quantity") / 50)
    return rounded(E.roc_auc_ovr(_lineitem(spark, d).withColumn("s", scores), "l_returnflag", "s", ["A", "N", "R"]))


@query(_RANK + " SELECT s_nationkey, len(list_intersect(r[1:2], t)) > 0 AS any_hit, len(list_intersect(r[1:2], t)) = len(r[1:2]) AS all_hit, round(CASE WHEN len(t) > 0 THEN hit / 2 ELSE 0 END, 6) AS noise_rate, CASE WHEN len(r[1:2]) > 1 THEN round((list_max(r[1:2]) - list_min(r[1:2])) / 9999.0::DOUBLE, 6) END AS spread, round(len(list_filter(r[1:2], lambda f: f >= 50 AND NOT list_contains(t, f))) / 2.0::DOUBLE, 6) AS confounders FROM h")
def ranking_diagnostics_supplier(spark, d):
    r, t = F.col("ranking"), F.col("truth")
    any_, all_ = E.hits_at(r, t, 2)
    return rounded(_rankings(spark, d).select("s_nationkey", any_.alias("any_hit"), all_.alias("all_hit"), E.noise_rate(r, t, 2).alias("noise_rate"), E.index_spread(r, F.lit(10000), 2).alias("spread"), E.confounder_rate(r, t, F.lit(50), 2).alias("confounders")))


@query(f"WITH b AS ({_BOARD}) SELECT method, len(list_filter([0, 1, 2], lambda k: NOT list_contains(list(seed), k))) = 0 AS covered FROM b GROUP BY 1")
def k_coverage_board(spark, d):
    return E.k_values_covered(_board(spark, d).withColumnRenamed("seed", "k"), ["method"], [0, 1, 2])


# --- sensitivity tables ----------------------------------------------------------------------

_CELL = f"b AS ({_BOARD}), s AS (SELECT dataset, method, learner, seed, avg(score) AS score FROM b GROUP BY ALL)"


def _cells(spark, d):
    return _board(spark, d).groupBy("dataset", "method", "learner", "seed").agg(F.avg("score").alias("score"))


_TIED = "rank() OVER (PARTITION BY {p} ORDER BY {o}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0::DOUBLE"


def _places(by: str, cell: str) -> str:
    return f"""rk AS (SELECT *, {_TIED.format(p=f"{by}, {cell}", o="score DESC", v="score")} AS rank FROM s),
mr AS (SELECT {by}, method, round(avg(rank), 12) AS mean_rank FROM rk GROUP BY ALL), ps AS (SELECT *, {_TIED.format(p=by, o="mean_rank", v="mean_rank")} AS position FROM mr)"""


@query(f"WITH {_CELL}, {_places('learner', 'dataset, seed')} SELECT learner, method, round(mean_rank, 6) AS mean_rank, position FROM ps")
def rank_of_means_board(spark, d):
    return rounded(B.rank_of_means(_cells(spark, d), ["learner"], ["dataset", "seed"], "method", "score"))


_SEEDS = """f AS (SELECT count(DISTINCT method) AS m, count(DISTINCT seed) * count(DISTINCT learner) AS r FROM s), pc AS (SELECT dataset, seed, learner, count(DISTINCT method) AS n FROM s GROUP BY ALL),
mb AS (SELECT dataset, count(*) FILTER (n = m) AS n_complete_cells, count(*) AS n_observed_cells, any_value(r) AS required_cells FROM pc, f GROUP BY dataset)"""


@query(f"WITH {_CELL}, {_SEEDS} SELECT *, n_complete_cells = required_cells AS seed_complete FROM mb")
def seed_membership_board(spark, d):
    return B.seed_membership(_cells(spark, d), ["learner"], "dataset", "method", "seed")


@query(f"WITH {_CELL.replace(', s AS', ', s0 AS')}, s AS (SELECT * FROM s0 WHERE learner <> 'P'), {_SEEDS}, s1 AS (SELECT s.* FROM s JOIN mb USING (dataset) WHERE n_complete_cells = required_cells), {_places('seed', 'learner, dataset').replace('FROM s)', 'FROM s1)')} SELECT method, count(DISTINCT seed) AS n_seeds, round(avg(position), 6) AS mean_position, min(position) AS best_position, max(position) AS worst_position, round(avg(mean_rank), 6) AS mean_rank FROM ps GROUP BY method")
def seed_sensitivity_board(spark, d):
    return rounded(B.seed_sensitivity(_cells(spark, d).where("learner <> 'P'"), ["learner"], "dataset", "method", "seed", "score"))


@query(f"WITH {_CELL}, {_places('learner, seed', 'dataset')} SELECT method, round(avg(position), 6) AS mean_position, round(avg(mean_rank), 6) AS mean_rank, min(position) AS best_position, max(position) AS worst_position, count(*) FILTER (position <= 3) AS top3_cells, count(*) FILTER (position <= 5) AS top5_cells, count(*) AS n_cells, round(avg(position) FILTER (learner = 'F'), 6) AS \"F_mean_position\", round(avg(position) FILTER (learner = 'O'), 6) AS \"O_mean_position\" FROM ps GROUP BY method")
def learner_sensitivity_board(spark, d):
    return rounded(B.learner_sensitivity(_cells(spark, d), "learner", "seed", "dataset", "method", "score", ["F", "O"]))


@query(f"WITH b AS ({_BOARD}), s AS (SELECT dataset, config, method, avg(score) AS score FROM b GROUP BY ALL) SELECT s.dataset, s.config, s.method, round(s.score, 4) AS score, round(z.score, 4) AS default_value, round(s.score - z.score, 4) AS delta FROM s LEFT JOIN s z ON z.dataset = s.dataset AND z.method = s.method AND z.config = '1-URGENT'")
def delta_to_default_board(spark, d):
    s = _board(spark, d).groupBy("dataset", "config", "method").agg(F.avg("score").alias("score"))
    return rounded(B.delta_to_default(s, ["dataset", "method"], "config", "1-URGENT", "score"), 4)


@query(f"WITH b AS ({_BOARD}) SELECT DISTINCT dataset, method, first_value(config IGNORE NULLS) OVER w AS config, first_value(id) OVER w AS id FROM b WINDOW w AS (PARTITION BY dataset, method ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_row_board(spark, d):
    return B.first_per_group(_board(spark, d), ["dataset", "method"], [F.desc("score"), F.asc("id")], ["config", "id"])


@query(f"WITH b AS ({_BOARD}) SELECT method, CAST(CASE method WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS INT) AS place, count(*) AS n FROM b GROUP BY ALL")
def custom_order_board(spark, d):
    return _board(spark, d).groupBy("method").agg(F.count("*").alias("n")).withColumn("place", B.custom_order("method", ["MACHINERY", "BUILDING"]).cast("int"))


@query(f"WITH b AS ({_BOARD}), s AS (SELECT dataset, seed, avg(score) AS score, count(*)::DOUBLE AS n FROM b GROUP BY ALL) SELECT dataset, round(avg(score), 4) AS score_mean, round(stddev_pop(score), 4) AS score_std, round(avg(n), 4) AS n_mean, round(stddev_pop(n), 4) AS n_std FROM s GROUP BY 1")
def aggregate_seeds_board(spark, d):
    s = _board(spark, d).groupBy("dataset", "seed").agg(F.avg("score").alias("score"), F.count("*").cast("double").alias("n"))
    return rounded(B.aggregate_seeds(s, ["dataset"], ["score", "n"]), 4)


@query("SELECT n_name AS dataset, s.seed::INT AS seed, m AS method FROM nation, range(3) s(seed), (VALUES ('a'), ('b')) v(m) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9990) OR m = 'a'")
def grid_with_exclusions_nation(spark, d):
    n = table(spark, d, "nation")
    rich = table(spark, d, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("n_nationkey"))
    out = n.join(rich, "n_nationkey", "left_semi").select(F.col("n_name").alias("dataset"), F.lit("b").alias("method"))
    axes = B.grid({"dataset": [r[0] for r in n.select("n_name").orderBy("n_name").collect()], "seed": [0, 1, 2], "method": ["a", "b"]}, spark, out)
    return axes.select("dataset", "seed", "method")


@query("SELECT n_name, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey")
def config_lookup_customer(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("config_id"), "n_name")
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "config_id")
    return B.with_config(c, n).select("n_name", "c_custkey", "c_acctbal")


@query("SELECT p_type, CASE WHEN contains(p_type, 'STANDARD') THEN 'x' ELSE 'y' END AS kind, 'standard' AS family, count(*) AS n FROM part GROUP BY ALL")
def family_part(spark, d):
    p = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return p.select("p_type", F.when(F.contains("p_type", F.lit("STANDARD")), "x").otherwise("y").alias("kind"), B.family_of_name(F.col("p_type")).alias("family"), "n")


@query(f"""WITH {_CELL}, p AS (SELECT a.method AS method1, c.method AS method2, a.score - c.score AS delta FROM s a JOIN s c USING (dataset, learner, seed) WHERE a.method < c.method), e AS (SELECT method1, method2 FROM p GROUP BY ALL HAVING count(*) >= 10),
d AS (SELECT method1, method2, delta, {_TIED.format(p="method1, method2", o="abs(delta)", v="abs(delta)")} AS r, count(*) OVER (PARTITION BY method1, method2, abs(delta))::DOUBLE AS t FROM p JOIN e USING (method1, method2) WHERE delta <> 0),
w AS (SELECT method1, method2, count(*)::DOUBLE AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_plus, sum(t * t - 1) AS tt FROM d GROUP BY ALL),
z AS (SELECT *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tt / 48) AS z FROM w), v AS (SELECT *, abs(z) AS x FROM z),
o AS (SELECT *, greatest(0, 1 - 2 * exp(-x * x / 2) / sqrt(2 * pi()) * x * {_PHI}) AS p FROM v), h AS (SELECT *, row_number() OVER (ORDER BY p, method1, method2) AS i, count(*) OVER () AS m FROM o),
g AS (SELECT *, max(least(1.0::DOUBLE, p * (m - i + 1))) OVER (ORDER BY i) AS holm FROM h)
SELECT method1, method2, CAST(n AS BIGINT) AS n, w_plus, round(z, 6) AS z, round(p, 6) AS p_value, round(holm, 6) AS holm, holm < 0.05 AS significant FROM g""")  # fmt: skip
def pairwise_wilcoxon_board(spark, d):
    return rounded(I.pairwise_wilcoxon(_cells(spark, d), ["dataset", "learner", "seed"], "method", "score"))


@query("WITH s AS (SELECT l_linestatus AS g, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT abs((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))) AS d FROM s a, s b WHERE a.g = 'O' AND b.g = 'F') SELECT CASE WHEN d < 0.2 THEN 'negligible' WHEN d < 0.5 THEN 'small' WHEN d < 0.8 THEN 'medium' ELSE 'large' END AS label FROM d")
def effect_label_lineitem(spark, d):
    return I.cohens_d(_lineitem(spark, d), "l_linestatus", "O", "F", "l_extendedprice").select(I.effect_label(F.col("d")).alias("label"))


@query("SELECT count(*) AS n FROM lineitem")
def footer_rows_lineitem(spark, d):
    return files.footers(spark, f"{d}/lineitem.parquet").agg(F.sum("rows").alias("n"))


# --- generated data --------------------------------------------------------------------------


@query()
def generated_datasets(spark, d):
    """A row for each of the benchmark's datasets and feature family: how strongly the family goes with the target."""
    out = []
    for s in (*generators.CLASSIFICATION, *generators.REGRESSION):
        if s.n_features > 100:
            continue
        df, truth = generators.make(spark, s)
        r = ranking.correlations(df, [*truth.informative, "y"])
        out.append((s.name, s.task, len(df.columns) - 2, len(truth.informative), round(float(abs(r[-1, :-1]).max()), 6)))
    return spark.createDataFrame(out, "name string, task string, features int, informative int, strongest double")


@query()
def null_calibration(spark, d):
    return rounded(experiments.calibration(experiments.null_p_values(spark, 200, 40, "mc", 39)))


@query()
def stopping_study(spark, d):
    return rounded(experiments.stopping_study(spark, 300))


@query()
def split_count_ranking_embeddings(spark, d):
    v = _vectors(spark, d)
    sample = S.bootstrap(v, "vec_id", 3, 1, "label", "stratified")
    rows = wrappers.split_count_ranking(v, "vec_id", DIMENSIONS, "label", trees.TreeParams(trees=3, max_depth=2, min_leaf=5, max_features="sqrt"), sample)
    return spark.createDataFrame(rows, "feature string, splits int, rank int")


@query()
def forest_permutation_importance_embeddings(spark, d):
    return rounded(wrappers.permutation_importance(_vectors(spark, d), "vec_id", DIMENSIONS, "label", seed=3, repeats=2, trees=5, model="forest"))


