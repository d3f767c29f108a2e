"""Every query with an SQL twin equals it; the others return rows."""

import random
from collections import Counter

import pytest

from sylvaspark.queries import ORACLE_SQL, QUERIES, _board
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, con, name):
    assert same(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_board_queries_take_the_whole_board(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    total = lambda name: sum(r["n"] for r in QUERIES[name](spark, SF).collect())
    assert total("completeness_board") == orders and total("completeness_lines") == lines
    assert QUERIES["completeness_lines"](spark, SF).where("n = 0").count() > 0
    rows = [(r["dataset"], r["config"], r["learner"], r["method"]) for r in _board(spark, SF).collect()]
    methods = {r[3] for r in rows}
    full = [c for c in {r[:3] for r in rows} if {r[3] for r in rows if r[:3] == c} == methods]
    want = Counter(r[2] for r in rows if r[:3] in full)
    assert {r["learner"]: r["n"] for r in QUERIES["complete_cases_board"](spark, SF).collect()} == want


def test_embedding_queries_see_all_dimensions(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        v = [rng.random() for _ in range(64)]
        rows.append((i, v, int(v[40] > 0.5)))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in run("explode_rankings_embeddings")) == [(i, p, x) for i, v, _ in rows for p, x in enumerate(v)]
    assert next(r["feature"] for r in run("tree_nodes_embeddings") if r["node"] == 1) == "e40"
    assert run("mrmr_embeddings")[0]["feature"] == "e40"
    assert max(run("model_importance_embeddings"), key=lambda r: r["importance"])["feature"] == "e40"
