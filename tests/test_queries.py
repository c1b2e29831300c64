"""Every query with SQL against DuckDB, and the shape of the others."""

import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from quarkflow.plans import model_queries  # noqa: F401  registers its queries
from quarkflow.plans.queries import oracle_sql, queries

TABLES = "customer orders lineitem supplier events documents labels embeddings".split()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries()[name](spark, data)
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, data, name):
    assert queries()[name](spark, data).count() > 0


def test_latent_pca_takes_all_dimensions(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    got = np.array([[r.pc0, r.pc1] for r in queries()["latent_pca"](spark, data).orderBy("vec_id").collect()])
    want = (x - x.mean(axis=0)) @ axes[:2].T
    assert np.allclose(np.abs(got - got.mean(axis=0)), np.abs(want), atol=1e-6)


def test_edge_counts(spark, data):
    q = queries()
    sizes = [r.n for r in q["multiplicity"](spark, data).collect()]
    assert sizes and q["knn_eta_phi"](spark, data).where("rank > 3").count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    shutil.copytree(f"{root}/quarkflow", tmp_path / "quarkflow", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n == 'pipeline' or n.startswith('op')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_hold_bounded_numbers_of_particles(spark, data, monkeypatch):
    """Partitions grow with the table, and graphs go on in them."""
    from quarkflow.operators import graphs
    from quarkflow.plans import fixtures as fx

    n = fx.table(spark, data, "lineitem").count()
    monkeypatch.setattr(fx, "PER_TASK", 500)
    nodes = fx.particles(spark, data)
    want = -(-n // 500)
    assert want > 4 and nodes.rdd.getNumPartitions() == want
    for method in ("eta_phi", "fully_connected", "mass_knn"):
        assert graphs.build(nodes, method, 3).rdd.getNumPartitions() == want


@pytest.mark.parametrize("name", "knn_eta_phi knn_all_features fully_connected mass_knn hybrid_knn undirected_edges edge_max learned_edge_message".split())
def test_graphs_read_particles_once(spark, data, name):
    assert _plan(queries()[name](spark, data)).count("l_extendedprice") and len([x for x in _plan(queries()[name](spark, data)).splitlines() if "FileScan" in x and "lineitem" in x]) == 1


@pytest.mark.parametrize("name", "flagship scaled_features multiplicity".split())
def test_particles_are_shuffled_once_for_quantiles_and_rows(spark, data, name):
    """What quantiles and the result both read is written, not made anew."""
    assert "lineitem" not in _plan(queries()[name](spark, data))


def test_stacked_sets_are_encoded_as_single_ones():
    from quarkflow.operators.models import TokenEncoder

    rng, model = np.random.default_rng(3), TokenEncoder(4)
    x, m = rng.normal(size=(6, 5, 4)), rng.random((6, 5)) < 0.4
    out, latent = model.forward(x, m)
    for i in range(6):
        one, z = model.forward(x[i], m[i])
        assert np.allclose(out[i], one) and np.allclose(latent[i], z)


def test_summaries_of_rows_equal_those_of_nested_jets(spark, data, monkeypatch):
    """Jets needn't be nested for their summaries."""
    from quarkflow.operators import stats
    from quarkflow.plans import fixtures as fx
    from quarkflow.plans.queries import featured, flat

    jets = fx.jets(spark, data).select("jet_id", "label")
    want = stats.jet_summary(flat(featured(spark, data))).join(jets, "jet_id").na.drop().orderBy("jet_id").collect()
    monkeypatch.setattr(fx, "nested", None)
    got = model_queries.summaries(spark, data).orderBy("jet_id").collect()
    assert got and np.allclose(np.array(got, float), np.array(want, float))
