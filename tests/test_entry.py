"""The driver entry: every single-step query against its SQL, and the rest without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from weftgraph.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
#: Compared by the driver's check at a larger scale, and with brute force in the graph tests: many rounds of small jobs.
SLOW = {
    *"x08_eccentricity_bounded_co45 x03_eccentricity_exact_co45 g01_hyper_bfs_op45 g05_hyper_shortest_paths_op45 a03_bfs_components_co45 a02_bfs_bitvector_co45".split(),
    *"c04_edge_map_dense_forward c06_edge_map_sparse_no_filter x01_eccentricity_kbfs_co45 x06_eccentricity_near_set_co45 x07_eccentricity_lower_bounds_co45 k04_set_cover_co45".split(),
    *"k03_kcore_serial_co45 g09_hyper_kcore_efficient_op45 g01_hyper_bfs_parents_op45 l02_push_pagerank_optimised_co45 l03_push_pagerank_co45 l05_heat_walks_co45".split(),
    *"a12_pagerank_delta_co45 a04_dependency_co45 x02_eccentricity_one_phase_co45 x05_eccentricity_registers_co45 g07_hyper_independent_set_op45 x00_component_sizes_co45".split(),
    *(name for name in queries.ORACLES if name.endswith("_op") and name[0] in "gu"),
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - SLOW))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    rows = lambda it: sorted((tuple(r) for r in it), key=repr)
    assert rows(got.select(*order).collect()) == rows(tuple(r[k] for k in at) for r in want.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_subpackage():
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['weftgraph.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.corpus is None and len(e.queries()) > 100 and not [k for k in e.queries() if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
