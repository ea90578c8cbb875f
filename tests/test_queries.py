"""A few registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["pull_3", "pull_bound_dst1", "push_3d", "grad_backward_1d_grid", "resample_cubic", "restriction_2d", "spline_coeff_dft_3", "dt_euclidean", "dt_mesh_signed", "sym_solve_weighted_c3", "field_matvec_bending_3d", "flow_matvec_all_2d", "flow_kernel_lame_3d", "field_matvec_rls_2d", "field_relax_membrane_1d"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no shared tables here")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


def listed(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(f"{r[i] + 0.0:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert listed([tuple(r) for r in df.collect()], df.columns) == listed(result.fetchall(), columns)


def test_entry_and_registry(spark, duck):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
