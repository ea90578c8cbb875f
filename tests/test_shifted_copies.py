"""Queries on images and volumes against their SQL where copies of the vectors with shifted keys leave holes: lone vectors, holes in the middle, ends that aren't whole."""

import os

import pytest

import __spark_entry__ as entry
from tests.test_queries import SF, listed

NAMES = [
    "field_addmatvec_bending_3d",
    "field_cg",
    "field_diag_rls_2d",
    "field_diag_rls_3d",
    "field_diag_rls_channels_2d",
    "field_forward_bending_2d",
    "field_diag_rls_channels_3d",
    "field_forward_bending_3d",
    "field_matvec_absolute_2d",
    "field_matvec_absolute_3d",
    "field_matvec_bending_2d",
    "field_matvec_membrane_2d",
    "field_matvec_bending_3d",
    "field_matvec_rls_2d",
    "field_matvec_membrane_3d",
    "field_matvec_rls_3d",
    "field_matvec_rls_channels_2d",
    "field_matvec_rls_channels_3d",
    "field_relax_membrane_3d",
    "field_submatvec_bending_2d",
    "field_submatvec_bending_3d",
    "flow_addmatvec_all_2d",
]


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """109 of the smallest table's vectors and copies: 61 from 0 on, all but every seventh of 55 from 10,007 on, and a lone one."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no shared tables here")
    folder, connection = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    os.mkdir(folder / "embeddings.parquet")
    source = f"read_parquet('{SF}/embeddings.parquet')"
    for k, (shift, kept) in enumerate(((0, "vec_id < 61"), (10_007, "vec_id < 55 and vec_id % 7 <> 3"), (20_001, "vec_id = 0"))):
        connection.execute(f"copy (select vec_id + {shift} as vec_id, embedding, label from {source} where {kept}) to '{folder}/embeddings.parquet/{k}.parquet' (format parquet)")
    connection.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet')")
    assert connection.execute("select count(*) from embeddings").fetchone() == (109,)
    return str(folder), connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_on_shifted_copies(spark, shifted, name):
    folder, duck = shifted
    df = entry.queries()[name](spark, folder)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert listed([tuple(r) for r in df.collect()], df.columns) == listed(result.fetchall(), columns)
