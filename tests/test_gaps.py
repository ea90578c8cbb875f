"""Fields that lack voxels: stencils read nothing there, whatever the bricks, and the queries equal their SQL on them."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldloom.functions import bounds
from fieldloom.meta import Field, bound_of
from fieldloom.operators import bricks, stencils as st
from tests.test_queries import SF, listed

CASES = (({"x": 23}, ["u"]), ({"y": 9, "x": 7}, ["u", "v"]), ({"z": 5, "y": 7, "x": 4}, ["u", "v", "t"]))


def rows_with_gaps(axes, batches=("a", None, "c")):
    rng = random.Random(7)
    rows = [(b, *at, *[float(rng.randint(-9, 9)) for _ in range(3)], float(rng.randint(1, 4))) for b in batches for at in itertools.product(*map(range, axes.values())) if rng.random() < 0.8]
    # one batch ends where the next goes on
    rows = [r for r in rows if (r[0] != "a" or r[1] < 3) and (r[0] != "c" or r[1] >= 3)]
    rng.shuffle(rows)
    return rows


def field_of(spark, rows, axes, channels):
    df = spark.createDataFrame(rows, ", ".join(["b string", *[f"{a} int" for a in axes], "u double", "v double", "t double", "w double"])).repartition(3)
    return Field(df, axes, channels, ("b",), gaps=True)


def results(field):
    return {(r.b, *[r[a] for a in field.axes]): [r[c] for c in field.channels] for r in field.df.collect()}


def by_hand(rows, axes, channels, p, bound):
    n, sizes, b = len(axes), list(axes.values()), bound_of(bound)
    at = {r[: n + 1]: r[n + 1 :] for r in rows}

    def read(key, o, channel, around):
        sign, place = 1, [key[0]]
        for i, step, size, bd in zip(key[1:], o, sizes, around):
            j, s = bounds.place(i + step, size, bd)
            sign, place = sign * s, [*place, j]
        return sign * at[tuple(place)][channel] if sign and tuple(place) in at else 0.0

    out = {}
    for key, values in at.items():
        out[key] = []
        for c in range(len(channels)):
            centre, taps = st.same_channel(p, c)
            total = centre * values[c] + sum(w * (read(key, o, c, [b] * n) - values[c]) for o, w in taps.items())
            for (d, e), crossed in st.cross_channel(p, n).items():
                if d == c:
                    total += sum(w * read(key, o, e, [bounds.transposed(b) if k == d else b for k in range(n)]) for o, w in crossed.items())
            out[key].append(total)
    return out


@pytest.mark.parametrize("bound", ["zero", "replicate", "dct1", "dst2", "dft"])
@pytest.mark.parametrize("small", [False, True])
def test_missing_voxels_are_read_as_nothing(spark, monkeypatch, bound, small):
    if small:
        monkeypatch.setattr(bricks, "SIZES", {1: 11, 2: 4, 3: 3})
    for axes, channels in CASES:
        n, rows = len(axes), rows_with_gaps(axes)
        p = st.flow_penalties(n, 1.0, 0.5, 2.0, 2.0, 1.0, [1.0, 2.0, 0.5][:n])
        got, want = results(st.matvec(field_of(spark, rows, axes, channels), p, bound)), by_hand(rows, axes, channels, p, bound)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_weighted_operators_on_small_bricks(spark, monkeypatch):
    cases = []
    for axes, channels in CASES:
        field = field_of(spark, rows_with_gaps(axes), axes, channels)
        p = st.field_penalties(len(axes), len(channels), 1.0, 2.0, 0.5)
        cases += [lambda f=field, p=p: results(st.matvec_rls(f, p, ["w"], "dct2")), lambda f=field, p=p: results(st.diag_rls(f, p, ["w"], "dct2"))]
    whole = [c() for c in cases]
    monkeypatch.setattr(bricks, "SIZES", {1: 11, 2: 4, 3: 3})
    monkeypatch.setattr(bricks, "CHUNK", 64)
    for c, want in zip(cases, whole):
        got = c()
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_repeated_and_outer_voxels_are_refused(spark):
    axes = {"y": 9, "x": 7}
    field = field_of(spark, rows_with_gaps(axes), axes, ["u"])
    p = st.field_penalties(2, 1, 1.0, 1.0)
    first = field.df.orderBy("b", "y", "x").limit(1)
    for bad in (field.df.unionByName(first), field.df.unionByName(first.withColumn("y", F.lit(9)))):
        with pytest.raises(Exception, match="more than once"):
            st.matvec(field.with_df(bad), p, "dct2").df.collect()
    assert st.matvec(field.with_df(field.df.limit(0)), p, "dct2").df.count() == 0


NAMES = ["field_matvec_bending_2d", "field_submatvec_bending_3d", "field_forward_bending_3d", "field_matvec_rls_channels_2d", "field_diag_rls_3d", "field_diag_rls_channels_2d", "field_relax_membrane_3d", "field_cg", "flow_addmatvec_all_2d", "flow_addmatvec_all_3d"]


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    """The smallest tables with 487 vectors: the last of ten images and the last of 122 volumes aren't whole."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no shared tables here")
    folder, connection = tmp_path_factory.mktemp("ragged"), duckdb.connect()
    connection.execute(f"copy (select * from read_parquet('{SF}/embeddings.parquet') where vec_id < 487) to '{folder}/embeddings.parquet' (format parquet)")
    connection.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    return str(folder), connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_on_ragged_fields(spark, ragged, name):
    folder, duck = ragged
    df = entry.queries()[name](spark, folder)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert listed([tuple(r) for r in df.collect()], df.columns) == listed(result.fetchall(), columns)
