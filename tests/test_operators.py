"""Field operators: identities, adjoints, brute force and validation on toy fields."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import bounds, splines
from fieldloom.meta import Bound, Field, bound_of, spline_of
from fieldloom.operators import curves, lines, meshes, posdef, sampling as sp, solvers, stencils as st
from fieldloom.plans.oracles import extension
from fieldloom.sources.adapters import from_numpy, packed, read_parquet, to_numpy, write_parquet

BOUNDS = ["zero", "replicate", "dct1", "dct2", "dst1", "dst2", "dft"]
RNG = np.random.default_rng(0)


def basis(order, x):
    """The spline by its recursion."""
    if order == 0:
        return float(-0.5 <= x < 0.5)
    h = (order + 1) / 2
    return ((h + x) * basis(order - 1, x + 0.5) + (h - x) * basis(order - 1, x - 0.5)) / order


@pytest.mark.parametrize("bound", BOUNDS)
def test_bounds_are_walks_along_the_extension(spark, bound):
    for n in (1, 2, 5):
        want = {i: (j, s) for i, j, s in extension(n, bound, -20, 20)} if not (bound in ("dct1", "dst1") and n == 1) else {i: (0, 1) for i in range(-20, 21)}
        i, s = bounds.index_and_sign(F.col("id"), n, bound)
        for row in spark.range(-20, 21).select("id", i.alias("i"), s.alias("s")).collect():
            assert bounds.place(row.id, n, bound)[1] == row.s
            assert (row.i, row.s) == want.get(row.id, (None, 0)), (n, row)
            if row.s:
                assert bounds.place(row.id, n, bound) == (row.i, row.s)


@pytest.mark.parametrize("order", range(1, 8))
def test_splines_and_derivatives(spark, order):
    d = [x / 16 + 1e-3 for x in range(-70, 70)]
    df = spark.createDataFrame([(x,) for x in d], "d double").select("d", splines.value(F.col("d"), order).alias("v"))
    assert np.allclose([r.v for r in df.collect()], [basis(order, x) for x in d], atol=1e-12)
    x = spark.createDataFrame([(0.37,)], "x double")
    low = splines.first_tap(F.col("x"), order)
    eps = 1e-5
    for t in range(order + 1):
        r = x.select(*[splines.at_tap(F.col("x") - low - t + e, order, t, k).alias(n) for n, e, k in (("w", 0, 0), ("up", eps, 0), ("down", -eps, 0), ("g", 0, 1), ("h", 0, 2), ("gu", eps, 1), ("gd", -eps, 1))]).first()
        assert (r.up - r.down) / (2 * eps) == pytest.approx(r.g, abs=1e-6)
        assert (r.gu - r.gd) / (2 * eps) == pytest.approx(r.h, abs=1e-5)


def points(spark, coords, extra=None):
    rows = [(i, *map(float, c), *(map(float, extra[i]) if extra is not None else ())) for i, c in enumerate(coords)]
    loc = ["lx", "ly", "lz"][: len(coords[0])]
    more = [f"g{k}" for k in range(len(extra[0]))] if extra is not None else []
    return sp.Points(spark.createDataFrame(rows, ["q", *loc, *more]), ["q"], loc)


def values(df, columns):
    rows = sorted(df.collect(), key=lambda r: r.q)
    return np.array([[r[c] for c in columns] for r in rows])


@pytest.mark.parametrize("order,bound", [(0, "dct2"), (1, "zero"), (2, "dst1"), (3, "dft"), (4, "replicate"), (7, "dst2"), (5, "dct1")])
def test_push_is_the_adjoint_of_pull(spark, order, bound):
    f = RNG.standard_normal((4, 5, 2))
    coords, g = RNG.uniform(-3, 7, (12, 2)), RNG.standard_normal((12, 2))
    field, pts = from_numpy(spark, f, 2), points(spark, coords, g)
    pulled = values(sp.pull(field, pts, order, bound), field.channels)
    named = sp.Points(pts.df, pts.ids, pts.loc)
    pushed = to_numpy(sp.push(named, ["g0", "g1"], field.axes, order, bound))
    assert (pulled * g).sum() == pytest.approx((pushed * f).sum(), abs=1e-9)
    weights = to_numpy(sp.count(named, field.axes, order, bound))
    ones = sp.Points(pts.df.withColumn("g0", F.lit(1.0)), pts.ids, pts.loc)
    assert np.allclose(weights, to_numpy(sp.push(ones, ["g0"], field.axes, order, bound)))


def test_gradients_match_differences(spark):
    f, order, bound, eps = RNG.standard_normal((5, 6, 1)), 3, "dst2", 1e-4
    coords, g = RNG.uniform(0.1, 4, (6, 2)), RNG.standard_normal((6, 2))
    field = from_numpy(spark, f, 2)
    at = lambda c: values(sp.pull(field, points(spark, c), order, bound), ["v"])[:, 0]
    grad = values(sp.grad(field, points(spark, coords), order, bound), ["v_x", "v_y"])
    for k in range(2):
        step = np.eye(2)[k] * eps
        assert np.allclose((at(coords + step) - at(coords - step)) / (2 * eps), grad[:, k], atol=1e-5)
    slope = lambda c: values(sp.grad(field, points(spark, c), order, bound), ["v_x", "v_y"])
    _, back = sp.grad_backward(field, points(spark, coords, g), {("v", "x"): "g0", ("v", "y"): "g1"}, order, bound)
    got = values(back, ["lx", "ly"])
    for k in range(2):
        step = np.eye(2)[k] * eps
        want = ((slope(coords + step) - slope(coords - step)) / (2 * eps) * g).sum(1)
        assert np.allclose(want, got[:, k], atol=1e-4)
    to_field, to_grid = sp.pull_backward(field, points(spark, coords, g[:, :1]), ["g0"], order, bound)
    assert np.allclose(values(to_grid, ["lx", "ly"]), grad * g[:, :1])
    assert (to_numpy(to_field) * f).sum() == pytest.approx((at(coords) * g[:, 0]).sum())


def test_accumulation_adds_to_a_field(spark):
    pts = points(spark, [[0.0], [2.0]], [[1.0], [5.0]])
    base = from_numpy(spark, np.ones((4, 1)), 1, channels=["g0"])
    assert to_numpy(sp.push(pts, ["g0"], {"x": 4}, 1, "dct2", into=base))[:, 0].tolist() == [2, 1, 6, 1]


def test_out_of_view_is_zero(spark):
    field = from_numpy(spark, np.ones((4, 1)), 1)
    pts = points(spark, [[-0.6], [-0.52], [-0.04], [3.04], [3.2], [9.0]])
    got = {e: values(sp.pull(field, pts, 1, "replicate", e), ["v"])[:, 0].round(9).tolist() for e in (-1, 0, 1)}
    assert got == {1: [1] * 6, 0: [0, 0, 1, 1, 0, 0], -1: [0, 1, 1, 1, 1, 0]}


@pytest.mark.parametrize("order,shift", [(1, 0.0), (2, 0.5), (3, 0.5)])
def test_restriction_is_the_adjoint_of_resampling(spark, order, shift):
    coarse, fine = RNG.standard_normal((2, 5, 1)), RNG.standard_normal((2, 10, 1))
    a, b = from_numpy(spark, coarse, 1, ["b"]), from_numpy(spark, fine, 1, ["b"])
    up = to_numpy(sp.resample(a, {"x": 10}, order, "dct2", shift))
    down = to_numpy(sp.restriction(b, {"x": 5}, order, "dct2", shift))
    assert (up * fine).sum() == pytest.approx((down * coarse).sum(), abs=1e-9)
    assert np.allclose(to_numpy(sp.resample(a, {"x": 5}, 1)), coarse)


@pytest.mark.parametrize("order,bound", itertools.product((2, 3, 6, 7), ("dct1", "dct2", "dft")))
def test_prefilter_reproduces_samples(order, bound):
    f = RNG.standard_normal((3, 9))
    c = lines.prefiltered(f, order, bound_of(bound))
    back = np.zeros_like(f)
    for i in range(9):
        for j in range(i - 5, i + 6):
            p, s = bounds.place(j, 9, bound)
            back[:, i] += s * c[:, p] * basis(order, i - j)
    assert np.allclose(back, f, atol=1e-9)


def test_prefilter_and_distances_as_fields(spark):
    f = RNG.standard_normal((2, 12, 1))
    got = to_numpy(lines.spline_coeff(from_numpy(spark, f, 1, ["b"]), 3, "dct2"))
    assert np.allclose(got[..., 0], lines.prefiltered(f[..., 0], 3, Bound.DCT2))
    with pytest.raises(ValueError):
        lines.spline_coeff(from_numpy(spark, f, 1, ["b"]), 3, "zero")
    g = np.where(RNG.random((3, 25)) < 0.3, RNG.random((3, 25)) * 9, np.inf)
    g[2] = np.inf
    at = np.arange(25)
    field = from_numpy(spark, g[..., None], 1, ["b"])
    square = (g[:, None, :] + 1.69 * (at[:, None] - at) ** 2.0).min(2)
    assert np.array_equal(np.isinf(to_numpy(lines.dt_euclidean(field, spacing=1.3))[..., 0]), np.isinf(square))
    assert np.allclose(to_numpy(lines.dt_euclidean(field, spacing=1.3))[:2, :, 0], square[:2])
    plain = (g[:, None, :] + 1.3 * np.abs(at[:, None] - at)).min(2)
    assert np.allclose(to_numpy(lines.dt_l1(field, spacing=1.3))[:2, :, 0], plain[:2])
    assert np.allclose([lines._envelope(x, 1.69) for x in g[:2]], square[:2])


@pytest.mark.parametrize("c", [1, 2, 3, 4])
def test_packed_matrices(spark, c):
    n, size = 7, posdef.packed_size(c)
    h = RNG.uniform(-0.5, 0.5, (n, size))
    h[:, :c] += c + 2
    v, w = RNG.standard_normal((n, c)), RNG.uniform(0.1, 3, (n, c))
    names = [f"h{i}" for i in range(size)], [f"v{i}" for i in range(c)], [f"w{i}" for i in range(c)]
    df = spark.createDataFrame([(i, *map(float, np.concatenate([h[i], v[i], w[i]]))) for i in range(n)], ["q", *sum(names, [])])
    full = np.zeros((n, c, c))
    for i, j in itertools.product(range(c), repeat=2):
        full[:, i, j] = posdef.entry(h.T, c, i, j)
    hs, vs, ws = names
    out = [f"o{i}" for i in range(c)]
    assert np.allclose(values(posdef.sym_matvec(df, hs, vs, out), out), np.einsum("nij,nj->ni", full, v))
    solved = np.linalg.solve(full + w[:, :, None] * np.eye(c), v[..., None])[..., 0]
    assert np.allclose(values(posdef.sym_solve(df, hs, vs, out, ws), out), solved)
    assert np.allclose(values(posdef.sym_solve_(df, hs, vs, ws), vs), solved)
    inverse = np.linalg.inv(full)
    packed_inverse = np.stack([inverse[:, i, i] for i in range(c)] + [inverse[:, i, j] for i in range(c) for j in range(i + 1, c)], 1)
    assert np.allclose(values(posdef.sym_invert_(df, hs), hs), packed_inverse)
    with pytest.raises(ValueError):
        posdef.sym_matvec(df, hs + ["q"], vs, out)


def dense_operator(p, shape, bound, channels, weight=None):
    """The matrix of a penalty without a weight map, entry by entry."""
    size = int(np.prod(shape))
    index = lambda at: int(np.ravel_multi_index(at, shape))
    out = np.zeros((channels * size, channels * size))
    for c in range(channels):
        centre, taps = st.same_channel(p, c)
        for at in np.ndindex(*shape):
            row = c * size + index(at)
            out[row, row] += centre - sum(taps.values())
            for o, w in taps.items():
                found = [bounds.place(a + s, n, bound) for a, s, n in zip(at, o, shape)]
                sign = np.prod([s for _, s in found])
                if sign:
                    out[row, c * size + index([j for j, _ in found])] += w * sign
    for (d, e), taps in st.cross_channel(p, len(shape)).items():
        for at in np.ndindex(*shape):
            for o, w in taps.items():
                found = [bounds.place(a + s, n, bounds.transposed(bound_of(bound)) if k == d else bound) for k, (a, s, n) in enumerate(zip(at, o, shape))]
                sign = np.prod([s for _, s in found])
                if sign:
                    out[d * size + index(at), e * size + index([j for j, _ in found])] += w * sign
    return out


CASES = [(1, False, "dst2"), (2, False, "zero"), (3, False, "dct2"), (2, True, "dft"), (3, True, "dst2"), (1, True, "dct2"), (2, True, "dct1")]


@pytest.mark.parametrize("ndim,flow,bound", CASES)
def test_stencils_match_their_matrices(spark, ndim, flow, bound):
    shape = {1: (6,), 2: (4, 5), 3: (3, 4, 3)}[ndim]
    voxel = [1.0, 1.5, 0.8][:ndim]
    channels = ndim if flow else 2
    p = st.flow_penalties(ndim, 0.1, 0.2, 0.3, 0.4, 0.5, voxel) if flow else st.field_penalties(ndim, 2, 0.1, [0.2, 0.3], [0.3, 0.0], voxel)
    f = RNG.standard_normal((*shape, channels))
    field = from_numpy(spark, f, ndim)
    want = dense_operator(p, shape, bound, channels) @ np.moveaxis(f, -1, 0).ravel()
    got = np.moveaxis(to_numpy(st.matvec(field, p, bound)), -1, 0).ravel()
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("ndim,flow", [(1, False), (2, False), (2, True), (3, True)])
def test_weighted_stencils_are_self_adjoint_and_fall_back(spark, ndim, flow):
    shape, bound = {1: (7,), 2: (4, 5), 3: (3, 4, 3)}[ndim], "dct2"
    channels = ndim if flow else 1
    p = st.flow_penalties(ndim, 0.1, 0.2, 0.0, 0.4, 0.5) if flow else st.field_penalties(ndim, 1, 0.1, 0.2, 0.3)
    a, b, w = RNG.standard_normal((*shape, channels)), RNG.standard_normal((*shape, channels)), RNG.uniform(0.3, 1.5, (*shape, 1))
    names = [f"v{i}" for i in range(channels)]
    make = lambda f, w: from_numpy(spark, np.concatenate([f, w], -1), ndim, channels=[*names, "w"])
    on = lambda f, w: Field(make(f, w).df, make(f, w).axes, names)
    product = lambda f, w: to_numpy(st.matvec_rls(on(f, w), p, ["w"], bound))
    assert (product(a, w) * b).sum() == pytest.approx((product(b, w) * a).sum(), rel=1e-9)
    ones = np.ones_like(w)
    plain = to_numpy(st.matvec(on(a, ones), p, bound))
    assert np.allclose(product(a, ones), plain)
    assert np.allclose(to_numpy(st.diag_rls(on(a, ones), p, ["w"], bound)), to_numpy(st.diag(on(a, ones), p, bound)))


def test_impulse_gives_the_kernel(spark):
    p = st.flow_penalties(2, 0.5, 1.0, 2.0, 0.3, 0.7, [1.0, 2.0])
    f = np.zeros((7, 7, 2))
    f[3, 3, 1] = 1
    got = to_numpy(st.matvec(from_numpy(spark, f, 2), p, "dft"))
    made = to_numpy(st.kernel(spark, p, {"x": 7, "y": 7}))
    assert np.allclose(got[..., 0], made[..., 1]) and np.allclose(got[..., 1], made[..., 3])
    added = to_numpy(st.addkernel_(from_numpy(spark, np.ones((7, 7, 4)), 2), p))
    assert np.allclose(added, 1 + made)


@pytest.mark.parametrize("flow", [False, True])
def test_solvers_recover_the_solution(spark, flow):
    shape = (5, 4)
    p = st.flow_penalties(2, 0.2, 0.3, 0.0, 0.1, 0.1) if flow else st.field_penalties(2, 2, 0.2, 0.3)
    x = RNG.standard_normal((*shape, 2))
    h = np.concatenate([RNG.uniform(3, 4, (*shape, 2)), RNG.uniform(-0.5, 0.5, (*shape, 1))], -1)
    size = 20
    full = dense_operator(p, shape, "dct2", 2)
    for k in range(2):
        full[k * size : (k + 1) * size, k * size : (k + 1) * size] += np.diag(h[..., k].ravel())
    full[:size, size:] += np.diag(h[..., 2].ravel())
    full[size:, :size] += np.diag(h[..., 2].ravel())
    g = np.moveaxis((full @ np.moveaxis(x, -1, 0).ravel()).reshape(2, *shape), 0, -1)
    table = from_numpy(spark, np.concatenate([np.zeros_like(x), g, h], -1), 2, channels=["v0", "v1", "g0", "g1", "h0", "h1", "h2"])
    field = Field(table.df, table.axes, ["v0", "v1"])
    forward = st.forward(Field(from_numpy(spark, np.concatenate([x, h], -1), 2, channels=["v0", "v1", "h0", "h1", "h2"]).df, table.axes, ["v0", "v1"]), p, ["h0", "h1", "h2"])
    assert np.allclose(to_numpy(forward), g)
    swept = to_numpy(solvers.relax(field, p, ["g0", "g1"], ["h0", "h1", "h2"], iterations=2))
    assert np.abs(swept - x).max() < 0.3 * np.abs(x).max()
    if not flow:
        solved = solvers.cg(field, p, ["g0", "g1"], ["h0", "h1", "h2"], iterations=12, tolerance=1e-7)
        assert np.abs(to_numpy(solved.field) - x).max() < 1e-5 and solved.residual <= 1e-7 and solved.iterations < 12


def test_curve_refinement_is_no_worse(spark):
    control = RNG.uniform(-2, 2, (8, 3))
    coeff = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(control)], "k int, p0 double, p1 double, p2 double")
    x = RNG.uniform(-2, 2, (30, 3))
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "q int, x double, y double, z double")
    p, loc, times = ("p0", "p1", "p2"), ("x", "y", "z"), list(np.linspace(0, 7, 50))
    table = curves.dt_spline_table(pts, coeff, loc, times, p=p)
    seed = values(table, ["time", "dist"])
    curve = curves.Curve(control, 3, "dct2")
    far = ((x[:, None] - curve.at(np.array(times))) ** 2).sum(-1)
    assert np.allclose(seed[:, 1], far.min(1)) and np.allclose(seed[:, 0], np.array(times)[far.argmin(1)])
    best = ((x[:, None] - curve.at(np.linspace(0, 7, 20_001))) ** 2).sum(-1).min(1)
    for refine in (curves.dt_spline_brent, curves.dt_spline_gaussnewton):
        got = values(refine(table, coeff, loc, p=p), ["time", "dist"])
        assert (got[:, 1] <= seed[:, 1] + 1e-12).all() and np.allclose(((x - curve.at(got[:, 0])) ** 2).sum(1), got[:, 1])
        assert np.median(got[:, 1] - best) < 1e-6


def test_mesh_distances(spark):
    vertices, faces = RNG.uniform(-2, 2, (12, 3)), np.array([RNG.choice(12, 3, replace=False) for _ in range(8)])
    x = RNG.uniform(-4, 4, (60, 3))
    u = RNG.dirichlet([1, 1, 1], 20_000)
    sampled = np.stack([np.sqrt(((x[:, None] - (u @ vertices[f])[None]) ** 2).sum(2).min(1)) for f in faces]).min(0)
    v = spark.createDataFrame([(i + 5, *map(float, p)) for i, p in enumerate(vertices)], "vid long, px double, py double, pz double")
    f = spark.createDataFrame([(i, *map(int, r + 5)) for i, r in enumerate(faces)], "f int, v0 long, v1 long, v2 long")
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "q int, x double, y double, z double")
    got = [values(meshes.dt_mesh(pts, v, f, ("x", "y", "z"), naive=n, face_id="f"), ["dist", "nearest_vertex"]) for n in (False, True)]
    assert np.allclose(got[0], got[1]) and (got[0][:, 0] <= sampled + 1e-9).all() and np.allclose(got[0][:, 0], sampled, atol=0.06)
    square = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 0.0)], "vid long, px double, py double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "v0 long, v1 long")
    flat = spark.createDataFrame([(0, 0.5, 0.4), (1, 0.5, 1.5), (2, 2.0, 2.0)], "q int, x double, y double")
    signed = values(meshes.dt_mesh(flat, square, edges, ("x", "y"), signed=True, position=("px", "py"), corners=("v0", "v1")), ["dist"])[:, 0]
    assert np.allclose(signed, [-0.4, 0.5, 2**0.5])


def test_validation(spark):
    field = from_numpy(spark, np.ones((3, 2, 1)), 2)
    for wrong in (
        lambda: Field(field.df, {"x": 3, "y": 0}),
        lambda: Field(field.df, {"x": 3, "t": 2}),
        lambda: Field(field.df.withColumn("v", F.lit("s")), {"x": 3, "y": 2}),
        lambda: from_numpy(spark, np.ones((3, 1), np.float16), 1),
        lambda: bound_of("dynamic"),
        lambda: bound_of(9),
        lambda: spline_of(8),
        lambda: sp.pull(field, points(spark, [[1.0]])),
        lambda: st.matvec(field, st.flow_penalties(2, 1.0)),
        lambda: st.field_penalties(2, 1, [1.0, 2.0]),
        lambda: st.matvec_rls(field, st.flow_penalties(2, 1.0, bending=1.0), ["v"]),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_adapters_and_stream(spark, tmp_path):
    from fieldloom.streaming.sampling import pull_each_batch, push_stream

    f = RNG.standard_normal((2, 4, 1))
    field = from_numpy(spark, f, 1, ["b"])
    write_parquet(field, str(tmp_path / "f"), ["b"])
    assert np.allclose(to_numpy(read_parquet(spark, str(tmp_path / "f"), {"x": 4}, batch=["b"])), f)
    assert sorted(len(r.v) for r in packed(field).collect()) == [4, 4]
    schema = "q long, lx double, g double"
    spark.createDataFrame([(0, 0.5, 1.0), (1, 2.25, 2.0), (2, 1.0, 4.0)], schema).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "p"))
    query = push_stream(stream, ["lx"], ["g"], {"x": 4}, order=1).writeStream.format("memory").queryName("pushed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r.x: r.g for r in spark.table("pushed").collect()} == {0: 0.5, 1: 4.5, 2: 1.5, 3: 0.5}
    seen = []
    one = from_numpy(spark, f[0], 1)
    handle = pull_each_batch(one, ["lx"], ["q"], lambda out, epoch: seen.extend(out.collect()), order=1)
    query = stream.writeStream.foreachBatch(handle).start()
    query.processAllAvailable()
    query.stop()
    assert {r.q: round(r.v, 9) for r in seen}[2] == round(f[0, 1, 0], 9)
