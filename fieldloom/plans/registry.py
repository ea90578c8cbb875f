"""All queries of the field operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.meta import Field
from fieldloom.operators import curves, lines, meshes, posdef, sampling as sp, solvers, stencils as st
from fieldloom.plans import oracles as sql
from fieldloom.plans.fixtures import DUCK, table

Query = Callable[[SparkSession, str], DataFrame]

BOUNDS = ("zero", "replicate", "dct1", "dct2", "dst1", "dst2", "dft", "nocheck")

#: Fields by dimension: fixture, axes, batch, channel columns of a flow.
F1 = ("f1", {"x": 30}, ("b",))
F2 = ("f2", {"y": 50, "x": 64}, ("b",))
F3 = ("f3", {"x": 8, "y": 8, "z": 4}, ("b",))
#: Points by dimension: fixture, coordinates in order of the field's axes, batch.
P1, P2, P3 = ("p1", ("lx",), ("b",)), ("p2", ("ly", "lx"), ("b",)), ("p3", ("lx", "ly", "lz"), ("b",))
PAIRS = {1: (F1, P1), 2: (F2, P2), 3: (F3, P3)}
FLOWS = {1: (F1, ("v",)), 2: (F2, ("v", "v2")), 3: (F3, ("v", "v1", "v2"))}
VOXEL = {1: [1.0], 2: [1.0, 2.0], 3: [1.0, 2.0, 0.5]}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, without negative zeros, so that results don't depend on the order of sums; a little is added, as halves of a last decimal are common."""
    return df.select(*[(F.round(F.col(n) + sql.NUDGE, 6) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def field(spark: SparkSession, sf: str, which, channels: Sequence[str] = ("v",)) -> Field:
    name, axes, batch = which
    return Field(table(spark, sf, name), axes, channels, batch, gaps=name in ("f2", "f3"))  # the last image or volume may lack vectors


def points(spark: SparkSession, sf: str, which) -> sp.Points:
    name, loc, batch = which
    return sp.Points(table(spark, sf, name), ("q",), loc, batch)


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, text: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is there twice")
    _QUERIES[name] = lambda spark, sf: rounded(query(spark, sf))
    if text:
        _SQL[name] = text


# --- sampling


def _sampling(name: str, kind: str, ndim: int, order: int, bound: str = "dct2", extrapolate: int = 1) -> None:
    (ff, pp) = PAIRS[ndim]
    (fn, axes, batch), (pn, loc, _) = ff, pp
    a = list(axes)
    args = (order, bound, extrapolate)
    to_loc = lambda sums: {l: sums[x] for l, x in zip(loc, a)}
    along = {x: f"{sql.product(axes, {x: 'g'})} * f.v" for x in a}
    if kind == "pull":
        _add(name, lambda s, d: sp.pull(field(s, d, ff), points(s, d, pp), *args), sql.gather(fn, pn, axes, loc, *args, batch, {"v": f"{sql.product(axes)} * f.v"}))
    elif kind in ("grad", "grad_abs"):
        sums = {f"v_{x}": along[x] for x in a}
        if kind == "grad_abs":
            sums = {f"v_{x}": " * ".join(f"abs(g{y}) * s{y}" if y == x else f"w{y}" for y in a) + " * f.v" for x in a}
        _add(name, lambda s, d: sp.grad(field(s, d, ff), points(s, d, pp), *args, absolute=kind == "grad_abs"), sql.gather(fn, pn, axes, loc, *args, batch, sums))
    elif kind == "hess":
        pairs = [(x, x) for x in a] + [(a[i], a[j]) for i in range(len(a)) for j in range(i + 1, len(a))]
        sums = {f"v_{x}{y}": sql.product(axes, {x: "h"} if x == y else {x: "g", y: "g"}) + " * f.v" for x, y in pairs}
        _add(name, lambda s, d: sp.hess(field(s, d, ff), points(s, d, pp), *args), sql.gather(fn, pn, axes, loc, *args, batch, sums))
    elif kind == "push":
        _add(name, lambda s, d: sp.push(points(s, d, pp), ["g"], axes, *args).df, sql.scatter(pn, axes, loc, *args, batch, f"{sql.product(axes)} * g", "g"))
    elif kind == "count":
        _add(name, lambda s, d: sp.count(points(s, d, pp), axes, *args).df, sql.scatter(pn, axes, loc, *args, batch, sql.product(axes), "n"))
    elif kind == "pull_backward":
        _add(f"{name}_field", lambda s, d: sp.pull_backward(field(s, d, ff), points(s, d, pp), ["g"], *args)[0].df, sql.scatter(pn, axes, loc, *args, batch, f"{sql.product(axes)} * g", "v"))
        _add(f"{name}_grid", lambda s, d: sp.pull_backward(field(s, d, ff), points(s, d, pp), ["g"], *args)[1], sql.gather(fn, pn, axes, loc, *args, batch, to_loc({x: f"t.g * {along[x]}" for x in a}), ("g",)))
    elif kind == "push_backward":
        _add(f"{name}_values", lambda s, d: sp.push_backward(field(s, d, ff), points(s, d, pp), ["g"], *args)[0], sql.gather(fn, pn, axes, loc, *args, batch, {"v": f"{sql.product(axes)} * f.v"}))
        _add(f"{name}_grid", lambda s, d: sp.push_backward(field(s, d, ff), points(s, d, pp), ["g"], *args)[1], sql.gather(fn, pn, axes, loc, *args, batch, to_loc({x: f"t.g * {along[x]}" for x in a}), ("g",)))
    elif kind == "count_backward":
        _add(name, lambda s, d: sp.count_backward(field(s, d, ff), points(s, d, pp), *args), sql.gather(fn, pn, axes, loc, *args, batch, to_loc(along)))
    elif kind == "grad_backward":
        given = lambda p: sp.Points(p.df.withColumns({f"g_{x}": F.col("g") + i for i, x in enumerate(a)}), p.ids, p.loc, p.batch)
        columns = {("v", x): f"g_{x}" for x in a}
        spread = " + ".join(f"(g + {i}) * {sql.product(axes, {x: 'g'})}" for i, x in enumerate(a))
        second = {y: " + ".join(f"(t.g + {i}) * {sql.product(axes, {x: 'h'} if x == y else {x: 'g', y: 'g'})}" for i, x in enumerate(a)) for y in a}
        _add(f"{name}_field", lambda s, d: sp.grad_backward(field(s, d, ff), given(points(s, d, pp)), columns, *args)[0].df, sql.scatter(pn, axes, loc, *args, batch, spread, "v"))
        _add(f"{name}_grid", lambda s, d: sp.grad_backward(field(s, d, ff), given(points(s, d, pp)), columns, *args)[1], sql.gather(fn, pn, axes, loc, *args, batch, to_loc({y: f"({second[y]}) * f.v" for y in a}), ("g",)))


for _k in range(8):
    _sampling(f"pull_{_k}", "pull", 1, _k)
for _b in BOUNDS:
    _sampling(f"pull_bound_{_b}", "pull", 1, 3, _b)
for _e in (-1, 0, 1):
    _sampling(f"pull_extrapolate_{_e}".replace("-", "m"), "pull", 1, 2, "zero", _e)
_sampling("pull_2d", "pull", 2, 1)
_sampling("pull_3d", "pull", 3, 2, "dft")
_sampling("push_1d", "push", 1, 3, "dst2", 0)
_sampling("push_2d", "push", 2, 1, "replicate")
_sampling("push_3d", "push", 3, 2)
_sampling("count_1d", "count", 1, 2, "dst1")
_sampling("count_2d", "count", 2, 1, "zero", -1)
_sampling("grad_1d", "grad", 1, 3)
_sampling("grad_3d", "grad", 3, 2, "dst2")
_sampling("grad_abs_2d", "grad_abs", 2, 2, "dst2")
_sampling("grad_abs_1d_linear", "grad_abs", 1, 1, "dst2")
_sampling("grad_abs_1d_dst1", "grad_abs", 1, 3, "dst1")
for _b in BOUNDS:
    _sampling(f"push_bound_{_b}", "push", 1, 2, _b)
for _k in (0, 4, 5, 6, 7):
    _sampling(f"push_{_k}", "push", 1, _k)
_sampling("hess_2d", "hess", 2, 3)
_sampling("pull_backward_2d", "pull_backward", 2, 2)
_sampling("push_backward_2d", "push_backward", 2, 1, "dct1", 0)
_sampling("count_backward_1d", "count_backward", 1, 3)
_sampling("grad_backward_2d", "grad_backward", 2, 2, "dst2")
_sampling("grad_backward_1d", "grad_backward", 1, 5)


# --- resizing

for _o in range(8):
    _n = {0: "nearest", 1: "linear", 3: "cubic"}.get(_o, f"order_{_o}")
    _add(f"resample_{_n}", lambda s, d, o=_o: sp.resample(field(s, d, F1), {"x": 45}, o, "dct2", 0.5).df, sql.resize("f1", {"x": 30}, {"x": 45}, _o, "dct2", ("b",), 0.5))
    _add(f"restriction_{_n}", lambda s, d, o=_o: sp.restriction(field(s, d, F1), {"x": 10}, o, "dct2", 0.5).df, sql.restrict("f1", {"x": 30}, {"x": 10}, _o, "dct2", ("b",), 0.5))
_add("resample_2d", lambda s, d: sp.resample(field(s, d, F2), {"y": 25, "x": 96}, 2, "dft").df, sql.resize("f2", F2[1], {"y": 25, "x": 96}, 2, "dft", ("b",)))
_add("resample_3d", lambda s, d: sp.resample(field(s, d, F3), {"x": 5, "y": 12, "z": 8}, 1, "dst2").df, sql.resize("f3", F3[1], {"x": 5, "y": 12, "z": 8}, 1, "dst2", ("b",)))
_add("restriction_2d", lambda s, d: sp.restriction(field(s, d, F2), {"y": 25, "x": 16}, 1, "replicate").df, sql.restrict("f2", F2[1], {"y": 25, "x": 16}, 1, "replicate", ("b",)))


# --- distances and prefilter

MASK = ("mask", {"x": 64}, ("b",))
_add("dt_l1", lambda s, d: lines.dt_l1(field(s, d, MASK, ["f"]), spacing=2.0).df, f"with f as ({DUCK['mask']}) select p.b, q.x, round(min(p.f + 2.0 * abs(q.x - p.x)) + {sql.NUDGE}, 6) + 0.0 as f from f p join (select distinct b, x from f) q on p.b = q.b group by 1, 2")
_add("dt_euclidean", lambda s, d: lines.dt_euclidean(field(s, d, MASK, ["f"]), spacing=1.5).df, f"with f as ({DUCK['mask']}) select p.b, q.x, round(min(p.f + 2.25 * power(q.x - p.x, 2)) + {sql.NUDGE}, 6) + 0.0 as f from f p join (select distinct b, x from f) q on p.b = q.b group by 1, 2")
for _b in ("dct1", "dct2", "dft", "replicate"):
    for _o in range(2, 8):
        _weights = " + ".join(f"{_a!r} * power({_z!r}, abs(e.i - o.x))" for _a, _z in sql.inverse_spline(_o))
        _add(f"spline_coeff_{_b}_{_o}", lambda s, d, b=_b, o=_o: lines.spline_coeff(field(s, d, F1), o, b).df,
             f"with f as ({DUCK['f1']}), {sql.bmap('e', 30, 'dct2' if _b == 'replicate' else _b, 45)} select f.b, o.x, round(sum(({_weights}) * f.v) + {sql.NUDGE}, 6) + 0.0 as v from (select unnest(range(30))::int x) o join e on abs(e.i - o.x) <= 45 join f on f.x = e.j group by 1, 2")
_T = [k / 2 for k in range(49)]


def _table_search(s: SparkSession, d: str) -> DataFrame:
    return curves.dt_spline_table(table(s, d, "pts").select("q", "px", "py"), table(s, d, "curve"), ("px", "py"), _T)


def _refined(how) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        out = how(_table_search(s, d), table(s, d, "curve"), ("px", "py"))
        return out.select("q", F.round(F.sqrt("dist") + sql.NUDGE, 3).alias("dist"), F.round(F.col("time") * 0, 1).alias("off"))

    return query


_add("dt_spline_table", _table_search, f"""with c as ({DUCK['curve']}), p as ({DUCK['pts']}), {sql.bmap('e', 25, 'dct2', 6)},
times as (select unnest({_T!r}::double[]) t), placed as (select t, sum({sql.spline('t - e.i', 3)} * p0) x, sum({sql.spline('t - e.i', 3)} * p1) y from times join e on e.i between floor(t - 1) and floor(t - 1) + 3 join c on c.k = e.j group by t),
far as (select q, px, py, t, power(px - x, 2) + power(py - y, 2) d from p cross join placed), best as (select *, row_number() over (partition by q order by round(d, 9), t) n from far)
select q, round(px + {sql.NUDGE}, 6) + 0.0 as px, round(py + {sql.NUDGE}, 6) + 0.0 as py, round(t + {sql.NUDGE}, 6) + 0.0 as time, round(d + {sql.NUDGE}, 6) + 0.0 as dist from best where n = 1""")
# the least distance on a fine grid around the seed that the table search finds
_FINE = f"""with c as ({DUCK['curve']}), p as ({DUCK['pts']}), {sql.bmap('e', 25, 'dct2', 6)},
times as (select i / 4000.0::double t from (select unnest(range(-4000, 100001)) i)),
placed as materialized (select t, sum({sql.spline('t - e.i', 3)} * p0) x, sum({sql.spline('t - e.i', 3)} * p1) y from times join e on e.i between floor(t - 1) and floor(t - 1) + 3 join c on c.k = e.j group by t),
far as (select q, px, py, t, power(px - x, 2) + power(py - y, 2) d from p cross join (select * from placed where t * 2 = floor(t * 2) and t between 0 and 24)),
seed as (select q, px, py, t from (select *, row_number() over (partition by q order by round(d, 9), t) n from far) where n = 1)
select q, round(sqrt(min(power(px - x, 2) + power(py - y, 2))) + {sql.NUDGE}, 3) as dist, 0.0::double as off from seed join placed on placed.t between {{low}} and {{high}} group by q"""
_add("dt_spline_brent", _refined(curves.dt_spline_brent), _FINE.format(low="seed.t - 0.6", high="seed.t + 0.6"))
_add("dt_spline_gaussnewton", _refined(curves.dt_spline_gaussnewton), _FINE.format(low="greatest(seed.t - 0.6, 0)", high="least(seed.t + 0.6, 24)"))

_VERTICES = [(0, 2.0, 0.0, 0.0), (1, -2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.0, -2.0, 0.0), (4, 0.0, 0.0, 2.0), (5, 0.0, 0.0, -2.0)]
_FACES = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]


def _mesh(signed: bool, naive: bool = False) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        vertices = s.createDataFrame(_VERTICES, "vid long, px double, py double, pz double")
        faces = s.createDataFrame(_FACES, "v0 long, v1 long, v2 long")
        return meshes.dt_mesh(table(s, d, "pts"), vertices, faces, ("px", "py", "pz"), signed, naive).select("q", "dist")

    return query


# the octahedron is |x| + |y| + |z| = 2: in one octant, a point's nearest place is its projection on a simplex
_OCTAHEDRON = f"""with p as ({DUCK['pts']}), a as (select q, list_reverse_sort([abs(px), abs(py), abs(pz)]) u from p),
t as (select q, u, case when u[3] - (u[1] + u[2] + u[3] - 2) / 3 > 0 then (u[1] + u[2] + u[3] - 2) / 3 when u[2] - (u[1] + u[2] - 2) / 2 > 0 then (u[1] + u[2] - 2) / 2 else u[1] - 2 end h from a)
select q, round({{sign}} * sqrt(list_sum(list_transform(u, lambda x: power(x - greatest(x - h, 0), 2)))) + {sql.NUDGE}, 6) + 0.0 as dist from t"""
for _n, _s, _v in (("unsigned", False, False), ("signed", True, False), ("naive", True, True)):
    _add(f"dt_mesh_{_n}", _mesh(_s, _v), _OCTAHEDRON.format(sign="(case when u[1] + u[2] + u[3] < 2 then -1 else 1 end)" if _s else "1"))


# an uneven polygon, clockwise, so that normals point outwards: vertex numbers aren't places, and no point is as near to two segments
_CORNERS = [(10, 0.13, -2.17), (25, 2.31, 0.29), (30, 0.87, 0.41), (41, 0.53, 1.73), (52, -1.19, 2.11), (60, -2.43, -0.37)]
_SIDES = [(_CORNERS[(k + 1) % 6][0], _CORNERS[k][0]) for k in range(6)]


def _polygon(s: SparkSession, d: str) -> DataFrame:
    vertices = s.createDataFrame(_CORNERS, "vid long, px double, py double")
    faces = s.createDataFrame(_SIDES, "v0 long, v1 long")
    found = meshes.dt_mesh(table(s, d, "pts").select("q", "px", "py"), vertices, faces, ("px", "py"), True, position=("px", "py"), corners=("v0", "v1"))
    return found.select("q", "dist", "nearest_vertex")


_add("dt_mesh_2d_signed", _polygon, f"""with p as ({DUCK['pts']}), v(id, x, y) as (values {', '.join(map(str, _CORNERS))}), f(a, b) as (values {', '.join(map(str, _SIDES))}),
s as (select f.a, f.b, v.x ax, v.y ay, w.x bx, w.y by_ from f join v on v.id = f.a join v w on w.id = f.b),
t as (select q, px, py, s.*, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)))) u from p cross join s),
r as (select q, a, b, u, sqrt(power(px - ax - u * (bx - ax), 2) + power(py - ay - u * (by_ - ay), 2)) dist, case when (ay > py) <> (by_ > py) and px < (bx - ax) * (py - ay) / (by_ - ay) + ax then 1 else 0 end crossed from t),
n as (select *, sum(crossed) over (partition by q) crossings, row_number() over (partition by q order by dist, a) k from r)
select q, round((case when crossings % 2 = 1 then -1 else 1 end) * dist + {sql.NUDGE}, 6) + 0.0 as dist, case when u <= 0.5 then a else b end::bigint as nearest_vertex from n where k = 1""")


# --- packed matrices

_H = {1: ["h00"], 2: ["h00", "h11", "h01"], 3: ["h00", "h11", "h22", "h01", "h02", "h12"], 4: ["h00", "h11", "h22", "h33", "h01", "h02", "h03", "h12", "h13", "h23"]}


def _at(c: int, i: int, j: int, weighted: bool = False) -> str:
    i, j = min(i, j), max(i, j)
    return f"(h{i}{j} + w{i})" if weighted and i == j else f"h{i}{j}"


def _det(rows: list[list[str]]) -> str:
    """A determinant, by expansion along the first row."""
    if len(rows) == 1:
        return rows[0][0]
    return "(" + " + ".join(f"({(-1) ** j}) * {rows[0][j]} * {_det([r[:j] + r[j + 1:] for r in rows[1:]])}" for j in range(len(rows))) + ")"


def _matrix(c: int, weighted: bool = False) -> list[list[str]]:
    return [[_at(c, i, j, weighted) for j in range(c)] for i in range(c)]


def _sym(c: int) -> None:
    h, v, w, o = _H[c], [f"v{i}" for i in range(c)], [f"w{i}" for i in range(c)], [f"o{i}" for i in range(c)]
    frame = lambda s, d: table(s, d, "sym")
    text = lambda outs: f"select q, {', '.join(sql._r(e, n) for n, e in outs.items())} from ({DUCK['sym']}) f"
    hv = [" + ".join(f"{_at(c, i, j)} * v{j}" for j in range(c)) for i in range(c)]
    cramer = lambda weighted: {o[i]: f"{_det([[f'v{r}' if k == i else x for k, x in enumerate(row)] for r, row in enumerate(_matrix(c, weighted))])} / {_det(_matrix(c, weighted))}" for i in range(c)}
    named = lambda outs: {f"v{n[1:]}": e for n, e in outs.items()}
    _add(f"sym_matvec_c{c}", lambda s, d: posdef.sym_matvec(frame(s, d), h, v, o).select("q", *o), text(dict(zip(o, hv))))
    packed = [f"p{k}" for k in range(len(h))]
    back = [f"w{i} * v{i}" for i in range(c)] + [f"w{i} * v{j} + w{j} * v{i}" for i in range(c) for j in range(i + 1, c)]
    _add(f"sym_matvec_backward_c{c}", lambda s, d: posdef.sym_matvec_backward(frame(s, d), w, v, packed).select("q", *packed), text(dict(zip(packed, back))))
    _add(f"sym_addmatvec_c{c}", lambda s, d: posdef.sym_addmatvec_(frame(s, d), w, h, v).select("q", *w), text({x: f"{x} + {e}" for x, e in zip(w, hv)}))
    _add(f"sym_submatvec_c{c}", lambda s, d: posdef.sym_submatvec_(frame(s, d), w, h, v).select("q", *w), text({x: f"{x} - ({e})" for x, e in zip(w, hv)}))
    _add(f"sym_solve_c{c}", lambda s, d: posdef.sym_solve(frame(s, d), h, v, o).select("q", *o), text(cramer(False)))
    _add(f"sym_solve_weighted_c{c}", lambda s, d: posdef.sym_solve_(frame(s, d), h, v, w).select("q", *v), text(named(cramer(True))))
    pairs = [(i, i) for i in range(c)] + [(i, j) for i in range(c) for j in range(i + 1, c)]
    m = _matrix(c)
    minor = lambda i, j: _det([[x for k, x in enumerate(row) if k != j] for r, row in enumerate(m) if r != i]) if c > 1 else "1.0"
    inverse = {n: f"({(-1) ** (i + j)}) * {minor(i, j)} / {_det(m)}" for n, (i, j) in zip(h, pairs)}
    _add(f"sym_invert_c{c}", lambda s, d: posdef.sym_invert_(frame(s, d), h).select("q", *h), text(inverse))


for _c in (1, 2, 3, 4):
    _sym(_c)


# --- regularisers

_PENALTIES = {"absolute": (2.0, 0.0, 0.0), "membrane": (1.0, 2.0, 0.0), "bending": (1.0, 0.5, 2.0)}


def _field_stencils(ndim: int, kind: str, bound: str) -> None:
    ff, voxel = PAIRS[ndim][0], VOXEL[ndim]
    name, axes, batch = ff
    a, m, b = _PENALTIES[kind]
    p = st.field_penalties(ndim, 1, a, m, b, voxel)
    own = [("v", a, sql.field_taps(ndim, m, b, voxel))]
    end = f"{kind}_{ndim}d"
    keys = [*batch, *axes]
    _add(f"field_matvec_{end}", lambda s, d: st.matvec(field(s, d, ff), p, bound).df, sql.stencil(name, axes, batch, own, [], bound))
    _add(f"field_diag_{end}", lambda s, d: st.diag(field(s, d, ff), p, bound).df, sql.diagonal(name, axes, batch, own, bound))
    if kind == "bending":
        _add(f"field_addmatvec_{end}", lambda s, d: st.addmatvec_(["g"], field(s, d, ff), p, bound).df, sql.stencil(name, axes, batch, own, [], bound, {"g": "f.g + m0.lv"}))
        _add(f"field_submatvec_{end}", lambda s, d: st.submatvec_(["g"], field(s, d, ff), p, bound).df, sql.stencil(name, axes, batch, own, [], bound, {"g": "f.g - m0.lv"}))
        _add(f"field_adddiag_{end}", lambda s, d: st.adddiag_(field(s, d, ff), p, bound).df, sql.diagonal(name, axes, batch, own, bound, 1))
        _add(f"field_subdiag_{end}", lambda s, d: st.subdiag_(field(s, d, ff), p, bound).df, sql.diagonal(name, axes, batch, own, bound, -1))
        _add(f"field_forward_{end}", lambda s, d: st.forward(field(s, d, ff), p, ["h"], bound).df, sql.stencil(name, axes, batch, own, [], bound, {"v": "m0.lv + f.h * f.v"}))
        _add(f"field_precond_{end}", lambda s, d: st.precond_(field(s, d, ff), p, ["h"], bound).df.select(*keys, "v"), f"with f as ({DUCK[name]}) select {', '.join(keys)}, {sql._r(f'v / (h + {sql.diagonal_sql(axes, a, own[0][2], bound)})', 'v')} from f")
    kernel_rows = _kernel_rows(axes, [("k0", a, own[0][2])], [])
    _add(f"field_kernel_{end}", lambda s, d: st.kernel(s, p, axes, 1).df, kernel_rows(None, 0))
    for word, sign in (("addkernel", 1), ("subkernel", -1)):
        f = getattr(st, f"{word}_")
        _add(f"field_{word}_{end}", lambda s, d, f=f: f(field(s, d, ff), p).df, kernel_rows((name, batch, ["v"]), sign))


def _kernel_rows(axes, own, cross):
    """SQL of a kernel on the grid: own (column, absolute, taps), cross (column, taps)."""
    centre = [(n - 1) // 2 for n in axes.values()]
    entries: dict[tuple, dict[str, float]] = {}
    for column, a, taps in own:
        for o, w in [(tuple([0] * len(axes)), a - sum(w for _, w in taps)), *taps]:
            entries.setdefault(o, {})[column] = entries.get(o, {}).get(column, 0.0) + w
    for column, taps in cross:
        for o, w in taps:
            entries.setdefault(o, {})[column] = w
    columns = [c for c, *_ in own] + [c for c, _ in cross]
    rows = ", ".join("(" + ", ".join([*[str(c + s) for c, s in zip(centre, o)], *[f"{v.get(c, 0.0)!r}::double" for c in columns]]) + ")" for o, v in entries.items())

    def text(onto, sign: int) -> str:
        k = f"k({', '.join([*axes, *[f'c_{c}' for c in columns]])}) as (values {rows})"
        if onto is None:
            grid = " cross join ".join(f"(select unnest(range({n}))::int {a})" for a, n in axes.items())
            return f"with {k} select {', '.join(axes)}, {', '.join(sql._r(f'coalesce(c_{c}, 0.0)', c) for c in columns)} from {grid} left join k using ({', '.join(axes)})"
        name, batch, channels = onto
        return f"with f as ({DUCK[name]}), {k} select {', '.join([*batch, *axes])}, {', '.join(sql._r(f'{v} + ({sign}) * coalesce(c_{c}, 0.0)', v) for v, c in zip(channels, columns))} from f left join k using ({', '.join(axes)})"

    return text


for _d, _bound in ((1, "dst2"), (2, "dct2"), (3, "zero")):
    for _kind in _PENALTIES:
        _field_stencils(_d, _kind, _bound)
for _b in BOUNDS:
    _add(f"field_matvec_bound_{_b}", lambda s, d, b=_b: st.matvec(field(s, d, F1), st.field_penalties(1, 1, 1.0, 2.0, 1.0), b).df, sql.stencil(*F1, [("v", 1.0, sql.field_taps(1, 2.0, 1.0, [1.0]))], [], _b))

_FLOW = {"absolute": (2.0, 0.0, 0.0, 0.0, 0.0), "membrane": (1.0, 2.0, 0.0, 0.0, 0.0), "bending": (1.0, 0.5, 2.0, 0.0, 0.0), "lame": (1.0, 0.5, 0.0, 2.0, 1.0), "all": (1.0, 0.5, 2.0, 2.0, 1.0)}


def _cross(ndim: int, channels: Sequence[str], s: float, l: float):
    """(out, channel read, taps, axis swapped) of the terms between channels."""
    out = []
    for c in range(ndim):
        for e in range(ndim):
            if c != e and (s or l):
                taps = [(tuple(p if k == c else q if k == e else 0 for k in range(ndim)), -p * q * (s + l) / 4) for p in (-1, 1) for q in (-1, 1)]
                out.append((c, channels[e], taps, c))
    return out


def _flow_stencils(ndim: int, kind: str, bound: str) -> None:
    (ff, channels), voxel = FLOWS[ndim], VOXEL[ndim]
    name, axes, batch = ff
    a, m, b, s_, l_ = _FLOW[kind]
    p = st.flow_penalties(ndim, a, m, b, s_, l_, voxel)
    v = [1 / (x * x) for x in voxel]
    own = [(ch, a / v[c], sql.flow_taps(ndim, c, m, b, s_, l_, voxel)) for c, ch in enumerate(channels)]
    cross = _cross(ndim, channels, s_, l_)
    end = f"{kind}_{ndim}d"
    flow = lambda s, d: field(s, d, ff, channels)
    _add(f"flow_matvec_{end}", lambda s, d: st.matvec(flow(s, d), p, bound).df, sql.stencil(name, axes, batch, own, cross, bound))
    _add(f"flow_diag_{end}", lambda s, d: st.diag(flow(s, d), p, bound).df, sql.diagonal(name, axes, batch, own, bound))
    columns = [(f"k{c}{c}" if p.lame else f"k{c}", x, t) for c, (_, x, t) in enumerate(own)]
    crossed = [(f"k{c}{channels.index(ch)}", taps) for c, ch, taps, _ in cross]
    rows = _kernel_rows(axes, columns, crossed)
    _add(f"flow_kernel_{end}", lambda s, d: st.kernel(s, p, axes).df, rows(None, 0))
    if kind in ("bending", "absolute"):
        for word, sign in (("addkernel", 1), ("subkernel", -1)):
            f = getattr(st, f"{word}_")
            _add(f"flow_{word}_{end}", lambda s, d, f=f: f(flow(s, d), p).df, rows((name, batch, list(channels)), sign))
    if kind == "all":
        acc = ["g"] if ndim == 1 else ["g", "wgt"] if ndim == 2 else ["g", "wgt", "h"]
        _add(f"flow_addmatvec_{end}", lambda s, d: st.addmatvec_(acc, flow(s, d), p, bound).df, sql.stencil(name, axes, batch, own, cross, bound, {x: f"f.{x} + m{c}.lv" for c, x in enumerate(acc)}))
        _add(f"flow_submatvec_{end}", lambda s, d: st.submatvec_(acc, flow(s, d), p, bound).df, sql.stencil(name, axes, batch, own, cross, bound, {x: f"f.{x} - m{c}.lv" for c, x in enumerate(acc)}))
        _add(f"flow_adddiag_{end}", lambda s, d: st.adddiag_(flow(s, d), p, bound).df, sql.diagonal(name, axes, batch, own, bound, 1))
        _add(f"flow_subdiag_{end}", lambda s, d: st.subdiag_(flow(s, d), p, bound).df, sql.diagonal(name, axes, batch, own, bound, -1))
        with_h = lambda s, d: (f := flow(s, d)).with_df(f.df.withColumns({f"m{i}": F.col("h") if i < ndim else F.lit(0.5) for i in range(ndim * (ndim + 1) // 2)}))
        hs = [f"m{i}" for i in range(ndim * (ndim + 1) // 2)]
        hv = [" + ".join(["f.h * f." + ch, *[f"0.5 * f.{e}" for e in channels if e != ch]]) for ch in channels]
        _add(f"flow_forward_{end}", lambda s, d: st.forward(with_h(s, d), p, hs, bound).df, sql.stencil(name, axes, batch, own, cross, bound, {ch: f"m{c}.lv + {hv[c]}" for c, ch in enumerate(channels)}))
        diag = [f"(f.h + {sql.diagonal_sql(axes, x, t, bound)})" for _, x, t in own]
        mat = [[diag[i] if i == j else "0.5" for j in range(ndim)] for i in range(ndim)]
        solved = {ch: f"{_det([[f'f.{channels[r]}' if k == c else x for k, x in enumerate(row)] for r, row in enumerate(mat)])} / {_det(mat)}" for c, ch in enumerate(channels)}
        keys = [*batch, *axes]
        _add(f"flow_precond_{end}", lambda s, d: st.precond_(with_h(s, d), p, hs, bound).df.select(*keys, *channels), f"with f as ({DUCK[name]}) select {', '.join(keys)}, {', '.join(sql._r(e, n) for n, e in solved.items())} from f")


for _d, _bound in ((1, "dct2"), (2, "dct2"), (3, "dft")):
    for _kind in _FLOW:
        _flow_stencils(_d, _kind, _bound)


# --- weighted regularisers and solvers


def _weighted(ndim: int, bound: str) -> None:
    ff, voxel = PAIRS[ndim][0], VOXEL[ndim]
    name, axes, batch = ff
    p = st.field_penalties(ndim, 1, 1.0, 2.0, 0.0, voxel)
    own = [("v", 1.0, sql.field_taps(ndim, 2.0, 0.0, voxel))]
    _add(f"field_matvec_rls_{ndim}d", lambda s, d: st.matvec_rls(field(s, d, ff), p, ["wgt"], bound).df, sql.stencil(name, axes, batch, own, [], bound, weight="wgt"))
    _add(f"field_diag_rls_{ndim}d", lambda s, d: st.diag_rls(field(s, d, ff), p, ["wgt"], bound).df, sql.weighted_diagonal(name, axes, batch, own, bound, "wgt"))
    (_, channels) = FLOWS[ndim]
    q = st.flow_penalties(ndim, 1.0, 2.0, 0.0, 0.0, 0.0, voxel)
    v = [1 / (x * x) for x in voxel]
    flow = [(ch, 1.0 / v[c], sql.flow_taps(ndim, c, 2.0, 0.0, 0.0, 0.0, voxel)) for c, ch in enumerate(channels)]
    _add(f"flow_matvec_rls_{ndim}d", lambda s, d: st.matvec_rls(field(s, d, ff, channels), q, ["wgt"], bound).df, sql.stencil(name, axes, batch, flow, [], bound, weight="wgt"))
    _add(f"flow_diag_rls_{ndim}d", lambda s, d: st.diag_rls(field(s, d, ff, channels), q, ["wgt"], bound).df, sql.weighted_diagonal(name, axes, batch, flow, bound, "wgt"))


for _d, _bound in ((1, "dft"), (2, "dct2"), (3, "zero")):
    _weighted(_d, _bound)


def _weighted_by_channel(ndim: int, channels: Sequence[str], weights: Sequence[str], bound: str) -> None:
    (name, axes, batch), voxel = PAIRS[ndim][0], VOXEL[ndim]
    p = st.field_penalties(ndim, len(channels), [1.0, 0.5][: len(channels)], [2.0, 3.0][: len(channels)], 0.0, voxel)
    own = [(ch, a, sql.field_taps(ndim, m, 0.0, voxel)) for ch, a, m in zip(channels, (1.0, 0.5), (2.0, 3.0))]
    _add(f"field_matvec_rls_channels_{ndim}d", lambda s, d: st.matvec_rls(field(s, d, (name, axes, batch), channels), p, weights, bound).df, sql.stencil(name, axes, batch, own, [], bound, weight=list(weights)))
    _add(f"field_diag_rls_channels_{ndim}d", lambda s, d: st.diag_rls(field(s, d, (name, axes, batch), channels), p, weights, bound).df, sql.weighted_diagonal(name, axes, batch, own, bound, list(weights)))


def _weighted_lame(ndim: int, bound: str) -> None:
    ((name, axes, batch), channels), voxel = FLOWS[ndim], VOXEL[ndim]
    p = st.flow_penalties(ndim, 1.0, 0.5, 0.0, 2.0, 1.0, voxel)
    v = [1 / (x * x) for x in voxel]
    own = [(ch, 1.0 / v[c], sql.flow_taps(ndim, c, 0.5, 0.0, 2.0, 1.0, voxel)) for c, ch in enumerate(channels)]
    flow = lambda s, d: field(s, d, (name, axes, batch), channels)
    _add(f"flow_matvec_rls_lame_{ndim}d", lambda s, d: st.matvec_rls(flow(s, d), p, ["wgt"], bound).df, sql.weighted_lame(name, axes, batch, own, channels, 2.0, 1.0, bound, "wgt"))
    _add(f"flow_diag_rls_lame_{ndim}d", lambda s, d: st.diag_rls(flow(s, d), p, ["wgt"], bound).df, sql.weighted_diagonal(name, axes, batch, own, bound, "wgt"))


_weighted_by_channel(2, ["v", "v2"], ["wgt", "h"], "dct2")
_weighted_by_channel(3, ["v", "v1"], ["wgt", "h"], "dft")
for _d, _bound in ((1, "dct2"), (2, "dct2"), (3, "dft")):
    _weighted_lame(_d, _bound)


def _solver(name: str, which, p, taps, a: float, colours: int, kind: str, sweeps: int, bound: str, weight: str | None = None) -> None:
    fx, axes, batch = which
    keys = [*batch, *axes]

    def query(s: SparkSession, d: str) -> DataFrame:
        f = field(s, d, which)
        done = solvers.relax_rls(f, p, ["g"], [weight], ["h"], bound, sweeps) if weight else solvers.relax(f, p, ["g"], ["h"], bound, sweeps)
        return done.df.select(*keys, "v")

    _add(name, query, sql.relax(fx, axes, batch, a, taps, bound, colours, kind, sweeps, weight))


_solver("field_relax_membrane_1d", F1, st.field_penalties(1, 1, 1.0, 2.0), sql.field_taps(1, 2.0, 0.0, [1.0]), 1.0, 2, "sum", 2, "dct2")
_solver("field_relax_bending_1d", F1, st.field_penalties(1, 1, 1.0, 0.5, 2.0), sql.field_taps(1, 0.5, 2.0, [1.0]), 1.0, 3, "3", 1, "dft")
_solver("field_relax_membrane_3d", F3, st.field_penalties(3, 1, 1.0, 2.0), sql.field_taps(3, 2.0, 0.0, [1.0] * 3), 1.0, 2, "sum", 1, "dct2")
_solver("field_relax_rls_1d", F1, st.field_penalties(1, 1, 1.0, 2.0), sql.field_taps(1, 2.0, 0.0, [1.0]), 1.0, 2, "sum", 1, "dct2", "wgt")
_solver("flow_relax_membrane_1d", F1, st.flow_penalties(1, 1.0, 2.0), sql.flow_taps(1, 0, 2.0, 0.0, 0.0, 0.0, [1.0]), 1.0, 2, "sum", 1, "dct2")
_solver("flow_relax_lame_1d", F1, st.flow_penalties(1, 1.0, 2.0, 0.0, 1.0, 1.0), sql.flow_taps(1, 0, 2.0, 0.0, 1.0, 1.0, [1.0]), 1.0, 2, "2", 1, "dft")
_solver("flow_relax_rls_1d", F1, st.flow_penalties(1, 1.0, 2.0), sql.flow_taps(1, 0, 2.0, 0.0, 0.0, 0.0, [1.0]), 1.0, 2, "sum", 1, "dct2", "wgt")


def _flow_solver(name: str, ndim: int, penalties: Sequence[float], right: Sequence[str], colours: int, kind: str, bound: str) -> None:
    (fx, axes, batch), channels = FLOWS[ndim]
    a, m, b, s_, l_ = penalties
    p = st.flow_penalties(ndim, a, m, b, s_, l_)
    own = [(ch, a, sql.flow_taps(ndim, c, m, b, s_, l_, [1.0] * ndim)) for c, ch in enumerate(channels)]
    query = lambda s, d: solvers.relax(field(s, d, (fx, axes, batch), channels), p, right, None, bound, 1).df.select(*batch, *axes, *channels)
    _add(name, query, sql.relax_flow(fx, axes, batch, own, _cross(ndim, channels, s_, l_), right, bound, colours, kind, 1))


_flow_solver("flow_relax_membrane_2d", 2, (1.0, 2.0, 0.0, 0.0, 0.0), ["g", "wgt"], 2, "sum", "dct2")
_flow_solver("flow_relax_lame_2d", 2, (1.0, 2.0, 0.0, 1.0, 0.5), ["g", "wgt"], 4, "2", "dft")
_flow_solver("flow_relax_all_1d", 1, (1.0, 0.5, 0.25, 1.0, 0.5), ["g"], 3, "3", "dct2")
_flow_solver("flow_relax_membrane_3d", 3, (1.0, 2.0, 0.0, 0.0, 0.0), ["g", "wgt", "h"], 2, "sum", "dct2")


def _cg(s: SparkSession, d: str) -> DataFrame:
    return solvers.cg(field(s, d, F3), st.field_penalties(3, 1, 1.0, 0.5, 0.25), ["g"], ["h"], "dct2", iterations=3, tolerance=0.0).field.df.select("b", "x", "y", "z", "v")


_add("field_cg", _cg, sql.conjugate("f3", F3[1], ("b",), 1.0, sql.field_taps(3, 0.5, 0.25, [1.0] * 3), "dct2", 3))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear ``pull`` from the fields of event counts at all points."""
    return _QUERIES["pull_1"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
