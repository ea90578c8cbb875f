"""DuckDB SQL for the field operators, written from their definitions.

Boundary conditions are lists of (position, place, sign) found by walking along
the extension; splines are sums of truncated powers; stencils gather neighbours
by joins.  The operators themselves use none of this.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from math import comb, factorial

import numpy as np

from fieldloom.plans.fixtures import DUCK

Axes = Mapping[str, int]


def extension(n: int, bound: str, low: int, high: int) -> list[tuple[int, int, int]]:
    """(i, j, s) for i from low to high, by repeating one period."""
    line = [(j, 1) for j in range(n)]
    if bound == "dft":
        period = line
    elif bound == "dct2":
        period = line + line[::-1]
    elif bound == "dst2":
        period = line + [(j, -1) for j, _ in line[::-1]]
    elif bound == "dct1":
        period = line + line[-2:0:-1] if n > 1 else line
    elif bound == "dst1":
        period = line + [(0, 0)] + [(j, -1) for j, _ in line[::-1]] + [(0, 0)]
    elif bound == "replicate":
        return [(i, min(max(i, 0), n - 1), 1) for i in range(low, high + 1)]
    else:
        return [(i, i, 1) for i in range(max(low, 0), min(high, n - 1) + 1)]
    return [(i, *period[i % len(period)]) for i in range(low, high + 1) if period[i % len(period)][1]]


def bmap(name: str, n: int, bound: str, reach: int) -> str:
    rows = ", ".join(f"({i}, {j}, {s})" for i, j, s in extension(n, bound, -reach, n + reach))
    return f"{name}(i, j, s) as (values {rows})"


def spline(d: str, k: int, derivative: int = 0) -> str:
    """The B-spline of order k, or a derivative, as a sum of truncated powers."""
    if k == 0:
        return "1.0" if derivative == 0 else "0.0"
    if derivative > k:
        return "0.0"
    p, scale = k - derivative, factorial(k) // factorial(k - derivative)
    step = (lambda x: f"(case when {x} >= 0 then 1.0 else 0.0 end)") if p == 0 else (lambda x: f"power(greatest({x}, 0.0), {p})")
    terms = " + ".join(f"({(-1) ** j * comb(k + 1, j) * scale / factorial(k)!r}) * {step(f'({d}) + {(k + 1) / 2 - j}')}" for j in range(k + 2))
    return f"({terms})"


#: Added before rounding on both sides: dyadic values often lie half way between two decimals.
NUDGE = 3e-8


def _r(x: str, name: str) -> str:
    return f"round({x} + {NUDGE}, 6) + 0.0 as {name}"


def _taps(axes: Axes, loc: Sequence[str], order: int, bound: str, extrapolate: int, keys: Sequence[str], carry: Sequence[str] = ()) -> str:
    """CTEs: bm_<axis>, and t with keys, carried columns, j<axis>, w<axis>, g<axis>, h<axis>, s<axis>."""
    maps = ",\n".join(bmap(f"bm_{a}", n, bound, 12) for a, n in axes.items())
    columns, joins, view = [], [], []
    for (a, n), x in zip(axes.items(), loc):
        d = f"p.{x} - {a}_.i"
        columns += [f"{a}_.j as j{a}", f"{a}_.s * {spline(d, order)} as w{a}", f"{a}_.s * {spline(d, order, 1)} as g{a}", f"{a}_.s * {spline(d, order, 2)} as h{a}", f"{a}_.s as s{a}"]
        span = f"{a}_.i = round(p.{x})" if order == 0 else f"{a}_.i between floor(p.{x} - {(order - 1) / 2}) and floor(p.{x} - {(order - 1) / 2}) + {order}"
        joins.append(f"join bm_{a} {a}_ on {span}")
        if extrapolate < 1:
            edge = 0.05 if extrapolate == 0 else 0.55
            view.append(f"p.{x} >= {-edge} and p.{x} <= {n - 1 + edge}")
    where = f"where {' and '.join(view)}" if view else ""
    return f"{maps},\nt as (select {', '.join(f'p.{k}' for k in (*keys, *carry))}, {', '.join(columns)} from p {' '.join(joins)} {where})"


def _on(axes: Axes, batch: Sequence[str]) -> str:
    return " and ".join([f"f.{a} = t.j{a}" for a in axes] + [f"f.{b} = t.{b}" for b in batch])


def gather(field: str, points: str, axes: Axes, loc: Sequence[str], order: int, bound: str, extrapolate: int, batch: Sequence[str], sums: Mapping[str, str], carry: Sequence[str] = ()) -> str:
    """Sums over taps of products of w/g/h columns with field columns, for each point."""
    keys = [*batch, "q"]
    names = list(sums)
    return f"""with f as ({DUCK[field]}), p as ({DUCK[points]}),
{_taps(axes, loc, order, bound, extrapolate, keys, carry)},
r as (select {', '.join(f't.{k}' for k in keys)}, {', '.join(f'{e} as {n}' for n, e in sums.items())} from t join f on {_on(axes, batch)}
      union all select {', '.join(keys)}, {', '.join('0.0' for _ in names)} from p)
select {', '.join(keys)}, {', '.join(_r(f'sum({n})', n) for n in names)} from r group by {', '.join(keys)}"""


def scatter(points: str, axes: Axes, loc: Sequence[str], order: int, bound: str, extrapolate: int, batch: Sequence[str], value: str, name: str, carry: Sequence[str] = ("g",)) -> str:
    keys = [*batch, "q"]
    grid = " cross join ".join([*([f"(select distinct {', '.join(batch)} from p)"] if batch else []), *[f"(select unnest(range({n}))::int {a})" for a, n in axes.items()]])
    return f"""with p as ({DUCK[points]}),
{_taps(axes, loc, order, bound, extrapolate, keys, carry)},
r as (select {', '.join(batch) + ', ' if batch else ''}{', '.join(f'j{a} as {a}' for a in axes)}, {value} as v from t
      union all select {', '.join([*batch, *axes])}, 0.0 from {grid})
select {', '.join([*batch, *axes])}, {_r('sum(v)', name)} from r group by {', '.join([*batch, *axes])}"""


def product(axes: Axes, kinds: Mapping[str, str] | None = None) -> str:
    return " * ".join(f"{(kinds or {}).get(a, 'w')}{a}" for a in axes)


def inverse_spline(order: int) -> list[tuple[float, float]]:
    """(a, z) such that a spline's coefficients are the sums over k of (sum a z**|k|) times the samples, from its values at whole places."""
    value = lambda x: sum((-1) ** j * comb(order + 1, j) * max(x + (order + 1) / 2 - j, 0.0) ** order for j in range(order + 2)) / factorial(order)
    m = order // 2
    polynomial = np.poly1d([value(k) for k in range(-m, m + 1)])
    return [(float((z ** (m - 1) / polynomial.deriv()(z)).real), float(z.real)) for z in polynomial.roots if abs(z) < 1]


def resize(field: str, axes: Axes, new: Axes, order: int, bound: str, batch: Sequence[str], shift: float = 0.0) -> str:
    """One tensor sum over all axes at once."""
    maps = ",\n".join(bmap(f"bm_{a}", n, bound, 12) for a, n in axes.items())
    parts, joins = [], []
    for a, n in axes.items():
        x = f"({n / new[a]!r}::double * (o{a} + {shift}) - {shift})"
        span = f"b.i = floor({x} + 0.5)" if order == 0 else f"b.i between floor({x} - {(order - 1) / 2}) and floor({x} - {(order - 1) / 2}) + {order}"
        parts.append(f"e_{a} as (select o{a}, b.j, b.s * {spline(f'{x} - b.i', order)} w from (select unnest(range({new[a]}))::int o{a}) join bm_{a} b on {span})")
        joins.append(f"join e_{a} on e_{a}.j = f.{a}")
    keys = [*[f"f.{b}" for b in batch], *[f"o{a}" for a in axes]]
    return f"""with f as ({DUCK[field]}), {maps}, {', '.join(parts)}
select {', '.join([*[f'f.{b}' for b in batch], *[f'o{a} as {a}' for a in axes]])}, {_r('sum(' + ' * '.join(f'e_{a}.w' for a in axes) + ' * f.v)', 'v')}
from f {' '.join(joins)} group by {', '.join(keys)}"""


def restrict(field: str, axes: Axes, new: Axes, order: int, bound: str, batch: Sequence[str], shift: float = 0.0) -> str:
    parts, joins = [], []
    for a, n in axes.items():
        f, pad = n / new[a], (order + 1) // 2
        rows = ", ".join(f"({i}, {j}, {s})" for i, j, s in extension(new[a], bound, -pad, new[a] + pad - 1))
        d = f"(({f!r}::double * (c.i + {shift}) - {shift}) - x.x) / {f!r}::double"
        inside = f"abs({d}) <= {(order + 1) / 2}"
        parts.append(f"e_{a} as (select x.x, c.j, c.s * {spline(d, order)} w from (values {rows}) c(i, j, s) join (select unnest(range({n}))::int x) x on {inside})")
        joins.append(f"join e_{a} on e_{a}.x = f.{a}")
    keys = [*[f"f.{b}" for b in batch], *[f"e_{a}.j" for a in axes]]
    return f"""with f as ({DUCK[field]}), {', '.join(parts)}
select {', '.join([*[f'f.{b}' for b in batch], *[f'e_{a}.j as {a}' for a in axes]])}, {_r('sum(' + ' * '.join(f'e_{a}.w' for a in axes) + ' * f.v)', 'v')}
from f {' '.join(joins)} group by {', '.join(keys)}"""


# --- stencils: (offset, weight) lists by channel, from the definitions of the penalties


def field_taps(ndim: int, m: float, b: float, voxel: Sequence[float]) -> list[tuple[tuple[int, ...], float]]:
    v = [1 / (x * x) for x in voxel]
    out = []
    for o in itertools.product(range(-2, 3), repeat=ndim):
        moved = [d for d in range(ndim) if o[d]]
        size = sum(map(abs, o))
        if size == 1:
            out.append((o, -m * v[moved[0]] - 4 * b * v[moved[0]] * sum(v)))
        elif size == 2 and len(moved) == 1:
            out.append((o, b * v[moved[0]] ** 2))
        elif size == 2 and len(moved) == 2:
            out.append((o, 2 * b * v[moved[0]] * v[moved[1]]))
    return [(o, w) for o, w in out if w]


def flow_taps(ndim: int, c: int, m: float, b: float, s: float, l: float, voxel: Sequence[float]) -> list[tuple[tuple[int, ...], float]]:
    v = [1 / (x * x) for x in voxel]
    out = {o: w / v[c] for o, w in field_taps(ndim, m, b, voxel)}
    if s or l:
        for d in range(ndim):
            for t in (-1, 1):
                o = tuple(t if k == d else 0 for k in range(ndim))
                out[o] = out.get(o, 0) + (-2 * s - l if d == c else -s * v[d] / v[c])
    return list(out.items())


def swapped(bound: str) -> str:
    return {"dct1": "dst1", "dst1": "dct1", "dct2": "dst2", "dst2": "dct2"}.get(bound, bound)


def _values(name: str, axes: Axes, taps) -> str:
    rows = ", ".join("(" + ", ".join(map(str, o)) + f", {w!r}::double)" for o, w in taps)
    return f"{name}({', '.join('o' + a for a in axes)}, w) as (values {rows})"


def stencil_ctes(axes: Axes, batch: Sequence[str], own: Sequence[tuple[str, float, list]], cross: Sequence[tuple[int, str, list, int]], bound: str, source: str = "f", weight: str | Sequence[str] | None = None, tag: str = "", factor: str = "") -> tuple[str, list[str]]:
    """CTEs that leave, for each channel, a table m<c> (keys, y) with L f; ``own`` has (channel, absolute, taps), ``cross`` (out, channel read, taps, axis swapped)."""
    keys = [*batch, *axes]
    ctes, parts = [], {}
    on = lambda names: " and ".join([*[f"n.{b} = f.{b}" for b in batch], *[f"n.{a} = {names[a]}.j" for a in axes]])
    for c, (channel, absolute, taps) in enumerate(own):
        ctes.append(_values(f"k{tag}{c}", axes, taps) if taps else f"k{tag}{c} as (select {', '.join(f'0 as o{a}' for a in axes)}, 0.0 as w)")
        maps = " ".join(f"left join bm_{a} {a}_ on {a}_.i = f.{a} + k.o{a}" for a in axes)
        of = weight if not isinstance(weight, (list, tuple)) else weight[c]
        w = f"k.w * (f.{of} + coalesce(n.{of}, f.{of})) / 2" if of else "k.w"
        centre = f"{absolute!r} * f.{of} * f.{channel}" if of else f"{absolute!r} * f.{channel}"
        sign = " * ".join(f"{a}_.s" for a in axes)
        parts.setdefault(c, []).append(f"select {', '.join(f'f.{k}' for k in keys)}, {w} * (coalesce({sign} * n.{channel}, 0) - f.{channel}) lv from {source} f cross join k{tag}{c} k {maps} left join {source} n on {on({a: a + '_' for a in axes})}")
        parts[c].append(f"select {', '.join(f'f.{k}' for k in keys)}, {centre} lv from {source} f")
    for i, (c, channel, taps, axis) in enumerate(cross):
        ctes.append(_values(f"x{tag}{i}", axes, taps))
        names = list(axes)
        maps = " ".join(f"join {'sw' if d == axis else 'bm'}_{a} {a}_ on {a}_.i = f.{a} + k.o{a}" for d, a in enumerate(names))
        sign = " * ".join(f"{a}_.s" for a in axes)
        parts[c].append(f"select {', '.join(f'f.{k}' for k in keys)}, k.w * {sign} * n.{channel} lv from {source} f cross join x{tag}{i} k {maps} join {source} n on {on({a: a + '_' for a in axes})}")
    for c in parts:
        ctes.append(f"m{tag}{c} as (select {', '.join(keys)}, sum(lv) lv from ({' union all '.join(parts[c])}) group by {', '.join(keys)})")
    return ",\n".join(ctes), [f"m{tag}{c}" for c in parts]


def maps_of(axes: Axes, bound: str) -> str:
    return ",\n".join([bmap(f"bm_{a}", n, bound, 3) for a, n in axes.items()] + [bmap(f"sw_{a}", n, swapped(bound), 3) for a, n in axes.items()])


def stencil(field: str, axes: Axes, batch: Sequence[str], own, cross, bound: str, outputs: Mapping[str, str] | None = None, weight: str | Sequence[str] | None = None) -> str:
    """L f, or expressions of m0.y, m1.y, ... and f's columns."""
    ctes, made = stencil_ctes(axes, batch, own, cross, bound, weight=weight)
    keys = [*batch, *axes]
    outputs = outputs or {channel: f"m{c}.lv" for c, (channel, _, _) in enumerate(own)}
    joins = " ".join(f"join {m} using ({', '.join(keys)})" for m in made)
    return f"with f as ({DUCK[field]}), {maps_of(axes, bound)},\n{ctes}\nselect {', '.join(keys)}, {', '.join(_r(e, n) for n, e in outputs.items())} from f {joins}"


def diagonal_sql(axes: Axes, absolute: float, taps, bound: str) -> str:
    """a - sum w s, with signs by position as CASEs from the extension."""
    def sign(a: str, n: int, o: int) -> str:
        if not o:
            return "1"
        have = {i: s for i, _, s in extension(n, bound, -3, n + 3)}
        cases = " ".join(f"when {x} then {have.get(x + o, 0)}" for x in range(n))
        return f"(case f.{a} {cases} end)"

    terms = " ".join(f"- ({w!r}) * {' * '.join(sign(a, n, s) for (a, n), s in zip(axes.items(), o))}" for o, w in taps)
    return f"({absolute!r} {terms})"


def diagonal(field: str, axes: Axes, batch: Sequence[str], own, bound: str, plus: int | None = None) -> str:
    keys = [*batch, *axes]
    expr = lambda c, a, t: diagonal_sql(axes, a, t, bound) if plus is None else f"f.{c} + ({plus}) * {diagonal_sql(axes, a, t, bound)}"
    return f"with f as ({DUCK[field]}) select {', '.join(keys)}, {', '.join(_r(expr(c, a, t), c) for c, a, t in own)} from f"


def weighted_lame(field: str, axes: Axes, batch: Sequence[str], own, channels: Sequence[str], shears: float, div: float, bound: str, weight: str) -> str:
    """L f with one weight map: between channels, neighbours' weights along either axis count for shears and for the divergence."""
    keys, names = [*batch, *axes], list(axes)
    ctes, made = stencil_ctes(axes, batch, own, [], bound, weight=weight)
    parts = {c: [f"select {', '.join(keys)}, lv from {m}"] for c, m in enumerate(made)}
    at = lambda t, places: " and ".join([*[f"{t}.{b} = f.{b}" for b in batch], *[f"{t}.{a} = {places.get(a, f'f.{a}')}" for a in names]])
    for c, d in enumerate(names):
        for e_, e in enumerate(names):
            if c == e_:
                continue
            for s in (-1, 1):
                for t in (-1, 1):
                    k = f"{-s * t / 4!r} * ({shears!r} * coalesce(wd.{weight}, f.{weight}) + {div!r} * coalesce(we.{weight}, f.{weight}))"
                    near = f"left join bm_{d} pd on pd.i = f.{d} + ({s}) left join {'f'} wd on {at('wd', {d: 'pd.j'})} left join bm_{e} pe on pe.i = f.{e} + ({t}) left join f we on {at('we', {e: 'pe.j'})}"
                    read = f"join sw_{d} sd on sd.i = f.{d} + ({s}) join bm_{e} se on se.i = f.{e} + ({t}) join f n on {at('n', {d: 'sd.j', e: 'se.j'})}"
                    parts[c].append(f"select {', '.join(f'f.{x}' for x in keys)}, {k} * sd.s * se.s * n.{channels[e_]} lv from f {near} {read}")
    for c, rows in parts.items():
        ctes += f",\nz{c} as (select {', '.join(keys)}, sum(lv) lv from ({' union all '.join(rows)}) group by {', '.join(keys)})"
    joins = " ".join(f"join z{c} using ({', '.join(keys)})" for c in parts)
    return f"with f as ({DUCK[field]}), {maps_of(axes, bound)},\n{ctes}\nselect {', '.join(keys)}, {', '.join(_r(f'z{c}.lv', ch) for c, ch in enumerate(channels))} from f {joins}"


def relax_flow(field: str, axes: Axes, batch: Sequence[str], own, cross, right: Sequence[str], bound: str, colours: int, kind: str, sweeps: int) -> str:
    """Coloured sweeps for the channels of a flow without a matrix, unrolled."""
    keys, channels = [*batch, *axes], [c for c, _, _ in own]
    names = list(dict.fromkeys([*channels, *right]))
    chain = [f"f0 as (select {', '.join([*keys, *names])} from f)"]
    colour = f"({' + '.join('f.' + a for a in axes)}) % 2" if kind == "sum" else " + ".join(f"(f.{a} % {kind}) * {int(kind) ** d}" for d, a in enumerate(axes))
    diag = [diagonal_sql(axes, a, taps, bound) for _, a, taps in own]
    for n in range(sweeps * colours):
        ctes, made = stencil_ctes(axes, batch, own, cross, bound, source=f"f{n}", tag=f"{n}_")
        chain.append(ctes)
        new = [f"case when {colour} = {n % colours} then f.{c} + (f.{g} - {m}.lv) / {d} else f.{c} end {c}" for c, g, m, d in zip(channels, right, made, diag)]
        joins = " ".join(f"join {m} using ({', '.join(keys)})" for m in made)
        rest = "".join(f", f.{x}" for x in names if x not in channels)
        chain.append(f"f{n + 1} as materialized (select {', '.join(f'f.{k}' for k in keys)}, {', '.join(new)}{rest} from f{n} f {joins})")
    return f"with f as ({DUCK[field]}), {maps_of(axes, bound)},\n" + ",\n".join(chain) + f"\nselect {', '.join(keys)}, {', '.join(_r(c, c) for c in channels)} from f{sweeps * colours}"


def weighted_diagonal(field: str, axes: Axes, batch: Sequence[str], own, bound: str, weight: str | Sequence[str]) -> str:
    """abs w - sum w_k (w + w') / 2 s, for penalties without bending; one weight, or one for each channel."""
    keys = [*batch, *axes]
    ctes, selects, weights = [], [], [weight] * len(own) if isinstance(weight, str) else list(weight)
    for c, (channel, absolute, taps) in enumerate(own):
        weight = weights[c]
        ctes.append(_values(f"k{c}", axes, taps))
        maps = " ".join(f"left join bm_{a} {a}_ on {a}_.i = f.{a} + k.o{a}" for a in axes)
        on = " and ".join([*[f"n.{b} = f.{b}" for b in batch], *[f"n.{a} = {a}_.j" for a in axes]])
        ctes.append(f"d{c} as (select {', '.join(f'f.{k}' for k in keys)}, {absolute!r} * any_value(f.{weight}) - sum(k.w * (f.{weight} + n.{weight}) / 2 * {' * '.join(f'{a}_.s' for a in axes)}) lv from f cross join k{c} k {maps} join f n on {on} group by {', '.join(f'f.{k}' for k in keys)})")
        selects.append(_r(f"d{c}.lv", channel))
    joins = " ".join(f"join d{c} using ({', '.join(keys)})" for c in range(len(own)))
    return f"with f as ({DUCK[field]}), {maps_of(axes, bound)},\n" + ",\n".join(ctes) + f"\nselect {', '.join(keys)}, {', '.join(selects)} from f {joins}"


def relax(field: str, axes: Axes, batch: Sequence[str], absolute: float, taps, bound: str, colours: int, kind: str, sweeps: int, weight: str | None = None) -> str:
    """Coloured sweeps for one channel v with right hand side g and matrix h, unrolled."""
    keys = [*batch, *axes]
    extra = [weight] if weight else []
    chain = [f"f0 as (select {', '.join([*keys, 'v', 'g', 'h', *extra])} from f)"]
    if kind == "sum":
        colour = f"({' + '.join('f.' + a for a in axes)}) % 2"
    else:
        colour = " + ".join(f"(f.{a} % {kind}) * {int(kind) ** d}" for d, a in enumerate(axes))
    for n in range(sweeps * colours):
        ctes, made = stencil_ctes(axes, batch, [("v", absolute, taps)], [], bound, source=f"f{n}", weight=weight, tag=f"{n}_")
        if weight:
            w = weighted_diagonal_cte(axes, batch, absolute, taps, weight, f"f{n}", f"dg{n}")
            chain.append(w)
            diag, join = f"dg{n}.lv", f"join dg{n} using ({', '.join(keys)})"
        else:
            diag, join = diagonal_sql(axes, absolute, taps, bound), ""
        chain.append(ctes)
        chain.append(f"f{n + 1} as materialized (select {', '.join(f'f.{k}' for k in keys)}, case when {colour} = {n % colours} then f.v + (f.g - {made[0]}.lv - f.h * f.v) / (f.h + {diag}) else f.v end v, f.g, f.h{''.join(', f.' + e for e in extra)} from f{n} f join {made[0]} using ({', '.join(keys)}) {join})")
    return f"with f as ({DUCK[field]}), {maps_of(axes, bound)},\n" + ",\n".join(chain) + f"\nselect {', '.join(keys)}, {_r('v', 'v')} from f{sweeps * colours}"


def weighted_diagonal_cte(axes: Axes, batch: Sequence[str], absolute: float, taps, weight: str, source: str, name: str) -> str:
    keys = [*batch, *axes]
    rows = ", ".join("(" + ", ".join(map(str, o)) + f", {w!r}::double)" for o, w in taps)
    maps = " ".join(f"join bm_{a} {a}_ on {a}_.i = f.{a} + k.o{a}" for a in axes)
    on = " and ".join([*[f"n.{b} = f.{b}" for b in batch], *[f"n.{a} = {a}_.j" for a in axes]])
    return f"{name} as (select {', '.join(f'f.{k}' for k in keys)}, {absolute!r} * any_value(f.{weight}) - sum(k.w * (f.{weight} + n.{weight}) / 2 * {' * '.join(f'{a}_.s' for a in axes)}) lv from {source} f cross join (values {rows}) k({', '.join('o' + a for a in axes)}, w) {maps} join {source} n on {on} group by {', '.join(f'f.{k}' for k in keys)})"


def conjugate(field: str, axes: Axes, batch: Sequence[str], absolute: float, taps, bound: str, steps: int) -> str:
    """A fixed number of preconditioned steps for one channel v, right hand side g, matrix h."""
    keys = [*batch, *axes]
    using = f"using ({', '.join(keys)})"
    diag = f"(f.h + {diagonal_sql(axes, absolute, taps, bound)})"
    ctes, made = stencil_ctes(axes, batch, [("v", absolute, taps)], [], bound, source="f", tag="i")
    chain = [ctes, f"s0 as materialized (select {', '.join('f.' + k for k in keys)}, f.v sol, f.h, {diag} dg, f.g - {made[0]}.lv - f.h * f.v r from f join {made[0]} {using})", f"t0 as materialized (select {', '.join(keys)}, sol, h, dg, r, r / dg d from s0)"]
    for n in range(steps):
        ctes, made = stencil_ctes(axes, batch, [("d", absolute, taps)], [], bound, source=f"t{n}", tag=f"c{n}")
        chain += [
            ctes,
            f"q{n} as materialized (select t.*, {made[0]}.lv + t.h * t.d q from t{n} t join {made[0]} {using})",
            f"a{n} as materialized (select sum(r * r / dg) / sum(d * q) alpha, sum(r * r / dg) rz from q{n})",
            f"u{n} as materialized (select {', '.join(keys)}, sol + alpha * d sol, h, dg, r - alpha * q r, d from q{n}, a{n})",
            f"b{n} as materialized (select sum(r * r / dg) / any_value(rz) beta from u{n}, a{n})",
            f"t{n + 1} as materialized (select {', '.join(keys)}, sol, h, dg, r, r / dg + beta * d d from u{n}, b{n})",
        ]
    return f"with f as ({DUCK[field]}), {maps_of(axes, bound)},\n" + ",\n".join(chain) + f"\nselect {', '.join(keys)}, {_r('sol', 'v')} from t{steps}"
