"""Row-local algebra on compact symmetric matrices: the diagonal first, then the upper rows.

All functions take a DataFrame and names of columns, and return it with result
columns added or (names that are there already) replaced; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the least pivot of a factorisation.
MIN_PIVOT = 1e-40


def packed_size(c: int) -> int:
    return c * (c + 1) // 2


def require_packed(h: Sequence[str], c: int) -> None:
    if len(h) != packed_size(c):
        raise ValueError(f"a packed matrix of {c} channels has {packed_size(c)} columns, not {len(h)}")


def entry(h: Sequence, c: int, i: int, j: int):
    """Where (i, j) of the matrix is in its packed form."""
    if i == j:
        return h[i]
    i, j = min(i, j), max(i, j)
    return h[c + i * (c - 1) - i * (i - 1) // 2 + (j - i - 1)]


def _double(names: Sequence[str]) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


def products(h: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    """The components of H v."""
    c = len(v)
    out = []
    for i in range(c):
        total = entry(h, c, i, 0) * v[0]
        for j in range(1, c):
            total = total + entry(h, c, i, j) * v[j]
        out.append(total)
    return out


def sym_matvec(df: DataFrame, h: Sequence[str], v: Sequence[str], out: Sequence[str]) -> DataFrame:
    """out = H v."""
    require_packed(h, len(v))
    return df.withColumns(dict(zip(out, products(_double(h), _double(v)))))


def sym_matvec_backward(df: DataFrame, gradient: Sequence[str], v: Sequence[str], out: Sequence[str]) -> DataFrame:
    """The gradient of H v for the packed H: g_i v_i, and g_i v_j + g_j v_i."""
    c = len(v)
    require_packed(out, c)
    g, x = _double(gradient), _double(v)
    terms = [g[i] * x[i] for i in range(c)] + [g[i] * x[j] + g[j] * x[i] for i in range(c) for j in range(i + 1, c)]
    return df.withColumns(dict(zip(out, terms)))


def sym_addmatvec_(df: DataFrame, acc: Sequence[str], h: Sequence[str], v: Sequence[str]) -> DataFrame:
    """acc + H v in place of acc."""
    require_packed(h, len(v))
    return df.withColumns({a: F.col(a).cast("double") + p for a, p in zip(acc, products(_double(h), _double(v)))})


def sym_submatvec_(df: DataFrame, acc: Sequence[str], h: Sequence[str], v: Sequence[str]) -> DataFrame:
    """acc - H v in place of acc."""
    require_packed(h, len(v))
    return df.withColumns({a: F.col(a).cast("double") - p for a, p in zip(acc, products(_double(h), _double(v)))})


def _cofactors(h: Sequence[Column], c: int) -> tuple[list[Column], Column]:
    """Packed cofactors and the determinant, for up to three channels."""
    if c == 1:
        return [F.lit(1.0)], h[0]
    if c == 2:
        return [h[1], h[0], -h[2]], h[0] * h[1] - h[2] * h[2]
    a, b, d, e, f, g = h  # 00 11 22 01 02 12
    co = [b * d - g * g, a * d - f * f, a * b - e * e, f * g - e * d, e * g - f * b, e * f - a * g]
    return co, a * co[0] + e * co[3] + f * co[4]


def _factored(df: DataFrame, h: Sequence[Column], c: int) -> tuple[DataFrame, list[list[str]]]:
    """Columns of the lower factor of each matrix; pivots below ``MIN_PIVOT`` count as that."""
    names = [[f"_l{i}_{j}" for j in range(i + 1)] for i in range(c)]
    for j in range(c):
        pivot = entry(h, c, j, j)
        for k in range(j):
            pivot = pivot - F.col(names[j][k]) * F.col(names[j][k])
        df = df.withColumn(names[j][j], F.sqrt(F.greatest(pivot, F.lit(MIN_PIVOT))))
        columns = {}
        for i in range(j + 1, c):
            total = entry(h, c, i, j)
            for k in range(j):
                total = total - F.col(names[i][k]) * F.col(names[j][k])
            columns[names[i][j]] = total / F.col(names[j][j])
        df = df.withColumns(columns) if columns else df
    return df, names


def _solved(df: DataFrame, names: list[list[str]], v: Sequence[Column], out: Sequence[str]) -> DataFrame:
    c = len(v)
    for i in range(c):
        total = v[i]
        for k in range(i):
            total = total - F.col(names[i][k]) * F.col(f"_y{k}")
        df = df.withColumn(f"_y{i}", total / F.col(names[i][i]))
    for i in reversed(range(c)):
        total = F.col(f"_y{i}")
        for k in range(i + 1, c):
            total = total - F.col(names[k][i]) * F.col(f"_x{k}")
        df = df.withColumn(f"_x{i}", total / F.col(names[i][i]))
    return df.withColumns({o: F.col(f"_x{i}") for i, o in enumerate(out)}).drop(*[f"_{n}{i}" for n in "xy" for i in range(c)])


def solve_columns(df: DataFrame, h: Sequence[Column], v: Sequence[Column], out: Sequence[str]) -> DataFrame:
    """out = H \\ v for columns of a packed matrix and a vector: cofactors up to three channels, else a factorisation."""
    c = len(v)
    if c > 3:
        df = df.withColumns({f"_h{k}": x for k, x in enumerate(h)}).withColumns({f"_v{k}": x for k, x in enumerate(v)})
        df, names = _factored(df, [F.col(f"_h{k}") for k in range(len(h))], c)
        df = _solved(df, names, [F.col(f"_v{k}") for k in range(c)], out)
        return df.drop(*[n for row in names for n in row], *[f"_h{k}" for k in range(len(h))], *[f"_v{k}" for k in range(c)])
    co, det = _cofactors(h, c)
    return df.withColumns({o: p / det for o, p in zip(out, products(co, v))})


def sym_solve(df: DataFrame, h: Sequence[str], v: Sequence[str], out: Sequence[str], w: Sequence[str] | None = None) -> DataFrame:
    """out = (H + diag(w)) \\ v; without ``w``, H \\ v."""
    c = len(v)
    require_packed(h, c)
    full = _double(h)
    if w is not None:
        if len(w) != c:
            raise ValueError("one weight for each channel")
        full = [x + y for x, y in zip(full, _double(w))] + full[c:]
    return solve_columns(df, full, _double(v), out)


def sym_solve_(df: DataFrame, h: Sequence[str], v: Sequence[str], w: Sequence[str] | None = None) -> DataFrame:
    """(H + diag(w)) \\ v in place of v."""
    return sym_solve(df, h, v, v, w)


def sym_invert(df: DataFrame, h: Sequence[str], out: Sequence[str]) -> DataFrame:
    """out = the packed inverse of H."""
    c = next((c for c in range(1, len(h) + 1) if packed_size(c) == len(h)), 0)
    if not c or len(out) != len(h):
        raise ValueError("H and its inverse are packed matrices of one size")
    full = _double(h)
    if c <= 3:
        co, det = _cofactors(full, c)
        return df.withColumns({o: x / det for o, x in zip(out, co)})
    df = df.withColumns({f"_h{k}": x for k, x in enumerate(full)})
    df, names = _factored(df, [F.col(f"_h{k}") for k in range(len(h))], c)
    pairs = [(i, i) for i in range(c)] + [(i, j) for i in range(c) for j in range(i + 1, c)]
    for j in range(c):
        df = _solved(df, names, [F.lit(float(i == j)) for i in range(c)], [f"_inv{i}_{j}" for i in range(c)])
    df = df.withColumns({o: F.col(f"_inv{i}_{j}") for o, (i, j) in zip(out, pairs)})
    return df.drop(*[n for row in names for n in row], *[f"_h{k}" for k in range(len(h))], *[f"_inv{i}_{j}" for i in range(c) for j in range(c)])


def sym_invert_(df: DataFrame, h: Sequence[str]) -> DataFrame:
    """The packed inverse in place of H."""
    return sym_invert(df, h, h)
