"""Distances from points to a mesh of segments (2-D) or triangles (3-D).

The mesh goes to every task in blocks of bounded size; each block is one pass
over the points, which carry the best so far.  Faces lie in a tree of bounding
spheres, in the order of a space-filling curve; its levels are gone down for many
points at once, and only faces that can be nearest are measured.  Nothing is
shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Faces that a task gets at once; vertices and faces of a mesh, which the driver holds.
BLOCK_FACES = 200_000
MAX_VERTICES, MAX_FACES = 5_000_000, 10_000_000
_PAIRS = 2_000_000
#: Children of a tree's node, and nodes of its top level at most.
_CHILDREN, _TOP = 16, 64


@dataclass(frozen=True)
class Mesh:
    """Corner positions (faces, corners, dimensions), vertex numbers, and pseudonormals of faces, corners and edges."""

    corners: np.ndarray
    ids: np.ndarray
    faces: np.ndarray
    vertex_normals: np.ndarray
    edge_normals: np.ndarray

    @functools.cached_property
    def tree(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Centres and radii of the spheres of each level, from the top down to the faces in the order ``sorted_faces``."""
        centre = self.corners.mean(1)
        radius = np.sqrt(((self.corners - centre[:, None]) ** 2).sum(2).max(1))
        levels = [(centre[self.sorted_faces], radius[self.sorted_faces])]
        while len(levels[-1][0]) > _TOP:
            c, r = levels[-1]
            first = np.arange(0, len(c), _CHILDREN)
            sizes = np.diff(np.append(first, len(c)))
            middle = np.add.reduceat(c, first, axis=0) / sizes[:, None]
            far = np.sqrt(((c - np.repeat(middle, sizes, axis=0)) ** 2).sum(1)) + r
            levels.append((middle, np.maximum.reduceat(far, first)))
        return levels[::-1]

    @functools.cached_property
    def sorted_faces(self) -> np.ndarray:
        """The faces by the interleaved bits of their centres."""
        centre = self.corners.mean(1)
        low, high = centre.min(0), centre.max(0)
        cells = ((centre - low) / np.maximum(high - low, 1e-300) * 1023).astype(np.int64)
        code = np.zeros(len(centre), np.int64)
        for bit in range(10):
            for d in range(centre.shape[1]):
                code |= (cells[:, d] >> bit & 1) << (bit * centre.shape[1] + d)
        return np.argsort(code, kind="stable")

    def part(self, at: slice) -> Mesh:
        return Mesh(self.corners[at], self.ids[at], self.faces[at], self.vertex_normals[at], self.edge_normals[at])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def build(vertices: np.ndarray, faces: np.ndarray) -> Mesh:
    """Face normals; vertex normals, in 3-D by angles; edge normals, the sums of the faces' beside them."""
    corners, dims = vertices[faces], vertices.shape[1]
    if dims == 2:
        edge = corners[:, 1] - corners[:, 0]
        normal = _unit(np.stack([-edge[:, 1], edge[:, 0]], 1))
        shares = np.ones((len(faces), 2))
        edge_normals = np.zeros((len(faces), 0, 2))
    else:
        normal = _unit(np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]))
        shares = np.stack([np.arccos(np.clip((_unit(corners[:, (i + 1) % 3] - corners[:, i]) * _unit(corners[:, (i + 2) % 3] - corners[:, i])).sum(1), -1, 1)) for i in range(3)], 1)
        pairs = np.sort(np.stack([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [0, 2]]], 1), axis=2)
        _, which = np.unique(pairs.reshape(-1, 2), axis=0, return_inverse=True)
        total = np.zeros((which.max() + 1, 3))
        np.add.at(total, which.ravel(), np.repeat(normal, 3, axis=0))
        edge_normals = _unit(total)[which.reshape(-1, 3)]
    at_vertex = np.zeros_like(vertices)
    for i in range(faces.shape[1]):
        np.add.at(at_vertex, faces[:, i], normal * shares[:, i : i + 1])
    return Mesh(corners, faces, normal, _unit(at_vertex)[faces], edge_normals)


def nearest_on(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place on each face to each point (pairs), and its part of the face: 0 the inside, then corners, then (3-D) edges 01, 12, 02."""
    if c.shape[1] == 2:
        a, e = c[:, 0], c[:, 1] - c[:, 0]
        s = ((x - a) * e).sum(1) / np.maximum((e * e).sum(1), 1e-300)
        part = np.where(s <= 0, 1, np.where(s >= 1, 2, 0))
        return a + np.clip(s, 0, 1)[:, None] * e, part
    a, ab, ac = c[:, 0], c[:, 1] - c[:, 0], c[:, 2] - c[:, 0]
    dot = lambda p, q: (p * q).sum(1)
    ap, bp, cp = x - a, x - c[:, 1], x - c[:, 2]
    d1, d2, d3, d4, d5, d6 = dot(ab, ap), dot(ac, ap), dot(ab, bp), dot(ac, bp), dot(ab, cp), dot(ac, cp)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    safe = lambda n, d: n / np.where(d == 0, 1, d)
    options = [
        (1, (d1 <= 0) & (d2 <= 0), 0 * d1, 0 * d1),
        (2, (d3 >= 0) & (d4 <= d3), 0 * d1 + 1, 0 * d1),
        (4, (vc <= 0) & (d1 >= 0) & (d3 <= 0), safe(d1, d1 - d3), 0 * d1),
        (3, (d6 >= 0) & (d5 <= d6), 0 * d1, 0 * d1 + 1),
        (6, (vb <= 0) & (d2 >= 0) & (d6 <= 0), 0 * d1, safe(d2, d2 - d6)),
        (5, (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), 1 - safe(d4 - d3, (d4 - d3) + (d5 - d6)), safe(d4 - d3, (d4 - d3) + (d5 - d6))),
    ]
    whole = va + vb + vc
    v, w, part = safe(vb, whole), safe(vc, whole), np.zeros(len(x), np.int64)
    open_ = np.ones(len(x), bool)
    for code, holds, sv, sw in options:
        take = open_ & holds
        v, w, part = np.where(take, sv, v), np.where(take, sw, w), np.where(take, code, part)
        open_ &= ~holds
    return a + v[:, None] * ab + w[:, None] * ac, part


def _candidates(x: np.ndarray, mesh: Mesh) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points and faces that can be nearest to them, by point, then face: down the tree, each level for all points."""
    limit = np.full(len(x), np.inf)
    p, node = (i.ravel() for i in np.indices((len(x), len(mesh.tree[0][0]))))
    for depth, (centre, radius) in enumerate(mesh.tree):
        far = np.sqrt(((x[p] - centre[node]) ** 2).sum(1))
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        limit = np.minimum(limit, np.minimum.reduceat(far + radius[node], first))  # every point has a node left
        near = far - radius[node] <= limit[p] * (1 + 1e-9) + 1e-9
        p, node = p[near], node[near]
        if depth + 1 < len(mesh.tree):
            begin = node * _CHILDREN
            sizes = np.minimum(_CHILDREN, len(mesh.tree[depth + 1][0]) - begin)
            ends = np.cumsum(sizes)
            p, node = np.repeat(p, sizes), np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])
    f = mesh.sorted_faces[node]
    order = np.lexsort((f, p))
    return p[order], f[order]


def nearest_faces(x: np.ndarray, mesh: Mesh, naive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each point: squared distance, nearest place, its part of the face, the face; the first face of equals."""
    best, place, part, face = np.full(len(x), np.inf), np.zeros_like(x), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    rows = max(1, _PAIRS // max(1, len(mesh.corners) if naive else 4 * _TOP * _CHILDREN))
    for s in range(0, len(x), rows):
        some = x[s : s + rows]
        p, f = (i.ravel() for i in np.indices((len(some), len(mesh.corners)))) if naive else _candidates(some, mesh)
        near, which = nearest_on(some[p], mesh.corners[f])
        d = ((some[p] - near) ** 2).sum(1)
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(p))))
        hit = np.flatnonzero(d == least)
        hit = hit[np.unique(p[hit], return_index=True)[1]]
        at = s + p[hit]
        best[at], place[at], part[at], face[at] = d[hit], near[hit], which[hit], f[hit]
    return best, place, part, face


def dt_mesh(points: DataFrame, vertices: DataFrame, faces: DataFrame, loc: Sequence[str], signed: bool = False, naive: bool = False, vertex_id: str = "vid", position: Sequence[str] = ("px", "py", "pz"), corners: Sequence[str] = ("v0", "v1", "v2"), face_id: str | None = None) -> DataFrame:
    """Points with ``dist`` (not squared; negative inside if ``signed``) and ``nearest_vertex``: of the nearest face the vertex nearest to the place found.

    Faces are taken in order of ``face_id`` (else of their corners); of equally
    near ones the first counts.
    """
    dims = len(loc)
    if dims not in (2, 3) or len(position) != dims or len(corners) != dims:
        raise ValueError("meshes have 2 dimensions and segments, or 3 and triangles")
    if (n := vertices.count()) > MAX_VERTICES:
        raise ValueError(f"{n} vertices are more than {MAX_VERTICES}")
    if (n := faces.count()) > MAX_FACES:
        raise ValueError(f"{n} faces are more than {MAX_FACES}")
    v = vertices.select(vertex_id, *[F.col(c).cast("double").alias(c) for c in position]).orderBy(vertex_id).toPandas()
    f = faces.orderBy(face_id or list(corners)).select(*corners).toPandas().to_numpy(np.int64)
    names = v[vertex_id].to_numpy(np.int64)
    mesh = build(v[list(position)].to_numpy(float), np.searchsorted(names, f))
    out = points.select(*[c for c in points.columns if c not in ("dist", "nearest_vertex", "_d2", "_sign")])
    keep = out.columns
    state = [("_d2", T.DoubleType()), ("_sign", T.DoubleType()), ("nearest_vertex", T.LongType())]
    out = out.withColumns({"_d2": F.lit(float("inf")), "_sign": F.lit(1.0), "nearest_vertex": F.lit(None).cast("long")})
    schema = T.StructType([*out.select(*keep).schema.fields, *[T.StructField(c, t) for c, t in state]])
    for a in range(0, len(f), BLOCK_FACES):
        shared = points.sparkSession.sparkContext.broadcast((mesh.part(slice(a, a + BLOCK_FACES)), names))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            part_mesh, labels = shared.value
            for frame in frames:
                x = frame[list(loc)].to_numpy(float)
                d2, place, part, face = nearest_faces(x, part_mesh, naive)
                own = part_mesh.corners[face]
                vertex = ((own - place[:, None]) ** 2).sum(2).argmin(1)
                normals = np.concatenate([part_mesh.faces[face][:, None], part_mesh.vertex_normals[face], part_mesh.edge_normals[face]], 1)
                inside = ((x - place) * normals[np.arange(len(x)), part]).sum(1) < 0
                better = d2 < frame["_d2"].to_numpy(float)
                frame["nearest_vertex"] = pd.array(np.where(better, labels[part_mesh.ids[face, vertex]], frame["nearest_vertex"].fillna(-1)), "Int64")
                frame["_sign"] = np.where(better, np.where(inside, -1.0, 1.0), frame["_sign"])
                frame["_d2"] = np.where(better, d2, frame["_d2"])
                yield frame

        out = out.mapInPandas(run, schema)
    sign = F.col("_sign") if signed else F.lit(1.0)
    return out.select(*keep, (sign * F.sqrt("_d2")).alias("dist"), "nearest_vertex")
