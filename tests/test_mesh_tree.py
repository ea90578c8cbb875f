"""The tree of spheres finds the same faces as all pairs, in few measurements."""

import numpy as np
import pytest

from fieldloom.operators import meshes


def ball(n, dims, rng):
    """A bumpy sphere of triangles over a grid of angles, or a bumpy circle of segments."""
    if dims == 2:
        a = np.linspace(0, 2 * np.pi, n, endpoint=False)
        v = np.stack([np.cos(a), np.sin(a)], 1) * (2 + 0.2 * np.sin(9 * a))[:, None]
        return v, np.stack([np.arange(n), (np.arange(n) + 1) % n], 1)
    k = int(np.sqrt(n / 2))
    a, b = np.meshgrid(np.linspace(0, 2 * np.pi, k, endpoint=False), np.linspace(0.1, np.pi - 0.1, k), indexing="ij")
    r = 2 + 0.2 * np.sin(5 * a) * np.sin(4 * b)
    v = np.stack([r * np.cos(a) * np.sin(b), r * np.sin(a) * np.sin(b), r * np.cos(b)], -1).reshape(-1, 3)
    at = lambda i, j: (i % k) * k + j
    f = [t for i in range(k) for j in range(k - 1) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))]
    return v, np.array(f)


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("n", [3, 40, 3000])
def test_tree_equals_all_pairs(dims, n):
    rng = np.random.default_rng(n)
    v, f = ball(max(n, 8), dims, rng)
    mesh = meshes.build(v, f)
    x = np.concatenate([rng.uniform(-4, 4, (150, dims)), v[:20], np.zeros((1, dims))])
    for a, b in zip(meshes.nearest_faces(x, mesh), meshes.nearest_faces(x, mesh, naive=True)):
        assert np.allclose(a, b)


def test_few_faces_are_measured():
    rng = np.random.default_rng(1)
    mesh = meshes.build(*ball(60_000, 3, rng))
    x = rng.uniform(-3, 3, (500, 3))
    p, f = meshes._candidates(x, mesh)
    assert len(mesh.corners) > 50_000 and len(p) < 500 * 400
