"""Nearest neighbours: exactness where all is probed, recall elsewhere, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from tilewright.llm import catalog, neighbours
from tilewright.llm.neighbours import nearest, nearest_axes, rotated

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id BIGINT, vector STRING, bucket INT, copy INT, query INT"


def table_of(spark, rows):
    """Vectors with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, 0, 1, "v", 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, picked, k=10):
    """{query: [(vec_id, distance)]} over sound rows."""
    sound = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: (r[0], str(r[1]))):
        if all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound.setdefault(i, np.asarray(v, np.float32).astype(float))
    out = {}
    for q, own in sound.items():
        if picked(q):
            near = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in sound.items() if i != q and len(v) == len(own))
            out[q] = [(i, s) for s, i in near[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items() if near}
    for q, near in got.items():
        assert np.allclose([s for _, s in near], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_rotation_keeps_angles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 37))
    y = rotated(x, 2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert y.shape == (20, 64) and np.allclose(y @ y.T, unit @ unit.T)
    axes = nearest_axes(y, 200)
    assert axes.shape == (20, 128) and (np.sort(axes, axis=1) == np.arange(128)).all()
    signed = np.concatenate([y, -y], axis=1)
    assert (np.diff(np.take_along_axis(signed, axes, axis=1), axis=1) <= 0).all()


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, 0.5]) for i in range(60)]
    rows += [(100, [0.0, 0.0, 0.0]), (200, None), (300, [nan, 1.0, 1.0]), (400, [1.0, inf, 0.0]), (500, []), (600, [None, 1.0, 1.0])]
    rows += [(700, [1.0, 2.0]), (701, [2.0, 1.0]), (800, [5.0]), (None, [1.0, 1.0, 1.0]), (20, rows[20][1]), (20, rows[20][1])]
    rows += [(900, [1e-30, 1e-30, 0.0]), (901, [3e30, 0.0, 1e30])]
    same(result(nearest(table_of(spark, rows), "id % 10 = 0")), brute(rows, lambda i: i % 10 == 0))


@pytest.mark.parametrize("n", [0, 1, 2, 11])
def test_small_tables(spark, n):
    rng = np.random.default_rng(n)
    rows = [(100 * i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(n)]
    same(result(nearest(table_of(spark, rows), "id % 100 = 0")), brute(rows, lambda i: True))


def test_hot_vector_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 16)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 3)
    rng = np.random.default_rng(8)
    hot = rng.normal(size=16)
    rows = [(i, (hot if i % 3 == 0 else hot + 1e-3 * rng.normal(size=16) if i % 3 == 1 else rng.normal(size=16)).astype(np.float32).tolist()) for i in range(400)]
    # All 32 axes are probed, so the result is exact.
    same(result(nearest(table_of(spark, rows), "id % 5 = 0", tables=1, probes=32)), brute(rows, lambda i: i % 5 == 0))


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_recall_on_the_given_table(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    got = result(catalog.op11_neighbours(spark, sf))
    rows = [(r["vec_id"], r["embedding"]) for r in catalog.table(spark, sf, "embeddings").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    exact = {q: dict(near) for q, near in want.items()}
    assert got.keys() == want.keys() and all(len(near) == 10 for near in got.values())
    hits = sum(i in exact[q] for q, near in got.items() for i, _ in near)
    assert hits / sum(map(len, want.values())) >= 0.9
    vectors = {i: np.asarray(v, float) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        assert np.allclose([s for _, s in near], [np.linalg.norm(vectors[i] - vectors[q]) for i, _ in near], rtol=0, atol=1e-12)
