"""Nearest vectors against products with all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import hilbert_search as hs
from tallywise.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, tag string, v string, query_id string"


def brute(rows, k, asked=lambda i: i % 20 == 0):
    """(query, rank, id, score) of distinct rows by products with all others."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    x = np.array([v for _, v in rows]) if rows else np.empty((0, 1))
    out = []
    for at, (i, _) in enumerate(rows):
        if asked(i):
            score = np.einsum("j,ij->i", x[at], x)
            order = sorted((-s, rows[j][0], j) for j, s in enumerate(score) if j != at)[:k]
            out += [(i, place + 1, o[1], -o[0]) for place, o in enumerate(order)]
    return out


def search(df, k=20, **options):
    found = hs.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in found.collect())


def close(got, want):
    return len(got) == len(want) and all(
        a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-12, abs=1e-12) for a, b in zip(got, sorted(want))
    )


def share(got, want):
    pairs = {(q, i) for q, _, i, _ in want}
    return len(pairs & {(q, i) for q, _, i, _ in got}) / len(pairs)


def test_hilbert_curve_goes_from_cell_to_neighbouring_cell():
    for directions, bits in ((1, 5), (2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * directions), axis=-1).reshape(-1, directions)
        place = hs.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(side**directions))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_one_block_gives_the_exact_neighbours(spark):
    """Vectors of many lengths, copies, and rows that take no part."""
    chance = np.random.default_rng(1)
    rows = [(i, (chance.normal(size=7) * 10 ** chance.uniform(-3, 3)).tolist()) for i in range(300)]
    rows += [(i + 300, rows[40][1]) for i in range(60)] + [(400, rows[40][1]), (400, rows[41][1])]
    rows += [(1000, None), (1020, [0.0] * 7), (1040, [1.0, None] + [2.0] * 5), (1060, [float("nan")] * 7), (1080, [float("inf")] * 7)]
    rows += [(1100, []), (1120, [1.0, 2.0]), (None, rows[3][1])] + rows[:45]
    df = spark.createDataFrame([(*r, "t", "v", "q") for r in rows], SCHEMA).repartition(4)
    usual = [r for r in rows if r[1] is None or len(r[1]) == 7]
    assert close(search(df), brute(usual, 20))
    assert close(search(df, 500), brute(usual, 500))
    assert search(df.where("false")) == [] and search(df.where("vec_id = 20")) == []
    assert search(df.where("vec_id % 20 <> 0")) == []


def test_windows_find_near_rows_and_hot_copies(spark, monkeypatch):
    """Many blocks: a third of the rows is one vector, the others lie in few directions."""
    monkeypatch.setattr(hs, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hs, "AT_ONCE", 60)
    monkeypatch.setattr(hs, "SIDE", (7, 30))
    monkeypatch.setattr(hs, "PAIRS", 50)
    chance = np.random.default_rng(2)
    points = chance.normal(size=(1600, 3)) @ chance.normal(size=(3, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    points += chance.normal(size=points.shape) * 0.01
    points[::3] = points[0]
    rows = list(enumerate(points.tolist()))
    df = spark.createDataFrame([(*r, "t", "v", "q") for r in rows], SCHEMA).repartition(6)
    got, want = search(df), brute(rows, 20)
    assert share(got, want) >= 0.9
    assert [r for r in got if r[0] % 3 == 0] == [r for r in sorted((q, p, i, pytest.approx(s)) for q, p, i, s in want) if r[0] % 3 == 0]
    assert all(b[3] == pytest.approx(float(np.dot(points[b[0]], points[b[2]]))) for b in got)


def test_query_reaches_the_recall(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_nearest_vectors"](spark, DATA).collect())
    assert close(got, brute(rows, 20))


def test_windows_reach_the_recall_on_vectors_without_structure(spark, monkeypatch):
    monkeypatch.setattr(hs, "BLOCK_ROWS", 128)
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 20)
    assert share(search(table), want) >= 0.9
