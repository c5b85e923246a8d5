import os

import numpy as np
import pytest

from proseline.llm import op8_embeddings as op

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.98):
    ok = [(i, l, np.array(v, np.float64)) for i, v, l in rows if l is not None and v and None not in v and np.all(np.isfinite(v)) and np.any(v)]
    out = {i: [0, i] for i, _, _ in rows}
    parent = {i: i for i in out}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (i, l, v) in enumerate(ok):
        for j, m, w in ok[:a]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                out[i][0] += 1
                out[j][0] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (n, root(i)) for i, (n, _) in out.items()}


@pytest.mark.parametrize("cell,block,most", [(2000, 2000, 4096), (9, 5, 4096), (4, 5, 6)])
def test_as_all_pairs(spark, monkeypatch, cell, block, most):
    monkeypatch.setattr(op, "CELL", cell)
    monkeypatch.setattr(op, "MOST_PIVOTS", most)
    monkeypatch.setattr(op, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [1.0, None] * 4, 1), (5, [float("nan")] * 8, 1), (6, [1.0] * 8, None), (7, [1.0] * 8, 1), (8, [2.0] * 8, 1), (9, [1.0] * 7, 1), (10, [float("inf")] * 8, 1)]
    for c in range(12):
        centre = rng.normal(size=8)
        rows += [(100 + c * 10 + k, (centre + rng.normal(size=8) * 0.13).astype(np.float32).tolist(), c % 2) for k in range(8)]
    rows += [(500 + k, rows[20][1], rows[20][2]) for k in range(12)]
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, part string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_vectors(df).collect()}
    assert got == brute([(i, v, l) for i, v, l in rows])
    assert op.near_vectors(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (None, None, 1), (4, [2.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, op.near_vectors(odd).collect()), key=str) == sorted([(None, 0, None, True)] * 2 + [(3, 1, 3, True), (4, 1, 3, False)], key=str)


def test_cells_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(op, "CELL", 10)
    monkeypatch.setattr(op, "MOST_PIVOTS", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    classes = spark.createDataFrame([("1:16", i, 1, v.tobytes()) for i, v in enumerate(x)], "part string, id long, n long, unit binary")
    rows = op.all_cells(classes, 0.1).collect()
    assert sorted(r.id for r in rows if r.home) == list(range(400))
    cells = {}
    for r in rows:
        cells.setdefault((r.part, r.cell), []).append(r.home)
    assert len(cells) > 16 and max(map(sum, cells.values())) < 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.op8_embeddings(spark, SF).collect()}
    assert got == brute(rows)
