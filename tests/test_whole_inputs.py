"""entry() and r09_conjugate_gradients over all cells and all kernel columns, against plain versions."""

import os

import numpy as np
import pytest

from __spark_entry__ import entry
from lodestrata.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype="float64")


def test_entry_meets_all_cells(spark, vectors):
    ids, e = vectors
    x, y, z = e[:, 0] * 1000, e[:, 1] * 1000, e[:, 2] * 100
    want = np.zeros(len(ids))
    for cell in range(256):
        density = cell % 7 * 0.1 + 0.1
        for a in (-50.0, 50.0):
            for b in (-50.0, 50.0):
                for c in (-50.0, 50.0):
                    dx, dy, dz = cell % 8 * 100.0 - 350.0 + a - x, cell // 8 % 8 * 100.0 - 350.0 + b - y, cell // 64 * 100.0 - 350.0 + c - z
                    r = np.sqrt(dx * dx + dy * dy + dz * dz)
                    want += np.sign(a * b * c) * density * 6.6743e-3 * (dx * np.log(dy + r) + dy * np.log(dx + r) - dz * np.arctan(dx * dy / (dz * r)))
    got = {r.id: r.gz for r in entry(spark).collect()}
    assert sorted(got) == sorted(ids) and np.allclose([got[i] for i in ids], want, rtol=0, atol=2e-6)


def test_conjugate_gradients_have_all_columns(spark, vectors):
    _, g = vectors
    residual = g.T @ g[:, 2]
    model, search = np.zeros(g.shape[1]), residual
    for _ in range(8):
        moved = g.T @ (g @ search) + 0.1 * search
        alpha = residual @ residual / (search @ moved)
        model, after = model + alpha * search, residual - alpha * moved
        residual, search = after, after + after @ after / (residual @ residual) * search
    got = {r.cell_id: r.value for r in QUERIES["r09_conjugate_gradients"](spark, DATA).collect()}
    assert sorted(got) == list(range(g.shape[1])) and np.allclose([got[k] for k in sorted(got)], model, rtol=0, atol=2e-6)
