"""Blocked pair sums against numpy."""

import numpy as np
import pytest

from tidemark.operators import panel as P
from tidemark.operators.products import pair_sums


def cells(spark, runs):
    rows = [
        (run, i, j, None if np.isnan(v) else float(v))
        for run, (there, x) in runs.items() for i, line in enumerate(x) for j, v in enumerate(line) if there[i, j]
    ]
    return spark.createDataFrame(rows, "run_id string, row_idx int, region_id int, value double")


@pytest.mark.parametrize("rows, columns", [(256, 4096), (5, 4096), (4, 3), (1, 1)])
def test_sums_over_all_pairs(spark, rows, columns):
    rng = np.random.default_rng(rows)
    runs = {k: (rng.random((n, m)) < 0.8, np.where(rng.random((n, m)) < 0.9, rng.normal(size=(n, m)), np.nan)) for k, n, m in (("a", 17, 9), ("b", 6, 14), ("c", 1, 3))}
    got = pair_sums(cells(spark, runs), ["run_id"], "row_idx", "region_id", rows=rows, columns=columns).collect()
    want = {}
    for run, (there, x) in runs.items():
        for i in range(len(x)):
            for j in range(i, len(x)):
                both = there[i] & there[j]
                if both.any():
                    p, q = np.nan_to_num(x[i][both]), np.nan_to_num(x[j][both])
                    want[run, i, j] = (both.sum(), p.sum(), q.sum(), (p * p).sum(), (q * q).sum(), (p * q).sum())
    found = {(r.run_id, r.row_idx_a, r.row_idx_b): (r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy) for r in got}
    assert len(got) == len(found) and found.keys() == want.keys()
    assert all(np.allclose(found[k], want[k]) for k in want)


def test_correlation_and_cosine(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 5))
    x[3, 2] = np.nan
    frame = cells(spark, {"a": (np.ones_like(x, dtype=bool), x)})
    pearson = {(r.region_id_a, r.region_id_b): (r.correlation, r.n_pairs) for r in P.correlation_matrix(frame, "region_id").collect()}
    for (i, j), (c, n) in pearson.items():
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert n == ok.sum() and abs(c - np.corrcoef(x[ok, i], x[ok, j])[0, 1]) < 1e-9
    cosine = {(r.row_a, r.row_b): r.cosine for r in P.temporal_similarity(frame, "region_id").collect()}
    y = np.nan_to_num(x)
    assert len(pearson) == 15 and len(cosine) == 78
    assert all(abs(c - y[i] @ y[j] / np.linalg.norm(y[i]) / np.linalg.norm(y[j])) < 1e-9 for (i, j), c in cosine.items())
