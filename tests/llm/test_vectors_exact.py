"""No link is lost where the data have no clusters, at two sizes."""

import numpy as np
import pytest

from jobweave.llm import vectors


@pytest.mark.parametrize("n", [500, 3000])
def test_links_just_above_the_threshold(spark, scratch, n):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, n // 2, 2):  # pairs at 0.90 to 0.92
        away = r.normal(size=32)
        away -= away @ x[i] * x[i]
        cos = r.uniform(0.901, 0.92)
        x[i + 1] = cos * x[i] + np.sqrt(1 - cos**2) * away / np.linalg.norm(away)
    want = ((x @ x.T >= 0.9) & ~np.eye(n, dtype=bool)).sum(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {g.vec_id: g for g in vectors.near_vectors(df, scratch, block=256).collect()}
    assert [got[i].n_links for i in range(n)] == want.tolist() and want.sum() >= n // 2
    assert all(got[i + 1].component_id == got[i].component_id for i in range(0, n // 2, 2))
