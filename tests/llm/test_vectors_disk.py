"""Vectors move once and lie on disk once; all pairs are still compared."""

import os

import numpy as np
import pytest
from pyspark.sql import types as T

from jobweave.llm import vectors

FLOATS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def block_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return set(env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) - {""}


def size(paths):
    return sum(os.path.getsize(p) for p in paths if os.path.exists(p))


def expected(ids, x):
    """(links, component) by row: equal ids are not compared here, so give distinct ones."""
    x = x.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = ids.copy()
    while True:
        low = np.where(near, label[None, :], label.max()).min(1)
        if (low == label).all():
            return near.sum(1) - 1, label
        label = low


def test_disk_does_not_grow_with_the_blocks(spark, scratch):
    n = 3000
    x = np.random.default_rng(1).normal(size=(n, 64)).astype(np.float32)
    x[1::10] = x[::10] + np.float32(0.1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], FLOATS)
    before = block_files(spark)
    got = sorted(vectors.near_vectors(df, scratch, block=32).collect())
    left = [os.path.join(d, f) for d, _, names in os.walk(scratch.root) for f in names]
    used = size(block_files(spark) - before) + size(left)
    links, component = expected(np.arange(n), x)
    assert [(g.n_links, g.component_id) for g in got] == [*zip(links.tolist(), component.tolist(), strict=True)]
    assert used < 4 * x.nbytes, used


@pytest.mark.parametrize("dims", [5, 64])
def test_dense_groups_in_many_files(spark, scratch, monkeypatch, dims):
    monkeypatch.setattr(vectors, "BUFFER", 100 * dims)
    r = np.random.default_rng(dims)
    x = r.normal(size=(2000, dims)).astype(np.float32)
    x[200:1200] = x[0] + r.normal(size=(1000, dims)) * 0.25 * np.linalg.norm(x[0]) / np.sqrt(dims)
    x[1500:1560] = x[1]
    ids = r.permutation(2000) * 7 - 3000
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], FLOATS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {g.vec_id: g for g in vectors.near_vectors(df, scratch, block=256).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    links, component = expected(ids, x)
    assert [got[i].n_links for i in ids.tolist()] == links.tolist() and links.max() > 300
    assert [got[i].component_id for i in ids.tolist()] == component.tolist()


def test_stretches_take_every_row_once_by_cell():
    r = np.random.default_rng(2)
    for _ in range(50):
        files, cells = r.integers(1, 9, size=2)
        counts = r.integers(0, 9, size=(files, cells)) * r.integers(0, 2, size=cells)
        counts[0, r.integers(cells)] += 1
        size = int(r.integers(1, 20))
        at = vectors._stretches(counts, size)
        n = counts.sum()
        assert (at[0] == 0).all() and (at[-1] == counts.sum(1)).all() and (np.diff(at, axis=0) >= 0).all()
        assert np.diff(at, axis=0).sum(1).tolist() == [min(size, n - i) for i in range(0, n, size)]
        rows = [np.repeat(np.arange(counts.shape[1]), c) for c in counts]
        taken = [np.concatenate([f[a:b] for f, a, b in zip(rows, lo, hi, strict=True)]) for lo, hi in zip(at, at[1:], strict=False)]
        assert all(a.max() <= b.min() for a, b in zip(taken, taken[1:], strict=False))


def test_weights_of_a_dense_tile_are_exact():
    w = np.array([3, 2**40 + 1, 2**53 + 1, 1])
    links = vectors._Links(w)
    rows, cols = np.array([0, 1]), np.array([2, 3])
    links.add_dense(rows, cols, np.array([[True, False], [True, True]]))
    assert links.sums.tolist() == [w[2], w[2] + w[3], w[0] + w[1], w[1]] and len(set(links.parent)) == 1
