"""A dense group just below the threshold that holds a few true pairs."""

import random

import numpy as np
from test_operators import brute_near

from jobweave.llm import neardup


def dense_rows(n, pairs, length=200, own=13, seed=5):
    """Variants of one template that replace places of their own; near pairs share
    most of them."""
    r = random.Random(seed)
    template = [f"w{k}" for k in range(length)]

    def variant(places, tag):
        out = list(template)
        for k in places:
            out[k] = f"{tag}x{k}"
        return out

    rows = [variant(r.sample(range(length), own), f"v{i}") for i in range(n)]
    for i in range(pairs):  # about 0.8 to one variant, less to all others
        x = list(rows[i])
        for k in r.sample(range(length), 6):
            x[k] = f"p{i}x{k}"
        rows.append(x)
    r.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def test_dense_group_below_the_threshold(spark, scratch):
    rows = dense_rows(400, 60)
    want = brute_near(rows, 2, 80)
    linked = sum(root != i for i, (_, root) in want.items())
    assert 10 < linked < 120  # few true pairs in a large group
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, scratch, shingle=2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_intersections_in_blocks():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(30)]
    got = neardup.common_counts(sets[:12], sets[12:], width=7)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[12:]] for x in sets[:12]]
    assert neardup.common_counts([], sets).shape == (0, 30)
