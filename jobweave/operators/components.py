"""Connected components of rows that share keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobweave.operators.scratch import Rolling, Scratch

CHUNK_PAIRS = 1 << 20  # pairs a task merges before it passes on what it found


def component_labels(shared: DataFrame, scratch: Scratch, *, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """(node, label) of every node of ``shared`` (node, key), nodes of type long.

    Nodes that have a key in common are neighbours, and the label is the smallest
    node that can be reached.  First every task merges what meets in it, in chunks of
    bounded size; a node that is in pieces of several chunks makes these neighbours,
    and only such pieces go through rounds of labels.
    """
    by_key = shared.select("node", "key").repartition("key").sortWithinPartitions("key")
    pieces = scratch.keep(
        by_key.mapInArrow(lambda batches: _merged(batches, chunk_pairs), "node long, root long"), "pieces"
    )
    ends = pieces.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    torn = ends.filter("low < high").select("node")
    open_ends = scratch.keep(
        pieces.join(torn, "node").select(F.col("root").alias("node"), F.col("node").alias("key")), "torn"
    )
    if open_ends.isEmpty():
        return pieces.select("node", F.col("root").alias("label")).distinct()
    further = _spread_labels(open_ends, scratch).withColumnRenamed("node", "low")
    return ends.select("node", "low").join(further, "low", "left").select(
        "node", F.coalesce("label", "low").alias("label")
    )


def _merged(batches: Iterable[pa.RecordBatch], chunk_pairs: int) -> Iterator[pa.RecordBatch]:
    """Union-find over pairs sorted by key: the nodes of a chunk and the smallest nodes
    of their pieces.  A key that goes on in the next chunk takes a node along."""
    parent: dict[int, int] = {}
    pairs, last_key, member = 0, None, None

    def root(node: int) -> int:
        top = node
        while parent[top] != top:
            top = parent[top]
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(parent.keys(), pa.int64()), pa.array([root(n) for n in parent], pa.int64())],
            names=["node", "root"],
        )

    for b in batches:
        for node, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(node, node)
            if key == last_key:
                parent.setdefault(member, member)
                a, c = root(node), root(member)
                parent[max(a, c)] = min(a, c)
            last_key, member, pairs = key, node, pairs + 1
            if pairs >= chunk_pairs:
                yield found()
                parent.clear()
                pairs = 0
    if parent:
        yield found()


def _spread_labels(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels of (node, key) by rounds.

    In a round every key passes on the smallest label it has, a node's old label moves
    along with the node, and labels are replaced by their own labels; so ways halve
    and a chain of n pieces takes about log n rounds (Zhang, Azad and Buluc, 2020, with
    keys in the place of edges).  Minima are taken per task before anything moves.  One
    table is written a round and the one before is deleted.
    """
    states = Rolling(scratch, "labels")
    pairs = shared.select("node", "key")
    low = pairs.groupBy("key").agg(F.min("node").alias("label"))
    state = states.keep(pairs.join(low, "key").groupBy("node").agg(F.min("label").alias("label")))
    while True:
        known = pairs.join(state, "node")
        low = known.groupBy("key").agg(F.min("label").alias("new"))
        moved = known.join(low, "key").groupBy("node", "label").agg(F.min("new").alias("new"))
        ends = moved.select("node", "new", "label").unionByName(
            moved.select(F.col("label").alias("node"), "new", F.lit(None).cast("long").alias("label"))
        )
        stepped = ends.groupBy("node").agg(F.min("new").alias("new"), F.max("label").alias("old"))
        further = stepped.select(F.col("node").alias("new"), F.col("new").alias("label"))
        seen = Observation()
        state = states.keep(
            stepped.join(further, "new")
            .observe(seen, F.count_if(F.col("label") != F.col("old")).alias("changed"))
            .select("node", "label")
        )
        if not seen.get["changed"]:
            return state
