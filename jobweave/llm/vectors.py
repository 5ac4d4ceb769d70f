"""Near-duplicate vectors: spherical k-means cells, exact bounds, blocked cosine products."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import components, opened, publish
from jobweave.operators.scratch import Scratch

SAMPLE_PER_CELL = 16  # vectors the cells are fitted on, per cell
SAMPLE_LEAST = 1024  # vectors the axes are fitted on, at least
BLOCK = 2048  # vectors on one side of a product
TILE = 256, 1024  # of a product that is held at once
BUFFER = 1 << 23  # numbers of the vectors a task holds to sort them by cell
LOADED = 1 << 21  # numbers of the vectors of one side of a task's comparison


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k unit centres for unit rows; a cell without rows keeps its centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(x[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def _matrix(column, dims: int) -> np.ndarray:
    """Rows padded with zeros to one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of norm 1 in double precision."""
    x = rows.astype(np.float64)
    with np.errstate(over="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def _can_link(ids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The length of each vector; whether it is finite, not zero and has an id."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
    at = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(at, ~np.isfinite(flat), len(sizes))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(np.bincount(at, flat * flat, len(sizes)))
    return sizes, (bad == 0) & (norm > 0) & ids.is_valid().to_numpy(zero_copy_only=False)


def hashed_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, k1, k2, v): vectors of floats stay floats, others become doubles."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding").cast("array<float>" if kind == "float" else "array<double>")
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.xxhash64(v).alias("k1"), F.xxhash64(F.reverse(v)).alias("k2"), v.alias("v"),
    )


def measured(hashed: DataFrame) -> DataFrame:
    """With the length of each vector as ``dims``: null if it can link with nothing."""

    def measure(batches):
        for b in batches:
            sizes, fine = _can_link(b.column(0), b.column(3))
            dims = pa.array(sizes.astype(np.int32), mask=~fine)
            yield pa.RecordBatch.from_arrays([*b.columns, dims], names=["vec_id", "k1", "k2", "v", "dims"])

    kind = hashed.schema["v"].dataType.simpleString()
    return hashed.mapInArrow(measure, f"vec_id long, k1 long, k2 long, v {kind}, dims int")


def _axes(x: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """An orthogonal matrix that turns the sample's widest axes to the front, and how
    many of them a first test should look at.  By Cauchy-Schwarz, x * y is at most the
    product on these and that of the norms of the rest.  Costs, roughly, in nanoseconds
    a pair: 1.4 and 0.02 an axis for a test, 0.7 for the row of a tile in which some
    pair passes, 300 for a pair that passes."""
    dims = x.shape[1]
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    y = x[:1024] @ turn
    far = y @ y.T < threshold
    cost = {}
    for m in sorted({dims, *range(8, dims, 4 * (1 + dims // 128))}):
        rest = np.linalg.norm(y[:, m:], axis=1)
        share = (far & (y[:, :m] @ y[:, :m].T + rest[:, None] * rest >= threshold)).mean()
        cost[m] = 1.4 + 0.02 * m + 0.7 * min(1, TILE[1] * share) + 300 * share
    return turn, min(cost, key=cost.get)


class _Side:
    """A stretch of vectors in order of their cells, ready for products.

    ``first`` has the coordinates of the first test, ``balls`` the centre and the
    widest angle of each block.
    """

    def __init__(self, rows: np.ndarray, turn: np.ndarray, first: int, block: int) -> None:
        rows = rows[np.argsort(rows["cell"], kind="stable")]
        self.node, self.w = rows["node"], rows["w"]
        self.unit = _units(rows["v"])
        turned = self.unit @ turn
        rest = np.linalg.norm(turned[:, first:], axis=1)
        self.first = np.column_stack([turned[:, :first], rest]).astype(np.float32)
        self.balls = []
        for i in range(0, len(rows), block):
            at = np.arange(i, min(i + block, len(rows)))
            mean = self.unit[at].sum(0)
            centre = mean / (np.linalg.norm(mean) or 1)
            self.balls.append((at, centre, _angle(self.unit[at] @ centre).max()))


class _Links:
    """Weights of the links of each place, and the trees of linked places."""

    def __init__(self, w: np.ndarray) -> None:
        self.w, self.sums = w, np.zeros(len(w), np.int64)
        self.parent = np.arange(len(w))
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_open = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of places, each once."""
        self.open.append((i, j))
        self.n_open += len(i)
        if self.n_open > 1 << 18:
            self.settle()

    def settle(self) -> None:
        if self.open:
            i, j = (np.concatenate(x) for x in zip(*self.open))
            self.open, self.n_open = [], 0
            np.add.at(self.sums, i, self.w[j])
            np.add.at(self.sums, j, self.w[i])
            self.union(i, j)

    def add_dense(self, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray) -> None:
        """The same for a tile of which many pairs are linked; no list of its pairs."""
        for at, other, h in ((rows, cols, hit), (cols, rows, hit.T)):
            for shift in (0, 24, 48):  # weights in parts whose sums are exact
                part = (self.w[other] >> shift) & 0xFFFFFF
                if part.any():
                    self.sums[at] += (h @ part.astype(np.float64)).astype(np.int64) << shift
            some = np.flatnonzero(h.any(1))
            self.union(at[some], other[h[some].argmax(1)])
        i, j = np.nonzero(hit & (self.parent[rows][:, None] != self.parent[cols][None, :]))
        self.union(rows[i], cols[j])

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins trees at their smaller root; every place points to its root."""
        while True:
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def _compare(a: _Side, b: _Side, threshold: float, reach: float, links: _Links) -> None:
    """Links of all pairs of ``a`` and ``b``, or inside ``a`` if they are the same."""
    same, shift = a is b, 0 if a is b else len(a.node)
    # rounding of a product of single precision, at most
    low = np.float32(threshold - (a.unit.shape[1] + 16) * 1.2e-7)
    room = np.empty(TILE[0] * TILE[1], np.float32)
    for p, (rows, centre, wide) in enumerate(a.balls):
        for q, (cols, other, wide2) in enumerate(b.balls):
            if same and q < p or _angle(centre @ other) > wide + wide2 + reach:
                continue
            x = rows[_angle(a.unit[rows] @ other) <= wide2 + reach]
            y = cols[_angle(b.unit[cols] @ centre) <= wide + reach]
            left, right = a.first[x], b.first[y]
            for r in range(0, len(x), TILE[0]):
                for c in range(0, len(y), TILE[1]):
                    if same and p == q and y[c : c + TILE[1]][-1] <= x[r]:
                        continue
                    i, j = x[r : r + TILE[0]], y[c : c + TILE[1]]
                    s = room[: len(i) * len(j)].reshape(len(i), len(j))
                    np.matmul(left[r : r + TILE[0]], right[c : c + TILE[1]].T, out=s)
                    may = np.flatnonzero(s.max(1) >= low)
                    if not len(may):
                        continue
                    hit = s[may] >= low
                    if np.count_nonzero(hit) * 64 > s.size:
                        hit = a.unit[i] @ b.unit[j].T >= threshold
                        if same and p == q:
                            hit &= i[:, None] < j[None, :]
                        if np.count_nonzero(hit) * 64 > s.size:
                            links.add_dense(i, j + shift, hit)
                            continue
                        u, v = np.nonzero(hit)
                        links.add(i[u], j[v] + shift)
                        continue
                    u, v = divmod(np.flatnonzero(hit), len(j))
                    u, v = i[may[u]], j[v]
                    if same and p == q:
                        u, v = u[u < v], v[u < v]
                    near = np.einsum("ij,ij->i", a.unit[u], b.unit[v]) >= threshold
                    links.add(u[near], v[near] + shift)
    links.settle()


def _stretches(counts: np.ndarray, size: int) -> np.ndarray:
    """Where each stretch of ``size`` rows begins in each file, and all ends last.

    counts: rows by file and cell; each file is sorted by cell.  Rows are numbered by
    cell, then by file, so a stretch is one range of every file.
    """
    in_cell, in_file = counts.sum(0), np.cumsum(counts, 1) - counts
    begins, earlier = np.cumsum(in_cell) - in_cell, np.cumsum(counts, 0) - counts
    n = int(in_cell.sum())
    starts = np.append(np.arange(0, n, size), n)
    cell = np.searchsorted(begins + in_cell, starts, side="right").clip(max=len(in_cell) - 1)
    inside = np.clip(starts - begins[cell] - earlier[:, cell], 0, counts[:, cell])
    return (in_file[:, cell] + inside).T


def near_vectors(
    vectors: DataFrame, scratch: Scratch, *, threshold: float = 0.9, block: int = BLOCK,
) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of ``vectors``.

    All pairs of vectors with cosine >= threshold, in double precision, are linked.
    Equal vectors are one node with a weight.  The cells are fitted by spherical
    k-means: sqrt(n) / 4 cells on a sample by hash, fitted on the driver.  Every node
    lives in its nearest cell and is written once, as it came, to a file sorted by
    cell.  Rows by cell are cut into stretches of up to eight blocks.  Two stretches
    are compared if the angle between the centres of some of their cells is at most the
    widest angles of both and that of the threshold; one task reads both from the
    files, so a cell with a third of all vectors is many tasks and no vector is sent
    for its comparisons.  Inside, blocks and then single vectors are left out by the
    same bound, and pairs by a bound on their first axes (see ``_axes``) in single
    precision with its rounding allowed for; what is left is tested in double
    precision.  The bounds on angles leave out pairs only if the data lie in clusters;
    without them the first test is made for all pairs.  A task returns counts per node
    and one edge per node to the smallest node it reaches inside the task, never its
    pairs.

    Null, zero, non-finite vectors and those without an id link with nothing: 0 links,
    component vec_id (null without one), kept.  Shorter vectors are padded with zeros.
    Rows that share a vec_id with different vectors are one node whose links add up.
    Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    hashed = hashed_vectors(vectors)
    rows = scratch.keep(measured(hashed).drop("v"), "hashes")
    valid = rows.filter("dims IS NOT NULL")
    groups = scratch.keep(
        valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("w")),
        "equal-vectors",
    )
    n = groups.count()
    if n:
        dims = valid.agg(F.max("dims")).first()[0]
        k = math.isqrt(n - 1) // 4 + 1
        share = max(SAMPLE_PER_CELL * k, SAMPLE_LEAST) / n
        sample = measured(hashed.filter(
            F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) < int(min(1, share) * (1 << 30))
        )).filter("dims IS NOT NULL").dropDuplicates(["k1", "k2"])
        x = _units(_matrix(sample.select("v").toArrow().column(0), dims))
        x = x if len(x) else np.eye(1, dims)
        turn, first = _axes(x, threshold)
        centres = spherical_kmeans(x, min(k, len(x)))
        # cells whose centres are near each other are neighbours
        coarse = spherical_kmeans(centres, math.isqrt(len(centres)))
        centres = centres[np.argsort((centres @ coarse.T).argmax(1), kind="stable")]
        reach = math.acos(threshold) if 0 < threshold <= 1 else math.pi
        reach += 1e-5  # more than the angles are rounded by
        kind = np.float32 if hashed.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
        row = np.dtype([("node", "<i8"), ("w", "<i8"), ("cell", "<i4"), ("v", kind, (dims,))])
        folder = f"{scratch.root}/vectors"
        cells = spark.sparkContext.broadcast(centres)

        def sorted_file(batches):
            c = cells.value
            out = np.concatenate(batches)
            near = np.empty(len(out))
            for i in range(0, len(out), 8192):
                u = _units(out["v"][i : i + 8192])
                home = (u.astype(np.float32) @ c.T.astype(np.float32)).argmax(1)
                out["cell"][i : i + 8192] = home
                near[i : i + 8192] = np.einsum("ij,ij->i", u, c[home])
            by = np.argsort(out["cell"], kind="stable")
            out, near = out[by], near[by]
            cell, begin, count = np.unique(out["cell"], return_index=True, return_counts=True)
            name = uuid.uuid4().hex
            publish(f"{folder}/{name}", out.tobytes())
            return pa.RecordBatch.from_pylist([{
                "name": name, "cells": cell.tolist(), "counts": count.tolist(),
                "wide": _angle(np.minimum.reduceat(near, begin)).tolist(),
            }], schema=pa.schema([
                ("name", pa.string()), ("cells", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
                ("wide", pa.list_(pa.float64())),
            ]))

        def place(batches):
            held, size = [], 0
            for b in batches:
                if not len(b):
                    continue
                out = np.empty(len(b), row)
                out["node"], out["w"] = b.column(0).to_numpy(), b.column(1).to_numpy()
                out["v"] = _matrix(b.column(2), dims)
                held.append(out)
                size += len(b) * dims
                if size >= BUFFER:
                    yield sorted_file(held)
                    held, size = [], 0
            if held:
                yield sorted_file(held)

        nodes = measured(hashed).filter("dims IS NOT NULL").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v")
        ).select("node", "w", "v")
        files = nodes.mapInArrow(
            place, "name string, cells array<int>, counts array<long>, wide array<double>"
        ).collect()
        counts, wide = np.zeros((len(files), len(centres)), np.int64), np.zeros(len(centres))
        for f, file in enumerate(files):
            counts[f, file.cells] = file.counts
            wide[file.cells] = np.maximum(wide[file.cells], file.wide)
        n = int(counts.sum())
        size = max(1, min(max(n // 16, block), 8 * block, max(LOADED // dims, 256)))
        at = _stretches(counts, size)
        lived = np.flatnonzero(counts.sum(0))
        ends = np.cumsum(counts.sum(0)[lived])  # of the cells that have rows
        starts = np.arange(0, n, size)
        lo = np.searchsorted(ends, starts, side="right")
        hi = np.searchsorted(ends, np.minimum(starts + size, n) - 1, side="right") + 1
        pairs = []
        for p in range(len(starts)):
            mine = lived[lo[p] : hi[p]]
            meet = _angle(centres[mine] @ centres[lived].T) <= wide[mine][:, None] + wide[lived] + reach
            sums = np.append(0, np.cumsum(meet.any(0)))
            q = np.arange(p, len(starts))
            q = q[sums[hi[q]] > sums[lo[q]]]
            pairs.append(np.column_stack([np.full(len(q), p), q]))
        pairs = np.concatenate(pairs)
        plan = spark.sparkContext.broadcast((pairs, at, [f.name for f in files], turn))

        def compare(batches):
            pairs, at, names, turn = plan.value
            fs, path = opened(folder)
            sides: dict[int, _Side] = {}

            def side(s: int) -> _Side:
                parts = []
                for f in np.flatnonzero(at[s + 1] > at[s]):
                    with fs.open_input_file(f"{path}/{names[f]}") as file:
                        begin, end = (int(x) * row.itemsize for x in at[s : s + 2, f])
                        parts.append(np.frombuffer(file.read_at(end - begin, begin), row))
                return _Side(np.concatenate(parts), turn, first, block)

            for b in batches:
                for i in b.column(0).to_pylist():
                    p, q = pairs[i].tolist()
                    sides = {s: sides[s] if s in sides else side(s) for s in {p, q}}
                    ends = [sides[p]] if p == q else [sides[p], sides[q]]
                    node = np.concatenate([e.node for e in ends])
                    links = _Links(np.concatenate([e.w for e in ends]))
                    _compare(sides[p], sides[q], threshold, reach, links)
                    hit = links.sums > 0
                    least = node.copy()
                    np.minimum.at(least, links.parent, node)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[hit]) for x in (node, links.sums, least[links.parent])],
                        names=["node", "links", "root"],
                    )

        tasks = min(len(pairs), max(64, min(len(pairs) // 4, 10_000)))  # most go on with a side they have
        part = scratch.keep(
            spark.range(0, len(pairs), 1, tasks).mapInArrow(compare, "node long, links long, root long"), "links"
        )
        scratch._delete(folder)  # nothing reads the vectors again
        label = components(part.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
        links = part.groupBy("node").agg(F.sum("links").alias("links"))
        groups = (
            groups.join(links, "node", "left").join(label, "node", "left")
            .select("k1", "k2", "node", "w", "links", "component")
        )
    else:
        groups = groups.select("*", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component"))
    g = groups.select(
        F.col("k1").alias("g1"), F.col("k2").alias("g2"),
        (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    linked = valid.select("vec_id", "k1", "k2").join(g, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")))
    linked = linked.select("vec_id", "n_links", "component_id")
    rest = rows.filter("dims IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(rest).select(
        "*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
