"""Near duplicates by one-permutation MinHash, optimal densification, banded buckets
and star-shaped candidate edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import components
from jobweave.operators.scratch import Scratch

BANDS, ROWS = 40, 5  # a pair at similarity 0.8 misses all bands once in 8 million
CENTRES = 4  # of a bucket, and of a member over all its buckets, in a later round
ROUNDS = 2  # of new centres, before all pairs that are left are tested
BLOCK, BLOCK_ITEMS = 512, 1 << 20  # members and shingles on one side of a task of pairs
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles.

    Words are separated by ASCII white space, A-Z are lower-cased; a text of fewer
    words is one shingle, one without words has none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(acc)


class OnePermutation:
    """One hash per shingle deals it to a bin and ranks it there.  An empty bin takes
    the value of a full one found by a walk of hashes of (bin, attempt), the same walk
    for all sets; this is the densification of least variance (Shrivastava, 2017)."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, walk: int = 64) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        cell = np.arange(self.bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20)
        step = np.arange(1, walk + 1, dtype=np.uint64)[None, :]
        self.walks = (_mixed(cell + step) % np.uint64(self.bins)).astype(np.int64)
        self.salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        bins = np.full(self.bins, none)
        at = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(bins, at, _mixed(hashes))
        full = bins != none
        empty = np.flatnonzero(~full)
        for width in (16, self.walks.shape[1]):
            hit = full[self.walks[empty, :width]]
            step = hit.argmax(1)
            ok = hit[np.arange(len(empty)), step]
            bins[empty[ok]] = bins[self.walks[empty[ok], step[ok]]]
            empty = empty[~ok]
            if not len(empty):
                break
        for b in empty:  # very few full bins: the walk goes on
            attempt, donors = 0, np.zeros(0, np.int64)
            while not len(donors):
                attempt += 1
                steps = np.arange(64 * attempt + 1, 64 * attempt + 65, dtype=np.uint64)
                more = (_mixed(np.uint64(b << 20) + steps) % np.uint64(self.bins)).astype(np.int64)
                donors = more[full[more]]
            bins[b] = bins[donors[0]]
        return bins

    def bands_of(self, hashes: np.ndarray) -> np.ndarray:
        sig, out = self.signature(hashes).reshape(self.bands, self.rows), self.salt
        for r in range(self.rows):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
        return out.view(np.int64)


def sketches(docs: DataFrame, *, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, key, bands): size, 128-bit digest of the whole set, band hashes."""

    def run(batches):
        oph = OnePermutation(bands, rows)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                n, key, out = [], [], []
                for t in s.column(1).to_pylist():
                    x = shingle_set(t or "", shingle)
                    n.append(len(x))
                    key.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    out.append(oph.bands_of(x) if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(out, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "key", "bands"],
                )

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_.mapInArrow(run, "doc_id long, n long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame, *, shingle: int) -> DataFrame:
    """(node, items): the whole sets as sorted arrays."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                sets = [shingle_set(t or "", shingle).view(np.int64) for t in s.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "node long, items array<long>")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sets, exact: one sort of all items, then products
    of incidence matrices, ``width`` items that both sides have at a time."""
    out = np.zeros((len(a), len(b)), np.int64)
    if not a or not b:
        return out
    sets = [*a, *b]
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, row = items[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    code = np.cumsum(np.concatenate([[0], items[1:] != items[:-1]]))[: len(items)]
    left = row < len(a)
    both = (np.bincount(code, left) > 0) & (np.bincount(code, ~left) > 0)
    of_both = both[code]
    code, row = (np.cumsum(both) - 1)[code[of_both]], row[of_both]
    for at in range(0, int(both.sum()), width):
        lo, hi = np.searchsorted(code, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], code[lo:hi] - at] = 1
        out += (part[: len(a)] @ part[len(a) :].T).astype(np.int64)
    return out


def block_links(open_: DataFrame, sets: DataFrame, *, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) across components inside the buckets of ``open_``, from all pairs.

    ``open_`` has (bucket, m, part).  The component with most members of a bucket is
    not compared with itself: its blocks meet the blocks of the others, and those meet
    each other.  Each pair of blocks is a task that returns one link a member and
    component at most, never its pairs.  Members are dealt by hash to as many blocks
    as keep ``block`` members and BLOCK_ITEMS shingles each, in the mean.
    """

    def blocks(members: Column, items: Column) -> Column:
        return F.ceil(F.greatest(members / block, items / BLOCK_ITEMS)).cast("int")

    sizes = open_.groupBy("bucket", "part").agg(
        F.count(F.lit(1)).alias("c"), F.sum("m.n").alias("i")
    ).groupBy("bucket").agg(
        F.max(F.struct("c", "part", "i")).alias("most"), F.sum("c").alias("all"), F.sum("i").alias("items")
    ).select(
        "bucket", F.col("most.part").alias("home"),
        blocks(F.col("most.c"), F.col("most.i")).alias("nh"),
        blocks(F.col("all") - F.col("most.c"), F.col("items") - F.col("most.i")).alias("nr"),
    )
    at_home = F.col("part") == F.col("home")
    own = F.pmod(F.xxhash64("m.node"), F.when(at_home, F.col("nh")).otherwise(F.col("nr"))).cast("int")
    others = F.when(at_home, F.sequence(F.lit(0), F.col("nr") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("nr") + F.col("nh") - 1)
    )
    tasks = open_.join(sizes, "bucket").withColumn(
        "at", F.when(at_home, F.col("nr") + own).otherwise(own)
    ).select("bucket", "m", "part", "at", F.explode(others).alias("o")).select(
        "bucket", F.least("at", "o").alias("p"), F.greatest("at", "o").alias("q"), "at",
        F.col("m.node").alias("node"), "part",
    ).join(sets, "node")

    def compare(key, t):
        p, q = key[1].as_py(), key[2].as_py()
        side, node, part = (t.column(c).to_numpy() for c in ("at", "node", "part"))
        items = [x.values.to_numpy() for x in t.column("items").combine_chunks()]
        n = np.array([len(x) for x in items], np.int64)
        a = np.flatnonzero(side == p)
        b = a if p == q else np.flatnonzero(side == q)
        small, large = np.minimum.outer(n[a], n[b]), np.maximum.outer(n[a], n[b])
        may = (part[a][:, None] != part[b][None, :]) & (100 * small >= percent * large)
        rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        a, b, may = a[rows], b[cols], may[np.ix_(rows, cols)]
        both = common_counts([items[i] for i in a], [items[j] for j in b])
        i, j = np.nonzero(may & (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)))
        x, y = node[a[i]], node[b[j]]
        # one link of a member to each component says all
        _, one = np.unique(np.stack([x, part[b[j]]]), axis=1, return_index=True)
        return pa.table({"a": x[one], "b": y[one]})

    return tasks.groupBy("bucket", "p", "q").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, scratch: Scratch, *, shingle: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Documents whose shingle sets have 100 * intersection >= percent * union are
    linked; the component is the smallest doc_id that links lead to, and the document
    of that id is kept.

    1. Equal sets are one node, named by their smallest doc_id, so thousands of
       copies cost one signature each and no pair.
    2. Nodes that share a band hash share a bucket.  Each member gets one candidate
       edge, to the bucket's centre: a bucket of m nodes gives m - 1 edges.
    3. Candidates are confirmed on the whole sets.
    4. A star can miss a link between two members neither of which is the centre.  So
       buckets whose members lie in several components get CENTRES new centres, drawn
       by hashes, in ROUNDS rounds; a member gets edges to at most CENTRES of all those
       it meets in other components, so a round has as many edges as nodes, times that.
    5. Of buckets that still span components all pairs across components are tested
       in tasks of pairs of blocks; buckets of the same members are one bucket, and a
       bucket of two is done by its star.  So every pair that shares a bucket is
       tested or lies in one component.

    Rows without words have set size 0, link with nothing and are kept.  Rows with a
    null doc_id also link with nothing: component null, kept.  Rows that share a
    doc_id count as one document that has the links of each.  Other columns are not
    read; an empty table gives no rows.
    """
    base = scratch.keep(sketches(docs, shingle=shingle, bands=bands, rows=rows), "sketches")
    full = base.filter("n > 0 AND doc_id IS NOT NULL")
    groups = scratch.keep(full.groupBy("key").agg(F.min("doc_id").alias("node")), "equal-sets")
    g = groups.select(F.col("key").alias("k"), "node")
    first = full.join(g, (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("node")))
    first = first.dropDuplicates(["key"])
    in_bucket = scratch.keep(
        first.select(F.explode("bands").alias("bucket"), F.struct("node", "n").alias("m")), "bands"
    )
    shared = in_bucket.groupBy("bucket").agg(F.min("m").alias("c"), F.max("m").alias("d"))
    shared = shared.filter("c.node <> d.node").select("bucket", "c")
    members = scratch.keep(in_bucket.join(shared, "bucket"), "buckets")
    nodes = members.select("m.node").distinct()
    sets = scratch.keep(
        shingle_sets(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
                nodes, F.col("doc_id") == F.col("node"), "left_semi"
            ),
            shingle=shingle,
        ),
        "sets",
    )

    def near(c: Column, m: Column) -> Column:
        """The sizes alone allow the similarity."""
        small, large = F.least(c["n"], m["n"]), F.greatest(c["n"], m["n"])
        return (100 * small >= percent * large) & (c["node"] != m["node"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        b = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y")).cast("long")
        union = F.size("x") + F.size("y") - both
        return (
            pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * union)
            .select("a", "b").distinct()
        )

    def paired(open_: DataFrame, turn: int) -> DataFrame:
        """Members and CENTRES centres in other components whose sizes allow a link."""
        other = F.filter(
            "centres", lambda c: (c["part"] != F.col("part")) & near(c["m"], F.col("m"))
        )
        # a node lies in at most ``bands`` buckets: that bounds its array of centres
        met = open_.select("m", other.alias("centres")).filter(F.size("centres") > 0)
        met = met.groupBy("m").agg(
            F.array_distinct(F.flatten(F.collect_list("centres"))).alias("centres")
        )
        drawn = F.array_sort(F.transform("centres", lambda c: F.struct(
            F.xxhash64(F.lit(turn), "m.node", c["m"]["node"]).alias("draw"), c["m"].alias("m")
        )))
        again = met.select("m", F.explode(F.slice(drawn, 1, CENTRES)).alias("centre"))
        again = again.select("m", F.col("centre.m").alias("c"))
        return again.select(
            F.least("c.node", "m.node").alias("a"), F.greatest("c.node", "m.node").alias("b")
        ).distinct()

    # a document that has several sets by a repeated id is one node
    own = groups.join(full.select(F.col("key"), "doc_id"), "key").filter("doc_id <> node")
    links = own.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).join(
        groups.select(F.col("node").alias("b")).distinct(), "b", "left_semi"
    )
    links = scratch.keep(links.select("a", "b").distinct(), "links")
    tested = scratch.keep(
        members.filter(near(F.col("c"), F.col("m"))).select(F.col("c.node").alias("a"), F.col("m.node").alias("b")).distinct(),
        "candidates",
    )
    found = scratch.keep(confirmed(tested), "links")
    label = components(links.unionByName(found), scratch)
    # a bucket of two is done: its star is its only pair
    left = members.select("bucket", "m", F.col("m.node").alias("node"))
    sized = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 2")
    left = left.join(sized.select("bucket"), "bucket", "left_semi")

    def opened(turn: int) -> DataFrame:
        """The buckets that span components, with the centres of the round."""
        marked = left.join(label, "node", "left")
        marked = marked.select("bucket", "m", "node", F.coalesce("component", "node").alias("part"))
        who = F.struct("m", "part")
        # first by the node alone: buckets that share members then share centres, and
        # a large group is joined by few distinct edges; later by the bucket as well
        seed = ("m.node",) if turn == 1 else ("m.node", "bucket")
        several = marked.groupBy("bucket").agg(
            F.min("part").alias("lo"), F.max("part").alias("hi"),
            F.array_distinct(F.array(*[
                F.min_by(who, F.xxhash64(F.lit(CENTRES * turn + i), *seed)) for i in range(CENTRES)
            ])).alias("centres"),
            # two sums of hashes and the number tell the members
            F.struct(
                F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")) for i in (1, 2)]
            ).alias("who"),
        ).filter("lo <> hi")
        several = several.groupBy("who").agg(F.min_by(F.struct("bucket", "centres"), "bucket").alias("b"))
        # a bucket inside one component is done: components only grow
        return scratch.keep(marked.join(several.select("b.*"), "bucket"), "open-buckets")

    for turn in range(1, ROUNDS + 1):
        open_ = opened(turn)
        left = open_.select("bucket", "m", "node")
        pairs = scratch.keep(paired(open_, turn).join(tested, ["a", "b"], "left_anti"), "candidates")
        found = scratch.keep(confirmed(pairs), "links")
        # the labels stand for all earlier links
        links = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
        label = components(links, scratch)
        tested = tested.unionByName(pairs)
    open_ = opened(ROUNDS + 1).select("bucket", "m", "part")
    found = scratch.keep(block_links(open_, sets, percent=percent), "links")
    if not found.isEmpty():
        links = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
        label = components(links, scratch)
    lab = label.select(F.col("node").alias("l"), "component")
    part = groups.join(lab, F.col("node") == F.col("l"), "left").select(
        F.col("key").alias("k"), F.coalesce("component", "node").alias("component")
    )
    out = full.select("doc_id", "n", "key").join(part, F.col("key") == F.col("k"))
    rest = base.filter("n = 0 OR doc_id IS NULL").select(
        "doc_id", "n", F.col("doc_id").alias("component")
    )
    out = out.select("doc_id", "n", "component").unionByName(rest)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"),
    )
