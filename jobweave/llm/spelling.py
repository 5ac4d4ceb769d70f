"""Spelling variants by a dictionary of trie-node pairs.

Numbers are given to the nodes of a trie of all words (a node is a prefix) and of a
trie of all reversed words (a node is a suffix).  A pair (prefix node, suffix node)
that leaves out one position of a word stands for the word without that letter; a
pair that leaves out none, taken at a border, for a place where a letter could be
inserted.  Words that share a pair differ by exactly one letter there:

- both leave out a position: one letter is replaced;
- one leaves out a position and the other none: one letter is deleted or inserted.

So exact neighbours come from equality of two integers; no strings are cut or compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave.operators.scratch import Scratch

FACTOR = 5  # a form is at least so many times as frequent as its variant


def count_words(docs: DataFrame, words: Column, least: int) -> DataFrame:
    """(word, n) of the words (an array column) that occur at least ``least`` times."""
    each = docs.select(F.explode(words).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the trie nodes of sorted words from 1, within one range; ``path`` has the
    nodes of all prefixes but the empty one, ``first`` tells where a letter differs
    from the one before it."""
    last, path, nodes, row = "", [], 0, 0
    for b in batches:
        out = []
        for word in b.column(1).to_pylist():
            same, end = 0, min(len(last), len(word))
            while same < end and last[same] == word[same]:
                same += 1
            new = len(word) - same
            path = path[:same] + list(range(nodes + 1, nodes + new + 1))
            nodes, row, last = nodes + new, row + 1, word
            first = [not i or c != word[i - 1] for i, c in enumerate(word)]
            out.append((row, nodes, path, first))
        no, top, paths, firsts = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(no, pa.int64()), pa.array(top, pa.int64()),
             pa.array(paths, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.bool_()))],
            names=["word", "text", "range", "no", "top", "path", "first"],
        )


def trie_nodes(words: DataFrame, text: Column, scratch: Scratch) -> DataFrame:
    """(word, no, path, first): ``no`` is the word's position in the order of ``text``,
    ``path`` the numbers of the trie nodes on its way, beginning with the root, 0.

    The sorted words are dealt out by ranges and numbered in each.  A range can share
    with earlier ones only nodes on the way to its first word; these take the numbers
    of the earlier ranges' last words.  That is settled from one row per range, which
    is what comes to the driver.
    """
    spark = words.sparkSession
    dealt = words.select("word", text.alias("text")).repartitionByRange("text")
    dealt = dealt.sortWithinPartitions("text").withColumn("range", F.spark_partition_id())
    numbered = scratch.keep(
        dealt.mapInArrow(
            _paths,
            "word string, text string, range int, no long, top long, path array<long>, first array<boolean>",
        ),
        "trie",
    )
    ranges = numbered.groupBy("range").agg(
        F.max("no").alias("rows"), F.max("top").alias("nodes"),
        F.min("text").alias("begin"), F.max("text").alias("end"),
        F.max_by("path", "no").alias("path"),
    ).orderBy("range").collect()
    shifts, rows, nodes, end, path = [], 0, 0, "", []
    for r in ranges:
        same = 0
        while same < min(len(end), len(r["begin"])) and end[same] == r["begin"][same]:
            same += 1
        shared = path[:same]
        shifts.append((r["range"], rows, nodes, shared))
        # the first word's nodes are 1, 2, ... in its range
        path = [shared[k - 1] if k <= same else nodes + k for k in r["path"]]
        rows, nodes, end = rows + r["rows"], nodes + r["nodes"], r["end"]
    shift = spark.createDataFrame(shifts, "range int, rows long, nodes long, shared array<long>")
    whole = F.transform(
        "path",
        lambda k: F.when(k <= F.size("shared"), F.get("shared", (k - 1).cast("int"))).otherwise(k + F.col("nodes")),
    )
    return numbered.join(F.broadcast(shift), "range").select(
        "word", (F.col("no") + F.col("rows")).alias("no"),
        F.concat(F.array(F.lit(0).cast("long")), whole).alias("path"), "first",
    )


def variants(counts: DataFrame, scratch: Scratch, *, factor: int = FACTOR) -> DataFrame:
    """One row per word of ``counts`` (word, n): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point.  The
    form is the near word of largest n (ties: the smallest in code-point order) if its
    n is at least ``factor`` (more than 1) times the word's; else null, as is form_n.
    The root is where the forms lead; a word without a form is its own root.

    A pair of nodes is shared by words that differ in one letter at one place, so a
    group is never larger than the alphabet.  Inside a group only the best two are
    looked at, never all pairs, and each neighbour is counted once: a replaced letter
    has one place, and of a run of equal letters only the first is left out.

    Words are compared as they are.  Null words and the empty word are left out,
    repeated words are one with the sum of their n; other columns are not read; an
    empty table gives no rows.
    """
    spark = counts.sparkSession
    words = counts.filter("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = scratch.keep(words, "dictionary")
    ahead = trie_nodes(words, F.col("word"), scratch).withColumnRenamed("path", "p")
    back = trie_nodes(words, F.reverse("word"), scratch).select("word", F.col("path").alias("s"))
    full = scratch.keep(words.join(ahead, "word").join(back, "word"), "nodes")

    size = F.size("first")
    skips = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.get("p", i).alias("p"), F.get("s", size - 1 - i).alias("s"),
            F.lit(True).alias("skip"), F.get("first", i).alias("first"),
        ),
    )
    inserts = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(
            F.get("p", i).alias("p"), F.get("s", size - i).alias("s"),
            F.lit(False).alias("skip"), F.lit(False).alias("first"),
        ),
    )
    # larger is better: more frequent, then smaller in code-point order
    me = F.struct("n", (-F.col("no")).alias("order"))
    pairs = full.select("no", me.alias("me"), F.explode(F.concat(skips, inserts)).alias("e")).select(
        "no", "me", "e.*"
    )
    group = W.partitionBy("p", "s")
    order = group.orderBy(F.col("skip").desc(), F.col("me").desc())
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shared = pairs.select(
        "no", "me", "skip", "first",
        F.count_if("skip").over(whole).alias("skips"),
        F.count_if("first").over(whole).alias("firsts"),
        F.first("me").over(whole).alias("best"),
        F.nth_value("me", 2).over(whole).alias("second"),
        F.max(F.when(F.col("first"), F.col("me"))).over(whole).alias("best_first"),
        F.max(F.when(~F.col("skip"), F.col("me"))).over(whole).alias("short"),
    )
    replaced = F.when(F.col("best") != F.col("me"), F.col("best")).when(F.col("skips") > 1, F.col("second"))
    shorter = F.when(F.col("first"), F.col("short"))
    near = shared.select(
        "no",
        F.when(F.col("skip"), F.col("skips") - 1 + shorter.isNotNull().cast("long"))
        .otherwise(F.col("firsts")).alias("k"),
        F.when(F.col("skip"), F.greatest(replaced, shorter)).otherwise(F.col("best_first")).alias("best"),
    ).filter("k > 0")
    best = near.groupBy("no").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
    linked = scratch.keep(
        full.select("no", "word", "n").join(best, "no", "left").select(
            "no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("best.n") >= factor * F.col("n"), -F.col("best.order")).alias("to"),
        ),
        "linked",
    )
    # a form is more frequent than its variant, so ways end and halve each round
    ways = scratch.keep(linked.filter("to IS NOT NULL").select("no", "to"), "ways")
    while True:
        further = ways.select(F.col("no").alias("to"), F.col("to").alias("on"))
        if ways.join(further, "to", "left_semi").isEmpty():
            break
        ways = scratch.keep(
            ways.join(further, "to", "left").select("no", F.coalesce("on", "to").alias("to")), "ways"
        )
    forms = linked.select(F.col("no").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = linked.select(F.col("no").alias("end"), F.col("word").alias("root"))
    ends = ways.withColumnRenamed("to", "end").join(roots, "end").select("no", "root")
    return linked.join(forms, "to", "left").join(ends, "no", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
