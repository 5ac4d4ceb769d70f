"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave.operators.scratch import Scratch

# white space that separates words everywhere in this subpackage
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    scratch: Scratch,
) -> DataFrame:
    """Exclusive running sums of value columns inside a group, under an order.

    ``values`` maps a result column to the column it sums.  Rows are dealt out by
    ranges of (group, order), so a group that holds a third of all rows lies in many
    ranges; sums run inside each range and are shifted by what the group has in
    earlier ranges.  A range can continue one group only, so there are at most as
    many shifts as ranges: that bounds what is broadcast.  Nulls come first.  Rows
    that tie in ``order`` stay in one range, so give a total order.
    """
    ranged = scratch.keep(
        df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    sizes = ranged.groupBy("_range", *group).agg(
        *[F.sum(v).alias(out) for out, v in values.items()]
    )
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col("_range").alias("_r"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.row_number().over(W.partitionBy(*group).orderBy("_range")).alias("_nth"),
        *[F.sum(out).over(earlier).alias(f"_s_{out}") for out in values],
    ).filter(F.col("_nth") > 1)
    local = (
        W.partitionBy("_range", *group)
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    summed = ranged.select("*", *[F.sum(v).over(local).alias(out) for out, v in values.items()])
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = summed.join(F.broadcast(shifts), same, "left")
    zero = F.lit(0)
    return joined.withColumns(
        {
            out: F.coalesce(F.col(out), zero) + F.coalesce(F.col(f"_s_{out}"), zero)
            for out in values
        }
    ).drop(
        "_range", "_r", "_nth",
        *[f"_g{i}" for i in range(len(group))],
        *[f"_s_{out}" for out in values],
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b).

    The component is its smallest node.  Alternating large-star and small-star steps
    (Kiveris et al., 2014) reach stars in logarithmically many rounds in practice;
    each step is a partial minimum per node and a join, so a node with very many
    neighbours is split by the join, never gathered.  The edges are stars, and done,
    when no node both has a smaller neighbour and is one, or has two smaller ones:
    one aggregation over nodes.  Loops and nulls are ignored.
    """
    pair = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("a <> b")
    stars = scratch.keep(pair.distinct(), "edges")
    while True:
        ends = stars.select(F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )).alias("e"))
        counted = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if counted.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # an edge may come twice here; the distinct edges below end that
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.filter("u <> v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        stars = scratch.keep(small.distinct(), "small-star")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, as a task reaches it, and the path on it."""
    return pafs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes) -> None:
    """Write a file so that it is there whole or not at all, also when a task is
    repeated or runs twice at the same time."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)
