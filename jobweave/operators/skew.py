"""Joins and numbering that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave.operators.scratch import Scratch

# A key is hot above max(HOT_FLOOR, rows / HOT_SHARE) rows, so there can never be
# more than HOT_SHARE hot keys: that is the proven bound of what is broadcast.
HOT_FLOOR = 1_000_000
HOT_SHARE = 1000


def hot_limit(total_rows: int, floor: int | None = None) -> int:
    return max(HOT_FLOOR if floor is None else floor, total_rows // HOT_SHARE)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy per-row work at least one task per core.

    Only inputs with fewer partitions than cores (one small file) are moved; a
    large scan is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    *,
    counts: DataFrame,
    total_rows: int,
    floor: int | None = None,
) -> DataFrame:
    """``rows`` inner join ``lookup`` (unique on ``key``), safe for hot keys.

    ``counts(key, n)`` holds the rows per key.  Rows of hot keys are joined with a
    broadcast slice of the lookup and never shuffled; the rest is an ordinary
    shuffled join.
    """
    limit = hot_limit(total_rows, floor)
    if total_rows <= limit:
        return rows.join(lookup, key)
    hot = F.broadcast(counts.filter(F.col("n") > limit).select(key))
    hot_lookup = F.broadcast(lookup.join(hot, key, "left_semi"))
    return rows.join(hot_lookup, key).unionByName(
        rows.join(hot, key, "left_anti").join(lookup, key)
    )


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    name: str,
    scratch: Scratch,
    group: Sequence[str] = (),
) -> DataFrame:
    """1-based position of every row inside its group under a total order.

    ``row_number`` over the group would sort a whole group in one task.  Here the
    rows are range-partitioned on (group, order), numbered inside each range, and
    shifted by the sizes of the group's earlier ranges.
    """
    group = list(group)
    keys = [F.col(g) for g in group] + list(order)
    ranged = scratch.keep(
        df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    local = F.row_number().over(W.partitionBy("_range", *group).orderBy(*order))
    sizes = ranged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_size"))
    # one row per (range, group): at most ranges + groups rows
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("_range")
    shifts = sizes.select(
        "_range",
        *group,
        F.coalesce(
            F.sum("_size").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_shift"),
    )
    return (
        ranged.withColumn("_local", local)
        .join(shifts, ["_range", *group])
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .drop("_range", "_local", "_shift")
    )
