"""Exact first-seen de-duplication over several keys.

A row is kept unless it shares a key with an *earlier kept* row.  A dropped row
blocks nobody, so this is neither a chain of ``dropDuplicates`` nor connected
components: the kept rows are the lexicographically first maximal independent
set of the graph "shares a key".  No row can influence another component's rows, so
the sequential rule runs inside each component, all components side by side.
Only a component too large for one task is first broken up by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from jobweave.functions.keys import dedup_signature, dedup_source_key
from jobweave.functions.urls import canonical_url
from jobweave.operators.components import component_labels
from jobweave.operators.scratch import Rolling, Scratch
from jobweave.operators.skew import lookup_join

# Rows of a component that one task goes through; a larger component, or a key with
# more rows, takes a round of joins first.  Results do not depend on it.
COMPONENT_ROWS = 100_000

KEYS = ("key_url", "key_source_id", "key_content")


def with_dedup_keys(postings: DataFrame, folded: Column | None = None) -> DataFrame:
    """Add the three duplicate signals (NULL where there is none)."""
    return postings.withColumns(
        {
            "key_url": canonical_url(F.col("url")),
            "key_source_id": dedup_source_key(),
            "key_content": dedup_signature(folded),
        }
    )


def kept_ordinals(
    keyed: DataFrame,
    scratch: Scratch,
    keys: Sequence[str] = KEYS,
    *,
    hot_floor: int | None = None,
    component_rows: int = COMPONENT_ROWS,
) -> DataFrame:
    """``ordinal`` of every row the sequential first-seen rule would keep.

    Rows whose keys nobody else has are kept at once.  The others fall into components;
    a chain of n rows is labelled in at most about log n rounds and decided in one task,
    so no number of jobs or tables follows the length of chains.  A round of joins decides
    every row that is first on all its keys, and its rivals, which breaks up what hot
    keys hold together.
    """
    # Rows equal on all keys share the fate of their first one.
    first = keyed.groupBy(*keys).agg(F.min("ordinal").alias("ordinal"))
    opened, counted = Rolling(scratch, "dedup-open"), Rolling(scratch, "dedup-stats")
    open_keys = opened.keep(_long(first, keys))
    kept_parts: list[DataFrame] = []
    giant = False
    while True:
        seen = Observation()
        n = F.col("n")
        stats = counted.keep(
            open_keys.groupBy("key")
            .agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
            .observe(
                seen, F.sum(n).alias("total"), F.max(n).alias("largest"),
                F.sum(F.when(n > 1, n)).alias("shared"),
            )
        )
        size = seen.get
        if not size["total"]:
            break
        if giant or size["largest"] > component_rows:
            kept, rest = _round(open_keys, stats, size["total"], scratch, hot_floor)
            kept_parts.append(kept)
            open_keys, giant = opened.keep(rest), False
            continue
        # no key has more rows than a task can hold: plain joins on it are fine
        met = open_keys.join(stats.filter("n > 1").select("key"), "key")
        shared = scratch.keep(met.select(F.col("ordinal").alias("node"), "key"), "dedup-shared")
        lone = open_keys.select("ordinal").distinct().join(
            shared.select(F.col("node").alias("ordinal")), "ordinal", "left_anti"
        )
        if not size["shared"]:
            kept_parts.append(lone)
            break
        labelled = shared.join(component_labels(shared, scratch), "node")
        if size["shared"] <= component_rows:  # so no component is larger
            kept_parts += [lone, scratch.keep(_sequential(labelled), "dedup-kept")]
            break
        sizes = labelled.groupBy("label").agg(F.count_distinct("node").alias("rows"))
        large = scratch.keep(sizes.filter(F.col("rows") > component_rows).select("label"), "dedup-large")
        small = labelled.join(F.broadcast(large), "label", "left_anti")  # few: each has many rows
        kept_parts.append(scratch.keep(_sequential(small), "dedup-kept"))
        if large.isEmpty():
            kept_parts.append(lone)
            break
        # the open rows are replaced now, so what was read from them is written
        kept_parts.append(scratch.keep(lone, "dedup-kept"))
        rest = labelled.join(F.broadcast(large), "label", "left_semi")
        open_keys = opened.keep(rest.select(F.col("node").alias("ordinal"), "key"))
        giant = True
    # rows without any key never meet another row
    keyless = keyed.filter(F.coalesce(*[F.col(k) for k in keys]).isNull())
    kept = keyless.select("ordinal")
    for part in kept_parts:
        kept = kept.unionByName(part)
    return kept


def _long(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (ordinal, non-NULL key); the key is a 32-byte digest."""
    digests = [
        F.when(
            F.col(k).isNotNull(),
            F.unhex(F.sha2(F.concat(F.lit(f"{i}:"), F.col(k)), 256)),
        )
        for i, k in enumerate(keys)
    ]
    return rows.select(
        "ordinal", F.explode(F.array_compact(F.array(*digests))).alias("key")
    )


def _round(
    open_keys: DataFrame, stats: DataFrame, total: int, scratch: Scratch, hot_floor: int | None
) -> tuple[DataFrame, DataFrame]:
    """Decide every open row that is first on all of its keys, and its rivals: the
    kept rows, and the rows that stay open."""
    skew = dict(counts=stats, total_rows=total, floor=hot_floor)
    kept = scratch.keep(
        lookup_join(open_keys, stats.select("key", "first"), "key", **skew)
        .groupBy("ordinal")
        .agg(F.bool_and(F.col("ordinal") == F.col("first")).alias("wins"))
        .filter("wins")
        .select("ordinal"),
        "dedup-kept",
    )
    # keys whose first row has just been kept (stats has one row per key: no skew)
    claimed = stats.join(
        kept.withColumnRenamed("ordinal", "first"), "first", "left_semi"
    ).select("key")
    decided = (
        lookup_join(open_keys, claimed, "key", **skew).select("ordinal").distinct()
    )
    return kept, open_keys.join(decided, "ordinal", "left_anti")


def _sequential(labelled: DataFrame) -> DataFrame:
    """The first-seen rule inside every component of (label, node, key)."""

    def decide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        mine: dict[int, set[bytes]] = {}
        for node, key in zip(rows.column("node").to_pylist(), rows.column("key").to_pylist()):
            mine.setdefault(node, set()).add(key)
        seen: set[bytes] = set()
        kept = []
        for node, keys in mine.items():
            if seen.isdisjoint(keys):
                seen |= keys
                kept.append(node)
        return pa.table({"ordinal": pa.array(kept, pa.int64())})

    return labelled.groupBy("label").applyInArrow(decide, "ordinal bigint")


def deduplicate(postings: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The kept rows of ``postings`` (normalised, with a unique ``ordinal``)."""
    keyed = scratch.keep(
        with_dedup_keys(postings).select("ordinal", *KEYS), "dedup-rows"
    )
    kept = kept_ordinals(keyed, scratch, **options)
    return postings.join(kept, "ordinal", "left_semi")


def attribute_duplicates(
    keyed: DataFrame,
    kept: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    hot_floor: int | None = None,
) -> DataFrame:
    """For every dropped row the kept row it duplicates and the matching key.

    Keys are looked at in the order of ``keys``.  No two kept rows share a key,
    so the lookup side is unique.
    """
    tagged = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("priority"),
                    F.lit(k.removeprefix("key_")).alias("matched_on"),
                    F.col(k).alias("value"),
                )
                for i, k in enumerate(keys)
            ]
        ),
        lambda s: s["value"].isNotNull(),
    )
    long = keyed.select("ordinal", F.explode(tagged).alias("k")).select(
        "ordinal",
        "k.priority",
        "k.matched_on",
        F.sha2(F.concat_ws(":", "k.matched_on", "k.value"), 256).alias("key"),
    )
    owners = long.join(kept, "ordinal", "left_semi").select(
        "key", F.col("ordinal").alias("kept_ordinal")
    )
    dropped = long.join(kept, "ordinal", "left_anti")
    counts = dropped.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = keyed.count() * len(keys)
    return (
        lookup_join(dropped, owners, "key", counts=counts, total_rows=total,
                    floor=hot_floor)
        .filter("kept_ordinal < ordinal")
        .groupBy("ordinal")
        .agg(F.min(F.struct("priority", "matched_on", "kept_ordinal")).alias("m"))
        .select("ordinal", "m.kept_ordinal", "m.matched_on")
    )
