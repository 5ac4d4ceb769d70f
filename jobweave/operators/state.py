"""Idempotent upserts as mergeable aggregates, and identity resolution.

A history row is the fold of everything seen for its key: first-seen columns from
the earliest sighting, value columns from the latest, a counter that adds up.  The
fold is associative, so a run only appends its own (already folded) delta, and a
snapshot folds the deltas.  No run rewrites the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.keys import entity_key


@dataclass(frozen=True)
class Spec:
    """Columns of a history table."""

    keys: tuple[str, ...]
    first: tuple[str, ...]  # kept from the first sighting
    last: tuple[str, ...]  # taken from the latest sighting
    counter: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, *self.last, *self.first, *((self.counter,) if self.counter else ()))


def _fold(rows: DataFrame, spec: Spec) -> DataFrame:
    aggs = [
        F.min("_first_seq").alias("_first_seq"),
        F.max("_last_seq").alias("_last_seq"),
        F.sum("_n").alias("_n"),
    ]
    if spec.last:
        aggs.append(F.max_by(F.struct(*spec.last), "_last_seq").alias("_last"))
    if spec.first:
        aggs.append(F.min_by(F.struct(*spec.first), "_first_seq").alias("_first"))
    folded = rows.groupBy(*spec.keys).agg(*aggs)
    return folded.select(
        *spec.keys,
        *[F.col(f"_last.{c}") for c in spec.last],
        *[F.col(f"_first.{c}") for c in spec.first],
        "_n",
        "_first_seq",
        "_last_seq",
    )


def delta(
    rows: DataFrame, spec: Spec, run_seq: int, position: Column, sub: Column | None = None,
    *, sole: Column | None = None,
) -> DataFrame:
    """Fold the rows of one run; ``(position, sub)`` is their order inside the run.

    Where ``sole`` holds, no other row has the key: such rows are their own fold and
    are neither sorted nor moved.
    """
    seq = F.struct(
        F.lit(run_seq).cast("bigint").alias("run"),
        position.cast("bigint").alias("pos"),
        (F.lit(0) if sub is None else sub).cast("bigint").alias("sub"),
    )

    def marked(some: DataFrame) -> DataFrame:
        return some.select(
            *spec.keys, *spec.last, *spec.first,
            F.lit(1).cast("bigint").alias("_n"),
            seq.alias("_first_seq"),
            seq.alias("_last_seq"),
        )

    if sole is None:
        return _fold(marked(rows), spec)
    alone = F.coalesce(sole, F.lit(False))
    return marked(rows.filter(alone)).unionByName(_fold(marked(rows.filter(~alone)), spec))


def sole_rows(rows: DataFrame, id: str, keys: Sequence[str]) -> DataFrame:
    """``id`` of the rows that share neither it nor ``keys`` with another row; a key
    with a NULL counts as shared."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    one = rows.filter(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(id).alias(id))
    once = rows.groupBy(id).agg(F.count(F.lit(1)).alias("_n"))
    return one.filter("_n = 1").select(id).join(once.filter("_n = 1").select(id), id)


def merge_snapshot(prev: DataFrame | None, batch: DataFrame, spec: Spec) -> DataFrame:
    """State after ``batch``: both sides are deltas or earlier merges."""
    return batch if prev is None else _fold(prev.unionByName(batch), spec)


def visible(state: DataFrame, spec: Spec) -> DataFrame:
    """The table as users see it."""
    counter = [F.col("_n").alias(spec.counter)] if spec.counter else []
    return state.select(*spec.keys, *spec.last, *spec.first, *counter)


# --- identities -------------------------------------------------------------


def resolve_job_keys(postings: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``(ordinal, job_key, is_new)`` for postings with an ``identities`` column.

    The strongest identity that is already stored gives the key; without a hit the
    key is derived from the posting's strongest identity.  Rows of one batch have
    passed the de-duplication on the same identities, so they cannot see each
    other and a join is exact.
    """
    own = postings.select(
        "ordinal", entity_key("job", F.get("identities", F.lit(0))).alias("own_key")
    )
    if stored is None:
        return own.select("ordinal", F.col("own_key").alias("job_key"), F.lit(True).alias("is_new"))
    hits = (
        postings.select("ordinal", F.explode("identities").alias("i"))
        .select("ordinal", "i.*")
        .join(stored.select("identity_type", "identity_value", "job_key"),
              ["identity_type", "identity_value"])
        .groupBy("ordinal")
        .agg(F.min_by("job_key", "priority").alias("stored_key"))
    )
    return own.join(hits, "ordinal", "left").select(
        "ordinal",
        F.coalesce("stored_key", "own_key").alias("job_key"),
        F.col("stored_key").isNull().alias("is_new"),
    )


def validation_status(normalized: DataFrame) -> DataFrame:
    """``(normalized_key, validation_status)``: a key is valid when any of its rows
    is; an aggregate instead of a semi-join, so hot keys stay cheap.

    ``normalized`` carries ``identities`` and ``valid``.
    """
    return (
        normalized.select(
            entity_key("normalized", F.get("identities", F.lit(0))).alias("normalized_key"),
            "valid",
        )
        .groupBy("normalized_key")
        .agg(
            F.when(F.bool_or("valid"), F.lit("valid"))
            .otherwise(F.lit("invalid"))
            .alias("validation_status")
        )
    )
