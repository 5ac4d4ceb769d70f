"""Which sources may run, and the union of several of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.schemas import POSTING_SCHEMA, require_columns
from jobweave.vocab import SOURCE_REGISTRY

# A source adapter: reads a path, returns POSTING_SCHEMA columns.
Source = Callable[[SparkSession, str], DataFrame]

# Files of one source stay below this position.
SOURCE_SHIFT = 58
MAX_SOURCES = 32  # the bits left above the shift, without the sign


class SourceNotAllowed(RuntimeError):
    """A source that is unknown or lacks approval."""


def registry(spark: SparkSession, rows: Sequence[tuple] = SOURCE_REGISTRY) -> DataFrame:
    return spark.createDataFrame(
        list(rows), "name string, status string, source_type string, priority int"
    )


def ensure_allowed(name: str, rows: Sequence[tuple] = SOURCE_REGISTRY) -> None:
    status = {r[0]: r[1] for r in rows}.get(name)
    if status is None:
        raise SourceNotAllowed(f"Source '{name}' is not registered")
    if status != "approved":
        raise SourceNotAllowed(f"Source '{name}' is {status} and cannot run")


def source_decisions(sources: DataFrame, registered: DataFrame) -> DataFrame:
    """Distinct sources with their status and whether they may run.

    ``sources`` has a ``source`` column; ``registered`` one row per known name.
    """
    return sources.join(
        registered.select(F.col("name").alias("source"), "status"), "source", "left"
    ).select(
        "source",
        F.coalesce("status", F.lit("unregistered")).alias("status"),
        F.coalesce(F.col("status") == "approved", F.lit(False)).alias("allowed"),
    )


def allowed_only(postings: DataFrame, registered: DataFrame) -> DataFrame:
    """Postings of approved sources (the registry is a small dimension)."""
    ok = registered.filter(F.col("status") == "approved").select(F.col("name").alias("source"))
    return postings.join(ok, "source", "left_semi")


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Sources one after the other; ``ordinal`` keeps (source, input order)."""
    if len(parts) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources can be numbered")
    out = None
    for i, part in enumerate(parts):
        shifted = require_columns(part, POSTING_SCHEMA, f"source {i}").select(
            *[
                (F.when(F.col("ordinal") < F.lit(1 << SOURCE_SHIFT), F.col("ordinal")).otherwise(
                    F.raise_error(F.lit("ordinal too large to number sources")).cast("bigint")
                ) + F.lit(i << SOURCE_SHIFT)).alias("ordinal")
                if c == "ordinal"
                else F.col(c)
                for c in POSTING_SCHEMA.fieldNames()
            ]
        )
        out = shifted if out is None else out.unionByName(shifted)
    if out is None:
        raise ValueError("no source given")
    return out
