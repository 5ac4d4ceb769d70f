"""Quality metrics over labelled postings and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _subset(expected: str, predicted: str) -> Column:
    return F.size(F.array_except(expected, predicted)) == 0


def _share(hit: Column) -> Column:
    """Share of rows with ``hit``; 0.0 for an empty set."""
    return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))


def label_accuracy(labelled: DataFrame) -> DataFrame:
    """One row: how often the expected tags are among the inferred ones.

    ``labelled`` carries the inferred tags and ``expected_role_tags`` /
    ``expected_concentration_tags``.
    """
    return labelled.agg(
        F.count(F.lit(1)).alias("record_count"),
        _share(_subset("expected_role_tags", "role_tags")).alias("role_accuracy"),
        _share(_subset("expected_concentration_tags", "concentration_tags")).alias(
            "concentration_accuracy"
        ),
    )


def relevance_at_k(profiles: DataFrame, ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: share of profiles with an expected posting among their matches.

    ``profiles(profile_no, label_set)``, ``ranked(profile_no, ordinal)`` holds the
    top k, ``expected(label_set, ordinal)`` the wanted postings; profiles may share
    a label set, so that nobody's list has to be repeated.
    """
    found = (
        ranked.join(profiles.select("profile_no", "label_set"), "profile_no")
        .join(expected, ["label_set", "ordinal"], "left_semi")
        .select("profile_no")
        .distinct()
        .withColumn("found", F.lit(True))
    )
    return (
        profiles.select("profile_no")
        .join(found, "profile_no", "left")
        .agg(
            F.count(F.lit(1)).alias("profile_count"),
            _share(F.coalesce("found", F.lit(False))).alias("ranking_relevance"),
        )
    )
