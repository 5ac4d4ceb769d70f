"""Program-level trend counts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.values import opt_label, week_bucket


def trend_counts(postings: DataFrame) -> DataFrame:
    """``(dimension, value, n)``: the total and eight independent counters.

    One scan: every posting is unfolded into its (dimension, value) entries, which
    are counted before the shuffle, so a value with most of the rows is harmless.
    """

    def one(dimension: str, value: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))

    def many(dimension: str, array: str) -> Column:
        values = F.coalesce(array, F.array().cast("array<string>"))
        return F.transform(values, lambda v: one(dimension, v))

    entries = F.concat(
        F.array(
            one("total_jobs", F.lit("all")),
            one("sources", F.col("source")),
            one("companies", F.col("company")),
            one("locations", F.col("location")),
            one("seniority", F.coalesce(F.nullif("seniority", F.lit("")), F.lit("Unknown"))),
            one("opt_cpt_signals", opt_label(F.col("opt_cpt_flag"))),
            one("posting_weeks", week_bucket(F.col("posted_date"))),
        ),
        many("roles", "role_tags"),
        many("concentrations", "concentration_tags"),
    )
    return (
        postings.select(F.explode(entries).alias("e"))
        .groupBy("e.dimension", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


ROLLUP_KEYS = (
    "company", "role_category", "concentration_track", "location", "source",
    "seniority", "employment_type", "opt_cpt_signal", "posting_week",
)


def trend_rollup(
    postings: DataFrame, as_of: date, *, days: int = 90, cross: bool = False
) -> DataFrame:
    """Weekly roll-up of the last ``days`` days.

    Role and concentration lists are unfolded side by side, the shorter one padded
    with NULL; ``cross=True`` gives every combination instead.  Postings with both
    lists empty do not appear.
    """
    recent = postings.filter(F.col("posted_date") >= F.lit(as_of - timedelta(days=days)))
    if cross:
        tags = recent.withColumn("role_category", F.explode("role_tags")).withColumn(
            "concentration_track", F.explode("concentration_tags")
        )
    else:
        tags = (
            recent.withColumn(
                "_t", F.explode(F.arrays_zip("role_tags", "concentration_tags"))
            )
            .withColumn("role_category", F.col("_t.role_tags"))
            .withColumn("concentration_track", F.col("_t.concentration_tags"))
        )
    return (
        tags.withColumn("posting_week", F.to_date(F.date_trunc("week", "posted_date")))
        .withColumnRenamed("opt_cpt_flag", "opt_cpt_signal")
        .groupBy(*ROLLUP_KEYS)
        .agg(
            F.count(F.lit(1)).alias("posting_count"),
            F.min("created_at").alias("first_seen_date"),
            F.max("updated_at").alias("last_seen_date"),
        )
    )


def skill_trend(postings: DataFrame) -> DataFrame:
    """Postings per week and profile term found in their text (``text_hits``)."""
    return (
        postings.select(
            week_bucket(F.col("posted_date")).alias("posting_week"),
            F.explode("text_hits").alias("skill_keyword"),
        )
        .groupBy("posting_week", "skill_keyword")
        .agg(F.count(F.lit(1)).alias("posting_count"))
    )
