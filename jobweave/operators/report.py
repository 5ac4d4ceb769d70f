"""Export rows, digests and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.vocab import EXPORT_COLUMNS, NO_SIGNALS

DIGEST_FOOTER = "This digest was generated automatically."


def export_rows(ranked: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ranked matches as the 15 export columns (plus ``keep``)."""
    seniority = F.coalesce(F.nullif("seniority_label", F.lit("")), F.lit(""))
    values: dict[str, Column] = {
        "student_id": F.col("student_key"),
        "student_name": F.col("name"),
        "title": F.col("title"),
        "company": F.col("company"),
        "location": F.col("location"),
        "source": F.col("source"),
        "apply_url/post_url": F.col("url"),
        "role_category": F.array_join("role_tags", "; "),
        "target_role": F.array_join("target_roles", "; "),
        "concentration_tags": F.array_join("concentration_tags", "; "),
        "seniority_level": seniority,
        "opt_cpt_flag": F.col("opt_cpt_flag"),
        "final_score": F.round("score", 4),
        "score_breakdown": F.to_json(
            F.struct(
                F.struct(F.col("seniority_label").alias("seniority")).alias("metadata"),
                F.col("reasons"),
            )
        ),
        "ranking_explanation": F.when(
            F.size("reasons") > 0, F.array_join("reasons", "; ")
        ).otherwise(F.lit(NO_SIGNALS)),
    }
    return ranked.select(*keep, *[values[c].alias(c) for c in EXPORT_COLUMNS])


def digests(profiles: DataFrame, ranked: DataFrame, *, footer: str = DIGEST_FOOTER) -> DataFrame:
    """One text per profile; ``ranked`` must be limited per profile.

    Profiles without matches get a text that says so.
    """
    line = F.concat(
        F.col("rank_position").cast("string"), F.lit(". "), F.col("title"),
        F.lit(" at "), F.col("company"),
        F.lit("\n   Location: "), F.col("location"),
        F.lit("\n   Score: "), F.format_string("%.1f", "score"),
        F.lit("\n   URL: "), F.col("url"), F.lit("\n"),
    )
    bodies = ranked.groupBy("profile_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("rank_position", line.alias("line")))
                ),
                lambda e: e["line"],
            ),
            "\n",
        ).alias("body")
    )
    return profiles.join(bodies, "profile_no", "left").select(
        "profile_no",
        "student_key",
        F.concat(
            F.lit("Hello "), F.col("name"),
            F.lit(",\n\nHere are your current job matches:\n\n"),
            F.coalesce("body", F.lit("No matches are available yet.")),
            F.lit("\n\n" + footer),
        ).alias("digest"),
    )


def run_counts(
    staged: DataFrame, unique: DataFrame, profiles: DataFrame, ranked: DataFrame
) -> DataFrame:
    """One row of stage counters.  ``staged(ordinal, valid)`` has every
    normalised posting, ``profiles`` every loaded profile."""
    def tally(df: DataFrame, kind: str, flag: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), flag.alias("flag"))

    rows = (
        tally(staged, "posting", F.col("valid"))
        .unionByName(tally(unique, "unique", F.lit(True)))
        .unionByName(
            tally(profiles, "profile", F.coalesce("ai_matching_consent", F.lit(True)))
        )
        .unionByName(tally(ranked, "match", F.lit(True)))
    )

    def n(kind: str, extra: Column | None = None) -> Column:
        cond = F.col("kind") == kind
        return F.count_if(cond if extra is None else cond & extra)

    valid = n("posting", F.col("flag"))
    return rows.agg(
        n("posting").alias("normalized_count"),
        valid.alias("valid_count"),
        n("posting", ~F.col("flag")).alias("invalid_count"),
        (valid - n("unique")).alias("duplicate_count"),
        n("unique").alias("unique_count"),
        n("unique").alias("classified_count"),
        n("profile").alias("profile_count"),
        n("profile", F.col("flag")).alias("active_profile_count"),
        n("match").alias("total_ranked_matches"),
    )
