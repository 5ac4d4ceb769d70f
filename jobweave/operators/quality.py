"""Normalising, validating and rejecting postings; the profile contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.keys import student_key
from jobweave.functions.text import casefold, is_blank, strip, terms_of, text_or_null
from jobweave.functions.urls import is_http_url, normal_url
from jobweave.schemas import settle
from jobweave.vocab import (
    DEFAULT_MATCH_FREQUENCY,
    NEEDS_SPONSORSHIP,
    PROFILE_ENUMS,
    STAGE_TO_SENIORITY,
)

REQUIRED_TEXT = ("source", "title", "company", "location", "description", "url")


def _listed(*checks: tuple[Column, Column]) -> Column:
    """Messages whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(bad, msg) for bad, msg in checks]))


# --- postings ---------------------------------------------------------------


def contract_problems() -> Column:
    """Every violated posting rule: six required texts, an http(s) URL."""
    blank = [
        (
            F.coalesce(strip(F.col(c)) == "", F.lit(True)),
            F.lit(f"{c}: String should have at least 1 character"),
        )
        for c in REQUIRED_TEXT
    ]
    bad_url = F.coalesce(strip(F.col("url")) != "", F.lit(False)) & ~is_http_url(
        F.col("url")
    )
    return _listed(*blank, (bad_url, F.lit("url: Input should be a valid URL")))


def check_contract(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw postings into (postings with stripped texts, rejects)."""
    checked = settle(raw.withColumn("_problems", contract_problems()))
    good = checked.filter(F.size("_problems") == 0).drop("_problems")
    good = good.withColumns(
        {
            **{c: strip(F.col(c)) for c in REQUIRED_TEXT if c != "url"},
            "url": normal_url(F.col("url")),
            "source_job_id": strip(F.col("source_job_id")),
            "employment_type": strip(F.col("employment_type")),
            "seniority": strip(F.col("seniority")),
            "concentration_tags": F.transform("concentration_tags", strip),
            "role_tags": F.transform("role_tags", strip),
        }
    )
    bad = rejects(checked.filter(F.size("_problems") > 0), "contract", F.get("_problems", F.lit(0)))
    return good, bad


def rejects(rows: DataFrame, stage: str, reason: Column) -> DataFrame:
    """``(stage, ordinal, reason)`` of rows that were left out."""
    return rows.select(
        F.lit(stage).alias("stage"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        reason.alias("reason"),
    )


def normalize(postings: DataFrame) -> DataFrame:
    return postings.withColumns(
        {
            **{c: strip(F.col(c)) for c in ("title", "company", "location", "description")},
            **{c: text_or_null(F.col(c)) for c in ("employment_type", "seniority")},
        }
    )


def is_valid() -> Column:
    """Minimum fields needed downstream, after normalising."""
    ok = F.coalesce(F.col("url") != "", F.lit(False))
    for c in REQUIRED_TEXT[:-1]:
        ok = ok & F.coalesce(~is_blank(F.col(c)), F.lit(False))
    return ok


INVALID_REASON = (
    "missing required source, title, company, location, description, or URL"
)


def validate(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        normalized.filter(is_valid()),
        rejects(normalized.filter(~is_valid()), "validate", F.lit(INVALID_REASON)),
    )


# --- profiles ---------------------------------------------------------------


def preferred_seniority(stage: Column) -> Column:
    s = casefold(F.coalesce(stage, F.lit("")))
    out = F.lit(None).cast("string")
    for label, parts in reversed(STAGE_TO_SENIORITY):
        out = F.when(s.rlike("|".join(parts)), F.lit(label)).otherwise(out)
    return out


def profile_features(profiles: DataFrame) -> DataFrame:
    """Profiles with the columns that ranking reads.

    Needs ``profile_no`` (input order, unique), the model's fields and lists.
    """
    stage = F.coalesce("academic_stage", "stage")
    return profiles.withColumns(
        {
            "student_key": student_key(F.col("student_id"), F.col("name")),
            "academic_stage": stage,
            "stage": F.coalesce("stage", "academic_stage"),
            "needs_opt": F.coalesce(
                F.col("work_auth_status") == NEEDS_SPONSORSHIP, F.lit(False)
            ),
            # an empty stage text falls through to the other field
            "preferred_seniority": preferred_seniority(
                F.coalesce(F.nullif("academic_stage", F.lit("")), "stage", "academic_stage")
            ),
            "skill_terms": terms_of(F.col("skills")),
            "role_terms": terms_of(F.col("target_roles")),
        }
    )


def consenting(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles to rank, and the others as rejects."""
    ok = F.coalesce(F.col("ai_matching_consent"), F.lit(True))
    skipped = profiles.filter(~ok).withColumnRenamed("profile_no", "ordinal")
    return profiles.filter(ok), rejects(
        skipped,
        "consent",
        F.concat(F.lit("Skipped profile without AI matching consent: "), F.col("name")),
    )


def with_profile_defaults(profiles: DataFrame, now: Column) -> DataFrame:
    """Defaults of the profile contract for fields the caller left out."""
    return profiles.withColumns(
        {
            "skills": F.coalesce("skills", F.array().cast("array<string>")),
            "match_frequency": F.coalesce("match_frequency", F.lit(DEFAULT_MATCH_FREQUENCY)),
            "ai_matching_consent": F.coalesce("ai_matching_consent", F.lit(False)),
            "profile_version": F.coalesce("profile_version", F.lit(1)),
            "updated_at": F.coalesce("updated_at", now),
        }
    )


def profile_errors() -> Column:
    """All contract violations of one profile, in a fixed order.

    ``updated_at`` and ``opt_eligibility_date`` are texts here, as in the contract.
    """

    def missing(c: str) -> tuple[Column, Column]:
        return F.col(c).isNull(), F.lit(f"Missing required field: {c}")

    def quoted(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(f'{prefix}: "'), value, F.lit('"'))

    def enum(c: str, also_blank: bool = False) -> tuple[Column, Column]:
        v = F.col(c)
        bad = ~v.isin(*PROFILE_ENUMS[c])
        if not also_blank:
            bad = bad & (v != "")
        return F.coalesce(bad, F.lit(False)), quoted(f"Invalid {c}", v)

    def members(c: str, label: str) -> Column:
        empty = F.coalesce(F.size(c) <= 0, F.lit(True))
        allowed = [F.lit(v) for v in PROFILE_ENUMS[c]]
        invalid = F.filter(c, lambda v: ~F.array_contains(F.array(*allowed), v))
        return F.when(
            empty, F.array(F.lit(f"{c} must be a non-empty array"))
        ).otherwise(F.transform(invalid, lambda v: quoted(f"Invalid {label}", v)))

    skills = F.filter(
        F.transform(
            F.coalesce("skills", F.array().cast("array<string>")),
            lambda s, i: F.when(
                F.coalesce(strip(s) == "", F.lit(True)),
                F.concat(F.lit("skills["), i.cast("string"), F.lit("] must be a non-empty string")),
            ),
        ),
        lambda m: m.isNotNull(),
    )
    sponsored = F.coalesce(F.col("work_auth_status") == NEEDS_SPONSORSHIP, F.lit(False))
    opt = F.coalesce("opt_eligibility_date", F.lit(""))
    return F.concat(
        _listed(
            *[
                missing(c)
                for c in (
                    "concentration", "academic_stage", "work_auth_status",
                    "delivery_preference", "profile_version", "updated_at",
                    "ai_matching_consent",
                )
            ],
            *[
                enum(c)
                for c in (
                    "concentration", "academic_stage", "work_auth_status",
                    "delivery_preference", "match_frequency",
                )
            ],
            enum("remote_preference", also_blank=True),
        ),
        members("target_roles", "target_role"),
        members("geo_preference", "geo_preference"),
        skills,
        _listed(
            (
                sponsored & (opt == ""),
                F.lit(
                    "opt_eligibility_date is required when work_auth_status is "
                    f"'{NEEDS_SPONSORSHIP}'"
                ),
            ),
            (
                sponsored & (opt != "") & ~opt.rlike(r"^\d{4}-\d{2}-\d{2}$"),
                F.lit("opt_eligibility_date must be in YYYY-MM-DD format"),
            ),
            (
                F.coalesce(F.col("profile_version") < 1, F.lit(True)),
                F.lit("profile_version must be an integer >= 1"),
            ),
            (
                F.col("updated_at").try_cast("timestamp").isNull(),
                F.lit("updated_at must be a valid ISO-8601 date-time string"),
            ),
            (
                F.col("ai_matching_consent").isNull(),
                F.lit("ai_matching_consent must be a boolean"),
            ),
        ),
    )


def stale_profiles(profiles: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Profiles not saved for ``days`` days or more before ``as_of``."""
    return profiles.filter(F.date_diff(as_of, F.to_date("updated_at")) >= days)

