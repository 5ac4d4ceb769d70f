"""Fixed schemas of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


POSTING_SCHEMA = _struct(
    ("ordinal", T.LongType()),
    ("source", T.StringType()),
    ("source_job_id", T.StringType()),
    ("title", T.StringType()),
    ("company", T.StringType()),
    ("location", T.StringType()),
    ("description", T.StringType()),
    ("url", T.StringType()),
    ("posted_date", T.DateType()),
    ("employment_type", T.StringType()),
    ("seniority", T.StringType()),
    ("concentration_tags", _TEXTS),
    ("role_tags", _TEXTS),
    ("opt_cpt_flag", T.BooleanType()),
    ("raw_metadata", T.StringType()),
)

PROFILE_SCHEMA = _struct(
    ("profile_no", T.LongType()),
    ("student_id", T.StringType()),
    ("name", T.StringType()),
    ("concentration", T.StringType()),
    ("academic_stage", T.StringType()),
    ("target_roles", _TEXTS),
    ("skills", _TEXTS),
    ("stage", T.StringType()),
    ("work_auth_status", T.StringType()),
    ("opt_eligibility_date", T.StringType()),
    ("geo_preference", _TEXTS),
    ("remote_preference", T.StringType()),
    ("delivery_preference", T.StringType()),
    ("match_frequency", T.StringType()),
    ("ai_matching_consent", T.BooleanType()),
    ("profile_version", T.IntegerType()),
    ("updated_at", T.StringType()),
)

REJECT_SCHEMA = "stage string, ordinal bigint, reason string"


def conform(df: DataFrame, schema: T.StructType, **extra: Column) -> DataFrame:
    """Select exactly the columns of ``schema``; absent ones become NULL."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        if f.name in extra:
            value = extra[f.name]
        elif f.name in have:
            value = F.col(f.name)
        else:
            value = F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def require_columns(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    missing = [n for n in schema.fieldNames() if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s): {', '.join(missing)}")
    return df


def settle(df: DataFrame) -> DataFrame:
    """Fix the computed columns of ``df`` as values.

    Filters that follow are otherwise pushed below the projection with every
    expression copied into them; a few layers of coalesced aliases would make the
    plan grow without bound.  A generator over one row stops that, lazily and
    without a shuffle.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
