"""Profile lists and labelled evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.text import strip
from jobweave.functions.values import parse_date
from jobweave.schemas import POSTING_SCHEMA, PROFILE_SCHEMA, conform
from jobweave.sources.files import fail_if, record_ordinal, whole_documents
from jobweave.vocab import DEFAULT_MATCH_FREQUENCY

_FIELDS = [f for f in PROFILE_SCHEMA.fields if f.name != "profile_no"]
_JSON = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _FIELDS) + ">"


def _profile_columns(record: Column) -> dict[str, Column]:
    """Model fields of a profile record, texts stripped, defaults filled."""
    out = {}
    none = F.array().cast("array<string>")
    for f in _FIELDS:
        v = record[f.name]
        if f.dataType.simpleString() == "string":
            v = strip(v)
        elif f.dataType.simpleString() == "array<string>":
            v = F.coalesce(F.transform(v, strip), none)
        out[f.name] = v
    out["match_frequency"] = F.coalesce(out["match_frequency"], F.lit(DEFAULT_MATCH_FREQUENCY))
    out["ai_matching_consent"] = F.coalesce(out["ai_matching_consent"], F.lit(True))
    out["profile_version"] = F.coalesce(out["profile_version"], F.lit(1))
    return out


def profile_problem() -> Column:
    """First model violation of a profile, NULL when it is fine."""
    out = F.when(F.lit(False), F.lit(""))
    for c in ("name", "concentration"):
        out = out.when(F.col(c).isNull(), F.lit(f"{c}: Field required"))
        out = out.when(F.col(c) == "", F.lit(f"{c}: String should have at least 1 character"))
    return out.when(
        F.col("profile_version") < 1,
        F.lit("profile_version: Input should be greater than or equal to 1"),
    )


def read_profiles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Profiles of a JSON array or an object with a ``profiles`` array.

    An empty list or any invalid profile fails the load.
    """
    docs = whole_documents(spark, path)
    body = strip(F.col("text"))
    docs = docs.withColumn(
        "list",
        F.when(F.startswith(body, F.lit("[")), F.col("text")).otherwise(
            F.get_json_object("text", "$.profiles")
        ),
    )
    records = F.from_json("list", "array<string>")
    fail_if(
        docs.withColumn(
            "reason",
            F.when(F.try_parse_json("text").isNull(), F.lit("Profiles file is not valid JSON"))
            .when(
                F.coalesce(~F.startswith(strip(F.col("list")), F.lit("[")), F.lit(True)),
                F.lit("Profiles file must be a JSON array or an object with a profiles array"),
            )
            .when(F.size(records) == 0, F.lit("Profiles file is empty")),
        ).filter(F.col("reason").isNotNull()),
        "reason",
    )
    rows = (
        docs.select("file_no", F.posexplode(records).alias("pos", "record"))
        .withColumn("profile_no", record_ordinal(F.col("pos") + 1))
        .withColumn("r", F.from_json("record", _JSON))
    )
    profiles = conform(rows, PROFILE_SCHEMA, **_profile_columns(F.col("r")))
    fail_if(
        profiles.withColumn("problem", profile_problem())
        .filter(F.col("problem").isNotNull())
        .withColumn("reason", F.concat(F.lit("Profiles file contains an invalid profile: "), "problem")),
        "reason",
    )
    return profiles


_POSTING_LABELS = (
    "struct<id:string,title:string,company:string,location:string,description:string,"
    "source:string,source_url:string,posted_date:string,employment_type:string,"
    "opt_cpt_flag:boolean,expected_role_tags:array<string>,"
    "expected_concentration_tags:array<string>,expected_seniority:string>"
)


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(postings, profiles)`` of a labelled set.

    Postings carry ``label_id`` and the expected tags; their own tags stay empty.
    Profiles carry ``expected_top_job_ids``.
    """
    docs = whole_documents(spark, path)
    posts = (
        docs.select(
            "file_no",
            F.posexplode(
                F.from_json(F.get_json_object("text", "$.postings"), f"array<{_POSTING_LABELS}>")
            ).alias("pos", "r"),
        )
        .withColumn("ordinal", record_ordinal(F.col("pos") + 1))
    )
    none = F.array().cast("array<string>")
    shaped = posts.select(
        "ordinal",
        *[strip(F.col(f"r.{c}")).alias(c) for c in
          ("source", "title", "company", "location", "description", "employment_type")],
        F.lit(None).cast("string").alias("source_job_id"),
        strip(F.col("r.source_url")).alias("url"),
        parse_date(F.col("r.posted_date")).alias("posted_date"),
        strip(F.col("r.expected_seniority")).alias("seniority"),
        none.alias("concentration_tags"),
        none.alias("role_tags"),
        F.col("r.opt_cpt_flag").alias("opt_cpt_flag"),
        F.to_json(F.struct(F.col("r.id").alias("fixture_id"))).alias("raw_metadata"),
        F.col("r.id").alias("label_id"),
        F.coalesce("r.expected_role_tags", none).alias("expected_role_tags"),
        F.coalesce("r.expected_concentration_tags", none).alias("expected_concentration_tags"),
    )
    people = docs.select(
        "file_no",
        F.posexplode(
            F.from_json(
                F.get_json_object("text", "$.sample_profiles"),
                f"array<struct<profile:{_JSON},expected_top_job_ids:array<string>>>",
            )
        ).alias("pos", "r"),
    ).withColumn("profile_no", record_ordinal(F.col("pos") + 1))
    cols = _profile_columns(F.col("r.profile"))
    profiles = people.select(
        "profile_no",
        *[v.alias(k) for k, v in cols.items()],
        F.coalesce("r.expected_top_job_ids", none).alias("expected_top_job_ids"),
    )
    assert set(POSTING_SCHEMA.fieldNames()) <= set(shaped.columns)
    return shaped, profiles
