"""Approved JSON exports: an approval envelope around a list of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.text import strip, text_or_null
from jobweave.functions.values import strict_date
from jobweave.operators.quality import check_contract, rejects
from jobweave.schemas import POSTING_SCHEMA, conform, settle
from jobweave.sources.files import fail_if, record_ordinal, whole_documents

_ENVELOPE_TEXTS = ("source_name", "approved_by", "approval_date", "access_method")
_AUDIT_OPTIONAL = ("source_owner", "documentation_url")
_REQUIRED = ("title", "company", "location", "description")
_OPTIONAL = (
    "source_job_id", "url", "apply_url", "post_url", "source", "employment_type",
    "seniority",
)
_LISTS = ("concentration_tags", "role_tags")
_KNOWN = (*_REQUIRED, *_OPTIONAL, *_LISTS, "posted_date", "opt_cpt_flag", "raw_metadata")


def _type_of(field: str) -> Column:
    """JSON type of a record field: VOID for null, NULL when absent."""
    return F.schema_of_variant(F.try_variant_get("_v", f"$.{field}", "variant"))


def _text(field: str) -> Column:
    return F.try_variant_get("_v", f"$.{field}", "string")


def _envelope_problem() -> Column:
    """Why an envelope is refused, NULL when it is fine."""
    meta = lambda f: F.get_json_object("text", f"$.metadata.{f}")
    terms = F.lower(F.coalesce(meta("terms_reviewed"), F.lit("true")))
    out = F.when(
        F.try_parse_json("text").isNull(), F.lit("Approved JSON export is not valid JSON")
    )
    for f in _ENVELOPE_TEXTS:
        bad = F.coalesce(strip(meta(f)) == "", F.lit(True))
        if f == "approval_date":
            bad = bad | strict_date(meta(f)).isNull()
        out = out.when(bad, F.lit(f"metadata.{f}: Field required"))
    out = out.when(
        terms.isin("false", "0", "no", "n", "f", "off"),
        F.lit("terms_reviewed must be true for approved exports"),
    )
    jobs = F.coalesce(F.get_json_object("text", "$.jobs"), F.lit("[]"))
    return out.when(~F.startswith(strip(jobs), F.lit("[")), F.lit("jobs: Input should be a valid list"))


def _audit() -> Column:
    """Approval metadata kept with every record, absent fields left out."""
    return F.to_json(
        F.struct(
            *[strip(F.get_json_object("text", f"$.metadata.{f}")).alias(f)
              for f in (*_ENVELOPE_TEXTS,)],
            F.lit(True).alias("terms_reviewed"),
            *[strip(F.get_json_object("text", f"$.metadata.{f}")).alias(f)
              for f in _AUDIT_OPTIONAL],
        )
    )


def _record_problem() -> Column:
    """First type problem of a record in field order, NULL when it is fine."""
    out = F.when(
        F.coalesce(~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(True)),
        F.lit("Input should be a valid dictionary or instance"),
    )
    for f in _REQUIRED:
        out = out.when(_type_of(f).isNull(), F.lit(f"{f}: Field required"))
        out = out.when(_type_of(f) != "STRING", F.lit(f"{f}: Input should be a valid string"))
    for f in _OPTIONAL:
        out = out.when(
            ~F.coalesce(_type_of(f), F.lit("VOID")).isin("STRING", "VOID"),
            F.lit(f"{f}: Input should be a valid string"),
        )
    out = out.when(
        (F.coalesce(_type_of("posted_date"), F.lit("VOID")) != "VOID")
        & strict_date(_text("posted_date")).isNull(),
        F.lit("posted_date: Input should be a valid date"),
    )
    for f in _LISTS:
        out = out.when(
            ~F.coalesce(_type_of(f), F.lit("ARRAY<VOID>")).isin(
                "ARRAY<STRING>", "ARRAY<VOID>"
            ),
            F.lit(f"{f}: Input should be a valid list"),
        )
    out = out.when(
        F.coalesce(_type_of("opt_cpt_flag"), F.lit("VOID")).isin("VOID", "BOOLEAN")
        | _flag().isNotNull(),
        F.lit(None),
    ).otherwise(F.lit("opt_cpt_flag: Input should be a valid boolean"))
    return out


def _flag() -> Column:
    word = F.lower(_text("opt_cpt_flag"))
    return F.when(word.isin("true", "1", "yes", "y", "t", "on"), F.lit(True)).when(
        word.isin("false", "0", "no", "n", "f", "off"), F.lit(False)
    )


def _first_text(*fields: str) -> Column:
    return F.coalesce(*[F.nullif(_text(f), F.lit("")) for f in fields])


def _raw_metadata() -> Column:
    """raw_metadata, overridden by unknown keys, plus audit data and source id."""
    as_map = "map<string,variant>"
    empty = F.from_json(F.lit("{}"), as_map)
    given = F.coalesce(F.from_json(F.get_json_object("record", "$.raw_metadata"), as_map), empty)
    extra = F.map_filter(
        F.coalesce(F.from_json("record", as_map), empty), lambda k, v: ~k.isin(*_KNOWN)
    )
    added = F.map_from_entries(
        F.array_compact(
            F.array(
                F.struct(F.lit("approval_metadata"), F.parse_json("audit")),
                F.when(
                    F.coalesce(_text("source_job_id") != "", F.lit(False)),
                    F.struct(F.lit("source_job_id"), F.try_variant_get("_v", "$.source_job_id", "variant")),
                ),
            )
        )
    )

    def without(base: Column, over: Column) -> Column:
        return F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))

    merged = F.map_concat(without(given, extra), extra)
    return F.to_json(F.map_concat(without(merged, added), added))


def read_approved(
    spark: SparkSession, path: str | list[str], *, strict: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(postings, rejects, records)`` of approved exports.

    Every malformed record is rejected alone.  A refused envelope refuses its
    whole file: an error when ``strict``, else a reject of stage ``envelope``.
    ``records`` has one row per record of the accepted files.
    """
    docs = whole_documents(spark, path).withColumn("problem", _envelope_problem())
    refused = docs.filter(F.col("problem").isNotNull())
    if strict:
        fail_if(
            refused.withColumn("reason", F.concat_ws(": ", "file_path", "problem")), "reason"
        )
    jobs = F.from_json(F.coalesce(F.get_json_object("text", "$.jobs"), F.lit("[]")), "array<string>")
    records = (
        docs.filter(F.col("problem").isNull())
        .withColumn("audit", _audit())
        .withColumn("source_name", strip(F.get_json_object("text", "$.metadata.source_name")))
        .select("file_no", "audit", "source_name", F.posexplode(jobs).alias("pos", "record"))
        .withColumn("ordinal", record_ordinal(F.col("pos") + 1))
        .select("ordinal", "audit", "source_name", "record")
    )
    parsed = records.withColumn("_v", F.try_parse_json("record"))
    typed = parsed.withColumn("problem", _record_problem()).withColumn(
        "problem",
        F.when(
            F.col("problem").isNull() & _first_text("url", "apply_url", "post_url").isNull(),
            F.lit("Value error, one of url, apply_url, or post_url is required"),
        ).otherwise(F.col("problem")),
    )
    typed = settle(typed)
    shaped = conform(
        typed.filter(F.col("problem").isNull()),
        POSTING_SCHEMA,
        source=F.coalesce(text_or_null(_text("source")), "source_name"),
        **{f: _text(f) for f in (*_REQUIRED, "source_job_id", "employment_type", "seniority")},
        url=_first_text("url", "apply_url", "post_url"),
        posted_date=strict_date(_text("posted_date")),
        **{
            f: F.coalesce(
                F.try_variant_get("_v", f"$.{f}", "array<string>"),
                F.array().cast("array<string>"),
            )
            for f in _LISTS
        },
        opt_cpt_flag=_flag(),
        raw_metadata=_raw_metadata(),
    )
    good, broken = check_contract(settle(shaped))
    bad = rejects(typed.filter(F.col("problem").isNotNull()), "record", F.col("problem")).unionByName(
        broken
    )
    if not strict:
        bad = bad.unionByName(
            rejects(refused.withColumn("ordinal", record_ordinal(F.lit(0))), "envelope", F.col("problem"))
        )
    return good, bad, records
