"""Exports whose headers vary: JSON (bare or wrapped), JSON lines and CSV."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.text import stable_hash, strip, text_or_null
from jobweave.functions.values import clean_list, parse_bool, parse_date, parse_list
from jobweave.operators.quality import check_contract, rejects
from jobweave.schemas import POSTING_SCHEMA, conform, settle
from jobweave.sources.files import (
    ExportError,
    fail_if,
    line_positions,
    number_files,
    record_ordinal,
    whole_documents,
)
from jobweave.vocab import (
    ALIASED_SOURCE_NAME,
    DEFAULT_LOCATION,
    FIELD_ALIASES,
    GENERATED_ID_PREFIX,
    REQUIRED_FIELDS,
    WRAPPER_KEYS,
)

ALL_ALIASES = tuple(dict.fromkeys(a for names in FIELD_ALIASES.values() for a in names))


def header_key(name: str) -> str:
    return name.strip().lower().replace("ß", "ss").replace("-", "_").replace(" ", "_")


def map_fields(raw: DataFrame) -> DataFrame:
    """Canonical fields from aliased headers: a projection fixed at plan time.

    The first alias with a non-blank value wins; of headers that normalise to the
    same name the last one counts.
    """
    by_key = {header_key(c): c for c in raw.columns}
    # "ordinal" and "raw_payload" are ours, not headers
    fields = {}
    for name, aliases in FIELD_ALIASES.items():
        found = [text_or_null(F.col(f"`{by_key[a]}`")) for a in aliases if a in by_key]
        fields[name] = F.coalesce(*found) if found else F.lit(None).cast("string")
    payload = F.col("raw_payload") if "raw_payload" in raw.columns else F.lit(None).cast("string")
    return settle(
        raw.select("ordinal", payload.alias("raw_payload"), *[v.alias(k) for k, v in fields.items()])
    )


def missing_fields() -> Column:
    """Names of absent required fields, in their fixed order."""
    return F.array_compact(
        F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED_FIELDS])
    )


def _list_field(c: str) -> Column:
    """A JSON list as it is, a text split on its separator."""
    as_json = F.when(
        F.startswith(F.col(c), F.lit("[")), F.from_json(F.col(c), "array<string>")
    )
    return F.coalesce(clean_list(as_json), parse_list(F.col(c)))


def to_postings(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(postings, rejects)`` of mapped records."""
    checked = fields.withColumn("_missing", missing_fields())
    skipped = rejects(
        checked.filter(F.size("_missing") > 0),
        "required",
        F.concat(F.lit("missing required field(s): "), F.array_join("_missing", ", ")),
    )
    location = F.coalesce("location", F.lit(DEFAULT_LOCATION))
    generated = F.concat(
        F.lit(GENERATED_ID_PREFIX),
        F.substring(
            stable_hash(F.concat_ws("|", "company", "title", location, "apply_url")), 1, 16
        ),
    )
    shaped = conform(
        checked.filter(F.size("_missing") == 0),
        POSTING_SCHEMA,
        source=F.lit(ALIASED_SOURCE_NAME),
        source_job_id=F.coalesce("source_job_id", generated),
        location=location,
        url=F.col("apply_url"),
        posted_date=parse_date(F.col("posted_date")),
        seniority=F.col("seniority_level"),
        concentration_tags=_list_field("concentration_tags"),
        role_tags=_list_field("role_tags"),
        opt_cpt_flag=parse_bool(F.col("opt_cpt_flag")),
        raw_metadata=F.to_json(
            F.struct("raw_payload", F.col("source_job_id").isNull().alias("source_job_id_was_generated"))
        ),
    )
    good, broken = check_contract(settle(shaped))
    return good, skipped.unionByName(broken)


def since(postings: DataFrame, day: str | date | None) -> DataFrame:
    """Postings of ``day`` or later; those without a date stay."""
    if day is None:
        return postings
    day = date.fromisoformat(day) if isinstance(day, str) else day
    return postings.filter(F.col("posted_date").isNull() | (F.col("posted_date") >= F.lit(day)))


def undated(postings: DataFrame) -> DataFrame:
    """Warnings for what :func:`since` let through without a date."""
    return rejects(
        postings.filter(F.col("posted_date").isNull()),
        "since_date",
        F.concat(F.lit("Included without parseable posted_date: "), F.col("source_job_id")),
    )


def first_records(postings: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` postings in input order."""
    if limit is None:
        return postings
    if limit < 1:
        raise ExportError("limit must be a positive integer")
    return postings.orderBy("ordinal").limit(limit)


# --- scans ------------------------------------------------------------------


def _from_objects(records: DataFrame) -> DataFrame:
    """One column per known alias from ``record`` JSON objects."""
    normal = F.transform(
        F.map_entries(F.from_json("record", "map<string,string>")),
        lambda e: F.struct(
            F.replace(
                F.replace(
                    F.replace(F.lower(strip(e["key"])), F.lit("ß"), F.lit("ss")),
                    F.lit("-"), F.lit("_"),
                ),
                F.lit(" "), F.lit("_"),
            ).alias("key"),
            e["value"].alias("value"),
        ),
    )
    entries = records.withColumn("_e", normal)

    def last(alias: str) -> Column:
        return F.try_element_at(
            F.filter("_e", lambda e: e["key"] == F.lit(alias)), F.lit(-1)
        )["value"].alias(alias)

    return settle(
        entries.select("ordinal", F.col("record").alias("raw_payload"), *map(last, ALL_ALIASES))
    )


def read_aliased_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw records of JSON documents: a list, or an object with a wrapper key."""
    docs = whole_documents(spark, path)
    body = strip(F.col("text"))
    keys = F.json_object_keys("text")
    chosen = F.when(F.startswith(body, F.lit("[")), F.col("text"))
    for k in WRAPPER_KEYS:
        chosen = chosen.when(
            F.array_contains(keys, F.lit(k)),
            F.coalesce(F.get_json_object("text", f"$.{k}"), F.lit("null")),
        )
    docs = docs.withColumn("list", chosen)
    records = F.from_json("list", "array<string>")
    problem = (
        F.when(body == "", F.lit("export is empty"))
        .when(F.try_parse_json("text").isNull(), F.lit("JSON export is not valid JSON"))
        .when(
            F.col("list").isNull(),
            F.lit("JSON export must be a list or contain one of these array keys: "
                  + ", ".join(WRAPPER_KEYS)),
        )
        .when(~F.startswith(strip(F.col("list")), F.lit("[")), F.lit("JSON wrapper key must contain a list"))
        .when(F.size(records) == 0, F.lit("export is empty"))
        .when(
            F.exists(records, lambda r: F.coalesce(~F.startswith(r, F.lit("{")), F.lit(True))),
            F.lit("export records must be JSON objects"),
        )
    )
    fail_if(
        docs.withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .withColumn("reason", F.concat_ws(": ", "file_path", "problem")),
        "reason",
    )
    return _from_objects(
        docs.select("file_no", F.posexplode(records).alias("pos", "record")).withColumn(
            "ordinal", record_ordinal(F.col("pos") + 1)
        )
    )


def read_aliased_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw records of JSON-lines files; these are split over tasks."""
    lines = line_positions(spark.read.text(path).withColumnRenamed("value", "record"))
    return _from_objects(
        number_files(lines.filter(strip(F.col("record")) != "").select("record", "position", "file_path"))
        .withColumn("ordinal", record_ordinal(F.col("position")))
    )


def read_aliased_csv(
    spark: SparkSession, path: str | list[str], *, multiline: bool = True
) -> DataFrame:
    """Raw records of CSV files with a header row, all columns as text.

    ``multiline=False`` lets Spark split files whose fields hold no line breaks.
    """
    rows = line_positions(
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )
    columns = [c for c in rows.columns if c not in ("position", "file_path")]
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    numbered = number_files(rows.withColumn("raw_payload", payload))
    return numbered.withColumn("ordinal", record_ordinal(F.col("position"))).drop(
        "file_no", "file_path", "position"
    )


def read_aliased(spark: SparkSession, path: str) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"json": read_aliased_json, "jsonl": read_aliased_jsonl, "csv": read_aliased_csv}
    if suffix not in readers:
        raise ExportError(f"Unsupported export extension '.{suffix}'. Use .json, .jsonl or .csv.")
    return readers[suffix](spark, path)


def load_counts(raw: DataFrame, loaded: DataFrame, returned: DataFrame) -> DataFrame:
    """One row: raw, loaded, skipped and returned records."""

    def count(df: DataFrame, stage: str) -> DataFrame:
        return df.select(F.lit(stage).alias("stage"))

    stages: Sequence[DataFrame] = (
        count(raw, "raw"), count(loaded, "loaded"), count(returned, "returned"),
    )
    all_rows = stages[0].unionByName(stages[1]).unionByName(stages[2])
    n = lambda s: F.count_if(F.col("stage") == s)
    return all_rows.agg(
        n("raw").alias("raw_count"),
        n("loaded").alias("loaded_count"),
        (n("raw") - n("loaded")).alias("skipped_count"),
        n("returned").alias("returned_count"),
    )
