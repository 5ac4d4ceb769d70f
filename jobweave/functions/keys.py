"""Keys and identities of postings and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.text import casefold, collapse, stable_hash, strip, text_or_null
from jobweave.functions.urls import canonical_url
from jobweave.vocab import RANKER_VERSION


def _sep() -> Column:
    return F.lit("\u001f")


def posting_source_id() -> Column:
    """The source's own id: the column, else the one kept in raw_metadata."""
    given = F.nullif(F.col("source_job_id"), F.lit(""))
    return text_or_null(
        F.coalesce(given, F.get_json_object("raw_metadata", "$.source_job_id"))
    )


def dedup_source_key() -> Column:
    sid = posting_source_id()
    return F.when(
        sid.isNotNull(), F.concat(casefold(F.col("source")), _sep(), casefold(sid))
    )


def folded_description() -> Column:
    """Folded, whitespace-collapsed description: the one long text that keys and
    keyword tests share, so callers compute it once and pass it on."""
    return collapse(casefold(F.col("description")))


def dedup_signature(folded: Column | None = None) -> Column:
    """Folded title, company, location and the hash of the collapsed description."""
    folded = folded_description() if folded is None else folded
    return F.sha2(
        F.concat_ws(
            "\u001f",
            casefold(F.col("title")),
            casefold(F.col("company")),
            casefold(F.col("location")),
            # folded and collapsed already: lower case, no white space at the ends
            F.sha2(folded, 256),
        ),
        256,
    )


def content_signature(folded: Column | None = None) -> Column:
    folded = folded_description() if folded is None else folded
    # every part is lower case and stripped already
    return F.sha2(
        F.concat_ws(
            "||",
            casefold(strip(F.col("title"))),
            casefold(strip(F.col("company"))),
            casefold(strip(F.col("location"))),
            folded,
        ),
        256,
    )


def identities(folded: Column | None = None) -> Column:
    """Identities of a posting, strongest first: source id, URL, content.

    ``array<struct<priority, identity_type, identity_value>>``.
    """
    sid = posting_source_id()
    source = casefold(strip(F.col("source")))
    url = text_or_null(F.col("url"))

    def one(priority: int, kind: str, value: Column) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"),
            F.lit(kind).alias("identity_type"),
            value.alias("identity_value"),
        )

    # a long text is hashed for the last one: each value is written, and computed, once
    return F.filter(
        F.array(
            one(
                1,
                "source_job_id",
                F.when(
                    (source != "") & sid.isNotNull(),
                    F.concat(source, F.lit(":"), casefold(sid)),
                ),
            ),
            one(2, "canonical_url", canonical_url(url)),
            one(3, "content_signature", content_signature(folded)),
        ),
        lambda i: i["identity_value"].isNotNull(),
    )


def entity_key(prefix: str, identity: Column) -> Column:
    """Hash of ``prefix:type:value`` of one identity struct."""
    return stable_hash(
        F.concat(
            F.lit(f"{prefix}:"), identity["identity_type"], F.lit(":"),
            identity["identity_value"],
        )
    )


def match_key(student: Column, version: Column, job: Column) -> Column:
    return stable_hash(
        F.concat_ws(":", F.lit("match"), student, version.cast("string"), job,
                    F.lit(RANKER_VERSION))
    )


def student_key(student_id: Column, name: Column) -> Column:
    return F.coalesce(text_or_null(student_id), F.substring(stable_hash(name), 1, 10))
