"""Taxonomy tagging and seniority inference.

Everything here is a projection: no join, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.keys import folded_description
from jobweave.functions.text import (
    boundary_pattern,
    casefold,
    collapse,
    has_any,
    terms_in,
    word_text,
)
from jobweave.vocab import SENIORITY_DEFAULT, SENIORITY_TERMS, Taxonomy


def fold(term: str) -> str:
    """Python side of :func:`jobweave.functions.text.casefold`."""
    return term.lower().replace("ß", "ss")


def class_text(folded: Column | None = None) -> Column:
    """Folded, whitespace-collapsed text that keywords are looked up in.

    ``folded`` is the folded description when the caller has it already.
    """
    folded = folded_description() if folded is None else folded
    parts = [collapse(casefold(F.col(c))) for c in ("title", "company", "location")]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in (*parts, folded)])


def rank_text() -> Column:
    return F.lower(F.concat_ws(" ", "title", "description"))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _matched_tags(text: Column, words: Column, keyword_map: Mapping[str, Sequence[str]]) -> Column:
    """Tags, in map order, with at least one keyword in the text."""
    return F.array_compact(
        F.array(
            *[
                F.when(has_any(text, [fold(k) for k in keywords], words=words), F.lit(tag))
                for tag, keywords in keyword_map.items()
            ]
        )
    ).cast("array<string>")


def classify(
    postings: DataFrame, taxonomy: Taxonomy | None = None, text: Column | None = None
) -> DataFrame:
    """Replace role_tags and concentration_tags by the inferred ones.

    Given tags that the taxonomy knows come first, then the tags of the roles,
    then keyword matches; every list keeps first-seen order.
    """
    t = taxonomy or Taxonomy()
    none = F.array().cast("array<string>")

    def known(tag: Column) -> Column:
        mapped = F.when(tag.isin(*t.concentrations), tag)
        for old, new in t.aliases.items():
            mapped = mapped.when(tag == old, F.lit(new))
        return mapped

    def tracks(role: Column) -> Column:
        out = F.when(F.lit(False), none)
        for name, targets in t.role_concentrations.items():
            out = out.when(role == name, _strings(targets))
        return out.otherwise(none)

    given_roles = F.filter(F.coalesce("role_tags", none), lambda r: r.isin(*t.roles))
    given = F.array_compact(F.transform(F.coalesce("concentration_tags", none), known))
    body = F.col("_text"), F.col("_words")
    return (
        postings.withColumn("_text", class_text() if text is None else text)
        .withColumn("_words", word_text(F.col("_text")))
        .withColumns(
            {
                "_by_word": _matched_tags(*body, t.concentration_keywords),
                "role_tags": F.array_distinct(
                    F.concat(given_roles, _matched_tags(*body, t.role_keywords))
                ),
            }
        )
        .withColumn(
            "concentration_tags",
            F.array_distinct(
                F.concat(given, F.flatten(F.transform("role_tags", tracks)), "_by_word")
            ),
        )
        .drop("_text", "_words", "_by_word")
    )


def keyword_stats(postings: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Postings per (kind, tag, keyword)."""
    entries = [
        (kind, tag, word)
        for kind, table in (
            ("role", taxonomy.role_keywords),
            ("concentration", taxonomy.concentration_keywords),
        )
        for tag, words in table.items()
        for word in words
    ]
    found = terms_in(F.col("_text"), [fold(w) for _, _, w in entries], words=F.col("_words"))
    used = (
        postings.select(class_text().alias("_text"))
        .withColumn("_words", word_text(F.col("_text")))
        .select(F.explode(found).alias("folded"))
        .groupBy("folded")
        .agg(F.count(F.lit(1)).alias("postings"))
    )
    spark = postings.sparkSession
    names = spark.createDataFrame(
        [(kind, tag, word, fold(word)) for kind, tag, word in entries],
        "kind string, tag string, keyword string, folded string",
    )
    return names.join(used, "folded").drop("folded")


def seniority_label(text: Column, terms=SENIORITY_TERMS, words: Column | None = None) -> Column:
    """The posting's own label, else the first class with a term in ``text``.

    ``text`` is :func:`rank_text`, best given as a column that exists already, as is
    ``words``, its :func:`word_text`.
    """
    inferred = F.lit(SENIORITY_DEFAULT)
    for label, wanted in reversed(terms):
        inferred = F.when(has_any(text, wanted, boundary_pattern, words), F.lit(label)).otherwise(
            inferred
        )
    return F.coalesce(F.nullif(F.col("seniority"), F.lit("")), inferred)
