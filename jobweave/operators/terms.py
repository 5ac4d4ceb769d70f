"""Whole-word join between a table of terms and a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import term_grams, term_shape

# Up to this many terms the dictionary is broadcast; beyond, the join is shuffled
# and salted.
BROADCAST_TERMS = 200_000
SALTS = 32


def match_terms(
    texts: DataFrame,
    terms: DataFrame,
    *,
    key: str = "ordinal",
    text: Column | str = "text",
    broadcast_terms: int = BROADCAST_TERMS,
    salts: int = SALTS,
) -> DataFrame:
    """``(key, term)`` for every term between two word boundaries of a text.

    ``terms`` has one distinct, non-empty, lower-cased ``term`` per row and
    ``text`` is lower-cased.  The test is an equi-join on grams of adjacent runs
    (see :func:`term_grams`), so the cost is linear in text and hits, not in
    texts x terms.
    """
    stats = terms.agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(term_shape(F.col("term"))).alias("shapes")
    ).first()
    # a handful of small numbers, one per distinct term length
    shapes = [(r["word"], r["runs"]) for r in stats["shapes"]] or [(True, 1)]
    text = F.col(text) if isinstance(text, str) else text
    grams = texts.select(key, F.explode(term_grams(text, shapes)).alias("term"))
    if stats["n"] <= broadcast_terms:
        found = grams.join(F.broadcast(terms.select("term")), "term")
        return found.select(key, "term").distinct()
    # a frequent word occurs in most texts: spread it over `salts` tasks
    salted = terms.select("term", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return (
        grams.withColumn("salt", F.pmod(F.hash(key), F.lit(salts)))
        .join(salted, ["term", "salt"])
        .select(key, "term")
        .distinct()
    )


def term_stats(hits: DataFrame, profile_terms: DataFrame) -> DataFrame:
    """Postings and profiles per term, for terms both sides have."""
    postings = hits.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    profiles = profile_terms.groupBy("term").agg(F.count(F.lit(1)).alias("profiles"))
    return postings.join(profiles, "term")
