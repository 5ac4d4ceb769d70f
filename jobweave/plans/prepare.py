"""Raw postings to unique, tagged, rankable postings in one pass over the text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.keys import folded_description, identities
from jobweave.operators.classify import class_text, classify
from jobweave.operators.dedup import KEYS, kept_ordinals, with_dedup_keys
from jobweave.operators.quality import is_valid, normalize, profile_features
from jobweave.operators.rank import POSTING_COLUMNS, posting_features, profile_vocabulary
from jobweave.operators.scratch import Scratch
from jobweave.vocab import SENIORITY_TERMS, Taxonomy


@dataclass
class Prepared:
    """Narrow tables: nothing here carries the description."""

    staged: DataFrame  # every normalised posting, with `valid`
    unique: DataFrame  # kept postings with tags and ranking features
    kept: DataFrame  # ordinal of every kept posting
    people: DataFrame  # profiles with ranking features


def prepare(
    postings: DataFrame,
    profiles: DataFrame,
    scratch: Scratch,
    *,
    taxonomy: Taxonomy | None = None,
    seniority_terms=SENIORITY_TERMS,
    keep: tuple[str, ...] = (),
    identify: bool = False,
) -> Prepared:
    """Normalise, validate, tag, de-duplicate.

    Tags, seniority, term hits and duplicate keys are all functions of one
    posting, so one projection over the scan computes them and drops the text;
    only narrow rows are shuffled by the de-duplication.  ``identify`` adds the
    identities that history tables need.
    """
    people = profile_features(profiles)
    folded = F.col("_folded")
    normalized = (
        normalize(postings)
        .withColumn("_folded", folded_description())
        .withColumn("valid", is_valid())
    )
    if identify:
        normalized = normalized.withColumn("identities", identities(folded))
        keep = (*keep, "identities", "source_job_id")
    tagged = classify(
        with_dedup_keys(normalized, folded), taxonomy, text=class_text(folded)
    )
    features = scratch.keep(
        posting_features(
            tagged,
            profile_vocabulary(people),
            keep=(*KEYS, "seniority", "valid", *keep),
            seniority_terms=seniority_terms,
        ),
        "features",
    )
    valid = features.filter("valid")
    kept = scratch.keep(
        kept_ordinals(valid.select("ordinal", *KEYS), scratch), "kept"
    )
    unique = valid.join(kept, "ordinal", "left_semi").select(
        *POSTING_COLUMNS, "seniority", *keep
    )
    return Prepared(
        staged=features,
        unique=scratch.keep(unique, "unique"),
        kept=kept,
        people=people,
    )
