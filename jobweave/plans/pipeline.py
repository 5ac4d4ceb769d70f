"""The two end-to-end runs and the labelled-set evaluation."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.classify import classify
from jobweave.operators.evaluate import label_accuracy, relevance_at_k
from jobweave.operators.quality import consenting, profile_features, validate
from jobweave.operators.quality import normalize as normalize_postings
from jobweave.operators.rank import posting_features, profile_vocabulary, rank_matches
from jobweave.operators.report import run_counts
from jobweave.operators.scratch import Scratch
from jobweave.plans.history import History, persist_run
from jobweave.plans.prepare import Prepared, prepare
from jobweave.plans.sinks import summary_path, write_matches, write_report, write_summary
from jobweave.schemas import PROFILE_SCHEMA
from jobweave.sources import aliased, approved
from jobweave.sources.profiles import read_labelled, read_profiles
from jobweave.sources.registry import ensure_allowed, union_sources
from jobweave.vocab import RankingWeights, Taxonomy


class RunFailed(RuntimeError):
    """A run that cannot complete safely."""


@dataclass
class Run:
    run_id: str
    ranked: DataFrame
    summary: DataFrame  # one row
    rejects: DataFrame  # stage, ordinal, reason
    prepared: Prepared


def load_source(
    spark: SparkSession,
    name: str,
    path: str,
    *,
    since_date: str | None = None,
    source_limit: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(postings, rejects, raw records)`` of one approved source."""
    ensure_allowed(name)
    if name == "approved_json":
        if since_date is not None or source_limit is not None:
            raise RunFailed("since_date and source_limit need an aliased export")
        return approved.read_approved(spark, path)
    if name != aliased.ALIASED_SOURCE_NAME:
        raise RunFailed(f"no reader for source '{name}'")
    raw = aliased.read_aliased(spark, path)
    loaded, bad = aliased.to_postings(aliased.map_fields(raw))
    recent = aliased.since(loaded, since_date)
    if since_date is not None:
        bad = bad.unionByName(aliased.undated(recent))
    return aliased.first_records(recent, source_limit), bad, raw


def run_export(
    spark: SparkSession,
    *,
    source_name: str,
    input_path: str,
    profiles_path: str,
    output_path: str,
    scratch: Scratch,
    limit: int | None = None,
    since_date: str | None = None,
    source_limit: int | None = None,
    dry_run: bool = False,
    history_root: str | None = None,
    taxonomy: Taxonomy | None = None,
    weights: RankingWeights | None = None,
) -> Run:
    """Ingest, check, de-duplicate, tag, rank and export.

    A dry run computes everything and writes nothing but scratch tables.
    """
    began = time.perf_counter()
    if limit is not None and limit < 1:
        raise RunFailed("limit must be a positive integer")
    postings, bad, raw = load_source(
        spark, source_name, input_path, since_date=since_date, source_limit=source_limit
    )
    postings = scratch.keep(postings, "postings")
    raw_count = raw.count()
    if raw_count == 0:
        raise RunFailed(f"{input_path} holds no records")
    if not postings.limit(1).collect():
        raise RunFailed(f"every record of {input_path} was refused")
    profiles = read_profiles(spark, profiles_path)
    prepared = prepare(postings, profiles, scratch, taxonomy=taxonomy, identify=True)
    if not prepared.kept.limit(1).collect():
        raise RunFailed("no posting passed the checks after normalisation")
    people, silent = consenting(prepared.people)
    ranked = scratch.keep(
        rank_matches(prepared.unique, people, scratch, limit=limit, weights=weights), "ranked"
    )
    _, invalid = validate(normalize_postings(postings))
    rejects = scratch.keep(
        bad.unionByName(invalid).unionByName(silent), "rejects"
    )

    run_id = str(uuid.uuid4())
    now = datetime.now(UTC).isoformat()
    summary = scratch.keep(
        run_counts(prepared.staged, prepared.unique, prepared.people, ranked).withColumns(
            {
                "run_id": F.lit(run_id),
                "timestamp": F.lit(now),
                "source": F.lit(source_name),
                "source_since_date": F.lit(since_date).cast("string"),
                "source_limit": F.lit(source_limit).cast("int"),
                "input_path": F.lit(input_path),
                "profiles_path": F.lit(profiles_path),
                "output_path": F.lit(output_path),
                "raw_count": F.lit(raw_count).cast("bigint"),
                "warning_count": F.lit(rejects.count()).cast("bigint"),
                "runtime_seconds": F.lit(round(time.perf_counter() - began, 3)),
                "dry_run": F.lit(dry_run),
            }
        ),
        "summary",
    )
    if not dry_run:
        history = History(spark, history_root) if history_root else None
        if history:
            history.preflight()
        write_matches(ranked, output_path)
        if history:
            persist_run(
                history, run_id=run_id, run_type="mvp", source=source_name,
                postings=postings, prepared=prepared, ranked=ranked, scratch=scratch,
                now=now, started_at=now, counts=summary, warnings=rejects.count(),
                runtime_seconds=round(time.perf_counter() - began, 3),
                paths={"input_path": input_path, "profiles_path": profiles_path,
                       "output_path": output_path},
            )
        write_summary(summary, summary_path(output_path))
    return Run(run_id, ranked, summary, rejects, prepared)


def run_report(
    spark: SparkSession,
    sources: Sequence[tuple[str, DataFrame]],
    profiles: DataFrame | None,
    output_path: str,
    scratch: Scratch,
    *,
    limit: int | None = None,
    history_root: str | None = None,
    taxonomy: Taxonomy | None = None,
) -> Run:
    """Thin run over several loaded sources: one report, then the history."""
    for name, _ in sources:
        ensure_allowed(name)
    postings = scratch.keep(union_sources([df for _, df in sources]), "postings")
    if profiles is None:
        profiles = spark.createDataFrame([], PROFILE_SCHEMA)
    prepared = prepare(postings, profiles, scratch, taxonomy=taxonomy, identify=True)
    people, silent = consenting(prepared.people)
    ranked = scratch.keep(
        rank_matches(prepared.unique, people, scratch, limit=limit), "ranked"
    )
    _, invalid = validate(normalize_postings(postings))
    run_id = str(uuid.uuid4())
    now = datetime.now(UTC).isoformat()
    label = ", ".join(name for name, _ in sources)
    counts = scratch.keep(
        run_counts(prepared.staged, prepared.unique, prepared.people, ranked).withColumn(
            "raw_count", F.col("normalized_count")
        ),
        "summary",
    )
    report = counts.select(
        F.col("raw_count").alias("raw_jobs"), F.col("valid_count").alias("valid_jobs"),
        F.col("invalid_count").alias("invalid_jobs"), F.col("unique_count").alias("deduplicated_jobs"),
    )
    write_report(
        report, prepared.unique,
        ranked.select("student_key", "name", "rank_position", "ordinal", "title", "company",
                      "url", "score", "reasons", "seniority_label"),
        output_path,
    )
    if history_root:
        persist_run(
            History(spark, history_root), run_id=run_id, run_type="thin", source=label,
            postings=postings, prepared=prepared, ranked=ranked, scratch=scratch, now=now,
            counts=counts, paths={"output_path": output_path},
        )
    return Run(run_id, ranked, counts, invalid.unionByName(silent), prepared)


def student_matches(
    postings: DataFrame, profiles: DataFrame, student_key: str, scratch: Scratch
) -> DataFrame:
    """All ranked matches of one student over tagged or untagged postings."""
    people = profile_features(profiles).filter(F.col("student_key") == student_key)
    features = scratch.keep(
        posting_features(postings, profile_vocabulary(people)), "features"
    )
    return rank_matches(features, people, scratch, limit=None)


def evaluate_labelled(
    spark: SparkSession, path: str, scratch: Scratch, taxonomy: Taxonomy | None = None
) -> DataFrame:
    """One row: record count, tag accuracies, ranking relevance at 3.

    Postings are ranked without tags, as labelled.
    """
    postings, profiles = read_labelled(spark, path)
    people = profile_features(profiles)
    accuracy = label_accuracy(classify(postings, taxonomy))
    features = scratch.keep(
        posting_features(postings, profile_vocabulary(people)), "features"
    )
    ranked = rank_matches(features, people, scratch, limit=3)
    sets = people.withColumn("label_set", F.col("profile_no"))
    wanted = (
        sets.select("label_set", F.explode("expected_top_job_ids").alias("label_id"))
        .join(postings.select("label_id", "ordinal"), "label_id")
        .select("label_set", "ordinal")
    )
    relevance = relevance_at_k(sets, ranked, wanted).select("ranking_relevance")
    one = F.lit(1)
    return accuracy.withColumn("_one", one).join(relevance.withColumn("_one", one), "_one").drop("_one")
