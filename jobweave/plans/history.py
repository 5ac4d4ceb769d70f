"""History tables over runs: append-only deltas made visible by a manifest.

A run writes its folded deltas to new folders and then one manifest entry per
table, in one file, written last.  Readers see a run completely or not at all.
One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.keys import entity_key, match_key
from jobweave.operators.quality import normalize
from jobweave.operators.report import run_counts
from jobweave.operators.scratch import Scratch
from jobweave.operators.skew import lookup_join
from jobweave.operators.state import (
    Spec,
    delta,
    merge_snapshot,
    resolve_job_keys,
    sole_rows,
    validation_status,
    visible,
)
from jobweave.plans.prepare import Prepared
from jobweave.schemas import POSTING_SCHEMA
from jobweave.vocab import CLASSIFIER_VERSION, RANKER_VERSION

COUNTS = (
    "raw_count", "normalized_count", "valid_count", "invalid_count", "duplicate_count",
    "unique_count", "classified_count", "profile_count", "active_profile_count",
    "total_ranked_matches",
)
_JOB_LAST = ("canonical_url", "content_signature", "last_seen_at", "last_run_id")
_PAIR = ("student_key", "profile_version", "job_key", "ranker_version")
# what the history keeps of a match; postings have tables of their own
_MATCH = (
    "profile_no", "student_key", "profile_version", "ordinal", "score", "rank_position",
    "reasons", "seniority_label",
)
# both tables of matches have one key, so they are one fold
_SCORED = Spec(_PAIR, (), ("score", "rank_position", "reasons", "seniority"))
# Up to this many matched postings their keys are broadcast.
BROADCAST_POSTINGS = 100_000

SPECS: dict[str, Spec] = {
    "pipeline_runs": Spec(
        ("run_id",),
        ("started_at", "created_at"),
        ("run_type", "source", "completed_at", "input_path", "profiles_path",
         "output_path", *COUNTS, "warnings", "runtime_seconds", "updated_at"),
    ),
    "normalized_jobs": Spec(
        ("normalized_key",),
        ("first_seen_at",),
        ("source", "source_job_id", "validation_status", *_JOB_LAST),
        "seen_count",
    ),
    "deduped_jobs": Spec(
        ("job_key",),
        ("first_seen_at",),
        ("source", "source_job_id", "title", "company", "location", *_JOB_LAST),
        "seen_count",
    ),
    "job_identities": Spec(
        ("identity_type", "identity_value"),
        ("first_seen_at",),
        ("job_key", "last_seen_at", "last_run_id"),
        "seen_count",
    ),
    "classification_results": Spec(
        ("job_key", "classifier_version"),
        ("first_classified_at",),
        ("role_tags", "concentration_tags", "last_classified_at", "last_run_id"),
        "times_classified",
    ),
    "ranking_scores": Spec(
        _PAIR,
        ("first_scored_at",),
        ("score", "rank_position", "reasons", "seniority", "last_scored_at", "last_run_id"),
        "times_scored",
    ),
    "match_history": Spec(
        _PAIR,
        ("first_run_id", "first_matched_at"),
        ("match_key", "latest_score", "reasons", "seniority", "last_matched_at",
         "last_run_id"),
        "times_matched",
    ),
}
PAYLOAD = "payload"
TEXT_CODEC = "zstd"  # of tables with whole texts
_MANIFEST = "seq bigint, run_id string, table string, path string, replaces boolean"


class History:
    """The history tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- manifest --

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def preflight(self) -> None:
        """Make sure the root can be written before anything else is."""
        fs, p = self._fs(self.root)
        if not fs.mkdirs(p):
            raise OSError(f"history root cannot be created: {self.root}")

    def _entries(self) -> list:
        """Live manifest entries; the manifest has a few short rows per run."""
        path = f"{self.root}/_manifest"
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        rows = self.spark.read.schema(_MANIFEST).json(path).collect()
        start: dict[str, int] = {}
        for r in rows:
            if r["replaces"]:
                start[r["table"]] = max(r["seq"], start.get(r["table"], 0))
        live = [r for r in rows if r["seq"] >= start.get(r["table"], 0)]
        return sorted(live, key=lambda r: (r["seq"], r["table"]))

    def next_seq(self) -> int:
        return 1 + max((r["seq"] for r in self._entries()), default=0)

    def has_run(self, run_id: str) -> bool:
        runs = self.state("pipeline_runs")
        return runs is not None and bool(runs.filter(F.col("run_id") == run_id).limit(1).collect())

    # -- reading --

    def _parts(self, name: str) -> list[DataFrame]:
        paths = [r["path"] for r in self._entries() if r["table"] == name]
        return [self.spark.read.parquet(f"{self.root}/{p}") for p in paths]

    def state(self, name: str) -> DataFrame | None:
        """Folded deltas of a table, None before the first run."""
        parts = self._parts(name)
        if not parts:
            return None
        union = reduce(lambda a, b: a.unionByName(b), parts[1:], parts[0])
        return union if len(parts) == 1 else merge_snapshot(union.limit(0), union, SPECS[name])

    def table(self, name: str) -> DataFrame:
        state = self.state(name)
        if state is None:
            raise LookupError(f"no run has been published under {self.root}")
        return visible(state, SPECS[name])

    def job_json(self, name: str) -> DataFrame:
        """``normalized_jobs`` or ``deduped_jobs`` keys with the latest posting."""
        parts = self._parts(PAYLOAD)
        posts = reduce(lambda a, b: a.unionByName(b), parts[1:], parts[0])
        spec = SPECS[name]
        return (
            self.state(name)
            .select(*spec.keys, F.col("_last_seq.run").alias("run_seq"), F.col("_last_seq.pos").alias("ordinal"))
            .join(posts, ["run_seq", "ordinal"])
            .select(*spec.keys, F.to_json(F.struct(*POSTING_SCHEMA.fieldNames())).alias("job_json"))
        )

    def table_counts(self, *names: str) -> DataFrame:
        parts = [
            self.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(n).alias("table_name"), "row_count"
            )
            for n in (names or tuple(SPECS))
        ]
        return reduce(lambda a, b: a.unionByName(b), parts[1:], parts[0])

    # -- writing --

    def publish(self, seq: int, run_id: str, tables: Mapping[str, DataFrame], *, replaces: bool = False) -> None:
        """Write all tables, then make them visible together."""
        paths = {name: f"{name}/v={seq:010d}" for name in tables}

        def write(name: str) -> None:
            # a folder of the same number can only be left over from a failed run
            codec = TEXT_CODEC if name == PAYLOAD else None
            tables[name].write.mode("overwrite").parquet(f"{self.root}/{paths[name]}", compression=codec)

        # independent jobs: let Spark run them side by side
        with ThreadPoolExecutor(max_workers=4) as pool:
            list(pool.map(write, tables))
        rows = [(seq, run_id, name, path, replaces) for name, path in paths.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").json(
            f"{self.root}/_manifest"
        )

    def compact(self) -> None:
        """Fold the deltas of every table into one; the payload stays as it is."""
        states = {n: self.state(n) for n in SPECS}
        self.publish(
            self.next_seq(), "compaction",
            {n: s for n, s in states.items() if s is not None}, replaces=True,
        )


def with_sole(people: DataFrame) -> DataFrame:
    """Add ``sole_profile``: no other profile has this one's number, or its student key
    and version.  Matches that carry it (``keep`` of ``rank_matches``) mostly need no
    fold in :func:`persist_run`."""
    sole = sole_rows(people, "profile_no", ("student_key", "profile_version"))
    return people.join(sole.withColumn("sole_profile", F.lit(True)), "profile_no", "left")


def persist_run(
    history: History,
    *,
    run_id: str,
    run_type: str,
    source: str,
    postings: DataFrame,
    prepared: Prepared,
    ranked: DataFrame | None,
    scratch: Scratch,
    now: str,
    started_at: str | None = None,
    paths: Mapping[str, str | None] | None = None,
    counts: DataFrame | None = None,
    warnings: int = 0,
    runtime_seconds: float | None = None,
) -> None:
    """Fold one finished run into all history tables.

    ``prepared`` must have been made with ``identify=True`` from ``postings``;
    ``counts`` is a one-row run summary and defaults to the stage counters.
    """
    history.preflight()
    seq = history.next_seq()
    at = F.lit(now)
    run = F.lit(run_id)

    def of(kind: str) -> Column:
        return F.get(
            F.filter("identities", lambda i: i["identity_type"] == kind), F.lit(0)
        )["identity_value"]

    def stamped(df: DataFrame, first: str, last: str) -> DataFrame:
        return df.withColumns({first: at, last: at, "last_run_id": run})

    jobs = prepared.staged.withColumns(
        {
            "source_job_id": F.nullif("source_job_id", F.lit("")),
            "canonical_url": of("canonical_url"),
            "content_signature": of("content_signature"),
        }
    )
    normalized = jobs.withColumn(
        "normalized_key", entity_key("normalized", F.get("identities", F.lit(0)))
    )
    spec = SPECS["normalized_jobs"]
    norm_delta = (
        delta(
            stamped(normalized, "first_seen_at", "last_seen_at").withColumn(
                "validation_status", F.lit("")
            ),
            spec, seq, F.col("ordinal"),
        )
        .drop("validation_status")
        .join(validation_status(prepared.staged), "normalized_key")
    )

    unique = prepared.unique.withColumns(
        {
            "canonical_url": of("canonical_url"),
            "content_signature": of("content_signature"),
        }
    )
    resolved = scratch.keep(
        resolve_job_keys(unique, history.state("job_identities")), "job-keys"
    )
    sole = scratch.keep(
        sole_rows(resolved, "ordinal", ("job_key",)).withColumn("sole_job", F.lit(True)), "sole-jobs"
    )
    keyed = scratch.keep(unique.join(resolved, "ordinal").join(sole, "ordinal", "left"), "keyed-jobs")
    seen = stamped(keyed, "first_seen_at", "last_seen_at")
    ids = seen.withColumn("i", F.explode("identities")).select("i.*", "*")
    tables = {
        "normalized_jobs": norm_delta,
        "deduped_jobs": delta(
            seen, SPECS["deduped_jobs"], seq, F.col("ordinal"), sole=F.col("sole_job")
        ),
        "job_identities": delta(ids, SPECS["job_identities"], seq, F.col("ordinal")),
        "classification_results": delta(
            stamped(keyed, "first_classified_at", "last_classified_at").withColumn(
                "classifier_version", F.lit(CLASSIFIER_VERSION)
            ),
            SPECS["classification_results"], seq, F.col("ordinal"), sole=F.col("sole_job"),
        ),
        PAYLOAD: normalize(postings).select(
            F.lit(seq).cast("bigint").alias("run_seq"), *POSTING_SCHEMA.fieldNames()
        ),
    }
    matches = prepared.unique.limit(0)
    if ranked is not None:
        marks = ("sole_profile",) if "sole_profile" in ranked.columns else ()
        matches = scratch.keep(ranked.select(*_MATCH, *marks), "ranked")
        per_posting = scratch.keep(
            matches.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")), "ranked-postings"
        )
        job_keys = scratch.keep(
            resolved.select("ordinal", "job_key").join(per_posting, "ordinal", "left_semi").join(sole, "ordinal", "left"),
            "ranked-keys",
        )
        if job_keys.count() <= BROADCAST_POSTINGS:
            found = matches.join(F.broadcast(job_keys), "ordinal")
        else:  # a popular posting is matched by very many profiles
            found = lookup_join(matches, job_keys, "ordinal", counts=per_posting, total_rows=matches.count())
        scored = found.withColumns(
            {"ranker_version": F.lit(RANKER_VERSION), "seniority": F.col("seniority_label")}
        )
        order = (F.col("profile_no"), F.col("rank_position"))
        alone = F.col("sole_profile") & F.col("sole_job") if marks else None
        pairs = scratch.keep(delta(scored, _SCORED, seq, *order, sole=alone), "pairs").withColumns(
            {
                "latest_score": F.col("score"),
                "match_key": match_key(F.col("student_key"), F.col("profile_version"), F.col("job_key")),
                "first_run_id": run,
                "last_run_id": run,
                **{c: at for c in ("first_scored_at", "last_scored_at", "first_matched_at", "last_matched_at")},
            }
        )
        for name in ("ranking_scores", "match_history"):
            spec = SPECS[name]
            tables[name] = pairs.select(
                *spec.keys, *spec.last, *spec.first, "_n", "_first_seq", "_last_seq"
            )

    summary = counts if counts is not None else run_counts(
        prepared.staged, prepared.unique, prepared.people, matches
    )
    where = dict(paths or {})
    values: dict[str, Column] = {
        "run_id": run, "run_type": F.lit(run_type), "source": F.lit(source),
        "started_at": F.lit(started_at or now), "completed_at": at, "created_at": at,
        "updated_at": at, "warnings": F.lit(warnings).cast("bigint"),
        "runtime_seconds": F.lit(runtime_seconds).cast("double"),
        **{p: F.lit(where.get(p)).cast("string") for p in ("input_path", "profiles_path", "output_path")},
    }
    for c in COUNTS:
        fallback = "normalized_count" if c not in summary.columns else c
        values[c] = F.col(fallback).cast("bigint")
    tables["pipeline_runs"] = delta(
        summary.select(*[v.alias(k) for k, v in values.items()]),
        SPECS["pipeline_runs"], seq, F.lit(0),
    )
    history.publish(seq, run_id, tables)
