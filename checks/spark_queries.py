"""The registered queries: library operators over the derived tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from jobweave.functions.keys import entity_key, identities
from jobweave.functions.text import casefold, collapse
from jobweave.functions.urls import canonical_url, url_host
from jobweave.operators import quality, report, state, terms, trends
from jobweave.operators.classify import classify, keyword_stats, rank_text, seniority_label
from jobweave.operators.dedup import (
    KEYS,
    attribute_duplicates,
    deduplicate,
    kept_ordinals,
    with_dedup_keys,
)
from jobweave.operators.evaluate import label_accuracy, relevance_at_k
from jobweave.operators.rank import (
    authorized_matches,
    export_position,
    posting_features,
    profile_vocabulary,
    rank_matches,
)
from jobweave.operators.scratch import Scratch
from jobweave.plans.history import TEXT_CODEC, History, persist_run, with_sole
from jobweave.plans.prepare import Prepared, prepare
from jobweave.schemas import POSTING_SCHEMA
from jobweave.sources import aliased
from jobweave.sources.registry import allowed_only, registry, source_decisions, union_sources
from jobweave.streaming.ingest import ingest_stream
from jobweave.vocab import RankingWeights

Query = Callable[[SparkSession, str], DataFrame]
SINCE = "2026-06-02"
RUN1_BEFORE = date(2026, 4, 20)


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return quality.normalize(fx.postings(spark, sf)).filter(quality.is_valid())


def _sha(c) -> F.Column:
    return F.sha2(c, 256)


def _prepared(
    spark: SparkSession, sf: str, scratch: Scratch, keep: tuple[str, ...] = ()
) -> Prepared:
    return prepare(
        fx.postings(spark, sf),
        fx.profiles(spark, sf),
        scratch,
        taxonomy=fx.TAXONOMY,
        seniority_terms=fx.SENIORITY,
        keep=keep,
    )


def _top(spark: SparkSession, sf: str, k: int | None, only: str | None = None) -> tuple:
    scratch = Scratch(spark)
    p = _prepared(spark, sf, scratch)
    people, _ = quality.consenting(p.people)
    if only is not None:
        people = people.filter(F.col("student_key") == only)
    return p, people, rank_matches(p.unique, people, scratch, limit=k), scratch


def _wide(spark, sf, weights: RankingWeights) -> DataFrame:
    """Three best postings for profiles that want thirty words, all of which count as
    frequent here: more than the classes take in."""
    scratch = Scratch(spark)
    p = prepare(fx.postings(spark, sf), fx.wide_profiles(spark, sf), scratch, taxonomy=fx.TAXONOMY,
                seniority_terms=fx.SENIORITY)
    people, _ = quality.consenting(p.people)
    ranked = rank_matches(p.unique, people, scratch, limit=3, weights=weights, pair_budget=1000)
    return ranked.select(
        "profile_no", "rank_position", "ordinal", "score", _reasons()
    )


def _reasons() -> F.Column:
    return F.array_join("reasons", "; ").alias("reasons")


# --- text, keys, ingest -----------------------------------------------------


def q_normalize(spark, sf):
    return quality.normalize(fx.postings(spark, sf)).select(
        "ordinal", "title", "company", "location",
        _sha(F.col("description")).alias("description_sha"),
        _sha(collapse(casefold(F.col("description")))).alias("folded_sha"),
        "employment_type", "seniority",
    )


def q_url_census(spark, sf):
    return (
        fx.table(spark, sf, "pages")
        .select("page_id", canonical_url(F.col("url")).alias("canonical_url"),
                url_host(F.col("url")).alias("host"))
        .groupBy("canonical_url", "host")
        .agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))
    )


def q_content_keys(spark, sf):
    return (
        with_dedup_keys(_valid(spark, sf))
        .groupBy("key_content")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("ordinal").alias("first_ordinal"))
    )


def q_keyword_stats(spark, sf):
    return keyword_stats(_valid(spark, sf), fx.TAXONOMY)


def q_term_stats(spark, sf):
    people, _ = quality.consenting(quality.profile_features(fx.profiles(spark, sf)))
    hits = terms.match_terms(_valid(spark, sf), profile_vocabulary(people), text=rank_text())
    each = people.select(
        F.explode(F.array_distinct(F.concat("skill_terms", "role_terms"))).alias("term")
    )
    return terms.term_stats(hits, each)


def _aliased(spark, sf) -> tuple[DataFrame, DataFrame]:
    return aliased.to_postings(aliased.map_fields(fx.raw_aliased(spark, sf)))


def q_ingest_aliased(spark, sf):
    good, _ = _aliased(spark, sf)
    return good.select(
        "ordinal", "source_job_id",
        (F.get_json_object("raw_metadata", "$.source_job_id_was_generated") == "true").alias("generated"),
        "title", "company", "location", _sha(F.col("description")).alias("description_sha"),
        "url", "posted_date",
        F.array_join("concentration_tags", ";").alias("concentration_tags"), "opt_cpt_flag",
    )


def q_since_date(spark, sf):
    good, _ = _aliased(spark, sf)
    return aliased.since(good, SINCE).select(
        "ordinal", "source_job_id", "posted_date", F.col("posted_date").isNull().alias("undated")
    )


def q_source_limit(spark, sf):
    good, _ = _aliased(spark, sf)
    return aliased.first_records(aliased.since(good, SINCE), 25).select("ordinal", "source_job_id")


def q_union_sources(spark, sf):
    good, _ = _aliased(spark, sf)
    return union_sources([fx.postings(spark, sf), good]).select(
        "ordinal", "source", quality.strip(F.col("title")).alias("title"), "company"
    )


def q_approved_sources(spark, sf):
    posts = fx.postings(spark, sf)
    reg = registry(spark, fx.REGISTRY)
    per_source = posts.groupBy("source").agg(F.count(F.lit(1)).alias("postings"))
    loaded = allowed_only(posts, reg).groupBy("source").agg(F.count(F.lit(1)).alias("loaded"))
    return (
        source_decisions(per_source, reg)
        .join(per_source, "source")
        .join(loaded, "source", "left")
        .select("source", "status", "allowed", "postings", F.coalesce("loaded", F.lit(0)).alias("loaded"))
    )


def q_rejects(spark, sf):
    _, broken = quality.check_contract(fx.postings(spark, sf))
    _, skipped = _aliased(spark, sf)
    return broken.unionByName(skipped)


def q_validate_counts(spark, sf):
    raw = fx.raw_aliased(spark, sf)
    good, _ = _aliased(spark, sf)
    normalized = quality.normalize(fx.postings(spark, sf))
    stages = normalized.agg(
        F.count(F.lit(1)).alias("normalized_count"), F.count_if(quality.is_valid()).alias("valid_count")
    )
    counts = aliased.load_counts(raw, good, aliased.since(good, SINCE))
    return counts.withColumn("one", F.lit(1)).join(stages.withColumn("one", F.lit(1)), "one").drop("one")


# --- postings ---------------------------------------------------------------


def q_dedup(spark, sf):
    return deduplicate(_valid(spark, sf), Scratch(spark)).select(
        "ordinal", "title", F.lit(0).cast("bigint").alias("undecided")
    )


def q_duplicates(spark, sf):
    scratch = Scratch(spark)
    keyed = scratch.keep(
        with_dedup_keys(_valid(spark, sf)).select("ordinal", *KEYS), "keyed"
    )
    return attribute_duplicates(keyed, kept_ordinals(keyed, scratch))


def q_dedup_chain(spark, sf):
    scratch = Scratch(spark)
    keyed = scratch.keep(fx.run_sql(spark, sf, fx.CHAINS), "chains")
    kept = scratch.keep(kept_ordinals(keyed, scratch), "kept")
    why = attribute_duplicates(keyed, kept)
    return keyed.select("ordinal").join(why, "ordinal", "left").select(
        "ordinal", F.col("kept_ordinal").isNull().alias("kept"), "kept_ordinal", "matched_on"
    )


def q_classify(spark, sf):
    return classify(_valid(spark, sf), fx.TAXONOMY).select(
        "ordinal", F.array_join("role_tags", ";").alias("role_tags"),
        F.array_join("concentration_tags", ";").alias("concentration_tags"),
    )


def q_seniority(spark, sf):
    return _valid(spark, sf).withColumn("text", rank_text()).select(
        "ordinal", seniority_label(F.col("text"), fx.SENIORITY).alias("seniority_label")
    )


def q_profile_features(spark, sf):
    return quality.profile_features(fx.profiles(spark, sf)).select(
        "profile_no", "student_key", "academic_stage", "stage", "needs_opt",
        "preferred_seniority", F.array_join("skill_terms", ";").alias("skill_terms"),
        F.array_join("role_terms", ";").alias("role_terms"),
    )


def q_profile_errors(spark, sf):
    return (
        fx.contract_profiles(spark, sf)
        .withColumn("e", quality.profile_errors())
        .select("profile_no", F.size("e").cast("bigint").alias("error_count"),
                F.array_join("e", " | ").alias("errors"))
    )


# --- ranking ----------------------------------------------------------------


def q_rank(spark, sf):
    _, _, ranked, _ = _top(spark, sf, 25)
    return ranked.select(
        "profile_no", "student_key", "ordinal", "score", _reasons(), "seniority_label",
        "rank_position",
    )


def q_topk(spark, sf):
    _, _, ranked, _ = _top(spark, sf, 5)
    return ranked.select("profile_no", "rank_position", "ordinal", "score")


def q_topk_authorized(spark, sf):
    """Profiles that need sponsorship get no posting that refuses it."""
    scratch = Scratch(spark)
    p = _prepared(spark, sf, scratch)
    people, _ = quality.consenting(p.people)
    ranked = authorized_matches(p.unique, people, scratch, limit=5)
    return ranked.select("profile_no", "rank_position", "ordinal", "score", _reasons())


def q_topk_wide(spark, sf):
    return _wide(spark, sf, RankingWeights(skill=1.5, role=2.0, concentration=4.0, opt_cpt=0.5))


def q_topk_negative(spark, sf):
    """Skills and tags that speak against a posting; the limit stays a limit."""
    return _wide(spark, sf, RankingWeights(skill=-1.0, role=3.0, concentration=-2.0))


def q_export_rows(spark, sf):
    _, _, ranked, _ = _top(spark, sf, 5)
    # the JSON column is left out: engines space JSON differently
    return report.export_rows(ranked, keep=("profile_no", "rank_position")).drop("score_breakdown")


def q_export_order(spark, sf):
    _, _, ranked, scratch = _top(spark, sf, 5)
    return export_position(ranked, scratch).select("profile_no", "ordinal", "export_position")


def q_student_matches(spark, sf):
    _, _, ranked, _ = _top(spark, sf, None, only="S1")
    return ranked.select("student_key", "ordinal", "score", _reasons(), "rank_position")


def q_digest(spark, sf):
    _, people, ranked, _ = _top(spark, sf, 3)
    return report.digests(people, ranked)


# --- reports ----------------------------------------------------------------


def q_trend_counts(spark, sf):
    return trends.trend_counts(_prepared(spark, sf, Scratch(spark)).unique)


def q_trend_rollup(spark, sf):
    unique = _prepared(spark, sf, Scratch(spark), keep=("created_at", "updated_at")).unique
    return trends.trend_rollup(unique, date(2026, 6, 15))


def q_skill_trend(spark, sf):
    scratch = Scratch(spark)
    people, _ = quality.consenting(quality.profile_features(fx.profiles(spark, sf)))
    # one pass over the texts; what is de-duplicated carries none
    features = scratch.keep(
        posting_features(with_dedup_keys(_valid(spark, sf)), profile_vocabulary(people), keep=KEYS), "features"
    )
    kept = kept_ordinals(features.select("ordinal", *KEYS), scratch)
    return trends.skill_trend(features.join(kept, "ordinal", "left_semi"))


def q_run_summary(spark, sf):
    p, _, ranked, _ = _top(spark, sf, 5)
    return report.run_counts(p.staged, p.unique, p.people, ranked)


def _labelled(spark, sf) -> DataFrame:
    labels = fx.table(spark, sf, "labels").withColumnRenamed("doc_id", "ordinal")
    return _valid(spark, sf).join(labels, "ordinal")


def q_eval_accuracy(spark, sf):
    none = F.array().cast("array<string>")

    def expected(flag: str, tag: str) -> F.Column:
        return F.when(F.col(flag) == 1, F.array(F.lit(tag))).otherwise(none)

    tagged = classify(_labelled(spark, sf), fx.TAXONOMY)
    return label_accuracy(
        tagged.withColumn(
            "expected_role_tags", expected("quality", "Data Analyst / BI Engineer")
        ).withColumn("expected_concentration_tags", expected("toxic", "Cybersecurity"))
    )


def q_eval_rel3(spark, sf):
    scratch = Scratch(spark)
    none = F.array().cast("array<string>")
    people, _ = quality.consenting(quality.profile_features(fx.profiles(spark, sf)))
    plain = _labelled(spark, sf).withColumn("role_tags", none).withColumn("concentration_tags", none)
    features = scratch.keep(
        posting_features(plain, profile_vocabulary(people), seniority_terms=fx.SENIORITY),
        "features",
    )
    ranked = rank_matches(features, people, scratch, limit=3)
    # the same postings, without a second pass over their texts
    wanted = features.select((F.col("ordinal") % 50).alias("label_set"), "ordinal")
    sets = people.withColumn("label_set", F.col("profile_no") % 50)
    return relevance_at_k(sets, ranked, wanted)


# --- history ----------------------------------------------------------------


def q_identities(spark, sf):
    return (
        _valid(spark, sf)
        .select("ordinal", F.explode(identities()).alias("i"))
        .select(
            "ordinal", F.col("i.priority").cast("bigint").alias("priority"),
            "i.identity_type", "i.identity_value",
            entity_key("normalized", F.col("i")).alias("normalized_key"),
            entity_key("job", F.col("i")).alias("job_key"),
        )
    )


def q_validation_status(spark, sf):
    normalized = quality.normalize(fx.postings(spark, sf))
    return state.validation_status(
        normalized.withColumn("valid", quality.is_valid()).withColumn("identities", identities())
    )


def _two_runs(spark, sf, ranked: bool) -> History:
    """History after run-1 (earlier postings) and run-2 (all postings)."""
    history = History(spark, Scratch(spark).root + "/history")
    early = fx.postings(spark, sf).filter(F.col("posted_date") < F.lit(RUN1_BEFORE))
    for run_id, rows in (("run-1", early), ("run-2", fx.postings(spark, sf))):
        scratch = Scratch(spark)
        p = prepare(rows, fx.profiles(spark, sf), scratch, taxonomy=fx.TAXONOMY,
                    seniority_terms=fx.SENIORITY, identify=True)
        matches = None
        if ranked:
            people, _ = quality.consenting(p.people)
            matches = rank_matches(p.unique, with_sole(people), scratch, limit=5, keep=("sole_profile",))
        persist_run(
            history, run_id=run_id, run_type="check", source="documents",
            postings=rows, prepared=p, ranked=matches, scratch=scratch,
            now="2026-06-15T00:00:00+00:00",
        )
    return history


def q_identity_resolve(spark, sf):
    scratch = Scratch(spark)
    valid = _valid(spark, sf)
    early = valid.filter(F.col("posted_date") < F.lit(RUN1_BEFORE))

    def unique(rows: DataFrame) -> DataFrame:
        narrow = scratch.keep(
            with_dedup_keys(rows).select("ordinal", *KEYS, identities().alias("identities")), "ids"
        )
        kept = kept_ordinals(narrow.select("ordinal", *KEYS), scratch)
        unique = narrow.join(kept, "ordinal", "left_semi").select("ordinal", "identities")
        return scratch.keep(unique, "unique-ids")

    first = unique(early)
    stored = (
        first.select("ordinal", F.explode("identities").alias("i"))
        .join(state.resolve_job_keys(first, None), "ordinal")
        .select("i.identity_type", "i.identity_value", "job_key")
    )
    return state.resolve_job_keys(unique(valid), stored)


def q_seen_counts(spark, sf):
    return _two_runs(spark, sf, False).table("normalized_jobs").select(
        "normalized_key", "seen_count", "last_run_id"
    )


def q_merge(spark, sf):
    h = _two_runs(spark, sf, False)

    def rows(name: str, entity: F.Column, times: str) -> DataFrame:
        t = h.table(name)
        return t.select(
            F.lit(name).alias("table_name"), entity.alias("entity"), "job_key",
            F.col(times).alias("times"), "last_run_id",
        )

    identity = F.concat("identity_type", F.lit(":"), "identity_value")
    return (
        rows("job_identities", identity, "seen_count")
        .unionByName(rows("deduped_jobs", F.col("job_key"), "seen_count"))
        .unionByName(rows("classification_results", F.col("job_key"), "times_classified"))
    )


def q_match_history(spark, sf):
    return _two_runs(spark, sf, True).table("match_history").select(
        "match_key", "student_key", "job_key", "latest_score", "times_matched",
        "first_run_id", "last_run_id",
    )


def q_table_counts(spark, sf):
    return _two_runs(spark, sf, True).table_counts()


def q_stream_ingest(spark, sf):
    """The same two runs as files landing in a folder, read as a stream.  The files
    are cut and sorted by ordinal, so their order is that of the postings."""
    scratch = Scratch(spark)
    landing = f"{scratch.root}/landing"
    posts = fx.postings(spark, sf)
    early = F.col("posted_date") < F.lit(RUN1_BEFORE)
    history = History(spark, f"{scratch.root}/history")
    for rows in (posts.filter(early), posts):
        ranged = rows.select(*POSTING_SCHEMA.fieldNames()).repartitionByRange("ordinal")
        ranged.sortWithinPartitions("ordinal").write.mode("append").parquet(landing, compression=TEXT_CODEC)
        ingest_stream(
            spark, landing, history, f"{scratch.root}/offsets", taxonomy=fx.TAXONOMY,
            seniority_terms=fx.SENIORITY,
        )
    return history.table("deduped_jobs").select("job_key", "title", "company", "seen_count")


def queries() -> dict[str, Query]:
    return {
        name: fn for name, fn in sorted(globals().items())
        if name.startswith("q_") and callable(fn)
    }
