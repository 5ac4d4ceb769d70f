"""Registered queries of the sources and sinks: tables derived from the given ones are
written as export files, read by the library and compared with what was in them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import oracles as o
from checks.spark_queries import _sha, _top, _two_runs
from jobweave.operators import quality, report
from jobweave.operators.scratch import Scratch
from jobweave.operators.skew import number_rows
from jobweave.plans.sinks import summary_path, write_matches, write_summary
from jobweave.sources import aliased
from jobweave.sources.approved import read_approved
from jobweave.sources.profiles import read_labelled, read_profiles

Query = Callable[[SparkSession, str], DataFrame]
PER_FILE = 200  # records of a derived whole-document export


def _folder(scratch: Scratch, name: str) -> str:
    return f"{scratch.root}/{name}"


def _in_order(df: DataFrame) -> DataFrame:
    """Files that follow each other hold records that do."""
    return df.repartitionByRange("ordinal").sortWithinPartitions("ordinal")


def _bucket(key: str = "ordinal") -> Column:
    return F.lpad((F.col(key) / PER_FILE).cast("long").cast("string"), 8, "0")


def _documents(records: DataFrame, body: Column, path: str) -> str:
    """One JSON document a bucket from (bucket, ordinal, record); ``body`` makes it of
    ``records``, the bucket's records in order."""
    whole = records.groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "record")))["record"].alias("records")
    )
    whole.select("bucket", F.to_json(body).alias("value")).write.partitionBy("bucket").text(path)
    return path


def _numbered(df: DataFrame, scratch: Scratch, key: str = "ordinal") -> DataFrame:
    """``position``: 1 for the first record in input order, and so on."""
    return number_rows(df, [F.col(key)], "position", scratch)


# --- aliased exports --------------------------------------------------------


def _loaded(raw: DataFrame, scratch: Scratch) -> DataFrame:
    good, _ = aliased.to_postings(aliased.map_fields(raw))
    return _numbered(scratch.keep(good, "loaded"), scratch).select(
        "position", "source_job_id",
        (F.get_json_object("raw_metadata", "$.source_job_id_was_generated") == "true").alias("generated"),
        "title", "company", "location", _sha(F.col("description")).alias("description_sha"),
        "url", "posted_date",
        F.array_join("concentration_tags", ";").alias("concentration_tags"), "opt_cpt_flag",
    )


def q_scan_csv(spark, sf):
    scratch = Scratch(spark)
    path = _folder(scratch, "export-csv")
    rows = _in_order(fx.raw_aliased(spark, sf)).drop("ordinal")
    writer = rows.write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _loaded(aliased.read_aliased_csv(spark, path), scratch)


def q_scan_jsonl(spark, sf):
    scratch = Scratch(spark)
    path = _folder(scratch, "export-jsonl")
    _in_order(fx.raw_aliased(spark, sf)).drop("ordinal").write.json(path)
    return _loaded(aliased.read_aliased_jsonl(spark, path), scratch)


def q_scan_json(spark, sf):
    scratch = Scratch(spark)
    raw = fx.raw_aliased(spark, sf)
    fields = F.struct(*[c for c in raw.columns if c != "ordinal"])
    records = raw.select(_bucket().alias("bucket"), "ordinal", fields.alias("record"))
    path = _documents(records, F.struct(F.col("records").alias("results")), _folder(scratch, "export-json"))
    return _loaded(aliased.read_aliased_json(spark, path), scratch)


_LOADED = """SELECT row_number() OVER (ORDER BY ordinal) AS position, source_job_id, generated, title, company, location,
  sha256(description) AS description_sha, url, posted_date,
  array_to_string(concentration_tags, ';') AS concentration_tags, opt_cpt_flag FROM aliased"""


# --- approved exports -------------------------------------------------------


def _approved(spark, sf, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exports of 200 records: of every seven files one has terms nobody reviewed, one
    no approver; some records lack the company, have a bad date or no own source."""
    posts = fx.postings(spark, sf)
    nth = F.col("ordinal")
    record = F.struct(
        "title", F.when(nth % 23 != 0, F.col("company")).alias("company"), "location", "description",
        F.when(nth % 2 == 0, F.col("url")).alias("url"),
        F.when(nth % 2 == 1, F.col("url")).alias("post_url"), "source_job_id",
        F.when(nth % 5 != 0, F.col("source")).alias("source"),
        F.when(nth % 29 == 0, F.lit("soon")).otherwise(F.col("posted_date").cast("string")).alias("posted_date"),
        "employment_type", "seniority", "concentration_tags", "role_tags", "opt_cpt_flag",
        (nth * 3).alias("extra_key"),
    )
    records = posts.select(_bucket().alias("bucket"), "ordinal", record.alias("record"))
    no = F.col("bucket").cast("long")
    body = F.struct(
        F.struct(
            F.concat(F.lit(" export "), no.cast("string")).alias("source_name"),
            F.when(no % 7 != 5, F.lit("Registrar")).otherwise(F.lit(" ")).alias("approved_by"),
            F.lit("2026-04-01").alias("approval_date"), F.lit("file drop").alias("access_method"),
            (no % 7 != 3).alias("terms_reviewed"),
        ).alias("metadata"),
        F.col("records").alias("jobs"),
    )
    return read_approved(spark, _documents(records, body, _folder(scratch, "approved")), strict=False)


def q_scan_approved(spark, sf):
    scratch = Scratch(spark)
    good, _, _ = _approved(spark, sf, scratch)
    meta = lambda p: F.get_json_object("raw_metadata", p)
    return _numbered(scratch.keep(good, "approved-postings"), scratch).select(
        "position", "source", "source_job_id", "title", "company", "location",
        _sha(F.col("description")).alias("description_sha"), "posted_date", "employment_type", "seniority",
        F.array_join("concentration_tags", ";").alias("concentration_tags"),
        F.array_join("role_tags", ";").alias("role_tags"), "opt_cpt_flag",
        meta("$.approval_metadata.source_name").alias("audit_source"),
        meta("$.approval_metadata.approved_by").alias("approved_by"),
        meta("$.extra_key").cast("long").alias("extra_key"),
        meta("$.source_job_id").alias("audit_job_id"),
    )


def q_approved_rejects(spark, sf):
    scratch = Scratch(spark)
    _, bad, records = _approved(spark, sf, scratch)
    total = records.agg(F.count(F.lit(1)).alias("n"))
    return bad.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        total.select(F.lit("records").alias("stage"), F.lit("all").alias("reason"), "n")
    )


_NO = f"(ordinal - ordinal % {PER_FILE}) / {PER_FILE}"
_APPROVED = [
    *o.base_ctes(),
    ("files", f"SELECT *, CAST({_NO} AS BIGINT) AS no FROM postings_raw"),
    ("envelopes", """SELECT DISTINCT no, CASE WHEN no % 7 = 5 THEN 'metadata.approved_by: Field required'
        WHEN no % 7 = 3 THEN 'terms_reviewed must be true for approved exports' END AS refused FROM files"""),
    ("records", f"""SELECT f.*, 'export ' || no AS source_name, CASE WHEN ordinal % 23 = 0 THEN 'company: Field required'
        WHEN ordinal % 29 = 0 THEN 'posted_date: Input should be a valid date' END AS bad_record,
        CASE WHEN {o.strip('title')} = '' THEN 'title: String should have at least 1 character' END AS bad_posting
        FROM files f JOIN envelopes e USING (no) WHERE e.refused IS NULL"""),
]
_SCAN_APPROVED = f"""SELECT row_number() OVER (ORDER BY ordinal) AS position,
  CASE WHEN ordinal % 5 = 0 THEN source_name ELSE {o.strip('source')} END AS source, {o.strip('source_job_id')} AS source_job_id,
  {o.strip('title')} AS title, {o.strip('company')} AS company, {o.strip('location')} AS location,
  sha256({o.strip('description')}) AS description_sha, posted_date, {o.strip('employment_type')} AS employment_type,
  {o.strip('seniority')} AS seniority, array_to_string({o.text_list('concentration_tags_text')}, ';') AS concentration_tags,
  array_to_string({o.text_list('role_tags_text')}, ';') AS role_tags, opt_cpt_flag, source_name AS audit_source,
  'Registrar' AS approved_by, ordinal * 3 AS extra_key, source_job_id AS audit_job_id
FROM records WHERE bad_record IS NULL AND bad_posting IS NULL"""
_APPROVED_REJECTS = """SELECT 'envelope' AS stage, refused AS reason, count(*) AS n FROM envelopes WHERE refused IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'record', bad_record, count(*) FROM records WHERE bad_record IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'contract', bad_posting, count(*) FROM records WHERE bad_record IS NULL AND bad_posting IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'records', 'all', count(*) FROM records"""


# --- profiles and labelled sets ---------------------------------------------


def q_scan_profiles(spark, sf):
    scratch = Scratch(spark)
    given = fx.profiles(spark, sf).withColumns(
        {
            "match_frequency": F.when(F.col("profile_no") % 3 == 0, F.lit("Weekly")),
            "profile_version": F.when(F.col("profile_no") % 4 != 0, F.col("profile_version")),
            "ai_matching_consent": F.when(F.col("profile_no") % 5 != 0, F.col("ai_matching_consent")),
        }
    )
    fields = F.struct(*[c for c in given.columns if c != "profile_no"])
    records = given.select(
        _bucket("profile_no").alias("bucket"), F.col("profile_no").alias("ordinal"), fields.alias("record")
    )
    path = _documents(records, F.struct(F.col("records").alias("profiles")), _folder(scratch, "profiles"))
    people = scratch.keep(read_profiles(spark, path), "people")
    return _numbered(people, scratch, "profile_no").select(
        "position", "student_id", "name", "concentration", "academic_stage", "stage", "work_auth_status",
        F.array_join("target_roles", ";").alias("target_roles"), F.array_join("skills", ";").alias("skills"),
        "match_frequency", "ai_matching_consent", F.col("profile_version").cast("long").alias("profile_version"),
    )


_SCAN_PROFILES = f"""SELECT row_number() OVER (ORDER BY profile_no) AS position, {o.strip('student_id')} AS student_id, name,
  concentration, academic_stage, stage, work_auth_status,
  array_to_string({o.text_list('target_roles_text')}, ';') AS target_roles, array_to_string({o.text_list('skills_text')}, ';') AS skills,
  CASE WHEN profile_no % 3 = 0 THEN 'Weekly' ELSE 'Once a day' END AS match_frequency,
  CASE WHEN profile_no % 5 <> 0 THEN ai_matching_consent ELSE TRUE END AS ai_matching_consent,
  CAST(CASE WHEN profile_no % 4 <> 0 THEN profile_version ELSE 1 END AS BIGINT) AS profile_version FROM profiles_raw"""


def _labelled(spark, sf) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark)
    labels = fx.table(spark, sf, "labels").withColumnRenamed("doc_id", "ordinal")
    flag = lambda c, tag: F.when(F.col(c) == 1, F.array(F.lit(tag)))
    posts = fx.postings(spark, sf).join(labels, "ordinal")
    post = F.struct(
        F.concat(F.lit("p"), F.col("ordinal").cast("string")).alias("id"), "title", "company", "location",
        "description", "source", F.col("url").alias("source_url"), F.col("posted_date").cast("string").alias("posted_date"),
        "employment_type", "opt_cpt_flag", flag("quality", "Software Engineer").alias("expected_role_tags"),
        flag("toxic", "Cybersecurity").alias("expected_concentration_tags"), F.col("seniority").alias("expected_seniority"),
    )
    records = posts.select(_bucket().alias("bucket"), "ordinal", post.alias("record"))
    profile = F.struct(
        F.struct(F.concat(F.lit(" reader of "), F.col("bucket")).alias("name"), F.lit("Cybersecurity").alias("concentration")).alias("profile"),
        F.slice(F.transform("records", lambda r: r["id"]), 1, 3).alias("expected_top_job_ids"),
    )
    body = F.struct(F.col("records").alias("postings"), F.array(profile).alias("sample_profiles"))
    return read_labelled(spark, _documents(records, body, _folder(scratch, "labelled")))


def q_scan_labelled(spark, sf):
    posts, people = _labelled(spark, sf)
    wanted = people.select(
        "name", F.size("skills").cast("long").alias("skills"), F.explode("expected_top_job_ids").alias("label_id")
    )
    return posts.join(wanted, "label_id", "left").select(
        "label_id", "title", "company", _sha(F.col("description")).alias("description_sha"), "posted_date", "seniority",
        "opt_cpt_flag", F.size("role_tags").cast("long").alias("own_tags"),
        F.array_join("expected_role_tags", ";").alias("expected_role_tags"),
        F.array_join("expected_concentration_tags", ";").alias("expected_concentration_tags"),
        F.get_json_object("raw_metadata", "$.fixture_id").alias("fixture_id"), F.col("name").alias("reader"), "skills",
    )


_SCAN_LABELLED = f"""SELECT 'p' || ordinal AS label_id, {o.strip('title')} AS title, {o.strip('company')} AS company,
  sha256({o.strip('description')}) AS description_sha, posted_date, {o.strip('seniority')} AS seniority, opt_cpt_flag, 0::BIGINT AS own_tags,
  CASE WHEN quality = 1 THEN 'Software Engineer' ELSE '' END AS expected_role_tags,
  CASE WHEN toxic = 1 THEN 'Cybersecurity' ELSE '' END AS expected_concentration_tags, 'p' || ordinal AS fixture_id,
  CASE WHEN nth <= 3 THEN 'reader of ' || lpad(CAST(CAST({_NO} AS BIGINT) AS VARCHAR), 8, '0') END AS reader,
  CASE WHEN nth <= 3 THEN 0::BIGINT END AS skills
FROM (SELECT p.*, l.*, row_number() OVER (PARTITION BY {_NO} ORDER BY ordinal) AS nth
      FROM postings_raw p JOIN labels l ON l.doc_id = p.ordinal)"""


def q_profile_defaults(spark, sf):
    given = fx.contract_profiles(spark, sf).withColumns(
        {
            "skills": F.when(F.col("profile_no") % 3 != 0, F.col("skills")),
            "match_frequency": F.when(F.col("profile_no") % 4 != 0, F.col("match_frequency")),
            "profile_version": F.when(F.col("profile_no") % 5 != 0, F.col("profile_version")),
            "updated_at": F.when(F.col("profile_no") % 6 != 0, F.col("updated_at")),
        }
    )
    return quality.with_profile_defaults(given, F.lit("2026-06-15T00:00:00Z")).select(
        "profile_no", F.array_join("skills", "|").alias("skills"), "match_frequency", "ai_matching_consent",
        F.col("profile_version").cast("long").alias("profile_version"), "updated_at",
    )


_DEFAULTS = """SELECT profile_no, CASE WHEN profile_no % 3 <> 0 THEN replace(skills_text, ';', '|') ELSE '' END AS skills,
  'Once a day' AS match_frequency, coalesce(ai_matching_consent, FALSE) AS ai_matching_consent,
  CASE WHEN profile_no % 5 <> 0 THEN CAST(profile_version AS BIGINT) ELSE 1 END AS profile_version,
  CASE WHEN profile_no % 6 <> 0 THEN updated_at ELSE '2026-06-15T00:00:00Z' END AS updated_at FROM contract"""


def q_stale_profiles(spark, sf):
    saved = F.date_add(F.lit(date(2026, 4, 1)), (F.col("profile_no") % 75).cast("int"))
    people = fx.profiles(spark, sf).withColumn("updated_at", F.concat(saved.cast("string"), F.lit("T23:59:00Z")))
    return quality.stale_profiles(people, F.lit(date(2026, 6, 15))).select("profile_no", "updated_at")


_STALE = """SELECT profile_no, strftime(DATE '2026-04-01' + CAST(profile_no % 75 AS INT), '%Y-%m-%d') || 'T23:59:00Z' AS updated_at
FROM profiles_raw WHERE profile_no % 75 <= 45"""


# --- sinks ------------------------------------------------------------------


def q_export_file(spark, sf):
    """All 15 columns of the written export, read back; the file order as positions."""
    _, _, ranked, scratch = _top(spark, sf, 5)
    path = _folder(scratch, "matches.csv")
    write_matches(ranked, path)
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    )
    parts = F.from_json("score_breakdown", "metadata struct<seniority:string>, reasons array<string>")
    texts = [c for c in rows.columns if c not in ("opt_cpt_flag", "final_score", "score_breakdown", "_file", "_row")]
    return number_rows(rows, [F.col("_file"), F.col("_row")], "position", scratch).select(
        "position", *[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in texts],
        F.col("opt_cpt_flag").cast("boolean").alias("opt_cpt_flag"), F.col("final_score").cast("double").alias("final_score"),
        parts["metadata"]["seniority"].alias("breakdown_seniority"),
        F.array_join(parts["reasons"], "; ").alias("breakdown_reasons"),
    )


_EXPORT_FILE = """SELECT row_number() OVER (ORDER BY student_key, score DESC, company, title, profile_no, rank_position) AS position,
  student_key AS student_id, name AS student_name, title, company, location, coalesce(source, '') AS source,
  url AS "apply_url/post_url", array_to_string(role_tags, '; ') AS role_category,
  array_to_string(target_roles, '; ') AS target_role, array_to_string(concentration_tags, '; ') AS concentration_tags,
  seniority_label AS seniority_level, opt_cpt_flag, round(score, 4) AS final_score,
  CASE WHEN reasons = '' THEN 'No deterministic match signals found' ELSE reasons END AS ranking_explanation,
  seniority_label AS breakdown_seniority, reasons AS breakdown_reasons
FROM ranked WHERE rank_position <= 5"""


def q_summary_file(spark, sf):
    p, _, ranked, scratch = _top(spark, sf, 5)
    path = summary_path(_folder(scratch, "matches.csv"))
    counts = report.run_counts(p.staged, p.unique, p.people, ranked)
    write_summary(counts, path)
    return spark.read.json(path).select(*counts.columns)


# --- history tables that hold whole runs ------------------------------------


def q_ranking_scores(spark, sf):
    return _two_runs(spark, sf, True).table("ranking_scores").select(
        "student_key", "profile_version", "job_key", "ranker_version", "score", "rank_position",
        F.array_join("reasons", "; ").alias("reasons"), "seniority", "times_scored", "first_scored_at",
        "last_scored_at", "last_run_id",
    )


_SCORES = """SELECT student_key, profile_version, job_key, 'deterministic-v0' AS ranker_version,
  arg_max(score, k) AS score, arg_max(rank_position, k) AS rank_position, arg_max(reasons, k) AS reasons,
  arg_max(seniority_label, k) AS seniority, count(*) AS times_scored, '2026-06-15T00:00:00+00:00' AS first_scored_at,
  '2026-06-15T00:00:00+00:00' AS last_scored_at, 'run-' || max(run) AS last_run_id
FROM (SELECT *, run * 1000000000000 + profile_no * 1000 + rank_position AS k FROM (
  SELECT 1 AS run, m.*, r.job_key FROM ranked_1 m JOIN res1 r ON r.ordinal = m.ordinal WHERE m.rank_position <= 5
  UNION ALL SELECT 2, m.*, r.job_key FROM ranked_2 m JOIN res2 r ON r.ordinal = m.ordinal WHERE m.rank_position <= 5))
GROUP BY 1, 2, 3"""


def q_pipeline_runs(spark, sf):
    return _two_runs(spark, sf, True).table("pipeline_runs").select(
        "run_id", "run_type", "source", "started_at", "completed_at", "normalized_count", "valid_count",
        "invalid_count", "duplicate_count", "unique_count", "classified_count", "profile_count",
        "active_profile_count", "total_ranked_matches", "warnings", "runtime_seconds",
    )


_RUNS = " UNION ALL ".join(
    f"""SELECT 'run-{r}' AS run_id, 'check' AS run_type, 'documents' AS source, '2026-06-15T00:00:00+00:00' AS started_at,
  '2026-06-15T00:00:00+00:00' AS completed_at, (SELECT count(*) FROM norm{r}) AS normalized_count,
  (SELECT count(*) FROM keyed{r}) AS valid_count,
  (SELECT count(*) FROM norm{r}) - (SELECT count(*) FROM keyed{r}) AS invalid_count,
  (SELECT count(*) FROM keyed{r}) - (SELECT count(*) FROM uniq{r}) AS duplicate_count,
  (SELECT count(*) FROM uniq{r}) AS unique_count, (SELECT count(*) FROM uniq{r}) AS classified_count,
  (SELECT count(*) FROM people_all) AS profile_count, (SELECT count(*) FROM people) AS active_profile_count,
  (SELECT count(*) FROM ranked_{r} WHERE rank_position <= 5) AS total_ranked_matches, 0::BIGINT AS warnings,
  NULL::DOUBLE AS runtime_seconds"""
    for r in (1, 2)
)


def queries() -> dict[str, Query]:
    return {n: f for n, f in sorted(globals().items()) if n.startswith("q_") and callable(f)}


def oracle_sql() -> dict[str, str]:
    people = [("profiles_raw", o._sql(fx.PROFILES))]
    ranked = o.history_ctes(ranked=True)
    return {
        **{n: o.with_(o.aliased_ctes(), _LOADED) for n in ("q_scan_csv", "q_scan_json", "q_scan_jsonl")},
        "q_scan_approved": o.with_(_APPROVED, _SCAN_APPROVED),
        "q_approved_rejects": o.with_(_APPROVED, _APPROVED_REJECTS),
        "q_scan_profiles": o.with_(people, _SCAN_PROFILES),
        "q_scan_labelled": o.with_(o.base_ctes(), _SCAN_LABELLED),
        "q_profile_defaults": o.with_([("contract", o._sql(fx.CONTRACT_PROFILES))], _DEFAULTS),
        "q_stale_profiles": o.with_(people, _STALE),
        "q_export_file": o.with_(o.full_rank(), _EXPORT_FILE),
        "q_summary_file": o.oracle_sql()["q_run_summary"],
        "q_ranking_scores": o.with_(ranked, _SCORES),
        "q_pipeline_runs": o.with_(ranked, _RUNS),
    }
