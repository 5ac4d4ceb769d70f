"""Postings, profiles and raw exports derived from the given tables.

The statements run unchanged in Spark and DuckDB; ``{S}`` is the text type.  Every
row of the source tables takes part.  The synthetic text does not contain the
default vocabulary, so the taxonomy and the seniority words are replaced by words
that do occur in it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.values import parse_list
from jobweave.operators.skew import spread
from jobweave.vocab import Taxonomy

TAXONOMY = Taxonomy(
    role_keywords={
        "IT Consultant / Tech Risk": ("threat", "hast", "in the"),
        "Data Analyst / BI Engineer": ("ai", "anre"),
        "Cybersecurity Analyst": ("der", "ouon"),
        "Product / Project Manager": ("los", "enst"),
        "Software Engineer": ("éç", "enung"),
    },
    concentration_keywords={
        "Digital Transformation with AI": ("ersh", "und"),
        "Data Analytics and AI": ("thon",),
        "Cybersecurity": ("que", "esble"),
        "Information Systems Research in AI": ("ente", "of the"),
    },
)
SENIORITY = (("Senior", ("hast", "enou")), ("Mid", ("atti",)), ("Entry", ("ing", "ersh")))

REGISTRY = (
    *[(f"src{i}", "approved", "local_export", i) for i in range(15)],
    *[(f"src{i}", "restricted", "restricted_platform", 99) for i in range(15, 18)],
    ("src18", "disabled", "local_export", 99),
)

POSTINGS = """
SELECT d.doc_id AS ordinal, d.source AS source,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE concat('J', CAST(CASE WHEN d.doc_id % 7 = 3 AND d.doc_id >= 20 THEN d.doc_id - 20 ELSE d.doc_id END AS {S})) END AS source_job_id,
  CASE WHEN d.doc_id % 97 = 0 THEN '   ' ELSE split_part(d.text, chr(10), 1) END AS title,
  s.s_name AS company, n.n_name AS location, d.text AS description,
  concat(split_part(p.url, '#', 1), CASE WHEN p.url LIKE '%?%' THEN '&' ELSE '?' END, 'id=',
         CAST(CASE WHEN d.doc_id % 10 = 0 THEN 0 ELSE d.doc_id END AS {S}),
         CASE WHEN d.doc_id % 3 = 0 THEN '&utm_campaign=x' ELSE '' END,
         CASE WHEN p.url LIKE '%#%' THEN '#top' ELSE '' END) AS url,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE DATE '2026-03-01' + CAST(d.doc_id % 100 AS INT) END AS posted_date,
  CASE d.doc_id % 2 WHEN 0 THEN 'Internship' ELSE ' Full-time ' END AS employment_type,
  CASE d.doc_id % 5 WHEN 0 THEN 'Entry' WHEN 1 THEN 'Early/Mid' WHEN 2 THEN 'Senior' WHEN 3 THEN ' ' ELSE NULL END AS seniority,
  CASE d.doc_id % 6 WHEN 0 THEN 'Business Analytics' WHEN 1 THEN 'Cybersecurity;Unknown Track' WHEN 2 THEN 'Enterprise Systems;Cybersecurity' ELSE '' END AS concentration_tags_text,
  CASE d.doc_id % 8 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Not A Role' ELSE '' END AS role_tags_text,
  CASE d.doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS opt_cpt_flag,
  DATE '2026-03-01' + CAST(d.doc_id % 50 AS INT) AS created_at,
  DATE '2026-05-01' + CAST(d.doc_id % 31 AS INT) AS updated_at
FROM documents d
JOIN supplier s ON s.s_suppkey = d.n_chars % (SELECT count(*) FROM supplier)
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
"""

PROFILES = """
SELECT c_custkey AS profile_no,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(' S', CAST(c_custkey AS {S}), ' ') END AS student_id, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Cybersecurity' WHEN 'MACHINERY' THEN 'Digital Transformation with AI' WHEN 'HOUSEHOLD' THEN 'Data Analytics and AI' ELSE 'Information Systems Research in AI' END AS concentration,
  CASE c_custkey % 4 WHEN 0 THEN 'Incoming student (Fall)' WHEN 1 THEN 'Returning / finishing up' WHEN 2 THEN NULL ELSE 'Unknown' END AS academic_stage,
  CASE c_custkey % 4 WHEN 2 THEN 'internship search' ELSE NULL END AS stage,
  CASE c_nationkey % 3 WHEN 0 THEN 'Software Engineer;hast' WHEN 1 THEN 'Data Analyst / BI Engineer' ELSE 'Cybersecurity Analyst;of the' END AS target_roles_text,
  CASE c_nationkey % 4 WHEN 0 THEN 'Ing;ai;ai' WHEN 1 THEN 'tion; ;ersh' WHEN 2 THEN 'enou;c++;que' ELSE '' END AS skills_text,
  CASE c_custkey % 2 WHEN 0 THEN 'Need CPT / OPT sponsorship' ELSE 'U.S. Citizen / Green Card' END AS work_auth_status,
  c_custkey % 9 <> 4 AS ai_matching_consent, CAST(1 + c_custkey % 2 AS INT) AS profile_version
FROM customer
"""

# profiles of the contract check: seeded defects by customer
CONTRACT_PROFILES = """
SELECT c_custkey AS profile_no, c_name AS name,
  CASE c_custkey % 7 WHEN 0 THEN 'Basket Weaving' WHEN 6 THEN NULL ELSE 'Cybersecurity' END AS concentration,
  CASE c_custkey % 4 WHEN 0 THEN 'Incoming student (Fall)' WHEN 1 THEN 'Someday' ELSE 'Returning / finishing up' END AS academic_stage,
  CASE c_custkey % 7 WHEN 1 THEN '' ELSE 'Software Engineer' END AS target_roles_text,
  CASE c_custkey % 7 WHEN 5 THEN 'SQL; ' ELSE 'SQL' END AS skills_text,
  CASE c_custkey % 2 WHEN 0 THEN 'Need CPT / OPT sponsorship' ELSE 'U.S. Citizen / Green Card' END AS work_auth_status,
  CASE c_custkey % 7 WHEN 2 THEN NULL WHEN 4 THEN '08/15/2026' ELSE '2026-08-15' END AS opt_eligibility_date,
  CASE c_custkey % 7 WHEN 3 THEN 'Mars' ELSE 'Open to anywhere' END AS geo_preference_text,
  'Email' AS remote_preference,
  'Daily or weekly email' AS delivery_preference, 'Once a day' AS match_frequency,
  CAST(CASE c_custkey % 7 WHEN 3 THEN 0 ELSE 1 END AS INT) AS profile_version,
  CASE c_custkey % 7 WHEN 5 THEN 'yesterday' ELSE '2026-05-15T10:00:00Z' END AS updated_at,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE TRUE END AS ai_matching_consent
FROM customer
"""

RAW_ALIASED = """
SELECT d.doc_id AS ordinal,
  CASE WHEN d.doc_id % 4 = 1 THEN concat('R', CAST(d.doc_id AS {S})) END AS job_id,
  CASE WHEN d.doc_id % 4 = 2 THEN '  ' WHEN d.doc_id % 4 = 1 THEN 'ignored' END AS req_id,
  CASE WHEN d.doc_id % 2 = 0 THEN split_part(d.text, chr(10), 1) END AS title,
  CASE WHEN d.doc_id % 2 = 1 THEN split_part(d.text, chr(10), 1) END AS job_title,
  CASE WHEN d.doc_id % 11 = 0 THEN ' ' ELSE d.source END AS employer,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.lang END AS city,
  CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE d.text END AS summary,
  CASE WHEN d.doc_id % 19 = 0 THEN 'ftp://example.com/j' ELSE concat('HTTPS://Example.com/j/', CAST(d.doc_id AS {S})) END AS job_url,
  CASE d.doc_id % 6 WHEN 0 THEN '2026-06-01' WHEN 1 THEN '2026-06-04T09:30:00Z' WHEN 2 THEN '2026-6' WHEN 3 THEN 'not-a-date' WHEN 4 THEN '2026-13-01' END AS date_posted,
  CASE d.doc_id % 3 WHEN 0 THEN 'a; b ;;c' WHEN 1 THEN 'a, b,' END AS concentration_tags,
  CASE d.doc_id % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'n' WHEN 2 THEN 'maybe' WHEN 3 THEN '1' END AS opt_cpt_flag
FROM documents d
"""

# profiles whose skills are six of many common words, each wanted by many profiles
WIDE_WORDS = (
    "the", "of", "and", "in", "to", "is", "it", "was", "that", "for", "on", "are", "with", "as", "be", "at", "this",
    "or", "de", "la", "le", "et", "un", "und", "der", "die", "que", "est", "el", "en",
)
WIDE_PROFILES = PROFILES.replace(
    "CASE c_nationkey % 4 WHEN 0 THEN 'Ing;ai;ai' WHEN 1 THEN 'tion; ;ersh' WHEN 2 THEN 'enou;c++;que' ELSE '' END AS skills_text",
    "concat(" + ", ';', ".join(
        f"split_part('{';'.join(WIDE_WORDS)}', ';', CAST(1 + (c_custkey * {a} + {b}) % {len(WIDE_WORDS)} AS INT))"
        for a, b in ((1, 0), (7, 3), (11, 8), (13, 1), (17, 5), (19, 2))
    ) + ") AS skills_text",
)

# chains of up to 40 neighbours, numbered forwards, backwards or jumping, and one key
# that holds many of them together
CHAINS = """
SELECT chain + CASE chain % 3 WHEN 0 THEN pos WHEN 1 THEN 39 - pos ELSE (pos * 17) % 40 END AS ordinal,
  concat(CAST(chain AS {S}), part, 'u', CAST(pos - pos % 2 AS {S})) AS key_url,
  CASE WHEN pos % 3 = 0 AND chain % 80 = 0 THEN 'hot' END AS key_source_id,
  concat(CAST(chain AS {S}), part, 'c', CAST(pos + pos % 2 AS {S})) AS key_content
FROM (SELECT chain, pos, CASE WHEN pos < 10 + chain % 31 THEN 'a' ELSE 'b' END AS part
      FROM (SELECT d.doc_id - d.doc_id % 40 AS chain, d.doc_id % 40 AS pos FROM documents d) AS numbered) AS parted
"""

_TABLES = ("documents", "supplier", "nation", "pages", "customer", "labels")
# Up to this many pages their URLs are broadcast, so that no whole text moves for them.
BROADCAST_PAGES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # text and profile work on one small file should still use all cores
    key = {"documents": "doc_id", "customer": "c_custkey"}.get(name)
    return spread(df, key) if key else df


def run_sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Run one of the statements above with its tables bound to the parquet files."""
    used = [t for t in _TABLES if re.search(rf"(FROM|JOIN) {t}\b", statement)]
    text = statement.replace("{S}", "STRING")
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    bound = {t: table(spark, sf_dir, t) for t in used}
    if "pages" in bound:
        few = bound["pages"].count() <= BROADCAST_PAGES
        # beyond, texts move to the pages in a hash join: they are never sorted
        bound["pages"] = bound["pages"].hint("broadcast" if few else "shuffle_hash")
    return spark.sql(text, **bound)


def _lists(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, parse_list(F.col(f"{n}_text"))).drop(f"{n}_text")
    return df


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_sql(spark, sf_dir, POSTINGS)
    return _lists(df, "concentration_tags", "role_tags").withColumn(
        "raw_metadata", F.lit(None).cast("string")
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(run_sql(spark, sf_dir, PROFILES), "target_roles", "skills")


def wide_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(run_sql(spark, sf_dir, WIDE_PROFILES), "target_roles", "skills")


def contract_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_sql(spark, sf_dir, CONTRACT_PROFILES)
    # a trailing blank skill is one of the defects, so keep blanks here
    df = df.withColumn("skills", F.split("skills_text", ";", -1)).drop("skills_text")
    return _lists(df, "target_roles", "geo_preference")


def raw_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, RAW_ALIASED)
