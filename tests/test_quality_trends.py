from datetime import date

from pyspark.sql import functions as F

from jobweave.operators import quality, report, trends
from jobweave.schemas import PROFILE_SCHEMA

GOOD = dict(
    concentration="Cybersecurity", academic_stage="Returning / finishing up",
    target_roles=["Software Engineer"], skills=["SQL"],
    work_auth_status="U.S. Citizen / Green Card", geo_preference=["Open to anywhere"],
    delivery_preference="Push notification", match_frequency="Once a day",
    updated_at="2026-05-15T10:00:00Z",
)


def test_contract_splits(make_postings):
    good, bad = quality.check_contract(
        make_postings(dict(title=" A "), dict(company=" "), dict(url="mailto:x"), dict(description=None))
    )
    assert [r["title"] for r in good.collect()] == ["A"]
    assert {r["ordinal"]: r["reason"].split(":")[0] for r in bad.collect()} == {
        2: "company", 3: "url", 4: "description",
    }


def test_normalize_validate(make_postings):
    n = quality.normalize(make_postings(dict(title="\tA ", seniority=" "), dict(company="  ")))
    ok, bad = quality.validate(n)
    row = ok.first()
    assert (row["title"], row["seniority"]) == ("A", None)
    assert [r["ordinal"] for r in bad.collect()] == [2]


def test_profile_features_and_consent(make_profiles):
    p = quality.profile_features(
        make_profiles(
            dict(student_id=" s1 ", stage="internship search", skills=["SQL ", "", "sql"]),
            dict(name="Zoe", academic_stage="GRADUATE", ai_matching_consent=False,
                 work_auth_status="Need CPT / OPT sponsorship"),
        )
    )
    a, b = p.orderBy("profile_no").collect()
    assert (a["student_key"], a["academic_stage"], a["preferred_seniority"]) == ("s1", "internship search", "Entry")
    assert a["skill_terms"] == ["sql", "sql"] and a["needs_opt"] is False
    assert (b["preferred_seniority"], b["needs_opt"], len(b["student_key"])) == ("Early/Mid", True, 10)
    active, silent = quality.consenting(p)
    assert active.count() == 1 and "Zoe" in silent.first()["reason"]


def test_profile_contract(spark, make_profiles):
    df = make_profiles(
        GOOD,
        {**GOOD, "concentration": "X", "target_roles": [], "skills": ["", "ok"], "profile_version": 0,
         "geo_preference": ["Mars"], "remote_preference": "", "updated_at": "never"},
        {**GOOD, "work_auth_status": "Need CPT / OPT sponsorship"},
        {**GOOD, "work_auth_status": "Need CPT / OPT sponsorship", "opt_eligibility_date": "08/15/2026"},
        {**GOOD, "ai_matching_consent": None, "match_frequency": "Hourly"},
    )
    errors = [r["e"] for r in df.withColumn("e", quality.profile_errors()).orderBy("profile_no").collect()]
    assert errors[0] == []
    assert errors[1] == [
        'Invalid concentration: "X"', 'Invalid remote_preference: ""',
        "target_roles must be a non-empty array", 'Invalid geo_preference: "Mars"',
        "skills[0] must be a non-empty string", "profile_version must be an integer >= 1",
        "updated_at must be a valid ISO-8601 date-time string",
    ]
    assert len(errors[2]) == 1 and "is required" in errors[2][0]
    assert errors[3] == ["opt_eligibility_date must be in YYYY-MM-DD format"]
    assert errors[4] == [
        "Missing required field: ai_matching_consent", 'Invalid match_frequency: "Hourly"',
        "ai_matching_consent must be a boolean",
    ]
    empty = spark.createDataFrame([(1, *[None] * (len(PROFILE_SCHEMA.fields) - 1))], PROFILE_SCHEMA)
    row = quality.with_profile_defaults(empty, F.lit("2026-06-01T00:00:00Z")).first()
    assert (row["skills"], row["match_frequency"], row["ai_matching_consent"], row["profile_version"]) == (
        [], "Once a day", False, 1,
    )
    stale = quality.stale_profiles(df.limit(1), F.lit("2026-06-14").cast("date"))
    assert stale.count() == 1


def test_trend_counts(make_postings):
    counts = {
        (r["dimension"], r["value"]): r["n"]
        for r in trends.trend_counts(
            make_postings(
                dict(posted_date=date(2026, 6, 3), seniority="Entry", opt_cpt_flag=True,
                     role_tags=["R"], concentration_tags=["C", "D"]),
                dict(company="Other", opt_cpt_flag=False),
            )
        ).collect()
    }
    assert counts[("total_jobs", "all")] == 2 and counts[("companies", "Other")] == 1
    assert counts[("posting_weeks", "2026-06-01")] == 1 and counts[("posting_weeks", "unknown")] == 1
    assert counts[("seniority", "Unknown")] == 1 and counts[("concentrations", "D")] == 1
    assert counts[("opt_cpt_signals", "cpt_opt_friendly")] == counts[("opt_cpt_signals", "not_cpt_opt_friendly")] == 1


def test_rollup_zips_or_crosses(make_postings):
    d = date(2026, 6, 3)
    posts = make_postings(
        dict(posted_date=d, role_tags=["R"], concentration_tags=["C", "D"]),
        dict(posted_date=date(2026, 1, 1), role_tags=["R"]),
        dict(posted_date=d),
    ).withColumn("created_at", F.col("posted_date")).withColumn("updated_at", F.col("posted_date"))
    pairs = lambda cross: {
        (r["role_category"], r["concentration_track"])
        for r in trends.trend_rollup(posts, date(2026, 6, 15), cross=cross).collect()
    }
    assert pairs(False) == {("R", "C"), (None, "D")}
    assert pairs(True) == {("R", "C"), ("R", "D")}


def test_digest_without_matches(spark, make_profiles):
    people = quality.profile_features(make_profiles(dict(name="Ann")))
    none = spark.createDataFrame(
        [], "profile_no bigint, rank_position bigint, title string, company string, location string, score double, url string"
    )
    text = report.digests(people, none).first()["digest"]
    assert text.startswith("Hello Ann,\n\nHere are") and "No matches are available yet." in text
