from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def scratch(spark):
    from jobweave.operators.scratch import Scratch

    return Scratch(spark)


@pytest.fixture
def make_postings(spark):
    """Postings from partial dicts; absent fields get usable defaults."""
    from jobweave.schemas import POSTING_SCHEMA

    def make(*rows):
        full = []
        for i, r in enumerate(rows, 1):
            base = dict(
                ordinal=i, source="employer_careers", source_job_id=None,
                title="Data Analyst Intern", company="Example Employer",
                location="Bloomington, IN", description=f"Text number {i}.",
                url=f"https://example.com/jobs/{i}", posted_date=None,
                employment_type=None, seniority=None, concentration_tags=[],
                role_tags=[], opt_cpt_flag=None, raw_metadata=None,
            )
            base.update(r)
            full.append(tuple(base[f] for f in POSTING_SCHEMA.fieldNames()))
        return spark.createDataFrame(full, POSTING_SCHEMA)

    return make


@pytest.fixture
def make_profiles(spark):
    from jobweave.schemas import PROFILE_SCHEMA

    def make(*rows):
        full = []
        for i, r in enumerate(rows, 1):
            base = dict.fromkeys(PROFILE_SCHEMA.fieldNames())
            base.update(
                profile_no=i, name=f"Student {i}", concentration="Cybersecurity",
                target_roles=[], skills=[], geo_preference=[],
                ai_matching_consent=True, profile_version=1,
            )
            base.update(r)
            full.append(tuple(base[f] for f in PROFILE_SCHEMA.fieldNames()))
        return spark.createDataFrame(full, PROFILE_SCHEMA)

    return make
