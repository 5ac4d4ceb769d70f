import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from jobweave.sources import aliased
from jobweave.sources.approved import read_approved
from jobweave.sources.files import ExportError
from jobweave.sources.profiles import read_profiles
from jobweave.sources.registry import SourceNotAllowed, ensure_allowed, union_sources

META = {
    "source_name": "test_export", "source_owner": "Career Office", "approved_by": "Advisor",
    "approval_date": "2026-06-02", "access_method": "Local export", "terms_reviewed": True,
}
JOB = {
    "title": "Data Engineer", "company": "Acme", "location": "Gary, IN",
    "description": "Build pipelines.", "url": "https://Example.com/jobs/1",
}


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def approved(path, jobs, **meta):
    return put(path, {"metadata": {**META, **meta}, "jobs": jobs})


def test_approved_records(spark, tmp_path):
    jobs = [
        {**JOB, "posted_date": "2026-05-20", "opt_cpt_flag": True, "concentration_tags": ["X "], "source": " "},
        {**{k: v for k, v in JOB.items() if k != "url"}, "apply_url": "https://example.com/apply",
         "source_job_id": "a-1", "raw_metadata": {"batch": "b1", "extra": 1}, "extra": [1, 2], "source": "mine"},
        {k: v for k, v in JOB.items() if k != "title"},
        {**JOB, "title": 5},
        {**JOB, "title": "  "},
        {k: v for k, v in JOB.items() if k != "url"},
        {**JOB, "posted_date": "soon"},
        {**JOB, "role_tags": "x"},
        "nonsense",
        {**JOB, "url": "ftp://x.y"},
    ]
    good, bad, records = read_approved(spark, approved(tmp_path / "a.json", jobs))
    rows = sorted(good.collect(), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in rows] == [1, 2] and records.count() == len(jobs)
    assert rows[0]["source"] == "test_export" and rows[0]["url"] == "https://example.com/jobs/1"
    assert rows[0]["posted_date"] == date(2026, 5, 20) and rows[0]["opt_cpt_flag"] is True
    assert rows[0]["concentration_tags"] == ["X"]
    assert json.loads(rows[0]["raw_metadata"]) == {"approval_metadata": META}
    assert rows[1]["source"] == "mine" and rows[1]["url"] == "https://example.com/apply"
    assert json.loads(rows[1]["raw_metadata"]) == {
        "batch": "b1", "extra": [1, 2], "approval_metadata": META, "source_job_id": "a-1",
    }
    reasons = {r["ordinal"]: r["reason"] for r in bad.collect()}
    assert reasons[3] == "title: Field required"
    assert reasons[4] == "title: Input should be a valid string"
    assert reasons[5] == "title: String should have at least 1 character"
    assert "one of url" in reasons[6] and reasons[7].startswith("posted_date")
    assert reasons[8] == "role_tags: Input should be a valid list"
    assert set(reasons) == set(range(3, 11))


def test_envelope_gate(spark, tmp_path):
    ok = {k: v for k, v in META.items() if k != "terms_reviewed"}
    put(tmp_path / "1.json", {"metadata": ok, "jobs": [JOB]})
    approved(tmp_path / "2.json", [JOB], terms_reviewed=False)
    put(tmp_path / "3.json", "{not-json")
    with pytest.raises(ExportError, match="terms_reviewed"):
        read_approved(spark, str(tmp_path / "2.json"))
    with pytest.raises(ExportError, match="not valid JSON"):
        read_approved(spark, str(tmp_path / "3.json"))
    good, bad, _ = read_approved(spark, str(tmp_path), strict=False)
    assert good.count() == 1 and bad.filter("stage = 'envelope'").count() == 2


ALIASED = [
    {"req_id": "req-1", "role": "Risk Analyst", "organization": "Safe", "city": "Gary",
     "summary": "Review alerts.", "post_url": "https://example.com/r", "created_at": "2026-06-02T10:30:00Z",
     "work_type": "Internship", "level": "Entry", "concentration_tags": "Cybersecurity; Data", "opt_cpt_flag": "yes"},
    {"Job-ID": 7, "Job Title": " T ", "employer": "E", "description": "D", "url": "https://example.com/7",
     "concentration_tags": ["a", " ", "b"], "opt_cpt_flag": False, "date_posted": "not-a-date"},
    {"title": "No url", "company": "E", "description": " "},
    {"title": "T", "company": "C", "description": "D", "apply_url": "https://example.com/9", "posted_date": "2026-05-01"},
]


def check_aliased(raw):
    good, bad = aliased.to_postings(aliased.map_fields(raw))
    rows = sorted(good.collect(), key=lambda r: r["ordinal"])
    assert [r["source_job_id"] for r in rows[:2]] == ["req-1", "7"]
    assert rows[0]["title"] == "Risk Analyst" and rows[0]["posted_date"] == date(2026, 6, 2)
    assert rows[0]["concentration_tags"] == ["Cybersecurity", "Data"] and rows[0]["opt_cpt_flag"] is True
    assert rows[1]["title"] == "T" and rows[1]["location"] == "Not specified"
    assert rows[1]["concentration_tags"] == ["a", "b"] and rows[1]["opt_cpt_flag"] is False
    assert rows[2]["source_job_id"].startswith("ksbit-") and len(rows[2]["source_job_id"]) == 22
    assert [r["reason"] for r in bad.collect()] == ["missing required field(s): description, apply_url"]
    recent = aliased.since(good, "2026-06-01")
    assert sorted(r["source_job_id"] for r in recent.collect()) == ["7", "req-1"]
    assert [r["source_job_id"] for r in aliased.first_records(recent, 1).collect()] == ["req-1"]
    assert aliased.load_counts(raw, good, recent).first().asDict() == {
        "raw_count": 4, "loaded_count": 3, "skipped_count": 1, "returned_count": 2,
    }
    return rows


def test_aliased_json_and_jsonl(spark, tmp_path):
    bare = check_aliased(aliased.read_aliased(spark, put(tmp_path / "bare.json", ALIASED)))
    check_aliased(aliased.read_aliased(spark, put(tmp_path / "w.json", {"x": 1, "results": ALIASED})))
    lines = "\n".join(json.dumps(r) for r in ALIASED)
    check_aliased(aliased.read_aliased(spark, put(tmp_path / "l.jsonl", lines)))
    assert json.loads(json.loads(bare[0]["raw_metadata"])["raw_payload"])["role"] == "Risk Analyst"


def test_aliased_csv(spark, tmp_path):
    body = (
        "﻿job_id,Job Title,employer_name,work_location,job_description,job_url,concentration_tags,opt_cpt_flag\n"
        'c-1,"Analyst, ""Senior""",Acme,"Gary, IN","Line one\nline two",https://example.com/c1,Business Analytics,true\n'
        "c-2,Other,Acme,,Text,https://example.com/c2,,no\n"
    )
    good, bad = aliased.to_postings(
        aliased.map_fields(aliased.read_aliased(spark, put(tmp_path / "x.csv", body)))
    )
    a, b = sorted(good.collect(), key=lambda r: r["ordinal"])
    assert a["title"] == 'Analyst, "Senior"' and a["description"] == "Line one\nline two"
    assert a["source_job_id"] == "c-1" and a["opt_cpt_flag"] is True
    assert b["location"] == "Not specified" and b["opt_cpt_flag"] is False and bad.count() == 0


@pytest.mark.parametrize(
    "name,body,match",
    [
        ("a.json", "[]", "empty"), ("b.json", " ", "empty"), ("c.json", "{x", "not valid JSON"),
        ("d.json", '{"rows": []}', "array keys"), ("e.json", '{"data": 3}', "must contain a list"),
        ("f.json", "[1]", "must be JSON objects"), ("g.txt", "x", "Unsupported"),
    ],
)
def test_refused_exports(spark, tmp_path, name, body, match):
    with pytest.raises(ExportError, match=match):
        aliased.read_aliased(spark, put(tmp_path / name, body))


def test_profiles(spark, tmp_path):
    p = {"name": " Ann ", "concentration": "Cybersecurity", "skills": ["SQL"]}
    rows = read_profiles(spark, put(tmp_path / "p.json", {"profiles": [p, {**p, "ai_matching_consent": False}]})).collect()
    assert [r["name"] for r in rows] == ["Ann", "Ann"] and [r["profile_no"] for r in rows] == [1, 2]
    assert [r["ai_matching_consent"] for r in rows] == [True, False] and rows[0]["target_roles"] == []
    for bad, match in (([], "empty"), ({"x": 1}, "array"), ([{"name": "x"}], "concentration"), ("{", "valid JSON")):
        with pytest.raises(ExportError, match=match):
            read_profiles(spark, put(tmp_path / "q.json", bad))


def test_registry_and_union(spark, make_postings):
    ensure_allowed("approved_json")
    for name in ("handshake", "linkedin_reference", "nowhere"):
        with pytest.raises(SourceNotAllowed):
            ensure_allowed(name)
    both = union_sources([make_postings(dict(title="a"), dict(title="b")), make_postings(dict(title="c"))])
    assert [r["title"] for r in both.orderBy("ordinal").collect()] == ["a", "b", "c"]


def test_files_are_numbered_in_path_order(spark, tmp_path):
    for name, ids in (("b 2.jsonl", "34"), ("a.jsonl", "12")):
        put(tmp_path / name, "\n".join(json.dumps({"id": i, "title": i}) for i in ids))
    raw = aliased.read_aliased_jsonl(spark, str(tmp_path))
    assert [r["id"] for r in raw.orderBy("ordinal").select(F.col("id")).collect()] == list("1234")
