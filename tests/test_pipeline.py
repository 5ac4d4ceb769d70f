import json

import pytest

from checks import fixtures as fx
from jobweave.operators.dedup import KEYS, with_dedup_keys
from jobweave.operators.quality import normalize
from jobweave.operators.scratch import Scratch
from jobweave.plans.history import SPECS, History
from jobweave.plans.pipeline import RunFailed, evaluate_labelled, run_export, run_report, student_matches
from jobweave.sources.approved import read_approved
from jobweave.streaming.ingest import ingest_stream
from jobweave.vocab import EXPORT_COLUMNS
from test_sources import approved, put

SF = "/root/testdata/sf0.001"
READERS = {
    "profiles": [
        {"student_id": f"r{i}", "name": f"Reader {i}", "concentration": track, "target_roles": [role], "skills": skills,
         "academic_stage": stage, "ai_matching_consent": i != 3, "work_auth_status": needs}
        for i, (track, role, skills, stage, needs) in enumerate([
            ("Information Systems Research in AI", "IT Consultant / Tech Risk", ["hast", "que"], "Returning / finishing up", None),
            ("Digital Transformation with AI", "Software Engineer", ["der"], None, "Need CPT / OPT sponsorship"),
            ("Data Analytics and AI", "Product / Project Manager", ["of the", "ing", "und"], "Incoming student (Fall)", None),
            ("Cybersecurity", "Other", [], None, None),
            ("Cybersecurity", "Cybersecurity Analyst", ["ente"], "Returning / finishing up", "Need CPT / OPT sponsorship"),
        ])
    ]
}


def exported(rows):
    """Table rows as records of an export."""
    fields = ("source", "source_job_id", "title", "company", "location", "description", "url", "employment_type",
              "seniority", "concentration_tags", "role_tags", "opt_cpt_flag")
    out = [{f: r[f] for f in fields if r[f] is not None} for r in rows]
    for record, r in zip(out, rows):
        if r["posted_date"] is not None:
            record["posted_date"] = r["posted_date"].isoformat()
    return out


def first_seen(keyed):
    seen, kept = set(), []
    for r in sorted(keyed, key=lambda r: r["ordinal"]):
        mine = {(k, r[k]) for k in KEYS if r[k] is not None}
        if seen.isdisjoint(mine):
            seen |= mine
            kept.append(r["ordinal"])
    return kept


def test_export_run_with_history(spark, tmp_path, scratch):
    """Postings of the given tables, some of them again under their source id or with
    the same content elsewhere, for four consenting readers with two matches each."""
    rows = fx.postings(spark, SF).orderBy("ordinal").limit(45).collect()
    jobs = exported(rows)
    jobs += [{**j, "url": f"https://moved.example.net/{i}", "description": "Moved."} for i, j in enumerate(jobs[:9]) if "source_job_id" in j]
    jobs += [{**{k: v for k, v in j.items() if k != "source_job_id"}, "url": f"https://mirror.example.net/{i}"} for i, j in enumerate(jobs[20:26])]
    jobs.append({"title": "no more than a title"})
    path = approved(tmp_path / "jobs.json", jobs)
    good, _, _ = read_approved(spark, path)
    keyed = with_dedup_keys(normalize(good)).select("ordinal", *KEYS).collect()
    kept = first_seen(keyed)
    assert 0 < len(kept) < len(keyed) < len(jobs)

    args = dict(
        source_name="approved_json", input_path=path, profiles_path=put(tmp_path / "people.json", READERS),
        limit=2, scratch=scratch, history_root=str(tmp_path / "history"), taxonomy=fx.TAXONOMY,
    )
    out = str(tmp_path / "out" / "results.csv")
    run = run_export(spark, output_path=out, **args)
    table = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(out)
    assert tuple(table.columns) == EXPORT_COLUMNS
    lines = table.collect()
    ranked = {(r["student_key"], r["rank_position"]): r for r in run.ranked.collect()}
    assert sorted(ranked) == [(f"r{i}", n) for i in (0, 1, 2, 4) for n in (1, 2)]
    assert {r["ordinal"] for r in ranked.values()} <= set(kept)
    assert [(r["student_id"], float(r["final_score"])) for r in lines] == [(k, r["score"]) for (k, _), r in sorted(ranked.items())]
    for line, (_, r) in zip(lines, sorted(ranked.items())):
        assert json.loads(line["score_breakdown"]) == {"metadata": {"seniority": r["seniority_label"]}, "reasons": r["reasons"]}
    s = spark.read.json(str(tmp_path / "out" / "results.summary.json")).first()
    want = dict(raw_count=len(jobs), normalized_count=len(keyed), invalid_count=0, duplicate_count=len(keyed) - len(kept),
                unique_count=len(kept), classified_count=len(kept), profile_count=5, active_profile_count=4,
                total_ranked_matches=8)
    assert {k: s[k] for k in want} == want
    assert {r["stage"] for r in run.rejects.collect()} >= {"record", "consent"}

    run_export(spark, output_path=str(tmp_path / "out" / "again.json"), **args)
    history = History(spark, str(tmp_path / "history"))
    counts = {r["table_name"]: r["row_count"] for r in history.table_counts().collect()}
    matched = len({(r["student_key"], r["ordinal"]) for r in ranked.values()})
    assert counts["pipeline_runs"] == 2 and counts["deduped_jobs"] == counts["classification_results"] == len(kept)
    assert counts["ranking_scores"] == counts["match_history"] == matched
    assert {r["seen_count"] for r in history.table("deduped_jobs").collect()} == {2}
    assert sum(r["seen_count"] for r in history.table("normalized_jobs").collect()) == 2 * len(keyed)
    stored = [json.loads(r["job_json"]) for r in history.job_json("deduped_jobs").collect()]
    by_no = {r["ordinal"]: r["description"] for r in normalize(good).collect()}
    assert sorted(j["description"] for j in stored) == sorted(by_no[i] for i in kept)
    before = {n: sorted(map(str, history.table(n).collect())) for n in SPECS}
    history.compact()
    assert {n: sorted(map(str, history.table(n).collect())) for n in SPECS} == before


def test_dry_run_and_failures(spark, tmp_path, scratch):
    people = put(tmp_path / "people.json", READERS)
    jobs = exported(fx.postings(spark, SF).filter("ordinal IN (5, 6, 7)").collect())
    out = tmp_path / "out.csv"
    args = dict(source_name="approved_json", profiles_path=people, output_path=str(out), scratch=scratch)
    run = run_export(spark, input_path=approved(tmp_path / "j.json", jobs), dry_run=True,
                     history_root=str(tmp_path / "h"), **args)
    assert run.ranked.count() == 4 * 3 and not out.exists() and not (tmp_path / "h").exists()
    with pytest.raises(RunFailed, match="holds no records"):
        run_export(spark, input_path=approved(tmp_path / "e.json", []), **args)
    with pytest.raises(RunFailed, match="was refused"):
        run_export(spark, input_path=approved(tmp_path / "b.json", [{"title": "x"}]), **args)
    with pytest.raises(RunFailed, match="positive"):
        run_export(spark, input_path="x", limit=0, **args)


def test_report_run(spark, tmp_path, scratch, make_postings, make_profiles):
    posts = make_postings(
        dict(title=" Power BI Trainee ", url="https://shop.example.net/p/5",
             description=" Draws charts over SQL views. ", concentration_tags=["Enterprise Systems", "Nowhere"]),
        dict(url="https://shop.example.net/p/5/", description="Elsewhere."),
        dict(company=" "),
    )
    run = run_report(
        spark, [("employer_careers", posts)],
        make_profiles(dict(name="Same", skills=["SQL"]), dict(name="Same", skills=["Python"], student_id="z")),
        str(tmp_path / "report"), scratch,
    )
    s = spark.read.json(str(tmp_path / "report/summary")).first()
    assert (s["raw_jobs"], s["valid_jobs"], s["invalid_jobs"], s["deduplicated_jobs"]) == (3, 2, 1, 1)
    job = run.prepared.unique.first()
    assert job["title"] == "Power BI Trainee" and job["role_tags"] == ["Data Analyst / BI Engineer"]
    assert spark.read.json(str(tmp_path / "report/ranked_matches")).select("student_key").distinct().count() == 2


def test_identities_across_runs(spark, tmp_path, scratch, make_postings):
    landing, offsets = str(tmp_path / "landing"), str(tmp_path / "offsets")
    history = History(spark, str(tmp_path / "history"))
    same = dict(title="T", description="Same text.")
    runs = [
        [dict(source_job_id="id-1", url="https://e.com/1", description="a"),
         dict(source_job_id="id-2", url="https://e.com/2", description="b"),
         dict(url="https://e.com/3", **same)],
        [dict(source_job_id="id-1", url="https://e.com/9", description="c"),
         dict(source_job_id="id-9", url="https://e.com/2?utm_source=x", description="d"),
         dict(url="https://e.com/4", **same)],
    ]
    for rows in runs:
        make_postings(*rows).write.mode("append").parquet(landing)
        ingest_stream(spark, landing, history, offsets)
    jobs = history.table("deduped_jobs")
    assert jobs.count() == 3 and {r["seen_count"] for r in jobs.collect()} == {2}
    ingest_stream(spark, landing, history, offsets)  # nothing new
    assert history.table("pipeline_runs").count() == 2
    assert history.has_run("stream-0") and not history.has_run("stream-7")
    # the identity of the second run points to the job it resolved to
    ids = {(r["identity_type"], r["identity_value"]): r["job_key"] for r in history.table("job_identities").collect()}
    assert ids[("canonical_url", "https://e.com/9")] == ids[("source_job_id", "employer_careers:id-1")]


def test_numbering_a_batch_sorts_no_texts(spark, tmp_path, make_postings, monkeypatch):
    """Numbers follow file and ordinal, rows that share both get one each, and texts
    are in no table but the numbered batch."""
    seen, keep = [], Scratch._keep

    def noted(self, df, name, *options):
        seen.append((name, "description" in df.columns))
        return keep(self, df, name, *options)

    monkeypatch.setattr(Scratch, "_keep", noted)
    history = History(spark, str(tmp_path / "history"))
    rows = [dict(ordinal=o, url=f"https://e.com/{i}", description=f"text {i}") for i, o in enumerate((7, 3, 3, 9))]
    make_postings(*rows).coalesce(1).write.parquet(str(tmp_path / "landing"))
    ingest_stream(spark, str(tmp_path / "landing"), history, str(tmp_path / "offsets"))
    assert [name for name, text in seen if text] == ["batch"]
    stored = spark.read.parquet(f"{history.root}/payload").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in stored] == [1, 2, 3, 4]
    assert [r["url"][-1] for r in stored][2:] == ["0", "3"] and {r["url"][-1] for r in stored[:2]} == {"1", "2"}


def test_replayed_batch(spark, tmp_path, make_postings):
    """A batch that was published and then replayed, its offset being lost, changes nothing."""
    landing, offsets = tmp_path / "landing", tmp_path / "offsets"
    history = History(spark, str(tmp_path / "history"))
    for n in (1, 2):
        rows = [dict(url=f"https://e.com/{n}/{i}", description=f"{n} {i}") for i in range(3)]
        make_postings(*rows).write.mode("append").parquet(str(landing))
        ingest_stream(spark, str(landing), history, str(offsets))
    before = {n: sorted(map(str, history.table(n).collect())) for n in SPECS if n in ("deduped_jobs", "pipeline_runs", "job_identities")}
    for name in ("commits/1", "commits/.1.crc"):
        (offsets / name).unlink(missing_ok=True)
    ingest_stream(spark, str(landing), history, str(offsets))
    assert (offsets / "commits/1").exists()
    assert before == {n: sorted(map(str, history.table(n).collect())) for n in before}


def test_exports_that_land_together(spark, tmp_path, make_postings):
    """Two exports numbered from 1 before one call are four jobs, each seen once."""
    landing, history = str(tmp_path / "landing"), History(spark, str(tmp_path / "history"))
    for pair in (("A", "B"), ("C", "D")):
        make_postings(*[
            dict(title=t, company=f"{t} and sons", url=f"https://e.com/{t}", description=f"About {t}.") for t in pair
        ]).coalesce(1).write.mode("append").parquet(landing)
    ingest_stream(spark, landing, history, str(tmp_path / "offsets"))
    jobs = history.table("deduped_jobs").collect()
    assert sorted((r["title"], r["company"], r["seen_count"]) for r in jobs) == [(t, f"{t} and sons", 1) for t in "ABCD"]
    ids = history.table("job_identities").filter("identity_type = 'canonical_url'")
    assert ids.select("job_key").distinct().count() == 4


def test_student_lookup(make_postings, make_profiles, scratch):
    posts = make_postings(*[dict(description=f"uses sql {i}") for i in range(5)])
    got = student_matches(posts, make_profiles(dict(student_id="a", skills=["SQL"]), dict(student_id="b")), "a", scratch)
    assert sorted((r["rank_position"], r["ordinal"]) for r in got.collect()) == [(i, i) for i in range(1, 6)]


def test_labelled_evaluation(spark, tmp_path, scratch):
    def post(i, title, text, roles, tracks):
        return {"id": i, "title": title, "company": "C", "location": "L", "description": text,
                "source": "employer_careers", "source_url": f"https://example.com/{i}",
                "expected_role_tags": roles, "expected_concentration_tags": tracks, "expected_seniority": "Entry"}

    labelled = {
        "postings": [
            post("p1", "Data Analyst", "Build SQL reports.", ["Data Analyst / BI Engineer"], ["Data Analytics and AI"]),
            post("p2", "Security Intern", "SIEM monitoring.", ["Cybersecurity Analyst"], ["Cybersecurity"]),
            post("p3", "Gardener", "Plants.", ["Software Engineer"], []),
            post("p4", "Cook", "Soup.", [], ["Cybersecurity"]),
        ],
        "sample_profiles": [
            {"profile": {"name": "D", "concentration": "Data Analytics and AI", "skills": ["SQL"]}, "expected_top_job_ids": ["p1"]},
            {"profile": {"name": "S", "concentration": "Cybersecurity", "skills": ["SIEM"]}, "expected_top_job_ids": []},
        ],
    }
    row = evaluate_labelled(spark, put(tmp_path / "l.json", labelled), scratch).first()
    assert row.asDict() == {"record_count": 4, "role_accuracy": 0.75, "concentration_accuracy": 0.75, "ranking_relevance": 0.5}


