import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from jobweave.functions import text
from jobweave.operators import state
from jobweave.operators.quality import consenting
from jobweave.operators.rank import rank_matches
from jobweave.operators.scratch import Scratch
from jobweave.operators.state import Spec, delta, sole_rows
from jobweave.plans.history import History, persist_run, with_sole
from jobweave.plans.prepare import prepare
from test_rank import world

SPEC = Spec(("k",), ("a",), ("b",), "times")


def test_sole_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1), (2, "b", 1), (3, "b", 1), (4, None, 1), (5, "c", 1), (5, "d", 1), (6, "a", 2), (7, "e", None), (None, "f", 1)],
        "id long, k string, v int",
    )
    assert sorted(r["id"] for r in sole_rows(rows, "id", ("k", "v")).collect()) == [1, 6]


def test_rows_alone_with_their_key_are_their_own_fold(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(i, None if i % 11 == 0 else f"k{i % 40 if i < 60 else i}", f"a{i}", f"b{i}") for i in range(100)],
        "id long, k string, a string, b string",
    )
    marked = rows.join(sole_rows(rows, "id", ("k",)).withColumn("sole", F.lit(True)), "id", "left")
    want = sorted(map(str, delta(rows, SPEC, 3, F.col("id")).collect()))
    folded, fold = [], state._fold
    monkeypatch.setattr(state, "_fold", lambda r, spec: folded.append(r.count()) or fold(r, spec))
    assert sorted(map(str, delta(marked, SPEC, 3, F.col("id"), sole=F.col("sole")).collect())) == want
    assert 0 < folded[0] < 60


@pytest.mark.parametrize("twice", [False, True])
def test_marked_matches_give_the_same_history(spark, tmp_path, make_postings, make_profiles, monkeypatch, twice):
    posts, profiles = world(make_postings, make_profiles, seed=5)
    if twice:  # shared names, versions and numbers, and a posting that comes twice
        profiles = profiles.withColumn("name", F.concat(F.lit("N"), (F.col("profile_no") % 20).cast("string")))
        profiles = profiles.withColumn("student_id", F.when(F.col("profile_no") == 3, "").when(F.col("profile_no") < 9, "s9"))
        profiles = profiles.unionByName(profiles.filter("profile_no IN (10, 15)"))
        posts = posts.unionByName(posts.filter("ordinal = 7"))
    folded, fold = [], state._fold
    monkeypatch.setattr(state, "_fold", lambda r, spec: folded.append((spec.keys, r.count())) or fold(r, spec))

    def run(root: str, marked: bool) -> dict:
        scratch, history = Scratch(spark), History(spark, root)
        p = prepare(posts, profiles, scratch, identify=True)
        people, _ = consenting(p.people)
        ranked = rank_matches(
            p.unique, with_sole(people) if marked else people, scratch, limit=3, keep=("sole_profile",) if marked else ()
        )
        persist_run(
            history, run_id="r", run_type="t", source="s", postings=posts, prepared=p, ranked=ranked,
            scratch=scratch, now="2026-06-15T00:00:00+00:00",
        )
        return {n: sorted(map(str, history.table(n).collect())) for n in ("ranking_scores", "match_history", "deduped_jobs", "classification_results")}

    plain = run(str(tmp_path / "plain"), False)
    of_pairs = lambda: [n for keys, n in folded if "student_key" in keys]
    assert of_pairs()[0] >= len(plain["match_history"]) > 0
    folded.clear()
    assert run(str(tmp_path / "marked"), True) == plain
    assert len(of_pairs()) == 1  # one fold for both tables
    assert 0 < of_pairs()[0] < len(plain["match_history"]) if twice else of_pairs() == [0]


@pytest.mark.parametrize("few", [True, False])
def test_texts_are_not_sorted_for_their_pages(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(fx, "BROADCAST_PAGES", 100 if few else 1)
    tables = {
        "documents": "SELECT id AS doc_id, concat('t', id) AS text, 'en' AS lang, 'x' AS source, 2L AS n_chars FROM range(50)",
        "supplier": "SELECT id AS s_suppkey, 'n' AS s_name, id % 2 AS s_nationkey FROM range(4)",
        "nation": "SELECT id AS n_nationkey, 'm' AS n_name FROM range(2)",
        "pages": "SELECT id AS page_id, concat('http://h/', id) AS url, 'h' AS html FROM range(9)",
    }
    for name, made in tables.items():
        spark.sql(made).write.parquet(str(tmp_path / f"{name}.parquet"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts = fx.run_sql(spark, str(tmp_path), fx.POSTINGS)
        plan = posts._jdf.queryExecution().executedPlan().toString()
        pages = next(line for line in plan.split("\n") if "Join" in line and "page_id" in line)
        assert ("BroadcastHashJoin" if few else "ShuffledHashJoin") in pages
        assert posts.count() == 50 and {r["url"].split("?")[0] for r in posts.collect()} == {f"http://h/{i}" for i in range(9)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_searched_end_begins_with_a_rare_character():
    assert text._search_end("threat ") == "hreat " and text._search_end("ing ") == "ing " and text._search_end("ai ") == "ai "
    assert text._search_end("of the ") == "f the " and text._search_end("\xe9\xe7 ") == "\xe9\xe7 " and text._search_end("x ") == "x "
