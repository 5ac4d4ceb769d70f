import glob
import random
from datetime import date

import pytest

from jobweave.operators.classify import classify
from jobweave.operators.quality import consenting, profile_features
from jobweave.operators.rank import (
    authorized_matches, posting_features, profile_vocabulary, rank_matches,
)
from jobweave.vocab import CONCENTRATIONS, RankingWeights

WORDS = ["sql", "python", "tableau", "siem", "nist", "agile", "power bi", "c++", "excel", "grc"]


def world(make_postings, make_profiles, seed, posts=60, people=25):
    r = random.Random(seed)
    postings = make_postings(
        *[
            dict(
                title=r.choice(["Analyst", "Engineer", "Lead Engineer"]),
                company=r.choice(["A", "B", "C"]),
                description=" ".join(r.sample(WORDS, r.randrange(1, 5))) + " x",
                posted_date=r.choice([None, date(2026, 6, 1), date(2026, 6, 2)]),
                seniority=r.choice([None, "Entry", "Senior", "Early/Mid"]),
                concentration_tags=r.sample(CONCENTRATIONS, r.randrange(3)),
                role_tags=r.choice([[], ["Software Engineer"]]),
                opt_cpt_flag=r.choice([None, True, False]),
            )
            for _ in range(posts)
        ]
    )
    profiles = make_profiles(
        *[
            dict(
                concentration=r.choice([*CONCENTRATIONS, "Unlisted"]),
                skills=r.choices([w.upper() for w in WORDS], k=r.randrange(4)),
                target_roles=r.choice([[], ["Software Engineer"], ["analyst", "siem"]]),
                academic_stage=r.choice([None, "Incoming student (Fall)", "Returning / finishing up"]),
                work_auth_status=r.choice([None, "Need CPT / OPT sponsorship"]),
                ai_matching_consent=r.random() < 0.9,
            )
            for _ in range(people)
        ]
    )
    return postings, profiles


def ranked_rows(df):
    return sorted(
        (r["profile_no"], r["rank_position"], r["ordinal"], r["score"], tuple(r["reasons"]))
        for r in df.collect()
    )


@pytest.mark.parametrize("pair_budget,max_frequent", [(10**9, 16), (0, 16), (60, 2)])
def test_pruned_equals_full(make_postings, make_profiles, scratch, pair_budget, max_frequent):
    postings, profiles = world(make_postings, make_profiles, seed=pair_budget % 97)
    people, _ = consenting(profile_features(profiles))
    features = scratch.keep(posting_features(postings, profile_vocabulary(people)), "f")
    full = ranked_rows(rank_matches(features, people, scratch, limit=None))
    assert len(full) == features.count() * people.count()
    got = rank_matches(
        features, people, scratch, limit=4, pair_budget=pair_budget, max_frequent=max_frequent
    )
    assert ranked_rows(got) == [r for r in full if r[1] <= 4]


@pytest.mark.parametrize("pair_budget", [10**9, 0, 60])
@pytest.mark.parametrize(
    "weights", [dict(skill=-2.0), dict(role=-1.0, skill=1.5), dict(concentration=-3.0, skill=-0.5, role=-1.0)]
)
def test_limit_is_kept_under_negative_weights(make_postings, make_profiles, scratch, pair_budget, weights):
    postings, profiles = world(make_postings, make_profiles, seed=5 + pair_budget % 97, posts=50, people=15)
    people = profile_features(profiles)
    features = scratch.keep(posting_features(postings, profile_vocabulary(people)), "f")
    w = RankingWeights(**weights)
    full = ranked_rows(rank_matches(features, people, scratch, limit=None, weights=w))
    got = ranked_rows(rank_matches(features, people, scratch, limit=2, weights=w, pair_budget=pair_budget))
    assert got == [r for r in full if r[1] <= 2]


@pytest.mark.parametrize("weights", [None, dict(skill=-2.0, opt_cpt=-1.0)])
def test_work_authorisation_comes_before_the_limit(make_postings, make_profiles, scratch, weights):
    postings, profiles = world(make_postings, make_profiles, seed=31, posts=40, people=16)
    people = profile_features(profiles)
    features = scratch.keep(posting_features(postings, profile_vocabulary(people)), "f")
    w = weights and RankingWeights(**weights)
    flags = {r["ordinal"]: r["opt_cpt_flag"] for r in features.collect()}
    needs = {r["profile_no"]: r["needs_opt"] for r in people.collect()}
    assert set(needs.values()) == {True, False} and False in flags.values()
    want, vetoed, at = [], 0, {}
    for r in ranked_rows(rank_matches(features, people, scratch, limit=None, weights=w)):
        if needs[r[0]] and flags[r[2]] is False:
            vetoed += r[1] <= 3
            continue
        at[r[0]] = at.get(r[0], 0) + 1
        if at[r[0]] <= 3:
            want.append((r[0], at[r[0]], *r[2:]))
    assert vetoed
    assert ranked_rows(authorized_matches(features, people, scratch, limit=3, weights=w)) == want
    one = authorized_matches(features, people.filter("needs_opt"), scratch, limit=3, weights=w)
    assert ranked_rows(one) == [r for r in want if needs[r[0]]]


@pytest.mark.parametrize("weights", [None, dict(skill=-1.0, role=3.0, concentration=-2.0), dict(skill=0.1, role=0.7)])
def test_blocks_and_parts_change_nothing(make_postings, make_profiles, scratch, weights):
    postings, profiles = world(make_postings, make_profiles, seed=77, posts=70, people=20)
    people = profile_features(profiles)
    features = scratch.keep(posting_features(postings, profile_vocabulary(people)), "f")
    w = weights and RankingWeights(**weights)
    full = ranked_rows(rank_matches(features, people, scratch, limit=None, weights=w))
    got = rank_matches(features, people, scratch, limit=3, weights=w, first_block=5, block=16, look_part=4)
    assert ranked_rows(got) == [r for r in full if r[1] <= 3]


@pytest.mark.parametrize("weights", [dict(skill=1.5), dict(skill=-1.0, role=3.0, concentration=-2.0)])
def test_common_words_of_many_profiles_make_few_pairs(spark, make_postings, make_profiles, scratch, weights):
    posts = make_postings(*[dict(description=f"the of and {WORDS[i % 10]} {i}", company=f"C{i}") for i in range(120)])
    profiles = make_profiles(*[dict(skills=["the", "of", WORDS[i % 4]], target_roles=["and"]) for i in range(80)])
    people = profile_features(profiles)
    features = scratch.keep(posting_features(posts, profile_vocabulary(people)), "f")
    got = rank_matches(features, people, scratch, limit=2, weights=RankingWeights(**weights), pair_budget=0)
    assert got.count() == 160
    pairs = glob.glob(f"{scratch.root}/*-rank-pairs")
    assert spark.read.parquet(*pairs).count() <= 4 * 2  # four looks, one block


def test_rows_of_a_repeated_profile_share_its_limit(make_postings, make_profiles, scratch):
    postings, profiles = world(make_postings, make_profiles, seed=3, posts=30, people=4)
    people = profile_features(profiles)
    features = scratch.keep(posting_features(postings, profile_vocabulary(people)), "f")
    once = ranked_rows(rank_matches(features, people, scratch, limit=4))
    twice = ranked_rows(rank_matches(features, people.unionByName(people), scratch, limit=4))
    # positions 1 to 4 hold the best two postings twice, and meet both rows again
    assert sorted({(r[0], r[2]) for r in twice}) == sorted({(r[0], r[2]) for r in once if r[1] <= 2})
    assert len(twice) == 2 * len(once)


def test_only_repeated_profiles_are_dealt_out_before_the_limit(spark, make_postings, make_profiles, scratch):
    postings, profiles = world(make_postings, make_profiles, seed=23)
    people, _ = consenting(profile_features(profiles))
    twice = people.agg({"profile_no": "min"}).first()[0]
    features = scratch.keep(posting_features(postings, profile_vocabulary(people)), "f")
    alone = ranked_rows(rank_matches(features, people, scratch, limit=4))
    both = people.unionByName(people.filter(f"profile_no = {twice}"))
    got = ranked_rows(rank_matches(features, both, scratch, limit=4))
    assert [r for r in got if r[0] != twice] == [r for r in alone if r[0] != twice]
    assert len(got) > len(alone) - 4 and any(r[0] == twice for r in got)
    (table,) = glob.glob(f"{scratch.root}/*-rank-numbers")
    assert {r["profile_no"] for r in spark.read.parquet(table).collect()} == {twice}


def test_term_join_equals_inline(make_postings, make_profiles, scratch):
    postings, profiles = world(make_postings, make_profiles, seed=8, posts=20, people=8)
    vocab = profile_vocabulary(profile_features(profiles))
    hits = lambda n: {
        r["ordinal"]: sorted(r["text_hits"])
        for r in posting_features(postings, vocab, inline_terms=n).collect()
    }
    assert hits(0) == hits(100)


def test_reasons_and_order(make_postings, make_profiles, scratch):
    posts = make_postings(
        dict(title="Night Porter", description="Carries bags up the stairs."),
        dict(
            title="Rotational Chartist", description="Ships SQL, Python and C++ jobs.",
            concentration_tags=["Data Analytics and AI"],
            role_tags=["Data Analyst / BI Engineer"], opt_cpt_flag=True,
        ),
    )
    people = profile_features(
        make_profiles(
            dict(
                concentration="Data Analytics and AI", academic_stage="Incoming student (Fall)",
                target_roles=["Data Analyst / BI Engineer"], skills=["SQL", " python ", "sql", "", "c++"],
                work_auth_status="Need CPT / OPT sponsorship", student_id=" s1 ",
            )
        )
    )
    features = scratch.keep(posting_features(posts, profile_vocabulary(people)), "f")
    best, other = sorted(
        rank_matches(features, people, scratch, limit=2).collect(), key=lambda r: r["rank_position"]
    )
    assert best["score"] == 2 * 3 + 3 + 2 + 1 + 1 and best["student_key"] == "s1"
    assert best["reasons"] == [
        "Skill match: sql", "Skill match: python", "Skill match: sql",
        "Target role match: data analyst / bi engineer",
        "Concentration match: Data Analytics and AI", "CPT/OPT-friendly signal",
        "Seniority match: Entry",
    ]
    assert other["score"] == -1.0 and other["reasons"] == ["Seniority mismatch: Early/Mid"]


@pytest.mark.parametrize(
    "title,description,given,roles,tracks",
    [
        ("Marketing Trainee", "You watch the splunk console and file grc notes.", [],
         ["Cybersecurity Analyst"], ["Cybersecurity"]),
        ("Store Planner", "Shelf plans with our scrum master; some java helps.", [],
         ["Product / Project Manager", "Software Engineer"], ["Digital Transformation with AI"]),
        ("Ticket Taker", "Greets guests at the gate.", ["IT Strategy / Consulting", "Nonsense"], [],
         ["Digital Transformation with AI"]),
        ("Ticket Taker", "Greets guests at the gate.", [], [], []),
    ],
)
def test_classification(make_postings, title, description, given, roles, tracks):
    row = classify(
        make_postings(dict(title=title, description=description, concentration_tags=given))
    ).first()
    assert (row["role_tags"], row["concentration_tags"]) == (roles, tracks)
