import random

import pytest

from jobweave.operators.components import component_labels
from jobweave.operators.dedup import KEYS, attribute_duplicates, deduplicate, kept_ordinals


def sequential(rows):
    seen, kept = set(), []
    for ordinal, *keys in rows:
        mine = {(i, k) for i, k in enumerate(keys) if k is not None}
        if not mine & seen:
            seen |= mine
            kept.append(ordinal)
    return kept


def table(spark, rows):
    return spark.createDataFrame(rows, "ordinal bigint, " + ", ".join(f"{k} string" for k in KEYS))


def random_rows(n, spread, seed):
    r = random.Random(seed)
    pick = lambda: f"k{r.randrange(spread)}"
    return [
        (i, pick(), None if r.random() < 0.3 else pick(), pick()) for i in range(1, n + 1)
    ]


@pytest.mark.parametrize(
    "n,spread,options",
    [
        (300, 120, dict(component_rows=1)),  # rounds until every key stands alone
        (300, 120, dict(component_rows=6)),  # rounds, then components
        (300, 400, dict(component_rows=1, hot_floor=3)),  # hot-key joins
        (200, 60, dict()),  # components only
    ],
)
def test_matches_sequential_rule(spark, scratch, n, spread, options):
    rows = random_rows(n, spread, seed=n + spread)
    got = sorted(r[0] for r in kept_ordinals(table(spark, rows), scratch, **options).collect())
    assert got == sequential(rows)


def test_hot_key_and_chain(spark, scratch):
    # one key with a third of the rows, and a chain A~B, B~C in which C survives
    rows = [(i, "hot" if i % 3 == 0 else f"u{i}", None, f"c{i}") for i in range(1, 91)]
    rows += [(101, "a", None, "x"), (102, "b", "s", "x"), (103, "c", "s", "y")]
    rows += [(104, None, None, None), (105, None, None, None)]
    keyed = scratch.keep(table(spark, rows), "keyed")
    kept = kept_ordinals(keyed, scratch, component_rows=10, hot_floor=5)
    got = sorted(r[0] for r in kept.collect())
    assert got == sequential(rows)
    assert 103 in got and 102 not in got and {104, 105} <= set(got)
    why = {r["ordinal"]: (r["kept_ordinal"], r["matched_on"])
           for r in attribute_duplicates(keyed, kept, hot_floor=5).collect()}
    assert why[6] == (3, "url") and why[102] == (101, "content") and 103 not in why
    assert set(why) == {r[0] for r in rows} - set(got)


def chain(length, order):
    """Neighbours share a url or a content, one after the other."""
    return sorted(
        (order(i), f"u{i // 2}", None, f"c{(i + 1) // 2}") for i in range(length)
    )


@pytest.mark.parametrize("order", [lambda i: i, lambda i: 1000 - i, lambda i: i * 37 % 101])
def test_long_chains(spark, scratch, order):
    rows = chain(100, order)
    got = sorted(r[0] for r in kept_ordinals(table(spark, rows), scratch).collect())
    assert got == sequential(rows)


def test_tables_do_not_follow_the_length_of_chains(spark, scratch):
    def tables(length):
        used = type(scratch)(spark)
        kept_ordinals(table(spark, chain(length, lambda i: i)), used).count()
        path = spark.sparkContext._jvm.java.io.File(used.root)
        return len(path.list())

    assert tables(200) == tables(10)


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_component_labels(spark, scratch, chunk):
    r = random.Random(8)
    pairs = [(n, f"k{r.randrange(260)}") for n in range(1, 301) for _ in range(r.randrange(1, 3))]
    got = component_labels(spark.createDataFrame(pairs, "node long, key string"), scratch, chunk_pairs=chunk)
    label = {n: n for n, _ in pairs}
    while True:
        low = {}
        for n, k in pairs:
            low[k] = min(low.get(k, n), label[n])
        new = {n: min(low[k] for m, k in pairs if m == n) for n in label}
        if new == label:
            break
        label = new
    assert {x.node: x.label for x in got.collect()} == label


def test_posting_cases(make_postings, scratch):
    posts = make_postings(
        dict(url="https://example.com/jobs/1"),
        dict(url="https://example.com/jobs/1/", title="Duplicate Posting"),
        dict(url="https://example.com/jobs/2?utm_source=x", title="Security Analyst"),
        dict(url="https://example.com/jobs/2", title="Other"),
        dict(title="Systems Analyst", description="One."),
        dict(title="Systems Analyst", description="Configure workflows."),
        dict(title="SYSTEMS analyst", description=" one. "),
        dict(source_job_id="A1"),
        dict(raw_metadata='{"source_job_id": "a1 "}'),
        dict(source_job_id="A1", source="elsewhere"),
    )
    kept = sorted(r["ordinal"] for r in deduplicate(posts, scratch).collect())
    assert kept == [1, 3, 5, 6, 8, 10]
