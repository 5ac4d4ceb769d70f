"""Every label gets a model; copies of a text count once."""

import numpy as np

from jobweave.llm import langid


def test_more_than_64_languages(spark, scratch):
    r = np.random.default_rng(3)
    words = [["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(12)] for _ in range(70)]
    text = lambda k: " ".join(r.choice(words[k], 30))
    rows = [(k * 10 + i, text(k), f"l{k:02}", "host") for k in range(70) for i in range(8 if k < 64 else 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(df)
    assert len(model.languages) == 70
    assert all(model.languages[int(np.argmax(model.likelihoods(t)[1]))] == x for _, t, x, _ in rows)


def test_copies_do_not_swamp_the_sample(spark):
    rows = [("aaa bbb ccc", "en")] * 300 + [(f"the house{i} of river{i}", "en") for i in range(50)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(df)
    once = langid.fit(df.distinct())
    assert np.array_equal(model.logs, once.logs)
    few = langid.fit(df, per_language=5)
    raw = np.exp(few.logs.astype(float)).T[0]
    seen = np.round(raw / raw.min() - 1) / 10  # counts of buckets
    assert 0 < seen.sum() <= 5 * 25
