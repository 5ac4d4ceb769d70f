from pyspark.sql import functions as F

from jobweave.functions import text, urls, values


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_canonical_url(spark):
    cases = {
        "HTTPS://Example.com/jobs/1/?utm_source=email&keep=yes": "https://example.com/jobs/1?keep=yes",
        "http://a.b//?q=%zz&b=~*x+y&&c#f": "http://a.b/?q=%25zz&b=~%2Ax+y&c=",
        "http://A.b": "http://a.b/",
        " https://x.org/A/b?UTM_x=1&Ref=2&SOURCE=3&z=%C3%A9 ": "https://x.org/A/b?z=%C3%A9",
        "https://x.org/?a=1=2&a=3": "https://x.org/?a=1%3D2&a=3",
    }
    for raw, want in cases.items():
        assert one(spark, urls.canonical_url(F.lit(raw))) == want


def test_url_contract(spark):
    assert one(spark, urls.normal_url(F.lit("HTTP://Ex.com:80"))) == "http://ex.com/"
    assert one(spark, urls.normal_url(F.lit("https://Ex.com:443/A?b#c"))) == "https://ex.com/A?b#c"
    for bad in ("ftp://x.y", "x.y/z", "http://", ""):
        assert one(spark, urls.is_http_url(F.lit(bad))) is False


def test_strip_and_collapse_know_unicode_space(spark):
    assert one(spark, text.strip(F.lit(" \t a b　\n"))) == "a b"
    assert one(spark, text.collapse(F.lit(" a \n  b\tc  d "))) == "a b c d"


def test_word_boundaries(spark):
    body = F.lit("café ai, c++ and a++b; power bi")

    def found(terms, pattern):
        return one(spark, text.terms_in(body, terms, pattern))

    terms = ["caf", "ai", "c++", "a++", "++", "power bi", "power", "and a", "b; power"]
    # no word character beside the term
    assert found(terms, text.lookaround_pattern) == ["ai", "c++", "power bi", "power", "and a", "b; power"]
    # a boundary on both sides: a symbol at the edge needs a word character next to it
    assert found(terms, text.boundary_pattern) == [
        "ai", "a++", "++", "power bi", "power", "and a", "b; power",
    ]


def test_grams_agree_with_patterns(spark, scratch):
    from jobweave.operators.terms import match_terms

    bodies = ["café ai, c++ and a++b; power bi", "++ ai", "x ai-ai y", "power  bi .net asp.net", ""]
    terms = ["caf", "ai", "c++", "a++", "++", "power bi", ".net", "asp.net", "ai-ai", "and a"]
    texts = spark.createDataFrame(list(enumerate(bodies)), "ordinal bigint, text string")
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    want = {
        (r["ordinal"], t)
        for r in texts.select(
            "ordinal", text.terms_in(F.col("text"), terms, text.boundary_pattern).alias("h")
        ).collect()
        for t in r["h"]
    }
    for limit in (1000, 0):  # broadcast, then salted shuffle
        got = {
            (r["ordinal"], r["term"])
            for r in match_terms(texts, vocab, broadcast_terms=limit, salts=3).collect()
        }
        assert got == want
    assert (3, ".net") in want and (0, "++") in want and (1, "++") not in want


def test_dates_lists_bools(spark):
    d = lambda s: str(one(spark, values.parse_date(F.lit(s))))
    assert d("2026-06-01") == d(" 2026-06-01T09:30:00Z ") == d("20260601") == "2026-06-01"
    assert d("2026-6") == d("not-a-date") == d("2026-13-01") == "None"
    assert one(spark, values.parse_list(F.lit("a; b, c ;;d"))) == ["a", "b, c", "d"]
    assert one(spark, values.parse_list(F.lit("a, b,"))) == ["a", "b"]
    assert one(spark, values.parse_bool(F.lit(" Yes "))) is True
    assert one(spark, values.parse_bool(F.lit("0"))) is False
    assert one(spark, values.parse_bool(F.lit("maybe"))) is None
    assert one(spark, values.week_bucket(F.lit("2026-06-03").cast("date"))) == "2026-06-01"


def test_dates(spark):
    from datetime import date

    from jobweave.functions.values import parse_date, strict_date

    texts = ["2026-W23-2", "2026-W23", "2026W232", "2026-W53-7", "2025-W53-1", "2026-W00-1", "2026-06-02 tomorrow", " 2026-06-02 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.orderBy("i").select(parse_date(F.col("t")), strict_date(F.col("t"))).collect()
    june = date(2026, 6, 2)
    assert [r[0] for r in got] == [june, date(2026, 6, 1), june, date(2027, 1, 3), None, None, june, june]
    assert [r[1] for r in got] == [None] * 7 + [june]


def test_words_are_found_as_by_the_pattern(spark):
    """Byte searches in ``word_text`` agree with the patterns, at every kind of edge."""
    bodies = [
        "ai", "ai,", "maid ai", "ai_x", "éai", "ai\u00a0x", "x ai\U00010400", "in the", "in  the", "in,the", "xin the",
        "c++ c++x", "a / b", "a/b", "café", "cafés", "\u4e00ai", "ai\u0301", "", None,
    ]
    terms = ["ai", "in the", "c++", "a / b", "café", "the", "b", "ai_x", "\u4e00ai"]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string").withColumn("words", text.word_text(F.col("body")))
    for pattern in (text.lookaround_pattern, text.boundary_pattern):
        got = rows.select(
            text.terms_in(F.col("body"), terms, pattern).alias("plain"),
            text.terms_in(F.col("body"), terms, pattern, F.col("words")).alias("fast"),
        ).collect()
        assert [r["plain"] for r in got] == [r["fast"] for r in got]
        assert got[0]["fast"] == ["ai"] and got[4]["fast"] == [] and got[7]["fast"] == ["in the", "the"]


def test_a_word_needs_no_pattern(spark):
    rows = spark.createDataFrame([("ai",)], "body string").withColumn("words", text.word_text(F.col("body")))
    hits = rows.select(text.terms_in(F.col("body"), ["ai", "que"], words=F.col("words")).alias("hits"))
    plan = hits._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" not in plan.upper()


def test_collapse_knows_every_space(spark):
    for c in text.SPACES:
        assert one(spark, text.collapse(F.lit(f"{c}a{c}b {c}  c{c}{c}"))) == "a b c"
    assert one(spark, text.collapse(F.lit("a\u200bb \u00e9\u00ff\u4e00\U00010400"))) == "a\u200bb \u00e9\u00ff\u4e00\U00010400"


def test_long_texts_are_stripped_and_lowered_once(spark):
    from jobweave.functions import keys
    from jobweave.operators.quality import is_valid

    bodies = ["", " ", None, "a", " a", *text.SPACES, *[f"{c}x{c}" for c in text.SPACES]]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = rows.select(text.is_blank(F.col("b")).alias("fast"), (text.strip(F.col("b")) == "").alias("plain")).collect()
    assert [r["fast"] for r in got] == [r["plain"] for r in got]
    names = ("source", "title", "company", "location", "description", "url")
    post = spark.createDataFrame([("s", "ßT ", "", None, "İ Σ　 Aß\x1f", "u")], ", ".join(f"{c} string" for c in names))
    signed = post.withColumn("_f", keys.folded_description())
    whole = F.concat_ws("||", *[text.casefold(text.strip(F.col(c))) for c in ("title", "company", "location")], "_f")
    row = signed.select(keys.content_signature(F.col("_f")).alias("a"), text.stable_hash(whole).alias("b")).first()
    assert row["a"] == row["b"]

    # the parts only: title, company, location
    assert "btrim" not in str(is_valid()).lower()
    assert str(keys.dedup_signature(F.col("_f"))).count("lower(") == 3
    assert str(keys.content_signature(F.col("_f"))).count("lower(") == 3
