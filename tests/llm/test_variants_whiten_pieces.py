"""Spelling variants, whitening and marked-word pieces against brute force: nulls, empty
and long texts, ties, repeated rows, empty tables, extra columns."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from jobweave.llm import pieces, spelling, whiten

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# --- spelling variants ------------------------------------------------------


def brute_variants(n, factor):
    cut, holes, near = defaultdict(set), defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add(w)
            holes[w[:i], w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for v in cut.get(w, ()):
            near[w].add(v)
            near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def found_variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_equal_brute_force(spark, scratch):
    r = random.Random(5)
    n = Counter()
    for _ in range(1500):  # few letters: dense neighbourhoods, runs of equal letters
        n["".join(r.choice("abé") for _ in range(r.randrange(1, 7)))] += r.choice([1, 1, 1, 5, 25, 125])
    n["x" * 3000] = 5
    n["x" * 3001] = 25
    n["x" * 1500 + "y" + "x" * 1499] = 125
    rows = [(w, c, "e", "f") for w, c in n.items()] + [(None, 9, "e", "f"), ("", 9, "e", "f")]
    given = spark.createDataFrame(rows, "word string, n long, form string, root string")
    assert found_variants(spelling.variants(given, scratch)) == brute_variants(n, 5)


def test_variants_chain_over_ranges(spark, scratch):
    # each word is a letter longer and five times as frequent: ways of many steps
    n = {"abcdefghijklmnop"[:k]: 5**k for k in range(1, 16)}
    given = spark.createDataFrame(list(n.items()), "word string, n long")
    again = given.filter("n > 1000").select("word", F.lit(0).cast("long").alias("n"))
    got = found_variants(spelling.variants(given.unionByName(again), scratch))
    assert got == brute_variants(n, 5) and got["a"][1] == "abcdefghijklmno"
    nodes = spelling.trie_nodes(given.repartition(7), F.col("word"), scratch).collect()
    assert {x.word: list(x.path) for x in nodes} == {w: list(range(len(w) + 1)) for w in n}


def test_trie_nodes_are_prefixes(spark, scratch):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(3000)})
    given = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
    rows = spelling.trie_nodes(given, F.col("word"), scratch).collect()
    assert {x.word: x.no for x in rows} == {w: i for i, w in enumerate(words, 1)}
    node = {}
    for x in rows:
        for i, p in enumerate(x.path):
            assert node.setdefault(x.word[:i], p) == p
    assert len(set(node.values())) == len(node)


def test_variants_of_nothing(spark, scratch):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none, scratch).count() == 0


def test_counted_words(spark):
    docs = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), (["a"],)], "ws array<string>")
    assert [tuple(r) for r in spelling.count_words(docs, F.col("ws"), 2).collect()] == [("a", 3)]


# --- whitening --------------------------------------------------------------


def test_whitening_equals_numpy(spark, scratch):
    r = np.random.default_rng(3)
    x = (r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) * 500).astype(np.int64) + 100000
    x[:100] = x[0]  # a third of the rows are one vector
    rows = [(int(i) if i % 50 else None, v.tolist(), "a", 1) for i, v in enumerate(x)]
    rows.append((7, None, "a", 1))
    given = spark.createDataFrame(rows, "vec_id long, vector array<long>, component string, n int")
    got = whiten.whiten(given, scratch, components=8).collect()
    assert len(got) == 300 * 8
    n, s = len(x), x.sum(0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1][:, :8]
    v = v * np.where(v[np.abs(v).argmax(0), range(8)] < 0, -1, 1)
    want = (x - s / n) @ v / np.sqrt(e[:8])
    deviation = ((n * x - s).astype(object) ** 2).sum(1)
    ids = [i if i % 50 else None for i in range(n)]
    mine = sorted(
        ((str(i), int(d), j + 1, w[j]) for i, d, w in zip(ids, deviation, want) for j in range(8)), key=lambda t: t[:3]
    )
    theirs = sorted(((str(g.vec_id), int(g.deviation), g.component, g.whitened) for g in got), key=lambda t: t[:3])
    assert [t[:3] for t in mine] == [t[:3] for t in theirs]
    assert np.allclose([t[3] for t in mine], [t[3] for t in theirs], atol=1e-9)
    assert all(g.n == n and g.identity_error < 1e-9 for g in got)
    assert all(abs(g.explained - e[g.component - 1] / e.sum()) < 1e-12 for g in got)


def test_whitening_uses_many_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whiten, "BLOCK_COLS", 4)
    monkeypatch.setattr(whiten, "BLOCKS_A_TASK", 2)
    r = np.random.default_rng(4)
    x = r.integers(0, 1000, (150, 10))
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<long>")
    got = whiten.whiten(given, scratch, components=3).orderBy("vec_id", "component").collect()
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    want = np.abs((x - x.mean(0)) @ v[:, ::-1][:, :3] / np.sqrt(e[::-1][:3]))
    assert np.allclose(np.abs(np.array([g.whitened for g in got]).reshape(150, 3)), want, atol=1e-9)


def test_whitening_without_variance(spark, scratch):
    # two rows vary in one direction only; the shorter vector is filled with zeros
    given = spark.createDataFrame([(1, [4, 0, 0]), (2, [8])], "vec_id long, vector array<long>")
    got = whiten.whiten(given, scratch).orderBy("vec_id", "component").collect()
    assert [(g.vec_id, g.component, g.n, int(g.deviation)) for g in got] == [
        (i, c, 2, 16) for i in (1, 2) for c in (1, 2, 3)
    ]
    assert [g.whitened for g in got if g.component > 1] == [None] * 4
    assert {round(g.whitened, 9) for g in got if g.component == 1} == {1.0, -1.0}
    alone = whiten.whiten(given.limit(1), scratch).collect()
    assert all(g.whitened is None and g.identity_error is None and g.explained == 0 for g in alone)
    none = whiten.whiten(given.limit(0), scratch)
    assert none.count() == 0 and none.columns == whiten.whiten(given, scratch).columns
    huge = spark.createDataFrame([(1, [10**12]), (2, [-(10**12)])], "vec_id long, vector array<long>")
    assert {int(g.deviation) for g in whiten.whiten(huge, scratch).collect()} == {4 * 10**24}


def test_fixed_point(spark):
    nan, inf = float("nan"), float("inf")
    given = spark.createDataFrame(
        [([0.5, -0.25],), ([0.0004],), (None,), ([None, 1.0],), ([nan],), ([-inf],), ([1e300],), ([],)], "v array<float>"
    )
    got = [r[0] for r in given.select(whiten.fixed_point(F.col("v"), 1024, 100000)).collect()]
    assert got == [[100512, 99744], [100000], None, None, None, None, None, []]


# --- marked-word pieces -----------------------------------------------------

TEXTS = [
    "", None, " ", "   ", "a", " a", "a ", "a  b", "  two   spaces  ", "tab\tand\nline\r\n end", "▁", "a▁b", "▁▁ x ▁",
    "<s> </s> <unk> <0x41>", "日本語のテキスト、空白なし", "emoji 👩‍👩‍👧 é é", "x" * 50_000, "ab " * 20_000,
    " " * 3000 + "x", "null \x00 byte", "don't stop", "don't stop",
]


@pytest.mark.parametrize("block_chars", [1, 40, 10**6])
def test_pieces_equal_the_library(spark, scratch, block_chars):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i if i else None, t, "r", [1], "w") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` string, ids array<int>, word string")
    got = pieces.decode(pieces.encode(docs.repartition(3), PIECES, scratch, block_chars=block_chars), PIECES).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = sp.encode(TEXTS[r.doc_id or 0] or "", num_threads=1) + [2]
        assert r.ids == want and r.text == sp.decode(want), r.doc_id


def test_pieces_of_repeated_rows_and_other_ends(spark, scratch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, None)], "doc_id long, text string")
    got = pieces.encode(docs, PIECES, scratch, end_id=None)
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == sorted(
        [(1, sp.encode("one two"))] * 2 + [(1, sp.encode("three")), (0, [])]
    )
    none = pieces.decode(pieces.encode(docs.limit(0), PIECES, scratch), PIECES)
    assert none.count() == 0 and none.columns == ["doc_id", "ids", "text"]
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing, PIECES).first().text == ""


def test_models_that_cross_marks_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(PIECES, "rb") as f:
        spec.ParseFromString(f.read())
    pieces.check_model(PIECES)
    spec.pieces.add(piece="of▁the", score=-1.0)
    (tmp_path / "m").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="crosses"):
        pieces.check_model(str(tmp_path / "m"))
