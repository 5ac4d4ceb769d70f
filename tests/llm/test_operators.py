"""Small cases of every operator against brute force: nulls, empty and long texts,
ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobweave.llm import bpe, chat, langid, lm, mix, neardup, pii, tokenfile, vectors
from jobweave.llm.common import components, prefix_sums
from jobweave.llm.exact import deduplicate, keep_one
from jobweave.llm.queries import new_index

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `key` string, ids string, row string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("ban cor dul fem gip hon jat kel mun nop".split()) + str(r.randrange(40)) for _ in range(n))


BASE = words(200, 1)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"),
    (3, BASE.replace("ban", "Ban") + " tail", None, "b"), (4, words(300, 2), "fr", None),
    (5, "", "en", "a"), (6, None, "en", "b"), (7, "one two", "de", "c"), (8, "One  two", "de", "c"),
    (None, BASE, "en", "a"), (9, "x" * 40000, "en", "d"), (10, words(6000, 3), "en", "d"), (11, "日本 語　é <|endoftext|>", "ja", "e"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1, "k", "i", "r") for r in ROWS], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, docs, none, scratch):
    index = new_index(spark, scratch)
    got = deduplicate(docs, index).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[hashlib.sha256((t or "").encode()).digest()].append(i)
    for r in got:
        ids = groups[bytes(r.digest)]
        assert r.keep_id == max(i for i in ids if i is not None) and r.copies == len(ids)
        assert r.kept == (r.id == r.keep_id)
    # a later batch: known texts lose, new ones are appended
    later = spark.createDataFrame([(90, "one two"), (91, "new"), (92, "new")], "doc_id long, text string")
    assert {(r.id, r.keep_id, r.kept) for r in deduplicate(later, index).collect()} == {(90, 7, False), (91, 92, False), (92, 92, True)}
    assert deduplicate(none, index).count() == 0
    kept = keep_one(docs, new_index(spark, type(scratch)(spark)))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7, 8, 9, 10, 11]


def brute_near(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
        sets.setdefault(i, s)
    link = {i: {j for j, y in sets.items() if i != j and x and y and 100 * len(x & y) >= percent * len(x | y)} for i, x in sets.items()}
    root = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += link[j]
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates(spark, docs, none, scratch):
    rows = [r for r in ROWS if r[0] is not None]
    base = words(150, 9).split()
    r = random.Random(4)
    for k in range(60):  # a chain of edits: links between neighbours, none between ends
        if k % 3 == 0:
            base[r.randrange(150)] = f"edit{k}"
        rows.append((100 + k, " ".join(base), "en", "a"))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), scratch, shingle=4)
    want = brute_near(rows, 4, 80)
    for x in got.collect():
        assert (x.n_shingles, x.component_id) == want[x.doc_id] and x.kept == (x.doc_id == x.component_id)
    got = {x.doc_id: x for x in neardup.near_duplicates(docs, scratch).collect()}
    assert got[None].component_id is None and got[None].kept and got[3].component_id == 1 and got[5].kept
    assert neardup.near_duplicates(none, scratch).count() == 0


def test_densified_signatures_agree_as_often_as_sets_do():
    oph = neardup.OnePermutation()
    r = np.random.default_rng(0)
    agree = []
    for _ in range(60):
        x = np.unique(r.integers(0, 1 << 63, 50, dtype=np.uint64))
        a, b = oph.signature(x[:45]), oph.signature(x[5:])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 0.8) < 0.03


def test_chat(spark, scratch):
    turns, r = [], random.Random(2)
    for c in (1, 2, None):
        for k in range(0 if c == 2 else 1, 40):
            role = "system" if k == 0 else ("user", "assistant", None, "tool\n")[k % 4 if k > 30 else k % 2]
            text = None if k == 7 else r.choice(["<|end|>", "<\\|end|>", "[INST] x", "", "日本 "]) * r.randrange(4) + words(r.randrange(60), k)
            turns.append((c, k, role, text, "z", 1))
    turns += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same")] and [(3, 0, "assistant", "same", "z", 1)] * 2
    turns.append((4, 0, "user", words(5000, 1), "z", 1))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, window string, start long")
    out = scratch.keep(chat.windows(df, scratch, budget=300, history=80), "w")
    back = defaultdict(list)
    for w in chat.parsed(out).orderBy("window").collect():
        back[w.conv_id].append(w)
    for c in (1, 2, 3, 4, None):
        mine = [(x[2] or "", x[3] or "") for x in turns if x[0] == c]
        assert [(t.role, t.text) for w in back[c] for t in w.turns] == mine
        assert [x for w in back[c] for x in w.losses] == [t for a, t in mine if a == "assistant"]
    shown = out.filter("conv_id = 2 AND window > 0").collect()
    assert shown and all(w.formatted.startswith("<|turn|>system") and w.n_context > 0 for w in shown)
    assert chat.windows(df.limit(0), scratch).count() == 0


def test_surrogates(spark, none, scratch):
    mail, card = "jo.doe7@mail3.example.com", "4012 8888 8888 1881"
    rows = [
        (1, f"write {mail} or +1 (743) 555-3824, 10.20.130.40; token = \"{'ab12' * 10}\"", "en", "a"),
        (2, f"{mail.upper()} {card}! Mrs. Ada Byron met Mr Ada Byron and Frau Иванова", "en", None),
        (3, "nothing here 12 34", "en", "a"), (4, None, None, None), (None, f"{card.replace(' ', '')} {mail}", "en", "a"), (4, "", "x", "y"),
    ]
    df = spark.createDataFrame([(*r, 0, 1, "k", "i", "r") for r in rows], SCHEMA)
    got = {(r.row.doc_id, r.row.source): r for r in pii.with_surrogates(df, "k1", scratch).collect()}
    one, two, three = got[1, "a"].text, got[2, None].text, got[None, "a"].text
    assert got[3, "a"].text == rows[2][1] and got[4, None].text is None and got[4, "y"].text == ""
    assert [got[k].n_entities for k in ((1, "a"), (2, None), (None, "a"))] == [4, 5, 2]
    for secret in (mail, "743", "10.20.130.40", "ab12ab12", card, "Byron", "Иванова"):
        assert secret.lower() not in (one + two + three).lower()
    new_mail = one.split()[1]
    assert new_mail.endswith(".com") and new_mail in two and new_mail in three  # one entity
    digits = lambda t: "".join(c for c in t if c.isdigit())
    new_card = digits(three)[:16]
    assert new_card in digits(two) and "!" in two
    luhn = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, new_card)))
    assert luhn % 10 == 0
    ada, bob = two.split("Mrs. ")[1].split(" met")[0], two.split("Mr ")[1].split(" and")[0]
    assert ada != bob and ada.split()[0].endswith("na") and bob.split()[0].endswith("ro")
    assert any("а" <= c <= "я" for c in two)
    again = {(r.row.doc_id, r.row.source): r.text for r in pii.with_surrogates(df, "k1", scratch).collect()}
    other = {(r.row.doc_id, r.row.source): r.text for r in pii.with_surrogates(df, "k2", scratch).collect()}
    assert again[1, "a"] == one and other[1, "a"] != one
    assert pii.with_surrogates(none, "k", scratch).count() == 0


def test_surrogates_never_collide(spark, scratch):
    ips = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in (1, 2) for d in range(1, 10)]
    table = pii.surrogate_table(spark.createDataFrame([("ip", "", x) for x in ips], "kind string, gender string, norm string"), "k", scratch)
    made = [r.surrogate for r in table.collect()]
    assert len(made) == len(set(made)) == len(ips) and not set(made) & set(ips)


def test_mix(spark, docs, none, scratch):
    got = mix.shares(docs, scratch).collect()
    assert len(got) == len(ROWS)
    size = Counter()
    for _, t, _, s in ROWS:
        size[s] += len((t or "").split(" ")) if t and "　" not in t and "  " not in t else len((t or "").encode().split())
    total, order = sum(size.values()), sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in size if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / free for s in size}
        over = {s for s in size if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sorted(map(str, mix.shares(docs, scratch).collect())) == sorted(map(str, got))
    rows = mix.mixed(docs, scratch)
    assert rows.columns == docs.columns and rows.filter("text IS NULL").count() == 1
    assert mix.shares(none, scratch).count() == mix.mixed(none, scratch).count() == 0


def test_bpe(docs, none):
    lib = Tokenizer.from_file(BYTE)
    out = bpe.decode(bpe.encode(docs, BYTE, keys=("doc_id", "source", "size")), BYTE).collect()
    assert len(out) == len(ROWS)
    want = Counter()
    for i, t, *_ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in out) == want
    assert bpe.encode(none, BYTE).count() == 0


def test_bpe_streams_like_the_library():
    lib, enc, dec = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE), bpe.Decoder(BYTE)
    r = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "the", "The", "'s", "1", "é", "日本", "\x1c", "　", "<|endoftext|>", "́", "!", " " * 9]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(500)]
    texts += ["".join(r.choice("abeinrst") for _ in range(3000)) for _ in range(20)] + ["a" * 9000, "=-" * 50 + "=" * 4000]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t).tolist() == ids and dec.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert dec.decode([0, 10**9, -3]) == lib.decode([0]) and len(list(dec.pieces(range(70_000)))) > 1
    assert dec.decode([enc.m.single[0xC3]]) == "�"


def test_token_files(docs, none, scratch, tmp_path):
    lib = Tokenizer.from_file(WORD)
    files = scratch.keep(tokenfile.write(docs, WORD, f"{scratch.root}/t", scratch), "files")
    got = tokenfile.read(files).collect()
    want = Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4"))) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_ids * 4 == len(r.ids)
        at += r.n_ids
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    some = tokenfile.read(files, [4, 10, 77]).collect()
    assert sorted(r.doc_id for r in some) == [4, 10] and tokenfile.read(files, []).count() == 0
    assert tokenfile.read(tokenfile.write(none, WORD, f"{scratch.root}/e", scratch)).count() == 0


def test_token_file_layout(tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    path = str(tmp_path / "x.zst")
    fs = pafs.LocalFileSystem()
    docs = [(i, np.arange(n, dtype=np.uint32)) for i, n in enumerate((0, 5, tokenfile.FRAME_IDS * 2 + 3, 7))]
    with fs.open_output_stream(path, compression=None) as out:
        w = tokenfile.Writer(out)
        for d in docs:
            w.add(*d)
        w.close()
    with fs.open_input_file(path) as f:
        r = tokenfile.Reader(f)
        for i in (3, 1, 2, 0):
            assert r.document(i).tolist() == docs[i][1].tolist()
    data = open(path, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(d.tobytes() for _, d in docs)
    assert zlib.crc32(plain)
    with open(path, "r+b") as f:  # a damaged frame is noticed
        f.seek(20)
        f.write(b"\xff\xfe")
    with fs.open_input_file(path) as f, pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.Reader(f).document(1)


def test_vectors(spark, scratch):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 16))
    x[100:180] = x[0] + r.normal(size=(80, 16)) * 0.15
    x[180:220] = x[1]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(400, None, 0), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (404, [], 2), (405, [1.0], 2), (None, x[1].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    got = {g.vec_id: g for g in vectors.near_vectors(df, scratch, block=32).collect()}
    y = np.vstack([x, np.eye(16)[:1]])
    ids = [*range(400), 405]
    u = y / np.linalg.norm(y, axis=1)[:, None]
    s = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.95 * s.sum() and all(got[i].n_links <= s[k].sum() for k, i in enumerate(ids))
    assert all(got[i].component_id == 1 for i in range(180, 220))
    for i in (400, 401, 402, 403, 404, None):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectors.near_vectors(df.limit(0), scratch).count() == 0


def test_language(spark, none, scratch):
    sets = {"en": "the of and house river walks", "fr": "le la et maison rivière été", "de": "der die und häuser flüsse straße"}
    r = random.Random(1)
    text = lambda l, n: " ".join(r.choice(sets[l].split()) for _ in range(n))
    rows = [(i, text(l, 30), l, f"{l}.example.com") for i, l in enumerate(["en", "fr", "de"] * 60)]
    train, test = rows[:90], rows[90:]
    schema = "doc_id long, text string, lang string, source string"
    model = langid.fit(spark.createDataFrame(train, schema))
    more = [(900, "12 34 !!", "en", "en.example.com"), (901, None, None, None), (902, "", "fr", "x"), (903, "rivière", None, None), (None, text("de", 9), "", "a"), (900, "12 34 !!", "en", "en.example.com")]
    df = spark.createDataFrame(test + more, schema)
    out = langid.identify(langid.document_evidence(df, "doc_id"), model, scratch, keys=["doc_id"]).collect()
    assert len(out) == len(test) + len(more)
    truth = {i: l for i, _, l, _ in test}
    assert np.mean([r.lang == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.98  # held out
    assert all(r.kept for r in out if r.doc_id in truth)
    assert all(r.lang == "und" and not r.kept for r in out if r.doc_id in (900, 901, 902))
    # a short text that says little goes with its host and its declared language
    vague = spark.createDataFrame(test + [(950, "e", "fr", "fr.example.com"), (951, "e", "de", "de.example.com")], schema)
    got = {r.doc_id: r.lang for r in langid.identify(langid.document_evidence(vague, "doc_id"), model, scratch, keys=["doc_id"]).collect()}
    assert (got[950], got[951]) == ("fr", "de")
    pages = spark.createDataFrame(
        [(1, "https://u@m.x.de:8/fr/1", '<html lang="de"><script>the the</script><p>der die</p></html>'), (2, None, None)],
        "page_id long, url string, html string",
    )
    seen = langid.page_evidence(pages, "page_id").orderBy("page_id").collect()
    assert (seen[0].declared, seen[0].hint, seen[0].host, seen[0].text.split()) == ("de", "fr", "m.x.de", ["der", "die"])
    assert langid.identify(langid.document_evidence(none, "doc_id"), model, scratch, keys=["doc_id"]).count() == 0
    assert langid.fit(none.select("text", "lang")).languages == []
    out = langid.identify(langid.document_evidence(df, "doc_id"), langid.fit(none), scratch, keys=["doc_id"])
    assert {r.kept for r in out.collect() if r.doc_id in truth} == {True}


def test_language_model(spark, docs, none, scratch):
    train = [t for i, t, *_ in ROWS if i != 4]
    toks = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c, bi = Counter(), Counter()
    for t in train:
        w = toks(t)
        c.update(w)
        bi.update(zip([b" ", *w], w))
    n, v, follows = sum(c.values()), len(c), Counter(w for _, w in bi)
    count = lambda x: [sum(y == i for y in x.values()) for i in (1, 2, 3, 4)]
    d2, d1 = lm.discounts(count(bi)), lm.discounts(count(follows))
    left = sum(d1[min(x, 3)] for x in follows.values()) / len(bi)
    total, kinds = Counter(), defaultdict(Counter)
    for (u, _), x in bi.items():
        total[u] += x
        kinds[u][min(x, 3)] += 1

    def p(u, w):
        one = max(follows[w] - d1[min(follows[w], 3)], 0) / len(bi) + left / (v + 1)
        if not total[u]:
            return one
        return max(bi[u, w] - d2[min(bi[u, w], 3)], 0) / total[u] + sum(d2[k] * m for k, m in kinds[u].items()) / total[u] * one

    assert abs(sum(p(b"ban1", w) for w in [*c, b"?"]) - 1) < 1e-9
    model = lm.train(docs.filter("doc_id IS NULL OR doc_id <> 4"), scratch, shards=5)
    assert (model.n_tokens, model.n_types, model.n_pairs) == (n, v, len(bi))
    got = lm.score(docs, model, keys=("doc_id", "text")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = toks(r.text)
        assert (r.n_tokens, r.n_known) == (len(w), sum(x in c for x in w))
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-6)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip([b" ", *w], w)), abs_tol=1e-6)
    empty = lm.train(none, type(scratch)(spark))
    assert [r.score for r in lm.score(docs.limit(1), empty).collect()] == [0.0] and lm.score(none, model).count() == 0


def test_helpers(spark, scratch):
    r = random.Random(5)
    rows = [(None if i % 3 == 0 else "g" if i % 3 == 1 else f"h{i}", i, r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    want, sums = {}, Counter()
    for g, o, v in rows:
        want[o] = sums[g]
        sums[g] += v
    assert {x.o: x.s for x in prefix_sums(df, ["g"], ["o"], {"s": "v"}, scratch).collect()} == want
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, *range(200, 260))}


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    seen = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, seen, "").cache()
        assert out.columns == seen.columns, name
        if name == "language":
            assert {r.doc_id for r in out.collect()} >= {1, 2, 3, 4, 10}
            assert not {5, 6} & {r.doc_id for r in out.collect()}
        if name == "exact":
            assert Counter(r.text for r in out.collect()).most_common(1)[0][1] == 1
        if name == "near":
            assert len({2, 3} & {r.doc_id for r in out.collect()}) == 1
        seen = out
    done = cp.STAGES[-1][1](spark, seen, "").collect()
    assert done and all(r.decoded_same for r in done) and len(done) == seen.count()
    empty = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0, name
