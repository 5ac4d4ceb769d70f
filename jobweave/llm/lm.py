"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from
memory-mapped sorted hash arrays.

Words are 64-bit hashes.  The vocabulary lies in shards by range of the hash, each a
sorted array with columns beside it; a word's id is its place in that order.  Bigrams
lie in shards by a hash of their context, each an array sorted by key; contexts that
own many tokens are spread over all shards by a hash of the whole bigram.  Counting
tasks send one packed array per shard and batch, summed before it moves.  The number
of shards follows the number of input partitions, so a shard's size does not grow.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import opened, publish
from jobweave.operators.scratch import Scratch

COUNT_TOKENS, SCORE_TOKENS = 1_000_000, 250_000  # handled at a time
END = xxhash.xxh64_intdigest(b"\n")  # no word contains white space
_GOLD, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BLOBS = "bucket long, data binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    return x ^ (x >> np.uint64(31))


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words and of one end mark."""
    words = (text or "").encode().lower().split()
    return np.fromiter([*map(xxhash.xxh64_intdigest, words), END], np.uint64, len(words) + 1)


def pack(**columns: np.ndarray) -> bytes:
    head = json.dumps([[k, v.dtype.str, len(v)] for k, v in columns.items()]).encode()
    head += b" " * (-(len(head) + 8) % 64)
    body = b"".join(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in columns.values())
    return len(head).to_bytes(8, "little") + head + body


def unpack(data) -> dict[str, np.ndarray]:
    n = int.from_bytes(bytes(data[:8]), "little")
    at, out = 8 + n, {}
    for name, kind, size in json.loads(bytes(data[8:at])):
        out[name] = np.frombuffer(data, kind, size, at)
        at += out[name].nbytes + -out[name].nbytes % 8
    return out


def mapped(uri: str) -> dict[str, np.ndarray]:
    """A shard as memory-mapped columns.  A shard in a remote store is first copied
    to the worker's own disk."""
    fs, path = opened(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        local = tempfile.NamedTemporaryFile(prefix="shard-", delete=False)
        with fs.open_input_stream(path) as f, local:
            while block := f.read(1 << 22):
                local.write(block)
        out = unpack(np.memmap(local.name, np.uint8, "r"))
        os.unlink(local.name)  # the mapping keeps it
        return out
    return unpack(np.memmap(path, np.uint8, "r"))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x.astype(np.uint64)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of a hash by its range, in ascending order."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _token_batches(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Key columns and tokens (of the last column) of about ``limit`` tokens of whole
    documents."""
    keys, docs, size = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            columns = [c.to_pylist() for c in b.slice(at, 1024).columns]
            for *key, text in zip(*columns):
                keys.append(key)
                docs.append(token_hashes(text))
                size += len(docs[-1])
                if size >= limit:
                    yield keys, docs
                    keys, docs, size = [], [], 0
    if docs:
        yield keys, docs


def _sent(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One packed row per bucket; columns are sorted by bucket already."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(bucket)]
    spans = list(zip(starts, ends)) if len(bucket) else []
    blobs = [pack(**{k: v[a:b] for k, v in columns.items()}) for a, b in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array(blobs, pa.binary())],
        names=["bucket", "data"],
    )


def _joined(table: pa.Table) -> dict[str, np.ndarray]:
    parts = [unpack(x.as_buffer()) for x in table.column("data")]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


class Model:
    """What workers need besides the shards; a few numbers per shard."""

    def __init__(self, root: str, shards: int) -> None:
        self.root, self.shards = root, shards
        self.types = np.zeros(shards, np.int64)  # words per vocabulary shard
        self.pairs = np.zeros(shards, np.int64)  # bigrams per bigram shard
        self.n_tokens = self.n_types = self.n_pairs = 0
        self.hot = 1
        self.d2 = self.d1 = np.zeros(4)  # discounts for counts 0, 1, 2, 3+
        self.left = 0.0  # mass the unigrams leave to the uniform distribution
        self._open: dict[str, dict] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def path(self, kind: str, shard: int) -> str:
        return f"{self.root}/{kind}-{shard:06d}.bin"

    def shard(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        path = self.path(kind, shard)
        if path not in self._open:
            self._open[path] = mapped(path)
        return self._open[path]

    def counted(self) -> Model:
        self.n_types = int(self.types.sum())
        self.offsets = np.concatenate([[0], np.cumsum(self.types)])
        return self

    def words(self, hashes: np.ndarray, kind: str, *columns: str) -> dict[str, np.ndarray]:
        """Ids (-1: unknown) and columns of sorted distinct hashes."""
        ids = np.full(len(hashes), -1, np.int64)
        out = {c: np.zeros(len(hashes), np.int64) for c in columns}
        edges = np.searchsorted(_bucket(hashes, self.shards), np.arange(self.shards + 1, dtype=np.uint64))
        for s in np.flatnonzero((np.diff(edges) > 0) & (self.types > 0)):
            a, b = edges[s], edges[s + 1]
            shard = self.shard(kind, int(s))
            at = np.minimum(np.searchsorted(shard["key"], hashes[a:b]), len(shard["key"]) - 1)
            hit = shard["key"][at] == hashes[a:b]
            ids[a:b][hit] = at[hit] + self.offsets[s]
            for c in columns:
                out[c][a:b][hit] = shard[c][at[hit]]
        return out | {"id": ids}

    def pair_key(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Exact while ids take 32 bits, a hash beyond."""
        c, w = context.astype(np.uint64), word.astype(np.uint64)
        if self.n_types + 1 < 1 << 32:
            return c << np.uint64(32) | w
        return _mixed(_mixed(c * _GOLD) + w * _M)

    def pair_shard(self, context: np.ndarray, word: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        c = _mixed((context.astype(np.uint64) + np.uint64(1)) * _GOLD)
        spread = _mixed(c + (word.astype(np.uint64) + np.uint64(1)) * _GOLD)
        return _bucket(np.where(tokens > self.hot, spread, c), self.shards).astype(np.int64)


def _pairs(docs: list[np.ndarray], model: Model, kind: str, *columns: str):
    """Word columns of all tokens, and each token's context id: the word before it,
    ``n_types`` at a document's start, -1 after an unknown word."""
    flat = np.concatenate(docs)
    distinct, inverse = np.unique(flat, return_inverse=True)
    found = model.words(distinct, kind, *columns)
    starts = np.cumsum([0, *[len(d) for d in docs[:-1]]])
    word = {k: v[inverse] for k, v in found.items()}
    context = np.concatenate([[0], word["id"][:-1]])
    context[starts] = model.n_types
    return word, context, starts


def _context_tokens(word: dict, starts: np.ndarray, model: Model) -> np.ndarray:
    """Training tokens that follow each token's context, or about that: its count."""
    t = np.concatenate([[0], word["n"][:-1]])
    t[starts] = model.n_tokens  # as common as documents are
    return t


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3+ from the numbers of
    things counted 1 to 4 times.  A class nobody is in gets the discount its count
    allows: small corpora stay well defined."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    out = [0.0]
    for c, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = c - (c + 1) * y * b / a if a else c * 0.5
        out.append(min(max(d, 0.05), c - 0.05))
    return np.array(out)


def train(docs: DataFrame, scratch: Scratch, *, shards: int | None = None) -> Model:
    """Count ``docs`` (text) into shards below the scratch folder.

    Null counts as empty: such a document is one end mark.  Repeated rows count each.
    Other columns are not read; an empty table gives a model in which every word has
    probability 1 of 1 possible, unknown.  A shard appears whole or not at all.
    """
    docs = docs.select("text")
    model = Model(f"{scratch.root}/model", shards or max(8, 4 * docs.rdd.getNumPartitions()))
    n_shards = model.shards

    def count_words(batches):
        for _, tokens in _token_batches(batches, COUNT_TOKENS):
            key, n = np.unique(np.concatenate(tokens), return_counts=True)
            yield _sent(_bucket(key, n_shards), key=key, n=_small(n))

    def merge_words(key, table):
        x, shard = _joined(table), key[0].as_py()
        word, inverse = np.unique(x["key"], return_inverse=True)
        n = np.bincount(inverse, x["n"]).astype(np.int64)
        publish(model.path("word", shard), pack(key=word, n=n))
        return pa.table({"shard": [shard], "types": [len(word)], "tokens": [int(n.sum())]})

    words = scratch.keep(
        docs.mapInArrow(count_words, BLOBS).groupBy("bucket")
        .applyInArrow(merge_words, "shard long, types long, tokens long"),
        "words",
    )
    for r in words.toLocalIterator():  # three numbers a shard
        model.types[r.shard], model.n_tokens = r.types, model.n_tokens + r.tokens
    model.counted()
    # a context with more tokens than half a shard's mean share is spread
    model.hot = max(1000, model.n_tokens // (2 * n_shards))

    def count_pairs(batches):
        for _, tokens in _token_batches(batches, COUNT_TOKENS):
            word, context, starts = _pairs(tokens, model, "word", "n")
            shard = model.pair_shard(context, word["id"], _context_tokens(word, starts, model))
            order = np.lexsort((word["id"], context, shard))
            c, w, s = context[order], word["id"][order], shard[order]
            new = np.concatenate([[True], (np.diff(c) != 0) | (np.diff(w) != 0)])
            n = np.diff(np.concatenate([np.flatnonzero(new), [len(c)]]))
            wide = np.uint32 if model.n_types + 1 < 1 << 32 else np.uint64
            yield _sent(s[new], c=c[new].astype(wide), w=w[new].astype(wide), n=_small(n).astype(np.uint32))

    def of_counts(n: np.ndarray) -> list[int]:
        return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()

    def merge_pairs(key, table):
        x, shard = _joined(table), key[0].as_py()
        order = np.lexsort((x["w"], x["c"]))
        c, w, m = x["c"][order], x["w"][order], x["n"][order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(c.astype(np.int64)) != 0) | (np.diff(w.astype(np.int64)) != 0)]))
        c, w, n = c[new], w[new], np.add.reduceat(m, new)
        pair = model.pair_key(c, w)
        by = np.argsort(pair, kind="stable")
        publish(model.path("pair", shard), pack(key=pair[by], n=_small(n[by])))
        # sums of this shard's part: per context, and per word the contexts it follows
        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        stats = {
            "id": c[at].astype(np.int64), "total": np.add.reduceat(n, at),
            **{f"n{i}": np.add.reduceat((n == i if i < 3 else n >= 3).astype(np.int64), at) for i in (1, 2, 3)},
        }
        follow, contexts = np.unique(w, return_counts=True)
        zero = np.zeros(len(follow), np.int64)
        ids = np.concatenate([stats["id"], follow.astype(np.int64)])
        columns = {k: np.concatenate([stats[k], zero]) for k in ("total", "n1", "n2", "n3")}
        columns["follows"] = np.concatenate([np.zeros(len(at), np.int64), contexts])
        home = np.searchsorted(model.offsets, ids, "right") - 1  # n_types: past the end
        order = np.argsort(home, kind="stable")
        sent = _sent(home[order], id=ids[order], **{k: _small(v[order]) for k, v in columns.items()})
        head = [len(n), *of_counts(n)]
        rows = sent.num_rows
        return pa.table({
            "shard": pa.array([shard] * rows, pa.int64()), "bucket": sent.column(0), "data": sent.column(1),
            "figures": pa.array([head] + [None] * (rows - 1), pa.list_(pa.int64())),
        })

    pairs = scratch.keep(
        docs.mapInArrow(count_pairs, BLOBS).groupBy("bucket")
        .applyInArrow(merge_pairs, "shard long, bucket long, data binary, figures array<long>"),
        "pairs",
    )
    heads = pairs.filter("figures IS NOT NULL").select("shard", "figures")
    totals = np.zeros(5, np.int64)
    for r in heads.toLocalIterator():
        model.pairs[r.shard] = r.figures[0]
        totals += r.figures
    model.n_pairs, model.d2 = int(totals[0]), discounts(totals[1:].tolist())

    def merge_stats(key, table):
        x, shard = _joined(table), key[0].as_py()
        start = model.n_types if shard >= n_shards else int(model.offsets[shard])
        size = 1 if shard >= n_shards else int(model.types[shard])
        out = {
            k: np.bincount(x["id"] - start, x[k], size).astype(np.int64)
            for k in ("total", "n1", "n2", "n3", "follows")
        }
        if shard < n_shards:
            old = mapped(model.path("word", shard))
            publish(model.path("uni", shard), pack(key=old["key"], n=_small(old["n"]), **{k: _small(v) for k, v in out.items()}))
        else:  # the start of a document, a context only
            publish(model.path("start", 0), pack(**out))
        return pa.table({"figures": pa.array([of_counts(out["follows"]) + [int((out["follows"] >= 3).sum())]], pa.list_(pa.int64()))})

    # words that share an offset with an empty shard belong to the last shard of it
    homes = scratch.keep(
        pairs.select("bucket", "data").groupBy("bucket").applyInArrow(merge_stats, "figures array<long>"), "stats"
    )
    n = np.zeros(5, np.int64)
    for r in homes.toLocalIterator():
        n += r.figures
    model.d1 = discounts(n[:4].tolist())
    taken = model.d1[1] * n[0] + model.d1[2] * n[1] + model.d1[3] * n[4]
    model.left = float(taken / model.n_pairs) if model.n_pairs else 1.0
    return model


def score(docs: DataFrame, model: Model, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns, n_tokens, n_known, base_score and score of every row's whole text.

    ``score`` is the log10 probability of the words and the end mark.
    ``base_score`` is that of add-one unigrams.  Null counts as empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for ids, docs_ in _token_batches(batches, SCORE_TOKENS):
            word, context, starts = _pairs(docs_, m, "uni", "n", "total", "n1", "n2", "n3", "follows")
            start = m.shard("start", 0) if m.n_pairs else {k: [0] for k in ("total", "n1", "n2", "n3")}
            ctx = {}
            for k in ("total", "n1", "n2", "n3"):
                ctx[k] = np.concatenate([[0], word[k][:-1]])
                ctx[k][starts] = start[k][0]
            one = m.left / (m.n_types + 1)
            if m.n_pairs:
                one = one + np.maximum(word["follows"] - m.d1[np.minimum(word["follows"], 3)], 0) / m.n_pairs
            n = _pair_counts(m, context, word, starts)
            total = np.maximum(ctx["total"], 1)
            back = (m.d2[1] * ctx["n1"] + m.d2[2] * ctx["n2"] + m.d2[3] * ctx["n3"]) / total
            p = np.where(
                ctx["total"] > 0,
                np.maximum(n - m.d2[np.minimum(n, 3)], 0) / total + back * one,
                one,
            )
            base = np.log10((word["n"] + 1) / (m.n_tokens + m.n_types + 1))
            sizes = np.array([len(d) for d in docs_], np.int64)
            figures = (
                sizes, np.add.reduceat((word["n"] > 0).astype(np.int64), starts),
                np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts),
            )
            columns = [pa.array([i[c] for i in ids], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, figures)], names=[*keys, "n_tokens", "n_known", "base_score", "score"]
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.schema[k].dataType) for k in keys]
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(
        run, f"{schema}, n_tokens long, n_known long, base_score double, score double"
    )


def _pair_counts(m: Model, context: np.ndarray, word: dict, starts: np.ndarray) -> np.ndarray:
    """Training counts of (context, word) per token; 0 when either is unknown."""
    out = np.zeros(len(context), np.int64)
    known = np.flatnonzero((context >= 0) & (word["id"] >= 0))
    if not len(known) or not m.n_pairs:
        return out
    c, w = context[known], word["id"][known]
    shard = m.pair_shard(c, w, _context_tokens(word, starts, m)[known])
    key = m.pair_key(c, w)
    order = np.lexsort((key, shard))
    edges = np.searchsorted(shard[order], np.arange(m.shards + 1))
    for s in np.flatnonzero((np.diff(edges) > 0) & (m.pairs > 0)):
        at = order[edges[s] : edges[s + 1]]
        x = m.shard("pair", int(s))
        i = np.minimum(np.searchsorted(x["key"], key[at]), len(x["key"]) - 1)
        out[known[at]] = np.where(x["key"][i] == key[at], x["n"][i], 0)
    return out
