"""SentencePiece BPE through a table of distinct marked words.

The library writes every space as the mark U+2581 and puts one before the text.  If no
piece of the model has a mark behind another character, no merge crosses the border
before a run of marks, so a text's ids are those of its marked words (a run of marks
and what follows up to the next run), one after the other.  Each distinct marked word
of the corpus is segmented once; the ids come back to every place it stands.

What moves is small: texts are cut in blocks that know their own distinct words, a
place is a number in its block's word list, and only the word lists meet.  The places
themselves are written once, bucketed by block, and wait there for their ids.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators.scratch import Scratch

MARK = "▁"
BLOCK_CHARS = 32_000_000  # of texts that share a word list; one longer text is a block of its own
PACKED_WORDS = 1 << 18  # segmented words that are packed together
# the first mark of a marked word is always there and is left out of its name
_MARKED = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


def check_model(model: str) -> None:
    """Raise unless marked words are independent under this model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(model, "rb") as f:
        spec.ParseFromString(f.read())
    norm, train = spec.normalizer_spec, spec.trainer_spec
    plain = (
        train.model_type == 2 and not norm.precompiled_charsmap and norm.add_dummy_prefix
        and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        and not train.treat_whitespace_as_suffix
    )
    if not plain:
        raise ValueError(f"{model} is not a BPE model with plain white space marks")
    for p in spec.pieces:
        if p.type == p.USER_DEFINED:
            raise ValueError(f"{model} has user-defined pieces, which may cross marks")
        if p.type == p.NORMAL and MARK in p.piece.lstrip(MARK):
            raise ValueError(f"{p.piece!r} of {model} crosses a mark")


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def marked_words(text: str) -> list[str]:
    """The marked words of a text, without their first mark."""
    return _MARKED.findall(MARK + text.replace(" ", MARK)) if text else []


def _batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def _lists(parts: Sequence[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, first bytes first: small numbers compress well so."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(frame: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def blocks(docs: DataFrame, keys: Sequence[str], text: str, block_chars: int) -> DataFrame:
    """One row per block: (block, words, rows, sizes, codes).

    ``rows`` are the key columns of the block's texts, ``sizes`` their numbers of
    places, ``codes`` all places, packed, as positions in ``words``.  A block's number
    is below 2 ** 31.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 11
        schema = None
        place, rows, sizes, codes, chars = defaultdict(int), [], [], [], 0
        place.default_factory = place.__len__

        def closed() -> pa.RecordBatch:
            flat = np.concatenate([np.zeros(0, "<u4"), *codes])
            times, words = np.bincount(flat, minlength=len(place)), list(place)
            place.clear()
            # rare words in alphabetical order: both the list and the numbers pack well
            often, rare = np.flatnonzero(times > 3), np.flatnonzero(times <= 3).tolist()
            order = often[np.argsort(-times[often])].tolist() + sorted(rare, key=words.__getitem__)
            at = np.empty(len(order), np.uint32)
            at[order] = np.arange(len(order))
            return _batch(schema, [
                [number], [[words[i] for i in order]],
                pa.ListArray.from_arrays([0, len(rows)], pa.concat_arrays(rows)),
                [sizes], [_packed(at[flat])],
            ])

        for b in batches:
            key = b.column(0)
            schema = schema or pa.schema([
                ("block", pa.int64()), ("words", pa.list_(pa.string())), ("rows", pa.list_(key.type)),
                ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()),
            ])
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                if rows and chars + len(t) > block_chars:
                    yield closed()
                    number += 1
                    if not number % (1 << 11):
                        raise ValueError("a task has too many blocks; raise block_chars")
                    place, rows, sizes, codes, chars = defaultdict(int), [], [], [], 0
                    place.default_factory = place.__len__
                found = marked_words(t)
                codes.append(np.fromiter(map(place.__getitem__, found), "<u4", len(found)))
                sizes.append(len(found))
                # copied: a slice would keep its whole batch in memory
                rows.append(key.take(pa.array([i])))
                chars += len(t)
        if rows:
            yield closed()

    row = F.struct(*keys)
    schema = ", ".join(f"`{k}`: {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(row.alias("row"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(
        run,
        f"block long, words array<string>, rows array<struct<{schema}>>, sizes array<long>, codes binary",
    )


def segmented(cut: DataFrame, model: str) -> DataFrame:
    """(block, found): the ids of the blocks' words, each distinct word segmented once.

    Equal words meet in one task and stand next to each other there.  A word has at
    most one row in a block.  ``found`` packs, for several words of a block, their
    steps between their positions in its list, their numbers of ids, and the ids.
    """

    def packed(held: list) -> Iterator[pa.RecordBatch]:
        place, size, ids = (np.concatenate(c) for c in zip(*held))
        first, order = np.cumsum(size) - size, np.argsort(place)
        block, at = place >> 32, place & 0xFFFFFFFF
        ends = np.flatnonzero(np.append(np.diff(block[order]), 1)) + 1
        frames = []
        for part in np.split(order, ends[:-1]):
            own = _runs(first[part], size[part])
            steps = np.diff(at[part], prepend=0)
            frames.append(_packed(np.concatenate([[len(part)], steps, size[part], ids[own]])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[order][ends - 1]), pa.array(frames, pa.binary())], names=["block", "found"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        known: dict[str, list[int]] = {}  # the last word may go on in the next batch
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column(0).to_pylist()
            new = [w for w in dict.fromkeys(words) if w not in known]
            found = dict(zip(new, sp.encode(new, num_threads=1)))
            if "" in found:  # a mark with nothing behind it
                found[""] = [sp.piece_to_id(MARK)]
            known |= found
            ids = [known[w] for w in words]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
            held.append((b.column(1).to_numpy(), size, flat))
            known, rows = {words[-1]: known[words[-1]]}, rows + len(words)
            if rows >= PACKED_WORDS:
                yield from packed(held)
                held, rows = [], 0
        if held:
            yield from packed(held)

    words = cut.select("block", F.posexplode("words").alias("at", "word")).select(
        "word", (F.shiftleft("block", 32) + F.col("at")).alias("place")
    )
    words = words.repartition("word").sortWithinPartitions("word")
    return words.mapInArrow(run, "block long, found binary")


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then the same of the others."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def encode(
    docs: DataFrame, model: str, scratch: Scratch, *, keys: Sequence[str] = ("doc_id",),
    text: str = "text", end_id: int | None = 2, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The key columns and ``ids`` (array of int, with ``end_id`` last unless that is
    None) of every row's whole text, exactly as the sentencepiece library encodes it.

    Memory holds one block.  A null text counts as empty and gives the end id alone.
    Rows are independent: repeated rows, null keys and extra columns change nothing;
    an empty table gives no rows.  A model whose pieces can cross marks is refused.
    """
    check_model(model)
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        blocks(docs, keys, text, block_chars).write.bucketBy(buckets, "block")
        .option("path", f"{scratch.root}/{name}").option("compression", "zstd").saveAsTable(name)
    )
    cut = spark.table(name)
    found = segmented(cut, model).groupBy("block").agg(F.collect_list("found").alias("found"))
    # a block of empty texts only has no words
    back = cut.select("block", "rows", "sizes", "codes").join(found, "block", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([] if end_id is None else [end_id], np.int64)
        for b in batches:
            for k in range(b.num_rows):
                rows, frames = b.column(1)[k].values, b.column(4)[k].as_py() or []
                at, size, flat = [], [], [np.zeros(0, np.uint32)]
                for x in map(_unpacked, frames):
                    n = int(x[0])
                    at.append(np.cumsum(x[1 : n + 1]))
                    size.append(x[n + 1 : 2 * n + 1])
                    flat.append(x[2 * n + 1 :])
                flat = np.concatenate(flat)
                size = np.concatenate([np.zeros(0, np.int64), *size])
                at = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
                n, first = np.zeros_like(size), np.zeros_like(size)
                n[at], first[at] = size, np.cumsum(size) - size
                codes, since, held, many = _unpacked(b.column(3)[k].as_py()), 0, [], 0
                ends = np.cumsum(b.column(2)[k].values.to_numpy()).tolist()
                for i, (a, e) in enumerate(zip([0, *ends], ends)):
                    own = codes[a:e]
                    held.append(np.concatenate([flat[_runs(first[own], n[own])], end]))
                    many += len(held[-1])
                    if many > 1 << 18 or i == len(ends) - 1:
                        yield pa.RecordBatch.from_arrays(
                            [rows.slice(since, len(held)), _lists(held)], names=["row", "ids"]
                        )
                        held, many, since = [], 0, i + 1

    schema = ", ".join(f"`{k}`: {docs.schema[k].dataType.simpleString()}" for k in keys)
    ids = back.mapInArrow(run, f"row struct<{schema}>, ids array<int>").select("row.*", "ids")
    ids.schema  # the plan is settled: the table's name is not needed any more
    spark.sql(f"DROP TABLE {name}")
    return ids


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """All columns and ``text``, what the library decodes from ``ids`` (null: empty).
    A column named ``text`` is replaced."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                ids = s.column(s.schema.get_field_index("ids"))
                ids = [i.values.to_numpy().tolist() if i.is_valid else [] for i in ids]
                texts = sp.decode(ids, num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [*s.columns, pa.array(texts, pa.string())], names=[*s.schema.names, "text"]
                )

    kept = [f for f in encoded.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return encoded.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, f"{schema}, text string")
