"""Token files: independent zstandard frames, a document index and a seek table.

Layout of a file, all numbers little-endian:

- data frames, each a complete zstandard frame of unsigned 32-bit ids; a frame holds
  whole documents up to FRAME_IDS ids, a longer document has frames of its own;
- a skippable frame (magic 0x184D2A50) with the document index: the number of
  documents, their ids as signed 64-bit numbers in ascending order (nulls first, told
  by a count), and n + 1 positions of their first ids in the file;
- a skippable frame (magic 0x184D2A5E) with the seek table of the seekable format:
  compressed size, decompressed size and checksum (low 32 bits of XXH64) per frame,
  then their number, the flag byte 0x80 and the magic 0x8F92EAB1.

Any zstandard reader can decompress the file as one stream of ids; this reader
fetches the trailing tables and then only the frames that hold what is asked for.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import opened, prefix_sums
from jobweave.operators.scratch import Scratch

FRAME_IDS = 1 << 18
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CACHE_ENTRIES = 1_000_000
SLICE_BYTES = 2 << 20  # of texts that are split and looked up together
MANIFEST = "file_no int, path string, n_docs long, n_ids long, first_id long, last_id long"


class Writer:
    """One file, written frame by frame; memory holds one frame and the tables."""

    def __init__(self, stream) -> None:
        self.stream, self.n_ids, self.held = stream, 0, 0
        self.parts: list[np.ndarray] = []
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.starts: list[int] = []
        self.zip = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        if self.held and self.held + len(ids) > FRAME_IDS:
            self._frame()
        for at in range(0, len(ids), FRAME_IDS):
            self.parts.append(ids[at : at + FRAME_IDS])
            self.held += len(self.parts[-1])
            if self.held >= FRAME_IDS:
                self._frame()

    def _frame(self) -> None:
        if self.held:
            raw = np.concatenate(self.parts).tobytes()
            packed = self.zip.compress(raw)
            self.stream.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def close(self) -> None:
        self._frame()
        nulls = sum(i is None for i in self.ids)
        index = b"".join([
            struct.pack("<QQ", len(self.ids), nulls),
            np.array([i or 0 for i in self.ids], "<i8").tobytes(),
            np.array([*self.starts, self.n_ids], "<i8").tobytes(),
        ])
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack(
            "<IBI", len(self.frames), 0x80, FOOTER_MAGIC
        )
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Random access to one file."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.size()
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("the file does not end with a seek table")
        at = end - 9 - 12 * n
        table = np.frombuffer(file.read_at(12 * n, at), "<u4").reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.ids_at = np.concatenate([[0], np.cumsum(table[:, 1] // 4)])
        index = file.read_at(at - 8 - int(self.at[-1]), int(self.at[-1]))
        if struct.unpack_from("<I", index)[0] != INDEX_MAGIC:
            raise ValueError("the file has no document index")
        docs, self.nulls = struct.unpack_from("<QQ", index, 8)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 24)
        self.starts = np.frombuffer(index, "<i8", docs + 1, 24 + 8 * docs)
        self.unzip = zstandard.ZstdDecompressor()
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            raw = self.unzip.decompress(
                self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])),
                max_output_size=int(4 * (self.ids_at[k + 1] - self.ids_at[k])),
            )
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, np.frombuffer(raw, "<u4"))
        return self.last[1]

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        first = int(np.searchsorted(self.ids_at, a, "right")) - 1
        out = []
        while a < b:
            base = int(self.ids_at[first])
            part = self.frame(first)[a - base : b - base]
            out.append(part)
            a, first = a + len(part), first + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else int(self.doc_ids[i])


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The file's pre-tokenizer drops white space and no token crosses it, so a text's
    ids are those of its white-space separated words, one after the other; words are
    given to the library in batches and remembered, up to CACHE_ENTRIES of them.
    ASCII capitals are folded first when the file's normalizer folds case.
    """

    def __init__(self, tokenizer: str, end_id: int) -> None:
        import json
        import os

        # one core a task; must be set before the library's first batch
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [
            s for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
            if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")
        ]
        self.by_word, self.fold = bool(splits), "Lowercase" in steps
        self.added = any(t["content"] != t["content"].strip() for t in spec.get("added_tokens", []))
        self.tok = Tokenizer.from_file(tokenizer)
        self.tok.no_truncation()
        self.tok.no_padding()
        # ids as bytes: a document is one join, and an entry takes little memory
        self.known: dict[bytes, bytes] = {}
        self.end_id = np.uint32(end_id)
        self.end = self.end_id.tobytes()

    def _library(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 4096):
            for e in self.tok.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _remember(self, words: list[bytes]) -> None:
        known = self.known
        if len(known) > CACHE_ENTRIES:
            for w in [*islice(known, CACHE_ENTRIES // 2)]:
                del known[w]
        new = [w for w in words if w not in known]
        # a word and one mark behind it are split by the pre-tokenizer
        marked = {w for w in new if w[-1:] in (b".", b",") and len(w) > 1 and w[-2:-1].isalpha()}
        ask = {w[:-1] if w in marked else w for w in new} | ({b".", b","} if marked else set())
        ask = [*ask.difference(known)]
        known.update(zip(ask, self._library([w.decode() for w in ask])))
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text and the end id.  Each distinct word of the batch is
        looked up once; the ids of all places are then gathered as one array."""
        if not self.by_word or self.added:
            yield from (np.frombuffer(ids + self.end, "<u4") for ids in self._library(texts.to_pylist()))
            return
        if self.fold:
            # a mark of an added token must keep its case
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self._remember(words)
        found = [self.known[w] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        at = np.cumsum(size) - size
        place = coded.indices.to_numpy()
        count = size[place]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(at[place] - ends[:-1], count) + np.arange(ends[-1])]
        borders = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for a, b in zip(borders[:-1], borders[1:]):
            yield np.append(ids[a:b], self.end_id)


@lru_cache(maxsize=1)
def encoder(tokenizer: str, end_id: int) -> WordEncoder:
    """The worker's encoder; tasks that follow each other share what it remembers."""
    return WordEncoder(tokenizer, end_id)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (column 1) have SLICE_BYTES together, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def write(docs: DataFrame, tokenizer: str, root: str, scratch: Scratch, *, end_id: int = 1) -> DataFrame:
    """Write all texts in ascending doc_id order below ``root``; returns the manifest
    (file_no, path, n_docs, n_ids, first_id, last_id, base), one row per file, where
    ``base`` is the number of ids in all files before.

    Ranges of (doc_id, hash of the text) make the files, so equal and null ids are
    split too; null ids come first, ties are in the hash's order.  A null text counts
    as empty and is written as its end id alone.  A file appears whole or not at all,
    and a repeated task writes the same bytes.  An empty table gives an empty manifest.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, first, last, writer = encoder(tokenizer, end_id), None, None, None, None
        number = TaskContext.get().partitionId()
        fs, folder = opened(root)
        path = f"{folder}/tokens-{number:06d}.zst"
        part = f"{path}.{uuid.uuid4().hex}"
        for b in batches:
            for s in slices(b):
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(part, compression=None)
                    writer = Writer(out)
                ids = s.column(0).to_pylist()
                known = [i for i in ids if i is not None]
                first = known[0] if known and first is None else first
                last = known[-1] if known else last
                for i, x in zip(ids, enc.encode(s.column(1))):
                    writer.add(i, x)
        if out is None:
            return
        writer.close()
        out.close()
        fs.move(part, path)
        row = [number, f"{root.rstrip('/')}/tokens-{number:06d}.zst", len(writer.ids), writer.n_ids, first, last]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 4))],
            names=["file_no", "path", "n_docs", "n_ids", "first_id", "last_id"],
        )

    files = scratch.keep(rows.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")
    return prefix_sums(files, [], ["file_no"], {"base": "n_ids"}, scratch)


def read(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_ids, ids) of all documents, or of the requested ones, read
    from the files; ``ids`` are little-endian unsigned 32-bit numbers.  A request
    opens only files whose range of ids can hold it and only the frames it needs."""
    files = manifest
    if doc_ids is not None:
        low, high = (min(doc_ids), max(doc_ids)) if doc_ids else (1, 0)
        files = files.filter((F.col("last_id") >= low) & (F.col("first_id") <= high))
    wanted = None if doc_ids is None else set(doc_ids)
    files = files.select("path", F.col("base").cast("long").alias("base"))
    files = files.repartition(max(1, files.count()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = opened(path)
                with fs.open_input_file(at) as f:
                    r, rows, size = Reader(f), [], 0
                    for i in range(len(r.doc_ids)):
                        if wanted is not None and r.doc_id(i) not in wanted:
                            continue
                        ids = r.document(i)
                        rows.append((r.doc_id(i), base + int(r.starts[i]), len(ids), ids.tobytes()))
                        size += ids.nbytes
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(run, "doc_id long, start long, n_ids long, ids binary")
