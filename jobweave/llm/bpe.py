"""Byte-level BPE as a streaming transducer with bounded lookahead.

What follows a byte can change the tokens before it only through a chain of merges,
each of later rank than the one before: a merge (u, v) that takes part at a place
where the two continuations differ moves that place left by |u|, and the next merge
(u', v') of the chain has a v' that begins with u.  The longest sum of |u| over such
chains is the merge list's sufficient lookahead: a token that ends that many bytes
before the end of what was read is final.  The rest is a text of its own, because
merges never cross a final boundary.  So the transducer keeps a block and the
lookahead, whatever the length of its input.

This needs a proper merge list (each part of a merge is a byte or made by an earlier
merge) and one text, the tokens of the pre-tokenizer, at a time.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the pre-tokenizer's pattern and the printable stand-ins of bytes
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

BLOCK = 1 << 16  # characters or bytes handled at a time
CACHED_BYTES = 64  # longest pre-token whose ids are remembered
CACHE_ENTRIES = 400_000


def byte_symbols() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeList:
    """Ranks and ids of one tokenizer file, and its sufficient lookahead."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.prefix_space = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        plain = lambda s: bytes(symbols[c] for c in s)
        self.ids = {plain(s): i for s, i in model["vocab"].items() if all(c in symbols for c in s)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: s for s, i in self.ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # a pair of ids -> rank and id of what it becomes, in one comparable number
        self.join: dict[int, int] = {}
        made, chain, self.lookahead = {bytes([b]) for b in range(256)}, {}, 1
        for r, (left, right) in enumerate(merges):
            u, v = plain(left), plain(right)
            if u not in made or v not in made:
                raise ValueError(f"merge {r} of {path} uses a part no earlier merge makes")
            made.add(u + v)
            self.join[self.ids[u] << 32 | self.ids[v]] = r << 32 | self.ids[u + v]
            reach = len(u) + max((chain.get(v[:i], 0) for i in range(1, len(v) + 1)), default=0)
            chain[u] = max(chain.get(u, 0), reach)
            self.lookahead = max(self.lookahead, reach)
        self.single = [self.ids[bytes([b])] for b in range(256)]

    def merge(self, data: bytes) -> list[int]:
        """All merges of one bounded string, lowest rank first and leftmost first."""
        ids = [self.single[b] for b in data]
        get, none = self.join.get, 1 << 62
        pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            ids[i] = new = low & 0xFFFFFFFF
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(new << 32 | ids[i + 1], none)
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | new, none)
        return ids


class Stream:
    """Ids of one pre-token fed in pieces of any length."""

    def __init__(self, merges: MergeList, window: int = 0) -> None:
        self.m, self.held = merges, b""
        self.window = max(window, merges.lookahead + 256)

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) < 2 * self.window:
                continue
            final, done = len(self.held) - self.m.lookahead, 0
            for token in self.m.merge(self.held):
                size = len(self.m.bytes_of[token])
                if done + size > final:
                    break
                done += size
                yield token
            self.held = self.held[done:]

    def finish(self) -> Iterator[int]:
        yield from self.m.merge(self.held)
        self.held = b""


class Encoder:
    """Whole texts to ids.  Keeps one block of text, the transducer's window and a
    bounded memory of short pre-tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        self.m = MergeList(path)
        self.find = regex.compile(PATTERN).findall
        # the library's classes of rare characters follow an older Unicode version
        self.split_rare = pre_tokenizers.ByteLevel(
            add_prefix_space=False, use_regex=True
        ).pre_tokenize_str
        # of pieces, and of the words in them
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.special = regex.compile("|".join(map(regex.escape, self.m.added))) if self.m.added else None

    def _words(self, piece: str) -> list[str]:
        if piece.isascii() or max(piece) < "ɐ":
            return self.find(piece)
        return [piece[a:b] for _, (a, b) in self.split_rare(piece)]

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids: list[int] = []
        for word in self._words(piece):
            seen = self.words.get(word)
            if seen is not None:
                ids.extend(seen)
                continue
            data = word.encode()
            if len(data) <= CACHED_BYTES:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words.clear()
                self.words[word] = new = tuple(self.m.merge(data))
                ids.extend(new)
            else:
                stream = Stream(self.m)
                for at in range(0, len(data), BLOCK):
                    ids.extend(stream.feed(data[at : at + BLOCK]))
                ids.extend(stream.finish())
        return tuple(ids)

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids piece by piece.  A piece begins at a space that has no white space on
        either side: there the pre-tokenizer always begins a new word."""
        known, at, carry = self.known, 0, ""
        while at < len(text) or carry:
            block = carry + text[at : at + BLOCK]
            at += BLOCK
            pieces: list[str] = []
            for i, p in enumerate(block.split(" ")):
                if not i:
                    pieces.append(p)
                elif p and not p[0].isspace() and not pieces[-1][-1:].isspace():
                    pieces.append(" " + p)
                else:
                    pieces[-1] += " " + p
            if not pieces[0]:
                del pieces[0]
            carry = pieces.pop() if at < len(text) and pieces else ""
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = self._piece(p)
                    if len(p) <= CACHED_BYTES:
                        if len(known) >= CACHE_ENTRIES:
                            known.clear()
                        known[p] = ids
                yield ids

    def encode(self, text: str) -> np.ndarray:
        out: list[int] = []
        at = 0
        # marks of added tokens in a text become their ids, as the library does
        for hit in self.special.finditer(text) if self.special else ():
            for ids in self._plain(text[at : hit.start()]):
                out.extend(ids)
            out.append(self.m.added[hit.group()])
            at = hit.end()
        for ids in self._plain(text[at:] if at else text):
            out.extend(ids)
        return np.array(out, dtype=np.int32)


class Decoder:
    """Ids to text by an incremental byte-to-text state machine; bytes that are not
    UTF-8 become replacement characters, ids outside the vocabulary are skipped."""

    def __init__(self, path: str) -> None:
        table = MergeList(path).bytes_of
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids, table = np.asarray(ids), self.table
        ids = ids[(ids >= 0) & (ids < len(table))]
        for at in range(0, len(ids), BLOCK):
            yield state.decode(b"".join([table[i] for i in ids[at : at + BLOCK].tolist()]))
        yield state.decode(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.pieces(ids))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; tasks that follow each other share what it remembers."""
    return Encoder(path)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode(docs: DataFrame, tokenizer: str, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns and ``ids`` (array of int) of every row's whole text.

    Null counts as empty and gives no ids.  Rows are independent: repeated rows,
    null keys and extra columns change nothing, and an empty table gives no rows.
    Nothing is shuffled.
    """

    def run(batches):
        enc = encoder(tokenizer)
        for b in _slices(batches):
            ids = [enc.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            array = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], array], names=[*keys, "ids"])

    rows = docs.select(*keys, F.coalesce(text, F.lit("")).alias("_text"))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """All columns and ``text``, read back from ``ids`` (null ids: empty text)."""

    def run(batches):
        dec = decoder(tokenizer)
        for b in _slices(batches):
            ids = b.column(b.schema.get_field_index("ids"))
            texts = [
                dec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in ids
            ]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"]
            )

    kept = [f for f in encoded.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return encoded.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, f"{schema}, text string")
