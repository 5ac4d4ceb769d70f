"""Ids of texts that are cut in words and looked up together equal the library's."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from jobweave.llm import tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " \t\n ", "  two  words\x0b\x0c", "<|endoftext|> Keeps ITS case <|EndOfText|>", "HÉLLO Wörld, x. ,. .",
    "　日本 語.\xa0x", "a.b, c.. don't CAN'T. 12.", "\x1c\x1dfoo\x85bar", "word " * 3000, "x" * 5000,
]


@pytest.mark.parametrize("skip", [0, 3])
def test_words_of_a_batch(skip):
    encoder, library = tokenfile.WordEncoder(PATH, 1), Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    texts = pa.array(["cut off"] * skip + TEXTS).slice(skip)
    told = [*encoder.encode(texts)]
    assert [x.tolist() for x in told] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in TEXTS]
    assert all(x.dtype == np.dtype("<u4") for x in told)


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(tokenfile, "SLICE_BYTES", 10)
    texts = ["", "a" * 30, "", "bb", "c" * 9, "d" * 10, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    runs = [s.column(1).to_pylist() for s in tokenfile.slices(batch)]
    assert sum(runs, []) == texts
    assert all(len("".join(r)) <= 10 or len(r) == 1 for r in runs)
    assert [*tokenfile.slices(batch.slice(0, 0))] == []
