"""Surrogates settle for values without letters and for more names than syllables give."""

import time

import pytest

from jobweave.llm import pii


@pytest.fixture
def bounded(monkeypatch):
    """A table that does not settle fails instead of running for ever."""
    from jobweave.operators.scratch import Scratch

    keep, end = Scratch.keep, time.time() + 60

    def kept(self, df, name):
        assert time.time() < end, "surrogates do not settle"
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", kept)


def test_masked_values_and_many_names(spark, scratch, bounded):
    masked = ["********", "......", "пароль", "密码密码密码"]
    block = "-----BEGIN PRIVATE KEY-----{}-----END PRIVATE KEY-----"
    names = ["N" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(20_000)]
    rows = [("secret", "", x) for x in masked] + [("key_block", "", block.format(x)) for x in ("...", "")]
    rows += [("name", "m", x) for x in names] + [("phone", "", f"+49{i}") for i in range(200, 300)]
    df = spark.createDataFrame(rows, "kind string, gender string, norm string")
    got = {(r.kind, r.norm): r.surrogate for r in pii.surrogate_table(df, "k", scratch).collect()}
    assert len(got) == len(rows) == len({(k, s) for (k, _), s in got.items()})
    assert not {(k, s) for (k, _), s in got.items()} & set(got)


def test_masked_password_in_a_text(spark, scratch, bounded):
    df = spark.createDataFrame([(1, "password: ******** and secret=......")], "doc_id long, text string")
    text = pii.with_surrogates(df, "k", scratch).first().text
    assert "********" not in text and "......" not in text and text.startswith("password: ")
