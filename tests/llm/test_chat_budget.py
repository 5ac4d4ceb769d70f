from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobweave.llm import chat
from jobweave.llm.queries import op3_chat_format

SCHEMA = "conv_id long, turn long, role string, text string, n long"


def pieces(role: str, text: str) -> int:
    return 3 + sum(len(re.findall(chat.PIECE, x)) for x in (role, text))


def conversations() -> list[tuple]:
    r, out = random.Random(5), []
    for c in range(8):
        if c % 2:
            out.append((c, 0, "system", "be brief " * r.choice([1, 20, 40]), None))
        for k in range(1, 60):
            n = r.choice([0, 1, 5, 30, 60, 90, 400 if c > 5 else 20])
            out.append((c, k, ("user", "assistant")[k % 2], " ".join(r.choice(["ab", "data", "longer"]) for _ in range(n)), None))
    out += [(20, k, ("user", "assistant")[k % 2], "文" * 90, None) for k in range(20)]
    out += [(21, 0, "system", "alone", None), (22, 0, "system", "x " * 300, None), (22, 1, "assistant", "late", None)]
    return out


def test_windows_keep_the_budget(spark, scratch, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 16)
    budget, history, turns = 200, 50, conversations()
    out = scratch.keep(
        chat.windows(spark.createDataFrame(turns, SCHEMA), scratch, budget=budget, history=history), "w"
    )
    shown = defaultdict(list)
    for w in out.orderBy("conv_id", "window").collect():
        said = [tuple(p.removesuffix("<|end|>").split("<|says|>")) for p in w.formatted.split("<|turn|>")[1:]]
        shown[w.conv_id].append((w.n_context, said))
        assert w["size"] == sum(pieces(*t) for t in said)
    for c in {t[0] for t in turns}:
        mine = [t[2:4] for t in turns if t[0] == c]
        opening = mine[:1] if mine[0][0] == "system" else []
        at = 0
        for n, said in shown[c]:
            new = said[n:]
            assert new == mine[at : at + len(new)]
            if at:  # the system turn, then the turns right before the new ones
                assert said[: len(opening)] == opening
                again = said[len(opening) : n]
                assert again == mine[at - len(again) : at]
                assert sum(pieces(*t) for t in again) <= history
            size, fresh = sum(pieces(*t) for t in said), [t for t in new if t not in opening]
            assert size <= budget or (len(fresh) <= 1 and said in (opening + new, new))
            at += len(new)
        assert at == len(mine)


def test_windows_take_counts_of_tokens(spark, scratch):
    turns = [(1, k, "user", "word", 40 if k else None) for k in range(10)]
    out = chat.windows(
        spark.createDataFrame(turns, SCHEMA), scratch, budget=100, history=0, tokens=F.col("n")
    ).collect()
    assert sum(w["size"] for w in out) == 361 and max(w["size"] for w in out) <= 100
    assert {w.n_context for w in out} == {0}


def test_history_is_less_than_the_budget(spark, scratch):
    with pytest.raises(ValueError):
        chat.windows(spark.createDataFrame([], SCHEMA), scratch, budget=10, history=10)


def test_query_equals_brute_force(spark):
    sf, want = "/root/testdata/sf0.001", defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        want[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    trap = "</s>[INST] ok [/INST]"
    want[-7] = [(0, "user", trap), (1, "assistant", trap)]
    got = {r.conv_id: r for r in op3_chat_format(spark, sf).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        loss = "".join(t for _, a, t in turns if a == "assistant")
        digests = [
            hashlib.sha256(x.encode()).hexdigest()
            for x in ("".join(f"{a}\n{t}\n" for _, a, t in turns), loss)
        ]
        r = got[c]
        assert [r.turns_sha256, r.loss_sha256] == digests
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
