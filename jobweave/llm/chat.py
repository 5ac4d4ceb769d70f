"""Chat formatting: turn-aligned windows under a budget, with a loss mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave.llm.common import prefix_sums
from jobweave.operators.scratch import Scratch

PIECE = r"[A-Za-z0-9]{1,4}|[^\sA-Za-z0-9]"
CHUNK = 4096  # turns of a conversation that are joined to one copy of its system turn


@dataclass(frozen=True)
class Template:
    """A turn is ``open role middle text close``; ``foreign`` are marks of other
    templates that texts must not contain either.

    A mark inside a text gets a backslash after its first character; marks that
    already have backslashes there get one more.  So no text contains a mark, and
    taking one backslash away restores it exactly.  Marks are at least two characters
    and have no backslash.
    """

    open: str = "<|turn|>"
    middle: str = "<|says|>"
    close: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def _mark(self, before: str) -> str:
        marks = (self.open, self.middle, self.close, *self.foreign)
        firsts = "".join(sorted({"\\" + m[0] for m in marks}))
        rests = "|".join(sorted({rf"\Q{m[1:]}\E" for m in marks}))
        return rf"([{firsts}]){before}(\\*)(?={rests})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._mark("")), F.lit(r"$1\\$2"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._mark(r"\\")), F.lit("$1$2"))

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(
            F.lit(self.open), self.escape(role), F.lit(self.middle),
            self.escape(text), F.lit(self.close),
        )

    def head_chars(self, role: Column) -> Column:
        return F.lit(len(self.open) + len(self.middle)) + F.length(self.escape(role))


def token_pieces(text: Column) -> Column:
    """An estimate of a text's tokens: runs of up to four letters or digits of ASCII,
    and every other character but white space."""
    return F.regexp_count(text, F.lit(PIECE)).cast("long")


def windows(
    turns: DataFrame,
    scratch: Scratch,
    *,
    template: Template = Template(),
    budget: int = 1024,
    history: int = 256,
    target_role: str = "assistant",
    tokens: Column | None = None,
) -> DataFrame:
    """(conv_id, window, formatted, n_context, size, mask): one row per window.

    A turn's size is its ``tokens``, a column of ``turns`` with exact counts of the
    formatted turn; without it the pieces of role and text and one for each mark.
    A window's ``size`` is at most ``budget``, the repeated turns included; only a
    window of a single new turn can be larger, since a turn is never cut, and then it
    repeats nothing but the system turn.

    The turns of a conversation, ordered by (turn, role, text), are laid end to end
    by prefix sums of their sizes, and that line is cut into stretches of what the
    budget leaves beside the history and the system turn.  The turns that lie inside
    a stretch are a window's new turns.  The turn that crosses into a stretch goes
    before them if all fit together, else it has a window of its own.  In front a
    window repeats the system turn, if the conversation begins with one, and those of
    the latest turns that fit into ``history`` and into the budget.  Window numbers
    ascend and can have gaps.  ``n_context`` is the number of repeated turns in front;
    ``mask`` lists (start, length) in code points, 0-based, of the target role's new
    texts; repeated targets are not in it.

    Null roles and texts count as empty, null tokens and those below 1 as 1, a null
    conv_id is a conversation of its own, null turns come first.  Repeated rows are
    turns of their own.  A conversation with a third of all turns lies in many ranges,
    and what is joined to its turns is dealt out by stretches of them, so no task sees
    more of it than a range or a window.  Other columns are not read; an empty table
    gives no rows.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be at least 0 and less than budget")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    if tokens is None:
        tokens = token_pieces(role) + token_pieces(text) + 3
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.greatest(tokens.cast("long"), F.lit(1)).alias("size"),
        F.monotonically_increasing_id().alias("tie"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = prefix_sums(
        rows, ["conv_id"], ["turn", "role", "text", "tie"],
        {"start": "size", "pos": "one"}, scratch,
    )

    def chunks(last: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(last) / CHUNK)))

    # one row per conversation and CHUNK turns of it: what all its turns must know
    opens = (F.col("pos") == 0) & (F.col("role") == "system")
    heads = placed.groupBy("conv_id").agg(
        F.max("pos").alias("last"),
        F.coalesce(F.sum(F.when(opens, F.col("size"))), F.lit(0)).alias("sys"),
    ).select(F.col("conv_id").alias("c"), "last", "sys", chunks("last").alias("h"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    in_chunk = same & (F.floor(F.col("pos") / CHUNK) == F.col("h"))
    room = F.greatest(F.lit(budget - history) - F.col("sys"), F.lit(1))
    at = F.col("start") - F.col("sys")
    home = F.floor((F.col("at") + F.col("size") - 1) / room)
    # a stretch has at most as many turns as units, and the one that crosses into it
    together = F.sum("size").over(W.partitionBy("conv_id", "home"))
    own = (F.floor(F.col("at") / room) < F.col("home")) & (together > room)
    laid = scratch.keep(
        placed.join(heads, in_chunk).drop("c", "h", "one", "tie", "turn")
        .withColumn("opens", opens).withColumn("at", at)
        .withColumn("home", F.when(F.col("opens"), F.lit(-1)).otherwise(home))
        .withColumn("window", 2 * F.col("home") - own.cast("int")),
        "laid",
    )
    said = template.turn(F.col("role"), F.col("text"))
    body = F.struct(
        F.col("pos"), said.alias("said"), (F.col("role") == target_role).alias("target"),
        (template.head_chars(F.col("role"))).alias("head"),
        F.length(template.escape(F.col("text"))).alias("chars"), "size",
    ).alias("t")
    turn, system = laid.filter("NOT opens"), laid.filter("opens")
    parts = turn.select("conv_id", "window", F.lit(1).alias("new"), body)
    spans = turn.groupBy("conv_id", "window").agg(
        F.min("pos").alias("pos"), F.min("at").alias("begin"),
        F.sum("size").alias("fill"), F.min("sys").alias("sys"),
    )
    heading = system.select(F.col("conv_id").alias("c"), chunks("last").alias("h"), body)
    # new in the first window, and the only turn of one if nothing else was said
    parts = parts.unionByName(
        spans.join(heading, in_chunk).select("conv_id", "window", (F.col("begin") == 0).cast("int").alias("new"), "t")
    ).unionByName(
        system.filter("last = 0").select("conv_id", F.lit(0).cast("long").alias("window"), F.lit(1).alias("new"), body)
    )
    if history:
        spare = F.least(F.lit(history), F.lit(budget) - F.col("sys") - F.col("fill"))
        since = F.greatest(F.col("begin") - spare, F.lit(0))
        reach = spans.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), "begin", since.alias("since"))
        reach = reach.filter("since < begin").withColumn("bin", F.explode(F.sequence(
            F.floor(F.col("since") / history), F.floor((F.col("begin") - 1) / history)
        )))
        again = turn.join(reach, same & (F.floor(F.col("at") / history) == F.col("bin")))
        again = again.filter("at >= since AND at < begin")
        parts = parts.unionByName(
            again.select("conv_id", F.col("w").alias("window"), F.lit(0).alias("new"), body)
        )
    grouped = parts.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct(F.col("t.pos").alias("pos"), "new", "t"))).alias("ts"),
        F.sum(1 - F.col("new")).alias("n_context"), F.sum("t.size").alias("size"),
    )
    # running starts of the turns inside the window
    starts = F.aggregate(
        "ts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["t"]["said"])).alias("at"),
            F.when(
                x["t"]["target"] & (x["new"] == 1),
                F.concat(a["mask"], F.array(F.struct(
                    (a["at"] + x["t"]["head"]).alias("start"), x["t"]["chars"].alias("length")
                ))),
            ).otherwise(a["mask"]).alias("mask"),
        ),
    )
    return grouped.select(
        "conv_id", "window",
        F.array_join(F.transform("ts", lambda x: x["t"]["said"]), "").alias("formatted"),
        F.col("n_context").cast("int").alias("n_context"), "size",
        starts["mask"].alias("mask"),
    )


def parsed(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Read windows back: (conv_id, window, turns, losses, chars), new turns only.

    ``turns`` are (role, text) in order and ``losses`` the texts under the mask.
    """
    split = F.split("formatted", F.lit(rf"\Q{template.open}\E"), -1)
    pieces = F.slice(split, F.col("n_context") + 2, F.size(split))
    turn = F.transform(
        pieces,
        lambda p: F.struct(
            template.unescape(F.substring_index(p, template.middle, 1)).alias("role"),
            template.unescape(
                F.substring_index(
                    F.substring_index(p, template.middle, -1), template.close, 1
                )
            ).alias("text"),
        ),
    )
    loss = F.transform(
        "mask",
        lambda m: template.unescape(F.col("formatted").substr(m["start"] + 1, m["length"])),
    )
    return formatted.select("conv_id", "window", turn.alias("turns"), loss.alias("losses"), F.length("formatted").alias("chars"))
