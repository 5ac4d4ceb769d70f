"""Mixing sources to target weights by random keys, range sorts and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import prefix_sums, text_or_empty, word_count
from jobweave.operators.scratch import Scratch

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MAX_EPOCHS = 3


def source_targets(
    sizes: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets share the total by weight; a target stops at ``max_epochs`` times its
    source's size and the excess is shared again.  The end of that is one level L
    with target = min(cap, weight * L): with the sources sorted by cap / weight, L
    is what remains for the sources not capped, divided by their weight, at the first
    source whose own ratio is not below it.  The sources are numbered, sorted and
    summed over ranges, so there may be as many of them as there are hosts.
    """
    sources = sizes.withColumn("_one", F.lit(1).cast("long")).withColumn(
        "_last", F.col("source").isNull()
    )
    ranked = prefix_sums(sources, [], ["_last", "source"], {"_no": "_one"}, scratch)
    pick = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("_no") % len(weights) + 1).cast("int"),
    )
    capped = scratch.keep(
        ranked.withColumn("_w", pick)
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .select("source", "source_size", "_no", "_w", "_cap", "_ratio"),
        "sources",
    )
    # two single rows of figures
    total = capped.agg(F.sum("source_size").cast("double"), F.sum("_w")).first()
    sums = prefix_sums(capped, [], ["_ratio", "_no"], {"_caps": "_cap", "_ws": "_w"}, scratch)
    level = (
        sums.withColumn("_level", (F.lit(total[0]) - F.col("_caps")) / (F.lit(total[1]) - F.col("_ws")))
        .filter(F.col("_level") <= F.col("_ratio"))
        .agg(F.min_by("_level", F.struct("_ratio", "_no")))
        .first()[0]
    )
    goal = F.least(F.col("_cap"), F.col("_w") * F.lit(level)) if level is not None else F.col("_cap")
    return capped.select("source", "source_size", goal.alias("target"))


def shares(
    docs: DataFrame, scratch: Scratch, *, size: Column | None = None, seed: int = 0,
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, whole: bool = False,
) -> DataFrame:
    """What the mix takes of each row: (doc_id, source, size, source_size, target,
    epochs, part, taken), one row per row of ``docs``.

    Every row is taken in ``epochs`` whole passes over its source; a last pass, in
    the order of a keyed hash, ends at the source's exact budget and takes ``part``
    units of the row: its size before the cut, 0 behind it, and the units that still
    fit at the cut.  With ``whole`` the row at the cut counts whole if at least half
    of it fits, else not at all.  taken = epochs * size + part.

    A null text has size 0, a null source is a source of its own.  Rows that share
    all of id, source and size are told apart by nothing and lie next to each other
    in the order.  The hash of id and seed is the order, so reruns agree.  An empty
    table gives no rows; sources of size 0 have target 0.
    """
    size = word_count(text_or_empty()) if size is None else size
    rows = scratch.keep(
        docs.select("doc_id", "source", size.alias("size")).withColumn(
            "_key", F.xxhash64(F.lit(seed), "doc_id", "size")
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(
        scratch.keep(sizes, "source-sizes"), scratch, weights=weights, max_epochs=max_epochs
    )
    sums = prefix_sums(rows, ["source"], ["_key", "doc_id", "size"], {"_before": "size"}, scratch)
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = sums.join(t, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    fits = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    part = F.when(2 * fits >= F.col("size"), F.col("size")).otherwise(0) if whole else fits
    return joined.withColumn("epochs", epochs.cast("long")).withColumn(
        "part", part.cast("long")
    ).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "part",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )


def mixed(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of the mix, repeated as often as taken, with the columns of ``docs``.

    Documents are taken whole.  Rows that share doc_id, source and size have equal
    shares counted together, so each is repeated by their mean, rounded up.  Rows of
    size 0 cost nothing and stay once.
    """
    s = shares(docs, scratch, whole=True, **options)
    taken = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1)
    times = s.groupBy("doc_id", "source", "size").agg(F.ceil(F.avg(taken)).cast("int").alias("times"))
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").alias("d"), F.col("row.source").alias("s"),
        word_count(F.coalesce("row.text", F.lit(""))).alias("n"),
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
        & (F.col("size") == F.col("n"))
    )
    out = rows.join(times.filter("times > 0"), same)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
