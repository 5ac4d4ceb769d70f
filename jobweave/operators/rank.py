"""Scoring and exact ranking of postings for profiles.

The score of a pair is a sum of term and concentration hits and a few small terms
(sponsorship, seniority).  The best ``limit`` postings of every profile are found
without pairing every profile with every posting, under weights of any sign:

* profiles that look the same to a posting (terms, concentration, sponsorship,
  seniority) are one look, scored and ranked once; postings that look the same to
  every profile are interchangeable up to the tie order, so the first ``limit`` of
  each such class are enough;
* the first postings of the tie order give every look a floor, its ``limit``-th score
  so far.  Later postings lose ties, so only a score above the floor counts, and a
  look is done with a block of postings whose terms cannot add up to more.

Both steps only drop pairs that provably have ``limit`` better ones.  The pairs left
are scored in groups of bounded size, a part of the looks against a block of postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave.functions.text import boundary_pattern, casefold, terms_in, word_text
from jobweave.operators.classify import rank_text, seniority_label
from jobweave.operators.scratch import Scratch
from jobweave.operators.skew import lookup_join, number_rows, spread
from jobweave.operators.terms import match_terms
from jobweave.vocab import SENIORITY_TERMS, RankingWeights

# Positions of the tie order that give the floors, those of a later block, and the
# looks that meet a block in one group.  Results do not depend on them.
FIRST_BLOCK = 8_192
BLOCK = 32_768
LOOK_PART = 20_000
# A look or posting with more rows than this is joined through a broadcast slice.
HOT_ROWS = 10_000
# Up to this many profile terms are looked up inside the scan of the texts.
INLINE_TERMS = 100

POSTING_COLUMNS = (
    "ordinal", "source", "title", "company", "location", "url", "posted_date",
    "employment_type", "role_tags", "concentration_tags", "opt_cpt_flag",
    "seniority_label", "text_hits",
)
# what the score and the candidate search read, without the long texts
SIGNAL_COLUMNS = (
    "role_tags", "concentration_tags", "opt_cpt_flag", "seniority_label", "text_hits",
)
PROFILE_COLUMNS = (
    "profile_no", "student_key", "name", "profile_version", "target_roles",
    "concentration", "needs_opt", "preferred_seniority", "skill_terms", "role_terms",
)


def with_tie(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """``(ordinal, tie)``: position of every posting in the order that decides
    among equal scores (date desc with NULLs last, company desc, title desc, input
    order).

    The order is the same for all profiles, so it is sorted once; everything that
    ranks afterwards compares one number instead of dates and long texts.
    """
    order = [
        F.col("posted_date").desc_nulls_last(),
        F.col("company").desc(),
        F.col("title").desc(),
        F.col("ordinal").asc(),
    ]
    few = postings.select("ordinal", "posted_date", "company", "title")
    return number_rows(few, order, "tie", scratch).select("ordinal", "tie")


def profile_vocabulary(profiles: DataFrame) -> DataFrame:
    """Distinct skill and role terms of all profiles."""
    return profiles.select(
        F.explode(F.concat("skill_terms", "role_terms")).alias("term")
    ).distinct()


def posting_features(
    postings: DataFrame,
    vocabulary: DataFrame,
    *,
    keep: Sequence[str] = (),
    seniority_terms: Sequence = SENIORITY_TERMS,
    inline_terms: int = INLINE_TERMS,
) -> DataFrame:
    """What ranking reads of a posting; the description is left behind here.

    Adds ``seniority_label`` and ``text_hits``, the vocabulary terms that occur in
    title and description.
    """
    columns = [*POSTING_COLUMNS[:-1], *keep]
    words = F.col("_words")
    labelled = (
        postings.withColumn("_text", rank_text())
        .withColumn("_words", word_text(F.col("_text")))
        .withColumn("seniority_label", seniority_label(F.col("_text"), seniority_terms, words))
    )
    head = vocabulary.limit(inline_terms + 1).collect()
    if len(head) <= inline_terms:
        terms = sorted(r["term"] for r in head)
        hits = terms_in(F.col("_text"), terms, boundary_pattern, words)
        return labelled.select(*columns, hits.alias("text_hits"))
    found = (
        match_terms(postings, vocabulary, text=rank_text())
        .groupBy("ordinal")
        .agg(F.collect_list("term").alias("text_hits"))
    )
    return labelled.select(*columns).join(found, "ordinal", "left").withColumn(
        "text_hits", F.coalesce("text_hits", F.array().cast("array<string>"))
    )


# --- scoring ----------------------------------------------------------------


def _has(array: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(F.col(array), value), F.lit(False))


def _matched_skills() -> Column:
    return F.filter("skill_terms", lambda t: _has("text_hits", t))


def _matched_roles() -> Column:
    tags = F.transform(F.coalesce("role_tags", F.array().cast("array<string>")), casefold)
    known = F.concat("text_hits", tags)
    return F.filter("role_terms", lambda t: F.array_contains(known, t))


def _dense_checks(w: RankingWeights) -> list[tuple[Column, float, Column]]:
    """(condition, weight, reason) of the signals that need no term."""
    wants = F.col("preferred_seniority")
    label = F.col("seniority_label")
    return [
        (
            _has("concentration_tags", F.col("concentration")),
            w.concentration,
            F.concat(F.lit("Concentration match: "), F.col("concentration")),
        ),
        (
            F.col("needs_opt") & F.coalesce("opt_cpt_flag", F.lit(False)),
            w.opt_cpt,
            F.lit("CPT/OPT-friendly signal"),
        ),
        (
            F.coalesce(wants == label, F.lit(False)),
            w.seniority,
            F.concat(F.lit("Seniority match: "), label),
        ),
        (
            F.coalesce((wants != label) & (label != ""), F.lit(False)),
            w.seniority_mismatch,
            F.concat(F.lit("Seniority mismatch: "), label),
        ),
    ]


def _dense_score(w: RankingWeights) -> Column:
    out = F.lit(0.0)
    for condition, weight, _ in _dense_checks(w):
        out = out + F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))
    return out


def with_score(pairs: DataFrame, w: RankingWeights) -> DataFrame:
    """Add ``score`` to rows that carry both profile and posting columns."""
    return pairs.withColumn(
        "score",
        F.size(_matched_skills()) * F.lit(float(w.skill))
        + F.size(_matched_roles()) * F.lit(float(w.role))
        + _dense_score(w),
    )


def with_reasons(pairs: DataFrame, w: RankingWeights) -> DataFrame:
    """Add ``reasons``: skills, roles, concentration, sponsorship, seniority."""
    dense = F.array_compact(
        F.array(*[F.when(c, reason) for c, _, reason in _dense_checks(w)])
    )
    return pairs.withColumn(
        "reasons",
        F.concat(
            F.transform(_matched_skills(), lambda t: F.concat(F.lit("Skill match: "), t)),
            F.transform(_matched_roles(), lambda t: F.concat(F.lit("Target role match: "), t)),
            dense,
        ),
    )


# --- candidates -------------------------------------------------------------

_LOOK = ("skill_terms", "role_terms", "concentration", "needs_opt", "preferred_seniority")
_BEST = "look binary, ordinal bigint, score double"


def _digest(columns: Sequence[str]) -> Column:
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256))


def _index(lists: Sequence[Sequence[str] | None]) -> dict[str, np.ndarray]:
    """Rows of every value of a column of lists."""
    found: dict[str, list[int]] = {}
    for row, values in enumerate(lists):
        for v in set(values or ()):
            found.setdefault(v, []).append(row)
    return {v: np.array(rows) for v, rows in found.items()}


def _block_best(posts: pa.Table, looks: pa.Table, k: int, w: RankingWeights) -> pa.Table:
    """The best ``k`` postings of a block for every look, as far as they are above its
    floor.  Scores add up in the order of :func:`with_score`, to the same doubles."""
    posts = posts.sort_by("tie")
    n = posts.num_rows
    ordinals = posts.column("ordinal").to_numpy()
    hits, tags = (posts.column(c).to_pylist() for c in ("text_hits", "tags"))
    by_hit = _index(hits)
    by_known = _index([[*(h or ()), *(t or ())] for h, t in zip(hits, tags)])
    by_track = _index(posts.column("concentration_tags").to_pylist())
    by_label = _index([[v] for v in posts.column("seniority_label").to_pylist()])
    opt = posts.column("opt").to_numpy(zero_copy_only=False).astype(bool)
    labelled = np.ones(n, bool)
    for none in ("", None):
        labelled[by_label.get(none, [])] = False
    nobody = np.array([], int)

    def dense(track: str | None, needs: bool | None, wants: str | None) -> np.ndarray:
        parts = [np.zeros(n, bool) for _ in range(4)]
        if track is not None:
            parts[0][by_track.get(track, nobody)] = True
        if needs:
            parts[1] = opt
        if wants is not None:
            parts[2][by_label.get(wants, nobody)] = True
            parts[3] = labelled & ~parts[2]
        out = np.zeros(n)
        for part, weight in zip(parts, (w.concentration, w.opt_cpt, w.seniority, w.seniority_mismatch)):
            out = out + np.where(part, float(weight), 0.0)
        return out

    def count(terms: Sequence[str] | None, rows_of: dict[str, np.ndarray]) -> list[tuple[np.ndarray, int]]:
        return [(rows_of[t], times) for t, times in Counter(terms or ()).items() if t in rows_of]

    def add(found: list[tuple[np.ndarray, int]]) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for rows, times in found:
            out[rows] += times
        return out

    def most(found: list[tuple[np.ndarray, int]], weight: float) -> float:
        return (sum(times for _, times in found) if weight > 0 else 0) * float(weight)

    known_dense: dict[tuple, tuple[np.ndarray, float]] = {}
    out_look, out_ordinal, out_score = [], [], []
    for look, skills, roles, track, needs, wants, floor in zip(
        *(looks.column(c).to_pylist() for c in ("look", *_LOOK, "floor"))
    ):
        if (track, needs, wants) not in known_dense:
            if len(known_dense) >= 64:
                known_dense.clear()
            d = dense(track, needs, wants)
            known_dense[track, needs, wants] = d, d.max()
        base, base_most = known_dense[track, needs, wants]
        skilled, cast = count(skills, by_hit), count(roles, by_known)
        if floor is not None and most(skilled, w.skill) + most(cast, w.role) + base_most <= floor:
            continue
        score = add(skilled) * float(w.skill) + add(cast) * float(w.role) + base
        rows = np.arange(n) if floor is None else np.flatnonzero(score > floor)
        if len(rows) > k:
            least = np.partition(score[rows], -k)[-k]
            above = rows[score[rows] > least]
            rows = np.concatenate([above, rows[score[rows] == least][: k - len(above)]])
        out_look += [look] * len(rows)
        out_ordinal.append(ordinals[rows])
        out_score.append(score[rows])
    return pa.table(
        {
            "look": pa.array(out_look, pa.binary()),
            "ordinal": pa.array(np.concatenate([nobody, *out_ordinal]), pa.int64()),
            "score": pa.array(np.concatenate([np.zeros(0), *out_score]), pa.float64()),
        }
    )


def _scored_in_groups(looks: DataFrame, posts: DataFrame, k: int, w: RankingWeights) -> DataFrame:
    """:func:`_block_best` of every (part, block) that both sides have."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            left = left.slice(0, 0)
            return pa.table({"look": left.column("look"), "ordinal": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _block_best(right, left, k, w)

    keys = ("part", "block")
    return looks.groupBy(*keys).cogroup(posts.groupBy(*keys)).applyInArrow(best, _BEST)


def _candidates(
    signals: DataFrame,
    people: DataFrame,
    k: int,
    w: RankingWeights,
    scratch: Scratch,
    first_block: int,
    block: int,
    look_part: int,
) -> tuple[DataFrame, DataFrame]:
    """The distinct looks of ``people``, and ``(look, ordinal)`` pairs that contain the
    best ``k`` of each."""
    none = F.array().cast("array<string>")
    lists = {
        "text_hits": F.col("text_hits"),
        "tags": F.transform(F.coalesce("role_tags", none), casefold),
        "concentration_tags": F.coalesce("concentration_tags", none),
    }
    posts = signals.select(
        "ordinal", "tie", "seniority_label", F.coalesce("opt_cpt_flag", F.lit(False)).alias("opt"),
        *[F.array_sort(F.array_distinct(c)).alias(n) for n, c in lists.items()],
    ).withColumn("_class", _digest((*lists, "opt", "seniority_label")))
    place = F.row_number().over(W.partitionBy("_class").orderBy("tie"))
    later = F.floor((F.col("tie") - F.lit(first_block + 1)) / F.lit(block)).cast("long") + 1
    posts = scratch.keep(
        posts.withColumn("_rn", place).filter(F.col("_rn") <= k).drop("_rn", "_class").withColumn(
            "block", F.when(F.col("tie") <= first_block, F.lit(0).cast("long")).otherwise(later)
        ),
        "rank-classes",
    )
    looks = scratch.keep(people.select("look", *_LOOK).distinct(), "rank-looks")
    parts = -(-looks.count() // look_part) or 1
    part = F.pmod(F.xxhash64("look"), F.lit(parts)).cast("long")
    looks = looks.withColumn("part", part)
    copies = posts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    first = scratch.keep(
        _scored_in_groups(
            looks.withColumns({"floor": F.lit(None).cast("double"), "block": F.lit(0).cast("long")}),
            copies.filter("block = 0"), k, w,
        ),
        "rank-first",
    )
    last = posts.agg(F.max("block")).first()[0] or 0
    if not last:
        return looks, first.select("look", "ordinal").distinct()
    floors = first.groupBy("look").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")
    )

    def reach(terms: str, weight: float) -> Column:
        return F.coalesce(F.size(F.filter(terms, lambda t: t.isNotNull())), F.lit(0)) * F.lit(max(float(weight), 0.0))

    best = reach("skill_terms", w.skill) + reach("role_terms", w.role) + F.lit(
        max(w.concentration, 0.0) + max(w.opt_cpt, 0.0) + max(w.seniority, w.seniority_mismatch, 0.0)
    )
    still = looks.join(floors, "look", "left").filter(F.col("floor").isNull() | (best > F.col("floor")))
    rest = _scored_in_groups(
        still.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(last)).cast("array<bigint>"))),
        copies.filter("block > 0"), k, w,
    )
    return looks, first.unionByName(rest).select("look", "ordinal").distinct()


def rank_matches(
    postings: DataFrame,
    profiles: DataFrame,
    scratch: Scratch,
    *,
    limit: int | None,
    weights: RankingWeights | None = None,
    pair_budget: int | None = None,
    max_frequent: int | None = None,
    first_block: int = FIRST_BLOCK,
    block: int = BLOCK,
    look_part: int = LOOK_PART,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Ranked matches: score desc, date desc (NULLs last), company and title desc,
    input order.  ``rank_position`` is 1-based inside the returned matches.

    ``postings`` come from :func:`posting_features`, written to a table since they
    are read several times; ``profiles`` from
    ``profile_features`` (consenting ones).  With ``limit=None`` every posting is
    returned for every profile, as asked; that output is their product, so pass
    few profiles.  ``pair_budget`` and ``max_frequent`` belong to an earlier search
    and change nothing; blocks and parts only change how the work is dealt.  ``keep``
    names further columns of the profiles that their matches carry.
    """
    of_profile = (*PROFILE_COLUMNS, *keep)
    w = weights or RankingWeights()
    if limit is not None and limit < 1:
        raise ValueError("limit must be a positive integer")
    postings = postings.select(*POSTING_COLUMNS)
    ties = with_tie(postings, scratch)
    signals = scratch.keep(
        postings.select("ordinal", *SIGNAL_COLUMNS).join(ties, "ordinal"), "rank-signals"
    )
    people = scratch.keep(
        spread(profiles.select(*of_profile), "profile_no").withColumn("look", _digest(_LOOK)),
        "rank-profiles",
    )
    order = [F.col("score").desc(), F.col("tie")]
    if limit is None:
        pairs = scratch.keep(
            people.select("profile_no").crossJoin(signals.select("ordinal", "tie").distinct()).drop("tie"),
            "rank-pairs",
        )
        scored = with_score(_spread_lookup(pairs, signals).join(people, "profile_no"), w).select(
            "profile_no", "ordinal", "tie", "score"
        )
        ranked = number_rows(scored, order, "rank_position", scratch, ["profile_no"])
        return _wide_rows(scratch.keep(ranked.drop("tie"), "rank-positions"), postings, people, w)

    def cut(rows: DataFrame, group: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint")
        return rows.withColumn("rank_position", place).filter(F.col("rank_position") <= limit)

    looks, pairs = _candidates(signals, people, limit, w, scratch, first_block, block, look_part)
    pairs = scratch.keep(pairs, "rank-pairs")
    # a popular posting is a candidate for very many looks
    scored = with_score(_spread_lookup(pairs, signals).join(looks, "look"), w)
    by_look = scratch.keep(cut(scored.select("look", "ordinal", "tie", "score"), "look"), "rank-positions")
    times = people.groupBy("profile_no").agg(F.count(F.lit(1)).alias("times"))
    several = None
    if not times.filter("times > 1").isEmpty():
        # rows of one profile share its limit; only these are dealt out before the cut
        parted = scratch.keep(people.join(times, "profile_no"), "rank-times")
        repeated = parted.filter("times > 1").drop("times")
        rows = repeated.select("profile_no", "look").join(by_look.drop("rank_position"), "look")
        ranked = scratch.keep(cut(rows, "profile_no").drop("tie", "look"), "rank-numbers")
        several = _wide_rows(ranked, postings, repeated, w)
        people = parted.filter("times = 1").drop("times")
    # what a look gets is put together once; only profiles are dealt to their looks
    full = with_reasons(_spread_lookup(by_look, postings).join(looks, "look"), w)
    found = ("rank_position", "score", "reasons", *POSTING_COLUMNS)
    matches = scratch.keep(
        full.groupBy("look").agg(F.collect_list(F.struct(*found)).alias("matches")), "rank-matches"
    )
    counts = people.groupBy("look").agg(F.count(F.lit(1)).alias("n"))
    dealt = lookup_join(people, matches, "look", counts=counts, total_rows=people.count(), floor=HOT_ROWS)
    alone = dealt.select(*of_profile, F.explode("matches").alias("_m")).select(*of_profile, "_m.*")
    return alone if several is None else alone.unionByName(several.select(*alone.columns))


def _wide_rows(ranked: DataFrame, postings: DataFrame, people: DataFrame, w: RankingWeights) -> DataFrame:
    """The wide columns come back for the matches only."""
    return with_reasons(_spread_lookup(ranked, postings).join(people.drop("look"), "profile_no"), w)


def authorized_matches(
    postings: DataFrame,
    profiles: DataFrame,
    scratch: Scratch,
    *,
    limit: int | None,
    weights: RankingWeights | None = None,
) -> DataFrame:
    """:func:`rank_matches` with work authorisation as a hard filter.

    A profile that needs sponsorship gets no posting that refuses it; postings that
    say nothing about it stay.  Such profiles are ranked over the postings left to
    them and the others over all, so the veto comes before the limit and every bound
    of the ranking holds as it is; ``rank_position`` counts what is left.
    """
    sponsored = F.coalesce("needs_opt", F.lit(False))
    willing = postings.filter(F.coalesce("opt_cpt_flag", F.lit(True)))
    return rank_matches(
        willing, profiles.filter(sponsored), scratch, limit=limit, weights=weights
    ).unionByName(
        rank_matches(postings, profiles.filter(~sponsored), scratch, limit=limit, weights=weights)
    )


def _spread_lookup(rows: DataFrame, postings: DataFrame) -> DataFrame:
    counts = rows.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    return lookup_join(rows, postings, "ordinal", counts=counts, total_rows=rows.count(), floor=HOT_ROWS)


def export_position(ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """Global export order: student, score desc, company, title, rank order."""
    return number_rows(
        ranked,
        [
            F.col("student_key").asc(),
            F.col("score").desc(),
            F.col("company").asc(),
            F.col("title").asc(),
            F.col("profile_no").asc(),
            F.col("rank_position").asc(),
        ],
        "export_position",
        scratch,
    )
