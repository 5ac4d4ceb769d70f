"""Text expressions: stripping, folding, hashing, whole-word term tests.

All of them are Column -> Column and stay on the JVM.  Word characters are the
Unicode letters, numbers and the underscore; the classes are spelled out because
Java's ``\\w`` is ASCII-only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\w\p{L}\p{N}]"
NOT_WORD = r"[^\w\p{L}\p{N}]"
_RUN = rf"{WORD}++|{NOT_WORD}++"
_is_word = re.compile(r"\w").match

# every character that counts as white space at the ends of a text
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def _but(codes: Iterable[int], slow: str) -> str:
    """The class ``slow`` less some Latin-1 characters, which one look at a table
    passes over; ranges and categories are tested one by one."""
    return f"[[^{''.join(f'\\x{c:02x}' for c in codes)}]&&{slow}]"


# terms of these characters only are word runs under any Unicode version
_LATIN = "A-Za-z0-9_\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_LATIN_CODES = [c for c in range(256) if re.match(f"[{_LATIN}]", chr(c))]
# white space and characters outside words, each without U+0020
_ODD_SPACE = _but([*range(0x20, 0x7F), *range(0xA1, 0x100)], _SPACE)
_BLANK = _but([0x20, *_LATIN_CODES], NOT_WORD)
# the characters that most texts have most of, rising
_COMMON = "bgfmpuhcdlorsaitne "


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` only knows U+0020).

    Trimming looks at the ends of the text only; a pattern would scan all of it.
    """
    return F.btrim(c, F.lit(SPACES))


def text_or_null(c: Column) -> Column:
    """Stripped text, NULL when blank."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """Whether nothing is left after :func:`strip`; looks at the beginning only."""
    return F.ltrim(c, F.lit(SPACES)) == ""


def casefold(c: Column) -> Column:
    """Lower case plus the sharp s; other full case foldings are not applied."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    """Whitespace runs become one space, ends stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, _ODD_SPACE, " "), "  +", " "))


def stable_hash(c: Column) -> Column:
    return F.sha2(F.lower(strip(c)), 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A one-element ``transform`` binds it; without that, Spark may inline the
    expression into a lambda and evaluate it again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def runs_of(term: str) -> list[str]:
    """Maximal word and non-word runs of a Python string, in order."""
    return re.findall(r"\w+|\W+", term)


def term_shape(c: Column) -> Column:
    """``struct<word, runs>``: does a term start with a word character, and how
    many maximal word and non-word runs does it have."""
    return F.struct(
        c.rlike(f"^{WORD}").alias("word"), F.regexp_count(c, F.lit(_RUN)).alias("runs")
    )


def term_grams(text: Column, shapes: Iterable[tuple[bool, int]]) -> Column:
    """Concatenations of adjacent runs of a text, for every ``(word, runs)`` shape.

    A term with a ``\\b`` on both sides occurs in a text exactly when the term's
    runs are consecutive maximal runs of the text, i.e. when the term equals one
    of these grams.  So the whole-word test becomes an equality test, which can
    be hashed and joined.  A look-ahead collects the overlapping grams in one
    pass over the text per shape.
    """
    parts = [
        F.regexp_extract_all(text, F.lit(_gram_pattern(word, runs)), F.lit(1))
        for word, runs in sorted(set(shapes))
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _gram_pattern(word: bool, runs: int) -> str:
    kinds = (WORD, NOT_WORD) if word else (NOT_WORD, WORD)
    body = "".join(f"{kinds[i % 2]}++" for i in range(runs))
    ends_in_word = (runs % 2 == 1) == word
    # a boundary needs a word character on exactly one side of it
    right = "" if ends_in_word else f"(?={WORD})"
    if word and runs == 1:
        return f"({body})"
    left = f"(?<!{WORD})" if word else f"(?<={WORD})"
    return f"{left}(?=({body}){right})"


def has_word_edges(term: str) -> bool:
    return bool(term) and bool(_is_word(term[0])) and bool(_is_word(term[-1]))


def lookaround_pattern(term: str) -> str:
    """Pattern of a term with no word character next to it.

    The literal comes first, so that most positions fail on one comparison.
    """
    t = _quote(term)
    return f"{t}(?!{WORD})(?<!{WORD}{t})"


def boundary_pattern(term: str) -> str:
    """Pattern of a term between two ``\\b`` under Unicode word classes."""
    t = _quote(term)
    left = f"(?<!{WORD}{t})" if _is_word(term[0]) else f"(?<={WORD}{t})"
    right = f"(?!{WORD})" if _is_word(term[-1]) else f"(?={WORD})"
    return f"{t}{right}{left}"


def _quote(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


def word_text(text: Column) -> Column:
    """``text`` between spaces, every character that is no word character a space.

    Computed once, it lets :func:`has_term` find whole words by byte searches.
    """
    return F.concat(F.lit(" "), F.regexp_replace(text, _BLANK, " "), F.lit(" "))


def has_term(
    text: Column,
    term: str,
    pattern: Callable[[str], str] = lookaround_pattern,
    words: Column | None = None,
) -> Column:
    """Whole-word test of one fixed term: a byte search, then the pattern.

    With ``words``, the :func:`word_text` of ``text``, a term that is one word needs no
    pattern, and one of several words only where they occur in this order.
    """
    there, exact = F.contains(text, F.lit(term)), text.rlike(pattern(term))
    if words is None or not has_word_edges(term) or not re.fullmatch(rf"[\x00-\x7f{_LATIN}]+", term):
        return there & exact
    spaced = re.sub(f"[^{_LATIN}]", " ", term) + " "
    # its end is searched first: spaces are frequent, so bad to begin with
    near = F.contains(words, F.lit(_search_end(spaced))) & F.contains(words, F.lit(" " + spaced))
    return near if re.fullmatch(f"[{_LATIN}]+", term) else near & exact


def _search_end(spaced: str) -> str:
    """An end of ``spaced`` of three or more characters that begins with a rare one: a
    byte search compares further only where the first byte is met."""
    starts = range(max(len(spaced) - 2, 1))
    return spaced[min(starts, key=lambda i: _COMMON.find(spaced[i])):]


def has_any(
    text: Column,
    terms: Sequence[str],
    pattern: Callable[[str], str] = lookaround_pattern,
    words: Column | None = None,
) -> Column:
    """Whether any of a few fixed terms occurs; stops at the first one."""
    out = None
    for t in dict.fromkeys(terms):
        hit = has_term(text, t, pattern, words)
        out = hit if out is None else out | hit
    return F.lit(False) if out is None else out


def terms_in(
    text: Column,
    terms: Sequence[str],
    pattern: Callable[[str], str] = lookaround_pattern,
    words: Column | None = None,
) -> Column:
    """Those of a few fixed terms that occur in ``text``, in the given order."""
    hits = [F.when(has_term(text, t, pattern, words), F.lit(t)) for t in dict.fromkeys(terms)]
    return F.array_compact(F.array(*hits)).cast("array<string>")


def terms_of(values: Column) -> Column:
    """Profile terms: stripped, lower-cased, blanks dropped, repeats kept."""
    return F.filter(
        F.transform(values, lambda v: F.lower(strip(v))), lambda v: v != F.lit("")
    )
