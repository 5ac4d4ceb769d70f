"""Language identification by Bayesian fusion of text, declared language, address and host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import text_or_empty
from jobweave.operators.scratch import Scratch

BUCKETS = 1 << 15  # hashed byte trigrams of the text model
PER_LANGUAGE = 2000  # labelled texts the text model is fitted on, at most, per language
STRENGTH = 20.0  # rows a level of the host hierarchy weighs in the next one's prior
EFFECTIVE = 200.0  # trigrams of a text are dependent: they count as at most so many
UNKNOWN = "und"
_LETTERS = np.array(
    [c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)],
    np.uint32,
)


def trigrams(text: str | None) -> np.ndarray:
    """Hash buckets of the byte trigrams of a lower-cased text; what is not a letter
    is a space, and only trigrams with a letter in the middle count."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)
    x = _LETTERS[raw]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    code = code[x[1:-1] != 32]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


class TextModel:
    """Log probabilities of trigram buckets, one row per language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.logs = np.log((counts + 0.1) / (total + 0.1 * BUCKETS)).astype(np.float32).T.copy()
        self.uniform = -float(np.log(BUCKETS))

    def likelihoods(self, text: str | None) -> tuple[int, list[float]]:
        """Trigrams, and log likelihoods of each language over that of noise."""
        t = trigrams(text)
        if not len(t):
            return 0, [0.0] * len(self.languages)
        mean = self.logs[t].mean(0, dtype=np.float64) - self.uniform
        return len(t), (mean * len(t) / (1 + len(t) / EFFECTIVE)).tolist()


def fit(labelled: DataFrame, *, per_language: int = PER_LANGUAGE) -> TextModel:
    """A text model of every label from (text, lang).

    Of each language at most ``per_language`` distinct texts take part, drawn by a
    hash, each once and whole; that bounds the work.  The driver holds a row of
    BUCKETS counts a label.  Null texts or labels and the label "und" do not take
    part.  No labelled row gives a model without languages.
    """
    rows = labelled.select("text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN)
    )
    rows = rows.withColumn("h", F.xxhash64("text"))
    texts = rows.select("lang", "h").distinct()
    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    at = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        # a fifth more than needed by hash, so that few rows are numbered
        share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.2 * per_language / n)))])
        place = F.pmod("h", F.lit(1_000_000))
        drawn = texts.filter(place < F.element_at(share, F.col("lang")) * 1_000_000)
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
        drawn = drawn.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("lang", "h")
        # all copies of a text are one row
        sample = rows.join(F.broadcast(drawn), ["lang", "h"], "left_semi")
        sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")

        def count(batches):
            for b in batches:
                sums: dict[str, np.ndarray] = {}
                for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
                for lang, s in sums.items():
                    at = np.flatnonzero(s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"]
                    )

        summed = (
            sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        ).toArrow()  # at most languages * BUCKETS rows
        row = np.array([at[x] for x in summed.column("lang").to_pylist()], np.int64)
        counts[row, summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return TextModel(languages, counts)


def _counts(n: int, best: str) -> list[Column]:
    return [F.count(F.when(F.col(best) == i, 1)).cast("double").alias(f"c{i}") for i in range(n)]


def _sum(n: int) -> list[Column]:
    return [F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]


def identify(rows: DataFrame, model: TextModel, scratch: Scratch, *, keys: list[str], min_posterior: float = 0.5) -> DataFrame:
    """Key columns, lang, posterior, text_lang, n_trigrams, kept per row of ``rows``.

    ``rows`` has the keys and text, declared (language the markup or the metadata
    states), hint (language or country part of the address) and host.  One pass
    over the texts gives log likelihoods; all else is grouped aggregation over narrow
    rows.  P(declared | language) and P(hint | language) are counted against the
    language that the text alone favours, smoothed towards the value's own share.
    The prior of a host is its counts smoothed towards its domain's, those towards
    its suffix's, those towards the corpus's.  The posterior is over the languages
    and "und", noise of uniform trigrams, to which the other evidence says nothing.

    Kept are rows with letters whose best language is not "und" and has at least
    ``min_posterior``.  Null or empty texts and texts without letters are "und" with
    posterior 1, not kept.  Null declared, hint or host is no evidence.  Repeated rows
    are rows of their own; an empty table gives no rows; a model without languages
    makes all "und", and keeps texts with letters, as nothing speaks against them.
    """
    size = len(model.languages)
    texts = rows.select(*keys, "declared", "hint", "host", text_or_empty("text").alias("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]

    def read(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                n, ll = zip(*[model.likelihoods(t) for t in s.column(s.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[:-1], pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64()))],
                    names=[*s.schema.names[:-1], "n_trigrams", "ll"],
                )

    seen = texts.mapInArrow(read, ", ".join(kinds) + ", n_trigrams long, ll array<double>")
    if not size:
        kept = F.col("n_trigrams") > 0
        return seen.select(
            *keys, F.lit(UNKNOWN).alias("lang"), F.lit(1.0).alias("posterior"),
            F.lit(UNKNOWN).alias("text_lang"), "n_trigrams", kept.alias("kept"),
        )
    best = F.when(
        (F.col("n_trigrams") > 0) & (F.array_max("ll") > 0), (F.array_position("ll", F.array_max("ll")) - 1).cast("int")
    )
    # how often each language won, by host; domain and suffix are parts of the host
    host = F.lower("host")
    seen = scratch.keep(
        seen.withColumn("best", best).withColumn("host", host).withColumn("declared", F.lower("declared")).withColumn("hint", F.lower("hint")),
        "texts",
    )
    won = seen.filter("best IS NOT NULL")
    totals = won.agg(*_counts(size, "best")).first()
    each = [x or 0.0 for x in totals]
    everything = sum(each)
    corpus = [(c + 1.0) / (everything + size) for c in each]

    def smoothed(prior) -> list[Column]:
        n = sum((F.col(f"c{i}") for i in range(1, size)), F.col("c0"))
        return [((F.col(f"c{i}") + STRENGTH * prior(i)) / (n + STRENGTH)).alias(f"p{i}") for i in range(size)]

    suffix, domain = F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)
    hosts = scratch.keep(
        won.filter("host IS NOT NULL").groupBy("host").agg(*_counts(size, "best"))
        .withColumn("domain", domain).withColumn("suffix", suffix),
        "hosts",
    )
    suffixes = hosts.groupBy("suffix").agg(*_sum(size)).select("suffix", *smoothed(lambda i: F.lit(corpus[i])))
    domains = hosts.groupBy("domain", "suffix").agg(*_sum(size)).join(suffixes, "suffix")
    domains = domains.select("domain", *smoothed(lambda i: F.col(f"p{i}")))
    priors = hosts.join(domains, "domain").select("host", *smoothed(lambda i: F.col(f"p{i}")))
    priors = priors.select("host", F.array(*[F.log(f"p{i}") for i in range(size)]).alias("prior"))

    def ratios(name: str) -> DataFrame:
        """log P(value | language) / P(value) of every value of an evidence column."""
        t = won.filter(F.col(name).isNotNull()).groupBy(name).agg(*_counts(size, "best"))
        n = sum((F.col(f"c{i}") for i in range(1, size)), F.col("c0"))
        share = n / max(everything, 1.0)
        logs = [
            F.log((F.col(f"c{i}") + STRENGTH * share) / (each[i] + STRENGTH)) - F.log(share) for i in range(size)
        ]
        return t.select(name, F.array(*logs).alias(f"{name}_ratio"))

    joined = seen.join(priors, "host", "left").join(ratios("declared"), "declared", "left").join(ratios("hint"), "hint", "left")
    none = F.array(*[F.lit(0.0)] * size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = F.coalesce("prior", F.array(*[F.lit(float(np.log(p))) for p in corpus]))
    total = add(add(add(F.col("ll"), total), F.coalesce("declared_ratio", none)), F.coalesce("hint_ratio", none))
    scored = joined.withColumn("total", F.concat(total, F.array(F.lit(float(np.log(0.01))))))
    top = F.array_max("total")
    scored = scored.withColumn("top", top).withColumn(
        "posterior",
        1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))),
    ).withColumn("at", F.array_position("total", F.col("top")))
    names = F.array(*[F.lit(x) for x in [*model.languages, UNKNOWN]])
    empty = F.col("n_trigrams") == 0
    lang = F.when(empty, UNKNOWN).otherwise(F.element_at(names, F.col("at").cast("int")))
    return scored.select(
        *keys, lang.alias("lang"), F.when(empty, 1.0).otherwise(F.col("posterior")).alias("posterior"),
        F.coalesce(F.element_at(names, F.col("best") + 1), F.lit(UNKNOWN)).alias("text_lang"),
        "n_trigrams", ((lang != UNKNOWN) & (F.col("posterior") >= min_posterior)).alias("kept"),
    )


def document_evidence(docs: DataFrame, *keys: Column | str) -> DataFrame:
    """Documents: the stated language is ``lang``, the source stands for the host."""
    return docs.select(*keys, "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("hint"), F.col("source").alias("host"))


def page_evidence(pages: DataFrame, *keys: Column | str) -> DataFrame:
    """Pages: visible text, the markup's language attribute, the host, and the part of
    the address that names a language: a first path segment of two letters, else a
    host suffix of two letters."""
    html = F.coalesce("html", F.lit(""))
    shown = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    shown = F.regexp_replace(shown, r"&[A-Za-z#0-9]{1,10};", " ")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    stated = F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    path = F.regexp_extract("url", r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1)
    ending = F.regexp_extract(host, r"\.([A-Za-z]{2})$", 1)
    filled = lambda c: F.when(c != "", c)
    return pages.select(
        *keys, shown.alias("text"), filled(stated).alias("declared"),
        F.coalesce(filled(path), filled(ending)).alias("hint"), filled(host).alias("host"),
    )
