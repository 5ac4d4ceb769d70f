"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import (
    bpe, chat, langid, lm, mix, neardup, pieces, pii, spelling, tokenfile, vectors, whiten,
)
from jobweave.llm.common import table, text_or_empty
from jobweave.llm.exact import DigestIndex, deduplicate
from jobweave.operators.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
SURROGATE_KEY = "documents-release-1"


def new_index(spark: SparkSession, scratch: Scratch) -> DigestIndex:
    """An index that begins empty, below the scratch folder."""
    name = "digests_" + scratch.root.rsplit("-", 1)[-1]
    return DigestIndex(spark, name, f"{scratch.root}/index")


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    index = new_index(spark, Scratch(spark))
    return deduplicate(table(spark, sf, "documents"), index).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("copies").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), Scratch(spark), shingle=4)


def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", trap), (-7, 1, "assistant", trap)],
        "conv_id long, turn long, role string, text string",
    )
    scratch = Scratch(spark)
    out = scratch.keep(chat.windows(turns.unionByName(more), scratch), "windows")
    back = chat.parsed(out)
    piece = F.struct("window", "turns", F.array_join("losses", "").alias("loss"))
    whole = back.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(piece)).alias("ws"),
        F.sum("chars").alias("formatted_chars"),
    )
    said = F.flatten(F.transform("ws", lambda w: F.transform(
        w["turns"], lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id", F.size(said).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op4_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.with_surrogates(table(spark, sf, "documents"), SURROGATE_KEY, Scratch(spark))
    return out.select("row.doc_id", "text", "n_entities", "kinds")


def op5_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix.shares(table(spark, sf, "documents"), Scratch(spark)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "epochs"
    )


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(table(spark, sf, "documents"), path)
    return bpe.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    files = tokenfile.write(table(spark, sf, "documents"), path, f"{scratch.root}/tokens", scratch)
    return tokenfile.read(files).select(
        "doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op8_vector_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"), Scratch(spark))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages together: each has the id of its own table."""
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    none = F.lit(None).cast("long")
    rows = langid.document_evidence(docs, "doc_id", none.alias("page_id")).unionByName(
        langid.page_evidence(pages, none.alias("doc_id"), "page_id")
    )
    return langid.identify(rows, langid.fit(docs), Scratch(spark), keys=["doc_id", "page_id"])


def held_out() -> F.Column:
    """crc32 of the id as text leaves 2 modulo 7; a row without id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def op10_ngram_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = lm.train(docs.filter(~held_out()), Scratch(spark))
    return lm.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def noisy_words() -> F.Column:
    """Words of at least six letters of a document.  One letter is missing from each
    run whose checksum with the doc_id (null: empty) is a multiple of 199."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.regexp_extract_all(text_or_empty(), F.lit("[A-Za-z\u00C0-\u00FF]+"), F.lit(0))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))

    def noisy(run: F.Column) -> F.Column:
        h = F.crc32(F.concat(name, run))
        at = (h % F.length(run)).cast("int")
        rest = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
        return F.when(h % 199 == 0, rest).otherwise(run)

    long = F.filter(runs, lambda r: F.length(r) >= 6)
    changed = F.transform(F.transform(long, lambda r: F.translate(r, upper, lower)), noisy)
    return F.filter(changed, lambda w: F.length(w) >= 6)


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    counts = spelling.count_words(table(spark, sf, "documents"), noisy_words(), 5)
    return spelling.variants(counts, Scratch(spark))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """The deviation is null where it does not fit a long."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", whiten.fixed_point(F.col("embedding"), 1024, 100000).alias("vector")
    )
    return whiten.whiten(rows, Scratch(spark)).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


def op13_pieces(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode(table(spark, sf, "documents"), path, Scratch(spark))
    return pieces.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Query]:
    found = [f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op2_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)] END) AS items FROM w),
e AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.item = b.item AND a.doc_id <> b.doc_id
      AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON c.node = s.doc_id""",
        "op8_vector_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.node = vec_id LEFT JOIN l ON l.a = vec_id""",
        # crc32 by half bytes; a word's shapes have one letter left open or left out
        "op11_spelling_variants": """
WITH RECURSIVE crc AS (SELECT list_transform(range(16), lambda k: list_reduce([0, 1, 2, 3],
    lambda c, i: xor(c >> 1, (c & 1) * 3988292384), k::BIGINT)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS name, w, count(*) AS k FROM (SELECT doc_id,
    translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM r)
  WHERE length(w) >= 6 GROUP BY ALL),
x AS (SELECT w, k, hex(encode(name)) AS s FROM l),
h AS (SELECT w, k, xor(4294967295, list_reduce(list_transform(range(length(s)),
    lambda i: (instr('0123456789ABCDEF', substr(s, (i + 1 + 1 - 2 * (i % 2))::BIGINT, 1)) - 1)::BIGINT),
    lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1]), 4294967295::BIGINT)) AS h FROM x, crc),
n AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0
    THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n),
o AS (SELECT word, n, substr(word, 1, i - 1) || chr(10) || substr(word, i + 1) AS open,
    substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM p),
near AS (SELECT a.word AS a, b.word AS b, b.n FROM o a JOIN o b ON a.open = b.open AND a.word <> b.word
  UNION SELECT o.word, n.word, n.n FROM o JOIN n ON n.word = o.less
  UNION SELECT n.word, o.word, o.n FROM o JOIN n ON n.word = o.less),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS b, max(n) AS bn FROM near GROUP BY a),
f AS (SELECT word, n.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN bn >= 5 * n.n THEN b END AS form,
    CASE WHEN bn >= 5 * n.n THEN bn END AS form_n FROM n LEFT JOIN best ON best.a = n.word),
w AS (SELECT word, coalesce(form, word) AS root FROM f
  UNION SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
e AS (SELECT w.word, w.root FROM w JOIN f ON f.word = w.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON e.word = f.word""",
    }
