"""Exact duplicates by a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import text_or_empty


class DigestIndex:
    """All texts seen so far: one row (digest, keep_id, copies) per batch and text.

    The index is a table bucketed and sorted by ``digest``, so the anti-join of a new
    batch and the look-up of its winners read it without a shuffle; only the narrow
    rows (digest, id) of the batch move, and a digest shared by a third of all rows is
    counted before they move.  ``buckets`` fixes the layout for the index's life.
    The catalogue entry is rebuilt over ``path`` when a new session opens the index.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, copies BIGINT"

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64) -> None:
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self.SCHEMA}) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def close(self) -> None:
        """Drop the catalogue entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, digests: DataFrame) -> None:
        """Add the texts of (digest, id) that the index does not hold yet."""
        winners = digests.groupBy("digest").agg(
            F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")
        )
        new = winners.join(self.table().hint("merge"), "digest", "left_anti")
        (
            new.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest")
            .mode("append").format("parquet").saveAsTable(self.name, path=self.path)
        )

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The rows with keep_id and copies of the text's first batch."""
        return digests.join(self.table().hint("merge"), "digest")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def deduplicate(
    docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, digest, keep_id, copies, kept) per row of ``docs``.

    A null text counts as empty and all empty texts are equal.  Of equal texts of one
    batch the row with the largest id stays; of rows that share this id too, every
    one is kept here, and ``keep_one`` leaves one of them.  Rows with a null id
    lose to all others; if all equal rows have a null id, keep_id is null and all are
    kept.  A text that an earlier batch brought keeps that batch's keep_id, so its
    new copies are dropped.  Columns of ``docs`` other than the two are not read.
    An empty table gives no rows and leaves the index as it is.
    """
    digests = docs.select(
        F.col(id_col).cast("long").alias("id"), digest(text_or_empty(text_col)).alias("digest")
    )
    index.append(digests)
    return index.lookup(digests).select(
        "id", "digest", "keep_id", "copies", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def keep_one(
    docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all their columns.

    Of rows that share text and id any one stays.
    """
    winners = deduplicate(docs, index, id_col=id_col, text_col=text_col)
    winners = winners.filter("kept").select(
        F.col("id").alias("_id"), F.col("digest").alias("_d")
    ).distinct()
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.{id_col}").cast("long").alias("_i"),
        digest(F.coalesce(F.col(f"row.{text_col}"), F.lit(""))).alias("_t"),
    )
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_d"))
    found = rows.join(winners, same, "left_semi")
    return found.dropDuplicates(["_i", "_t"]).select("row.*")
