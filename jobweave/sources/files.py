"""File scans that give every record a deterministic position.

``ordinal`` = file number * 2^36 + position inside the file, files in path order.
It needs no shuffle and does not depend on how Spark groups the files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SHIFT = 36
MAX_FILES = 1 << 22  # of one source; what is above numbers the sources
BROADCAST_FILES = 100_000
# listings and metadata columns write the slashes after the scheme differently
_SLASHES = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):/+")
_ROW_BITS = (1 << 33) - 1


class ExportError(ValueError):
    """An export that must not be loaded at all."""


def number_files(df: DataFrame) -> DataFrame:
    """Add ``file_no``: the position of the row's file among the scanned files.

    The file list is the driver's own listing, one short entry per file; it is
    broadcast up to ``BROADCAST_FILES`` entries.
    """
    paths = sorted(_SLASHES.sub(r"\1:/", p) for p in df.inputFiles())
    files = df.sparkSession.createDataFrame(
        list(enumerate(paths)), "file_no bigint, file_path string"
    )
    if len(paths) <= BROADCAST_FILES:
        files = F.broadcast(files)
    same = df.withColumn(
        "file_path", F.regexp_replace("file_path", _SLASHES.pattern, "$1:/")
    )
    return same.join(files, "file_path", "left").withColumn(
        "file_no",
        F.coalesce("file_no", F.raise_error(F.lit("file is not in the scan list")).cast("bigint")),
    )


def record_ordinal(position: Column) -> Column:
    """Both parts are checked: an ordinal that overflows would mix records."""
    fits = (position < F.lit(1 << FILE_SHIFT)) & (F.col("file_no") < F.lit(MAX_FILES))
    checked = F.when(fits, position).otherwise(
        F.raise_error(F.lit("too many files or too large a file to number the records")).cast("bigint")
    )
    return F.shiftleft(F.col("file_no"), FILE_SHIFT) + checked


def whole_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file_no, file_path, text)``, one row per file (files are not split)."""
    docs = (
        spark.read.option("wholetext", True)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    )
    return number_files(docs)


def line_positions(df: DataFrame) -> DataFrame:
    """Position of a record of a splittable text file inside its file.

    Block offset plus row count: a row has at least one byte, so positions of
    different blocks of a file cannot meet.  Must follow the scan directly.
    """
    return df.withColumn(
        "position",
        F.col("_metadata.file_block_start")
        + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
    ).withColumn("file_path", F.col("_metadata.file_path"))


def fail_if(bad: DataFrame, reason: str) -> None:
    """Raise when ``bad`` has a row; ``reason`` names a text column of it."""
    first = bad.select(reason).limit(1).collect()
    if first:
        raise ExportError(first[0][0])
