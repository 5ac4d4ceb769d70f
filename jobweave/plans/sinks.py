"""Writers.  Nothing is funnelled through one task; outputs are directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.report import export_rows


def write_matches(ranked: DataFrame, path: str) -> None:
    """Ranked-match export, CSV with header or JSON when ``path`` ends in .json.

    Files are in export order one after the other: student, score descending,
    company, title, then rank order.
    """
    order: list[Column] = [
        F.col("student_key").asc(), F.col("score").desc(), F.col("company").asc(),
        F.col("title").asc(), F.col("profile_no").asc(), F.col("rank_position").asc(),
    ]
    rows = export_rows(
        ranked.repartitionByRange(*order).sortWithinPartitions(*order)
    )
    if path.lower().endswith(".json"):
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def summary_path(path: str) -> str:
    """``<stem>.summary.json`` beside the results."""
    head, _, name = path.rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return f"{head}/{stem}.summary.json" if head else f"{stem}.summary.json"


def write_summary(summary: DataFrame, path: str) -> None:
    """One-row run summary."""
    summary.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(summary: DataFrame, jobs: DataFrame, matches: DataFrame, path: str) -> None:
    """Report of the thin run: three datasets under one folder.

    Matches are keyed by ``student_key``, so profiles that share a name stay apart.
    """
    write_summary(summary, f"{path}/summary")
    jobs.write.mode("overwrite").json(f"{path}/jobs")
    matches.write.mode("overwrite").json(f"{path}/ranked_matches")
