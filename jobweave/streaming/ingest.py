"""Incremental ingest: files landing in a folder become history updates."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.quality import check_contract
from jobweave.operators.scratch import Scratch
from jobweave.operators.skew import number_rows
from jobweave.plans.history import TEXT_CODEC, History, persist_run
from jobweave.plans.prepare import prepare
from jobweave.schemas import POSTING_SCHEMA, PROFILE_SCHEMA
from jobweave.vocab import SENIORITY_TERMS, Taxonomy


def ingest_stream(
    spark: SparkSession,
    landing: str,
    history: History,
    offsets: str,
    *,
    source: str = "stream",
    taxonomy: Taxonomy | None = None,
    seniority_terms=SENIORITY_TERMS,
    check: bool = False,
    max_files: int = 1000,
) -> None:
    """Process everything that has landed since the last call, then stop.

    A micro-batch is one run: de-duplicated in itself, resolved against the stored
    identities, folded into the history.  Exports that land together may number their
    postings alike, so a batch is numbered afresh by file and position.  At most
    ``max_files`` files make a batch.  The batch number is the run id, so a
    batch that is replayed after a failure is recognised and skipped.  Identities
    are kept for ever, as in the batch path; a watermark would change results.
    """

    def one(batch: DataFrame, number: int) -> None:
        run_id = f"{source}-{number}"
        if history.has_run(run_id):
            return
        with Scratch(spark) as scratch:
            # only places are sorted; every text moves once, to its number
            place, order = ["_file", "_row"], [F.col("_file"), F.col("ordinal")]
            numbers = number_rows(batch.select(*place, "ordinal"), order, "_position", scratch)
            numbers = numbers.select(*place, "_position").hint("shuffle_hash")
            rows = batch.join(numbers, place).withColumn("ordinal", F.col("_position"))
            rows = rows.select(*POSTING_SCHEMA.fieldNames())
            rows = check_contract(rows)[0] if check else rows
            rows = scratch.keep(rows, "batch", TEXT_CODEC)
            nobody = spark.createDataFrame([], PROFILE_SCHEMA)
            prepared = prepare(
                rows, nobody, scratch, taxonomy=taxonomy,
                seniority_terms=seniority_terms, identify=True,
            )
            persist_run(
                history, run_id=run_id, run_type="stream", source=source, postings=rows,
                prepared=prepared, ranked=None, scratch=scratch,
                now=datetime.now(UTC).isoformat(),
            )

    query = (
        spark.readStream.schema(POSTING_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(landing)
        .select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
        )
        .writeStream.foreachBatch(one)
        .option("checkpointLocation", offsets)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
