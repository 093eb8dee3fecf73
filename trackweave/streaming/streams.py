"""Streaming forms of ingest, embedding and the command fold.

Each micro-batch goes through the same functions as a batch run and ends in a
keyed store, so a batch replayed after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trackweave.functions.text import not_blank
from trackweave.operators.cleaning import drop_notices
from trackweave.operators.keyed import assign_ids, latest_per_key, only_in
from trackweave.operators.tracking import PAIR, fold_commands, rejected_commands
from trackweave.plans.ingest import EmbedCounts, IngestCounts, embed_new, ingest_listings
from trackweave.schemas import RAW_LISTING
from trackweave.session import materialize
from trackweave.sources.listings import impose_schema
from trackweave.sources.tables import KeyedTable


def listing_stream(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Feed files arriving in a folder. Repeats are settled by the upsert."""
    raw = spark.readStream.schema(RAW_LISTING).json(folder, multiLine=not lines)
    return impose_schema(drop_notices(raw))


def without_repeats(stream: DataFrame, within: str) -> DataFrame:
    """Drop rows equal in all columns to one that arrived at most ``within`` before (an interval, "2 hours").

    Time is arrival, so no row is ever late and none is lost to the watermark;
    a row that differs in any column, a fuller copy of a listing say, stays. The
    state holds 128 bits per row, and only for ``within``; a repeat that comes
    later is settled by the upsert, as without this.
    """
    columns = [F.col(f"`{c}`") for c in stream.columns]
    marked = stream.withColumns({
        "_arrived": F.current_timestamp(), "_k1": F.xxhash64(F.to_json(F.struct(*columns))),
        "_k2": F.xxhash64(F.lit("second"), F.to_json(F.struct(*columns))),
    })
    return marked.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_k1", "_k2"]).drop("_arrived", "_k1", "_k2")


def _start(stream: DataFrame, apply, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_stream(
    stream: DataFrame,
    store: KeyedTable,
    source: str,
    checkpoint: str,
    as_of: Column | None = None,
    available_now: bool = True,
    within: str | None = None,
    report: Callable[[int, IngestCounts], None] | None = None,
    **junk_options,
) -> StreamingQuery:
    """Clean arriving listings and upsert them.

    ``within`` drops in-flight repeats first (:func:`without_repeats`);
    ``report`` gets each batch's number and counts, observed while it is written.
    """
    now = F.current_timestamp() if as_of is None else as_of
    arriving = stream if within is None else without_repeats(stream, within)

    def apply(batch: DataFrame, batch_id: int) -> None:
        counts = ingest_listings(store, batch, source, now, **junk_options)
        if report is not None:
            report(batch_id, counts)

    return _start(arriving, apply, checkpoint, available_now)


def embed_stream(
    stream: DataFrame,
    store: KeyedTable,
    checkpoint: str,
    as_of: Column | None = None,
    available_now: bool = True,
    report: Callable[[int, EmbedCounts], None] | None = None,
    **options,
) -> StreamingQuery:
    """Chunk and embed arriving postings (job_id, description) that have no chunks yet.

    Of several arrivals of one id the newest by ``posted_at`` counts, where
    the stream has it, as it does for the stored postings; then the text.
    ``report`` gets each batch's number and counts.
    """
    now = F.current_timestamp() if as_of is None else as_of

    def apply(batch: DataFrame, batch_id: int) -> None:
        dated = ["posted_at"] if "posted_at" in batch.columns else []
        rows = batch.select("job_id", "description", *dated).filter(not_blank(F.col("description")))
        order = [*[F.desc_nulls_last(c) for c in dated], F.desc("description")]
        once = materialize(latest_per_key(rows, ["job_id"], order).select("job_id", "description"), "arrived")
        counts = embed_new(once, store, now, **options)
        if report is not None:
            report(batch_id, counts)

    return _start(stream, apply, checkpoint, available_now)


def command_stream(
    stream: DataFrame, store: KeyedTable, rejects: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Fold arriving save / update commands into the saved-jobs table.

    A replayed batch leaves the table as it is but may find fewer rejects,
    since its saves are in the table by then. Rejects are therefore written
    before the table and added to, never overwritten: a replay repeats some of
    them, and :func:`read_rejects` shows each once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        commands = materialize(batch, "commands")
        saved = store.read_for(commands)
        rejected_commands(saved, commands).write.mode("append").parquet(f"{rejects}/batch={batch_id}")
        folded = fold_commands(only_in(saved, commands, PAIR), commands)
        known = folded.filter(F.col("saved_job_id").isNotNull())
        new = assign_ids(
            folded.filter(F.col("saved_job_id").isNull()).drop("saved_job_id"), PAIR, "saved_job_id", after=store.read()
        )
        store.upsert(known.unionByName(new), ["stage", "updated_at"])

    return _start(stream, apply, checkpoint, available_now)


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """All rejected commands with the number of their batch, each once."""
    return spark.read.parquet(rejects).distinct()
