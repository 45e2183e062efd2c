"""Scheduled incremental runs as availableNow streams over bucketed key state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.keyed import keep_first, unseen, upsert_seen
from postmill.state import BucketedTable


def run_seen_stream(
    stream: DataFrame,
    table: BucketedTable,
    keys: Sequence[str],
    seen_at: Callable[[], Column],
    ordinal: str,
    checkpoint: str,
    attributes: Sequence[str] = (),
    on_new: Callable[[DataFrame, int], None] | None = None,
    keep: int | None = None,
) -> None:
    """Take everything available, then stop. Each batch hands on its unseen keys and moves the state.

    A batch reads and rewrites only the buckets of its keys. It starts from the newest version, whoever
    wrote it, and its own version carries the stream's id and the batch's number. A batch that is run again after its version stood is passed
    over; one that failed before that starts from the same newest version again. So streams with
    checkpoints of their own can follow each other on one state. `keep` bounds the versions kept.
    """

    def apply(batch: DataFrame, number: int) -> None:
        stream_id = table.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        mark = f"{stream_id}-{number}"
        if table.marked(mark):
            return
        taken = batch.persist()
        if on_new:
            first = keep_first(taken, keys, ordinal)
            on_new(unseen(first, table.read_for(taken), keys), number)
        table.merge(taken, lambda held, new: upsert_seen(held, new, keys, seen_at(), ordinal, attributes), mark=mark, keep=keep)
        taken.unpersist()

    query = (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def first_in_stream(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """In-flight dedup with bounded state: repeats within `delay` of each other are dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def backfill_or_head(listings: DataFrame, state_empty: bool, posted_at: str, now: Column, months: int = 12) -> DataFrame:
    """First run: everything of the last months; later runs: the first listing page only."""
    if state_empty:
        since = now - F.make_interval(days=F.lit(months * 30))
        return listings.filter(F.col(posted_at).isNull() | (F.col(posted_at) >= since))
    return listings.filter(F.col("page") == 0)


def retryable(state: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Keys that count as seen; failed ones come back unless `retry_failed` is off."""
    return state.filter(~F.coalesce("summary_status", F.lit("")).endswith("_error")) if retry_failed else state
