"""The customer event job: one parse, then archive, dead letters, documents and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from featloom.functions.time import Instant, instant, interval
from featloom.plans import events as E
from featloom.schemas import EVENT_TTL
from featloom.sinks import tables as out

DOCUMENT_FIELDS = ("event_type", "event_timestamp", "app_name", "payload")


def event_documents(events: DataFrame, as_of: Instant = None) -> DataFrame:
    """`event:{id}` documents with one day to live."""
    return events.select(
        F.concat(F.lit("event:"), F.col("event_id")).alias("doc_key"),
        F.to_json(F.struct(*DOCUMENT_FIELDS), {"ignoreNullFields": "false"}).alias("doc"),
        (instant(as_of) + interval(EVENT_TTL, "second")).alias("expires_at"))


def start_routed(parsed: DataFrame, out_dir: str, checkpoint_dir: str, as_of: Instant = None,
                 **trigger) -> StreamingQuery:
    """Archive, dead letters and documents of each micro-batch from one read of it."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good = E.valid(batch)
            out.write_batch(E.archive(good), batch_id, f"{out_dir}/archive")
            out.write_batch(E.dead_letters(batch), batch_id, f"{out_dir}/dead_letter")
            out.write_batch(event_documents(good, as_of), batch_id, f"{out_dir}/documents")
        finally:
            batch.unpersist()
    return out.start(parsed, handle, f"{checkpoint_dir}/routed", "append", **trigger)


def start_counts(parsed: DataFrame, out_dir: str, checkpoint_dir: str, watermark: str = "5 minutes",
                 **trigger) -> dict[str, StreamingQuery]:
    """Running counts by type and app, and windowed counts, each with its own checkpoint.

    Only the windowed counts drop events older than the watermark.
    """
    good = E.valid(parsed)
    frames = {
        "by_type": E.counts_by(good, "event_type"),
        "by_app": E.counts_by(good, "app_name"),
        "over_time": E.counts_over_time(good, watermark=watermark),
    }
    return {name: out.upsert_stream(df, f"{out_dir}/{name}", f"{checkpoint_dir}/{name}", **trigger)
            for name, df in frames.items()}


KEYS = {
    "by_type": ["event_type"], "by_app": ["app_name"],
    "over_time": ["window_start", "window_end", "event_type"], "documents": ["doc_key"],
}


def run(spark: SparkSession, records: DataFrame, out_dir: str, checkpoint_dir: str, strict: bool = False,
        as_of: Instant = None, wait: bool = True, **trigger) -> dict[str, StreamingQuery]:
    """Start every output of the job; with `wait`, block until one of them ends."""
    parsed = E.parse(records, strict)
    queries = {"routed": start_routed(parsed, out_dir, checkpoint_dir, as_of, **trigger)}
    queries.update(start_counts(parsed, out_dir, checkpoint_dir, **trigger))
    if wait:
        spark.streams.awaitAnyTermination()
    return queries


def lag(query: StreamingQuery) -> dict[str, str]:
    """How far the sources of a running query are behind, as its last progress reports it."""
    progress = query.lastProgress
    return {} if progress is None else {
        s["description"]: (s.get("metrics") or {}).get("maxOffsetsBehindLatest", "0")
        for s in progress["sources"]}
