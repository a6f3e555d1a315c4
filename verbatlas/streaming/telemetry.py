"""Telemetry rollups and index upkeep, in batch and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbatlas.operators.lexical import build_index
from verbatlas.operators.term_index import TermIndex


def trace_rollup(spans: DataFrame, run: str = "run_id") -> DataFrame:
    """run, spans, started_at, duration, errors, names: a null duration counts 0, a failed span is kept."""
    return spans.groupBy(run).agg(F.count("*").alias("spans"), F.min("started_at").alias("started_at"), F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("duration_ms"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.array_sort(F.collect_set("name")).alias("names"))


def job_states(events: DataFrame, job: str, status: str, at: str, tie: str) -> DataFrame:
    """job, status, at of the latest event; ties by ``tie``."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.max(at).alias("at"))


def stream_rollup(stream: DataFrame, keys: list[str], time: str, window: str = "1 day", watermark: str = "2 days", value: Column | None = None) -> DataFrame:
    """The same rollup in tumbling windows; rows later than the watermark are dropped, state is kept for open windows only."""
    value = value if value is not None else F.lit(0.0)
    return (
        stream.withWatermark(time, watermark)
        .groupBy(F.window(time, window), *keys)
        .agg(F.count("*").alias("spans"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("window_start"), *keys, "spans", "total")
    )


def session_rollup(stream: DataFrame, key: str, time: str, gap: str = "6 hours", watermark: str = "2 days") -> DataFrame:
    """Runs of events with gaps under ``gap``."""
    return stream.withWatermark(time, watermark).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), key, "events")


def upkeep(stream: DataFrame, tokens: Column, path: str, checkpoint: str, doc_id: str = "doc_id") -> StreamingQuery:
    """Keeps postings and lengths of a feed of new documents under ``path``.

    Each micro-batch replaces its own partition (batch=id), so a batch that is run again after a
    failure writes the same rows once. Document frequencies are aggregates over the batches (``read_index``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lengths, postings = build_index(batch, tokens, doc_id)
        for name, frame in (("lengths", lengths), ("postings", postings)):
            frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lengths, postings, df) of an index that ``upkeep`` keeps."""
    lengths, postings = (spark.read.parquet(f"{path}/{n}").drop("batch") for n in ("lengths", "postings"))
    return lengths, postings, postings.groupBy("term").agg(F.count("*").alias("df"))


def keep_index(stream: DataFrame, tokens: Column, index: TermIndex, checkpoint: str, doc_id: str = "doc_id", kind: str = "text", compact_every: int = 0) -> StreamingQuery:
    """Adds a feed of new documents to a stored index, a part for each micro-batch; after every ``compact_every`` batches all parts are merged (0: never).

    A batch that is run again after a failure writes its part anew, or finds it merged already.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        index.add(batch_id, batch, tokens, doc_id, kind)
        if compact_every and (batch_id + 1) % compact_every == 0:
            index.compact()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
