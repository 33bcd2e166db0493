"""Streaming forms of the incremental and stateful operators. Sources are unbounded frames; sinks keep checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", ts: str = "ts") -> DataFrame:
    """The events table as a stream, its time as a timestamp that watermarks accept."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return s.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return _windowed(events, F.window(ts, size), late, ts)


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return _windowed(events, F.window(ts, size, step), late, ts)


def _windowed(events: DataFrame, window, late: str, ts: str) -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def incremental_index(stream: DataFrame, target: Callable[[], DataFrame | None], append: Callable[[DataFrame], None], key: str, build: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Indexes each batch once: rows whose key the target has already are skipped, so that a repeated batch changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        have = target()
        fresh = df.dropDuplicates([key])
        if have is not None:
            fresh = fresh.join(have.select(key), key, "left_anti")
        append(build(fresh))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CALL = "stream_id string, call_index long, id string, name string, arguments string"
_STATE = "payload string"


def fold_call_stream(deltas: DataFrame) -> DataFrame:
    """Consolidated tool calls of delta streams: (stream_id, seq, call_index, id, name, arguments, finish_reason).

    State holds the open calls of a stream; when ``tool_calls`` finishes it they are emitted once and the state ends.
    Deltas that come after that open a new round.
    """
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls = json.loads(state.get[0]) if state.exists else {}
        rows = []
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples():
                if r.call_index == r.call_index and r.call_index is not None:
                    c = calls.setdefault(str(int(r.call_index)), {"id": None, "name": None, "arguments": ""})
                    c["id"] = c["id"] or r.id
                    c["name"] = c["name"] or r.name
                    c["arguments"] += r.arguments or ""
                if r.finish_reason == "tool_calls":
                    rows += [(key[0], int(i), c["id"], c["name"], c["arguments"]) for i, c in sorted(calls.items(), key=lambda x: int(x[0]))]
                    calls = {}
        if calls:
            state.update((json.dumps(calls),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["stream_id", "call_index", "id", "name", "arguments"])

    return deltas.groupBy("stream_id").applyInPandasWithState(step, CALL, _STATE, "append", GroupStateTimeout.NoTimeout)


def accept_chunks(chunks: DataFrame) -> DataFrame:
    """Upload chunks as they come: (upload_id, chunk_offset, accepted, uploaded_size, status).

    A chunk is accepted only if it starts where the upload stands; an upload is complete at its total size.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = []
        for pdf in batches:
            for r in pdf.sort_values(["seq"]).itertuples():
                ok = r.chunk_offset == at
                at += r.chunk_size if ok else 0
                rows.append((key[0], r.chunk_offset, ok, at, "COMPLETED" if at >= r.total_size else "IN_PROGRESS"))
        state.update((at,))
        yield pd.DataFrame(rows, columns=["upload_id", "chunk_offset", "accepted", "uploaded_size", "status"])

    return chunks.groupBy("upload_id").applyInPandasWithState(step, "upload_id string, chunk_offset long, accepted boolean, uploaded_size long, status string", "at long", "append", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives its output; for tests and backfills of bounded size."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
