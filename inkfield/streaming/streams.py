"""Structured Streaming: incremental scoring, best so far, line-wise re-chunking, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkfield.functions.similarity import difficulty


def scored_stream(shards: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Shard rows with their combined score, the first of each key that arrives. With an event time, keys are forgotten once the
    watermark passes them, which bounds the state."""
    if event_time:
        shards = shards.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
        first = shards.dropDuplicatesWithinWatermark(keys)
    else:
        first = shards.dropDuplicates(keys)
    return first.withColumn("combined_score", difficulty(F.col("image_similarity"), F.col("code_similarity")))


def append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to a Parquet folder; a restart goes on behind what its checkpoint holds."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def best_so_far(candidates: DataFrame, item: str, score: str, candidate: str) -> DataFrame:
    """The best candidate of each item up to now (update or complete mode); a tie keeps the lower candidate."""
    return candidates.groupBy(item).agg(F.max(score).alias("best"), F.max_by(candidate, F.struct(F.col(score), -F.col(candidate))).alias("candidate"), F.count(F.lit(1)).alias("seen"))


def fan_out(stream: DataFrame, sinks: list, checkpoint: str) -> StreamingQuery:
    """Every micro-batch to several sinks, each a function of (batch, id)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, batch_id)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rechunk_lines(tokens: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """(key, line, last) of token streams: each line when its line feed arrives. The open rest of a key is its state; a token
    that is null ends the stream and flushes the rest."""
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for piece in rows[token]:
            if piece is None or pd.isna(piece):
                if held:
                    out.append((held, True))
                held = ""
                continue
            held += piece
            *whole, held = held.split("\n")
            out += [(line + "\n", False) for line in whole]
        if held:
            state.update((held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(out), "line": [x for x, _ in out], "last": [y for _, y in out]})

    kind = dict(tokens.dtypes)[key]
    return tokens.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, line string, last boolean", "rest string", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, time: str, width: str, by: str, value: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and sum per (sliding) window and group; late rows count until the watermark passes the window."""
    seen = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    out = seen.groupBy(F.window(time, width, slide), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of each group: events no further than `gap` apart."""
    seen = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    out = seen.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
