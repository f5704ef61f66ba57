"""The stateless operators on streams, and the rate limiter with a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import from_files
from ..operators.actions import detect
from ..sources import rule_files


def score_stream(docs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``detect`` on a stream: no state."""
    return detect(docs, threshold=threshold)


def score_with_files(docs: DataFrame, folders: list[str], languages: list[str], write: Callable[[DataFrame, int], None], text: str = "text", threshold: float = 0.3) -> DataStreamWriter:
    """A writer that judges each micro-batch by the rule files as they are then, and hands it to ``write`` (rows, number)."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rules = from_files(spark, rule_files.load(spark, folders, languages), languages)
        write(detect(rows, text, threshold, rules=rules), number)

    return docs.writeStream.foreachBatch(batch)


def window_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 10, seconds: int = 60) -> DataFrame:
    """(window_start, key, requests, allowed): per aligned window; state is kept for two windows, later rows are dropped."""
    late = events.withWatermark(ts, f"{2 * seconds} seconds")
    counts = late.groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(F.col("window.start").alias("window_start"), key, "requests", F.least("requests", F.lit(limit)).alias("allowed"))


def rate_limited_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", event: str = "event_id", limit: int = 10, seconds: int = 60, delay: int | None = None) -> DataFrame:
    """(event, key, window_start, allowed, remaining, reset_at) of every event: the first ``limit`` of a key in each aligned window pass,
    in the order of their times, then of ``event``, however they arrive.

    A window is judged once the watermark (``delay`` seconds, two windows unless given) is past its end; until then its events are
    held as state, of a key that floods a window the earliest only: beyond ``limit`` an event is refused at
    once if ``limit`` earlier ones are held, so state is bounded by ``limit`` an open window. An event that is pushed out by an
    earlier one is refused then. Later events are dropped by the watermark.
    """
    start = (F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long")
    rows = events.withWatermark(ts, f"{2 * seconds if delay is None else delay} seconds").select(event, key, ts, start.alias("window_start"))

    def told(group: tuple, ids: list, place: list[int]) -> pd.DataFrame:
        left = [limit - p for p in place]
        return pd.DataFrame({event: ids, key: [group[0]] * len(ids), "window_start": [int(group[1])] * len(ids), "allowed": [x >= 0 for x in left], "remaining": [max(x, 0) for x in left], "reset_at": [int(group[1]) + seconds] * len(ids)})

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids = (list(x) for x in state.get) if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            yield told(group, ids, list(range(1, len(ids) + 1)))
            return
        new = pd.concat(list(frames))
        held = sorted([*zip(times, ids, strict=True), *zip(new[ts].astype("datetime64[us]").astype("int64").tolist(), new[event].tolist(), strict=True)])
        keep, refused = held[:limit], held[limit:]
        state.update(([t for t, _ in keep], [i for _, i in keep]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (int(group[1]) + seconds) * 1000))
        yield told(group, [i for _, i in refused], [limit + 1] * len(refused))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"`{event}` {kinds[event]}, `{key}` {kinds[key]}, window_start long, allowed boolean, remaining long, reset_at long"
    return rows.groupBy(key, "window_start").applyInPandasWithState(step, schema, f"times array<long>, ids array<{kinds[event]}>", "append", GroupStateTimeout.EventTimeTimeout)


def late_events(events: DataFrame, closed: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = 60) -> DataFrame:
    """(key, window_start, late): events per key and window that arrived after the window was judged; ``closed`` has (key, window_start,
    judged_at) of judged windows, ``events`` the time ``arrived`` beside ``ts``. A batch count, from the stored raw events."""
    start = (F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long")
    met = events.withColumn("window_start", start).join(closed, [key, "window_start"])
    return met.filter(F.col("arrived") > F.col("judged_at")).groupBy(key, "window_start").agg(F.count(F.lit(1)).alias("late"))
