"""Streams: changes of a source folder, and the events table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.history import AUTO_END


def watch_sources(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame], None], suffix: str = "*.py") -> StreamingQuery:
    """Hand new source files (path, content, file_hash) to apply, batch by batch, and stop when none are left."""
    schema = StructType.fromDDL("path string, modificationTime timestamp, length long, content binary")
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(folder)
    found = raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("file_hash"))
    return found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: apply(df)).start()


def read_events(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and their value per type and window, with a watermark for late ones."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with gaps below ``gap``."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# -- state by key -----------------------------------------------------------------------------------------------------------

CHANGES = "rel_path string, change_type string, old_hash string, new_hash string, at timestamp"


def source_changes(listings: DataFrame, gone_after_ms: int, late: str = "0 seconds") -> DataFrame:
    """CHANGES of a stream of listings (rel_path, file_hash, at) of a source tree: added, modified and deleted files.

    The state of a path is its last hash.  A path is deleted if it is not listed again within ``gone_after_ms`` of event time,
    which a later listing moves on; so choose less than the time between listings.
    """

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        if state.hasTimedOut:
            at = pd.Timestamp(state.get[1], unit="ms")
            state.remove()
            yield pd.DataFrame([(key[0], "deleted", known, None, at)], columns=["rel_path", "change_type", "old_hash", "new_hash", "at"])
            return
        out, last = [], state.get[1] if state.exists else 0
        for row in pd.concat(list(parts)).sort_values("at").itertuples():
            if known != row.file_hash:
                out.append((key[0], "added" if known is None else "modified", known, row.file_hash, row.at))
            known, last = row.file_hash, max(last, int(row.at.value // 1_000_000))
        state.update((known, last))
        state.setTimeoutTimestamp(max(last + gone_after_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["rel_path", "change_type", "old_hash", "new_hash", "at"])

    timed = listings.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("rel_path").applyInPandasWithState(step, CHANGES, "file_hash string, at long", "append", GroupStateTimeout.EventTimeTimeout)


SESSIONS = "project string, session_id long, started_at timestamp, ended_at timestamp, summary string"


def closed_sessions(events: DataFrame, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """SESSIONS of a stream of session events (project, session_id, event start or end, at, summary), as they end.

    A project has one open session at most, which is its state: a session ends by its own end, when the next one starts, or
    ``idle_ms`` of event time after its start, the last two with a fixed summary.
    """

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ms = lambda t: int(t.value // 1_000_000)
        when = lambda t: pd.Timestamp(t, unit="ms")
        opened, out = (state.get if state.exists else None), []
        if state.hasTimedOut:
            out, opened = [(key[0], opened[0], when(opened[1]), when(opened[1] + idle_ms), AUTO_END)], None
        else:
            # An end comes before a start at the same time, so that a session can follow at once.
            for row in pd.concat(list(parts)).sort_values(["at", "event", "session_id"]).itertuples():
                if row.event == "start":
                    if opened:
                        out.append((key[0], opened[0], when(opened[1]), when(min(ms(row.at), opened[1] + idle_ms)), AUTO_END))
                    opened = (int(row.session_id), ms(row.at))
                elif opened and opened[0] == row.session_id:
                    out.append((key[0], opened[0], when(opened[1]), row.at, row.summary))
                    opened = None
        if opened:
            state.update(opened)
            state.setTimeoutTimestamp(max(opened[1] + idle_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["project", "session_id", "started_at", "ended_at", "summary"])

    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("project").applyInPandasWithState(step, SESSIONS, "session_id long, started long", "append", GroupStateTimeout.EventTimeTimeout)
