"""Streams: the stateless and counting operators over unbounded tables, windows over events, and sequences by user with state and timers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total by window; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n by session."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counts(tokens: DataFrame, *columns: str) -> DataFrame:
    """Running counts, as of triplets or of a vocabulary."""
    return tokens.groupBy(*columns).agg(F.count("*").alias("cnt"))


def finished(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """What a stream gives over all that is there now. Its state is kept under path."""
    spark = stream.sparkSession
    name = "s" + str(abs(hash(path)))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


SESSIONS = "user_id bigint, start timestamp, end timestamp, tokens array<int>"


class _Sessions(StatefulProcessor):
    """Of one user, the events that no closed session has: by event_id, so that repeated ones count once.

    A session is closed when the watermark is a gap beyond its last event: then no event can join it. It is given out and its events go
    from the state, which so holds what is newer than the watermark, and one open session. An event-time timer wakes the user for it.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event_id bigint", "at bigint, token int")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for event, at, token in zip(part["event_id"].tolist(), part["ms"].tolist(), part["token"].tolist()):
                if at >= mark:  # a later one is of a session that may be closed
                    self.events.updateValue((event,), (at, token))
        yield from self._closed(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._closed(key, timerValues.getCurrentWatermarkInMs())

    def _closed(self, key, mark: int):
        held = sorted((at, event, token) for (event,), (at, token) in self.events.iterator())
        out = []
        for x in cut_sessions(held, self.gap):
            if x[-1][0] + self.gap <= mark:
                out.append((key[0], pd.Timestamp(x[0][0], unit="ms"), pd.Timestamp(x[-1][0] + self.gap, unit="ms"), [t for *_, t in x]))
                for _, event, _ in x:
                    self.events.removeKey((event,))
            else:
                self.handle.registerTimer(x[-1][0] + self.gap)
                break
        if out:
            yield pd.DataFrame(out, columns=["user_id", "start", "end", "tokens"])

    def close(self) -> None:
        pass


def cut_sessions(events: list[tuple], gap: int) -> list[list[tuple]]:
    """Sorted events (at, ...) in runs whose neighbours are less than a gap apart."""
    out: list[list[tuple]] = []
    for e in events:
        if out and e[0] - out[-1][-1][0] < gap:
            out[-1].append(e)
        else:
            out.append([e])
    return out


def session_sequences(events: DataFrame, gap_minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """user_id, start, end, tokens of a stream of events (event_id, ts, user_id, event_type): each closed session's event codes in order of (ts, event_id)."""
    from walkloom.sources.views import EVENT_CODES

    code = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])
    rows = events.select("event_id", "ts", "user_id", F.unix_millis("ts").alias("ms"), F.element_at(code, F.col("event_type")).alias("token")).withWatermark("ts", late)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("user_id").transformWithStateInPandas(_Sessions(gap_minutes * 60_000), SESSIONS, "Append", "EventTime")


def session_sequences_of(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """As session_sequences, of a table of events, with the sessions that are still open at its end."""
    from walkloom.sources.views import EVENT_CODES

    code = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])
    x = events.dropDuplicates(["event_id"]).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.element_at(code, F.col("event_type")).alias("token"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce((F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w)) >= gap_minutes * 60_000).cast("int"), F.lit(1))
    x = x.withColumn("_fresh", fresh).withColumn("_k", F.sum("_fresh").over(w))
    g = x.groupBy("user_id", "_k").agg(F.min("ts").alias("start"), (F.max("ts") + F.expr(f"interval {gap_minutes} minutes")).alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "token"))), lambda e: e["token"]).alias("tokens"))
    return g.drop("_k")


def written(stream: DataFrame, path: str) -> DataFrame:
    """What a stream gives over all that is there now, as a table under path, where its state is kept too."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
