"""Session sequences of a stream against those of a table, with late, repeated and disordered events."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from walkloom import streaming

NOON = datetime(2024, 1, 1, 12)
KINDS = ["signup", "purchase", "error", "view", "click"]


def rows_of(df):
    return sorted((r["user_id"], str(r["start"]), str(r["end"]), tuple(r["tokens"])) for r in df.collect())


def test_stream_equals_table(spark, tmp_path):
    """Events in files, each within an hour of the time when it comes, some twice; one is later than the watermark and is left out."""
    rng = random.Random(5)
    events = [(k, NOON + timedelta(minutes=rng.randrange(60 * 40)), rng.randrange(6), rng.choice(KINDS), 1.0, "{}") for k in range(400)]
    last = max(e[1] for e in events)
    events.append((900, last + timedelta(hours=30), 99, "view", 0.0, "{}"))  # moves the watermark past all others
    arrivals = sorted([(e[1] + timedelta(minutes=rng.randrange(60)), e) for e in events] + [(e[1] + timedelta(minutes=50), e) for e in events[::9]], key=lambda x: x[0])
    step = len(arrivals) // 6 + 1
    for k in range(6):
        part = [e for _, e in arrivals[k * step : (k + 1) * step]]
        if k == 4:
            part.append((901, NOON - timedelta(hours=9), 1, "click", 0.0, "{}"))  # too late
        spark.createDataFrame(part, streaming.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streaming.read(spark, f"{tmp_path}/in", streaming.EVENTS, files=1)
    got = rows_of(streaming.written(streaming.session_sequences(stream), f"{tmp_path}/out"))
    table = streaming.session_sequences_of(spark.createDataFrame(events, streaming.EVENTS).filter("event_id < 900"))
    assert got == rows_of(table) and len(got) > 50


def test_state_goes(spark, tmp_path):
    """Of closed sessions nothing stays in the state."""
    events = [(k, NOON + timedelta(hours=5 * k), k % 3, "click", 1.0, "{}") for k in range(30)]
    for k in range(3):
        spark.createDataFrame(events[k::3] if k < 2 else events[2::3], streaming.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = streaming.session_sequences(streaming.read(spark, f"{tmp_path}/in", streaming.EVENTS, files=3)).writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    state = [o for p in q.recentProgress for o in p["stateOperators"]]
    assert state[-1]["numRowsTotal"] < 10


def test_cut():
    assert streaming.cut_sessions([], 3) == [] and streaming.cut_sessions([(0,), (2,), (5,), (7,)], 3) == [[(0,), (2,)], [(5,), (7,)]]


def test_table_form(spark):
    events = [(1, NOON, 1, "view"), (1, NOON, 1, "view"), (2, NOON + timedelta(minutes=29), 1, "click"), (3, NOON + timedelta(minutes=59), 1, "error")]
    got = streaming.session_sequences_of(spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string"))
    assert [list(r["tokens"]) for r in got.orderBy("start").collect()] == [[4, 0], [1]]
    assert got.filter(F.col("end") == F.lit(NOON + timedelta(minutes=59))).count() == 1
