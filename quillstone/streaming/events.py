"""Answer events as streams: folding deltas, resets and tool-argument parts, sessions and windows, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "request_id string, seq bigint, ts timestamp, type string, message string, query string, text string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of JSON-line events; ``files_per_trigger`` is its back-pressure."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (request_id, seq) once; state is dropped after the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id", "seq"])


def fold_answers(events: DataFrame) -> DataFrame:
    """(request_id, answer, done, n_events) of a table of events: the deltas after the last reset, in order of seq, each seq once."""
    e = events.dropDuplicates(["request_id", "seq"])
    w = Window.partitionBy("request_id")
    reset = F.coalesce(F.max(F.when(F.col("type") == "answer_reset", F.col("seq"))).over(w), F.lit(-1))
    e = e.withColumn("reset", reset)
    parts = F.sort_array(F.collect_list(F.when((F.col("type") == "answer_delta") & (F.col("seq") > F.col("reset")), F.struct("seq", "text"))))
    return e.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("answer"), F.max((F.col("type") == "done").cast("int")).alias("done"), F.count("*").alias("n_events"))


def stream_answers(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """The same fold as a stateful stream: (request_id, answer, done), a row per request and batch.

    ``events`` carries a watermark on ts and each (request_id, seq) once (see
    ``distinct_events``); a request's seq runs from 1 without gaps.  An answer is
    done when its ``done`` event and all before it are there, in whatever order
    they came, or when it is there and the watermark is ``idle`` past the
    request's last event; then its state ends.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    state = "reset bigint, seqs array<bigint>, texts array<string>, last bigint, n bigint"
    out = "request_id string, answer string, done int"
    ms = {"second": 1_000, "minute": 60_000, "hour": 3_600_000}
    amount, unit = idle.split()
    wait = int(amount) * ms[unit.rstrip("s")]

    def row(key: tuple, got: dict[int, str], done: bool) -> pd.DataFrame:
        return pd.DataFrame({"request_id": [key[0]], "answer": ["".join(t for _, t in sorted(got.items()))], "done": [int(done)]})

    def fold(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        reset, seqs, texts, last, n = st.get if st.exists else (-1, [], [], 0, 0)
        got = dict(zip(seqs, texts))
        if st.hasTimedOut:
            st.remove()
            if last:
                yield row(key, got, True)
            return
        seen = st.getCurrentWatermarkMs()
        for pdf in batches:
            at = pdf["ts"].max()
            seen = max(seen, int(at.timestamp() * 1000)) if at is not pd.NaT else seen
            n += len(pdf)
            for seq, kind, text in zip(pdf["seq"], pdf["type"], pdf["text"]):
                if kind == "answer_reset":
                    reset = max(reset, int(seq))
                elif kind == "answer_delta":
                    got[int(seq)] = text or ""
                elif kind == "done":
                    last = int(seq)
        got = {s: t for s, t in got.items() if s > reset}
        done = 0 < last <= n
        if done:
            st.remove()
        else:
            st.update((reset, list(got), list(got.values()), last, n))
            st.setTimeoutTimestamp(seen + wait)
        yield row(key, got, done)

    return events.groupBy("request_id").applyInPandasWithState(fold, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def idle_gaps(events: DataFrame, every: str = "1 second", by: str = "request_id") -> DataFrame:
    """(by, ts, heartbeats): events of a table after which nothing came for ``every`` or longer, and how many heartbeats fill the gap."""
    w = Window.partitionBy(by).orderBy("ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.lead(at).over(w) - at
    amount, unit = every.split()
    step = int(amount) * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.rstrip("s")] * 1_000_000
    # a heartbeat is due at every whole step before the next event
    return events.select(by, "ts", F.floor((gap - 1) / F.lit(step)).alias("heartbeats")).where("heartbeats > 0")


def with_heartbeats(events: DataFrame, idle_ms: int = 1_000) -> DataFrame:
    """A stream's events, and a ``heartbeat`` whenever a request that isn't finished has been silent for ``idle_ms`` of processing time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def beat(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        if st.hasTimedOut:
            st.setTimeoutDuration(idle_ms)
            yield pd.DataFrame({"request_id": [key[0]], "seq": [None], "type": ["heartbeat"], "text": [None]}).astype({"seq": "Int64"})
            return
        over = False
        for pdf in batches:
            over |= bool(pdf["type"].isin(["done", "error"]).any())
            yield pdf[["request_id", "seq", "type", "text"]].astype({"seq": "Int64"})
        if over:
            if st.exists:
                st.remove()
        else:
            st.update((1,))
            st.setTimeoutDuration(idle_ms)

    return events.groupBy("request_id").applyInPandasWithState(beat, "request_id string, seq bigint, type string, text string", "open int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tool_arguments(parts: DataFrame) -> DataFrame:
    """(request_id, call_index, arguments, complete): streamed argument parts joined by seq; complete once a finish event is there."""
    got = F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("seq", "part"))))
    return parts.groupBy("request_id", "call_index").agg(F.array_join(F.transform(got, lambda x: x["part"]), "").alias("arguments"), F.max(F.coalesce("finished", F.lit(False))).alias("complete"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None, by: str = "event_type") -> DataFrame:
    """(start, by, n, total) per window; with ``late`` also on a stream."""
    e = events if late is None else events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, by: str = "user_id") -> DataFrame:
    """(by, start, end, n): runs of events no more than ``gap`` apart; ``end`` is the last event plus the gap."""
    e = events if late is None else events.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_once(path: str, key: str = "request_id"):
    """A ``foreachBatch`` function that appends finished rows once, also when a batch is replayed: each batch has its own folder, overwritten on replay."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.where("done = 1").dropDuplicates([key]).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write
