"""Structured Streaming over event and order streams; no counterpart exists in batch-only customer analytics.

Windowed counts with a watermark, exactly-once event deduplication, and customer movement (New,
Lapsed, Reactivated) as a stateful operator. Batch and stream give the same rows for the same input.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.config import DEFAULT, Config
from tidemark.sources.storage import new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 100, pattern: str = "*.parquet") -> DataFrame:
    """Event files of a folder, those whose names fit the pattern, as a stream, with event time as a timestamp."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_of(kind: str, size: str = "1 day", slide: str = "6 hours", gap: str = "30 minutes") -> Column:
    """A tumbling, sliding or session window over ts."""
    if kind == "tumbling":
        return F.window("ts", size)
    if kind == "sliding":
        return F.window("ts", size, slide)
    if kind == "session":
        return F.session_window("ts", gap)
    raise ValueError(f"no window kind {kind!r}")


def windowed_counts(events: DataFrame, kind: str = "tumbling", *, late: str = "1 day", **window: str) -> DataFrame:
    """Events and value by window and type; rows later than the watermark are left out of a stream.

    Works on a stream and on a table alike. Session windows are by user.
    """
    keys = ["event_type", *(["user_id"] if kind == "session" else [])]
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(window_of(kind, **window).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events", "value")


def distinct_events(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Each event_id once, for repeats that come within the watermark; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


MOVEMENT = "golden_customer_id long, event_type string, event_date date, change int"
#: Stands in for a customer in rows that only say how far time has moved.
MARK = -(1 << 63)
_STATE = "last date, gaps array<int>, lapsed date"
_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _median(gaps: list[int]) -> float:
    s, n = sorted(gaps), len(gaps)
    return (s[(n - 1) // 2] + s[n // 2]) / 2


class Movement(StatefulProcessor):
    """One customer's state: the last purchase day, the earlier gaps, and the lapse that was reported since; a timer for the day of the next lapse."""

    def __init__(self, floor: float, times: float) -> None:
        self.floor, self.times = floor, times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("customer", _STATE)

    def limit(self, gaps: list[int]) -> float | None:
        return self.times * max(self.floor, _median(gaps)) if len(gaps) >= 2 else None

    def timer(self, last: dt.date | None, gaps: list[int], lapsed: dt.date | None) -> int | None:
        """The start, in milliseconds, of the first day that is more than the limit after the last purchase."""
        most = self.limit(gaps)
        if last is None or lapsed is not None or most is None:
            return None
        day = last + dt.timedelta(days=math.floor(most) + 1)
        return int(dt.datetime.combine(day, dt.time(), dt.timezone.utc).timestamp() * 1000)

    def _known(self) -> tuple[dt.date | None, list[int], dt.date | None]:
        if not self.state.exists():
            return None, [], None
        last, gaps, lapsed = self.state.get()
        return last, list(gaps if gaps is not None else []), lapsed

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["golden_customer_id", "event_type", "event_date", "change"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days = sorted({d for part in rows for d in part["transaction_date"]})
        if key[0] == MARK:
            yield self._frame([])
            return
        out: list[tuple] = []
        last, gaps, lapsed = self._known()
        due = self.timer(last, gaps, lapsed)
        for day in days:
            if last is None:
                out.append((key[0], "New", day, 1))
            elif day <= last:
                continue
            else:
                gap, most = (day - last).days, self.limit(gaps)
                if most is not None and gap > most:
                    if lapsed is None:
                        out.append((key[0], "Lapsed", last + dt.timedelta(days=math.ceil(most)), -1))
                    out.append((key[0], "Reactivated", day, 1))
                gaps.append(gap)
            last, lapsed = day, None
        self.state.update((last, gaps, lapsed))
        now = self.timer(last, gaps, lapsed)
        if now != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if now is not None:
                self.handle.registerTimer(now)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, gaps, lapsed = self._known()
        most = self.limit(gaps)
        if last is None or lapsed is not None or most is None:
            return
        lapsed = last + dt.timedelta(days=math.ceil(most))
        self.state.update((last, gaps, lapsed))
        yield self._frame([(key[0], "Lapsed", lapsed, -1)])

    def close(self) -> None:
        pass


def movement_stream(days: DataFrame, cfg: Config = DEFAULT, *, late: str = "0 seconds") -> DataFrame:
    """New, Lapsed and Reactivated rows from a stream of (golden_customer_id, transaction_date), in date order by customer.

    A lapse is reported by a timer when its day has passed in event time, or with the purchase that
    ends it, whichever comes first, and only once. Purchases before the last seen day and rows without
    a customer are ignored. A row of the customer MARK stands for the noon of its day: time has moved
    that far, though nobody bought.
    """
    days.sparkSession.conf.set(*_STORE)  # timers and value states need it
    noon = F.when(F.col("golden_customer_id") == MARK, F.expr("interval 12 hours")).otherwise(F.expr("interval 0 hours"))
    timed = days.where("golden_customer_id is not null").withColumn("ts", F.col("transaction_date").cast("timestamp") + noon).withWatermark("ts", late)
    processor = Movement(float(cfg.min_expected_return_days), cfg.lapse_multiple)
    return timed.select("golden_customer_id", "transaction_date", "ts").groupBy("golden_customer_id").transformWithStateInPandas(processor, MOVEMENT, "Append", "EventTime")


def run_available(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Process all that a stream's source holds now and return what was written; the sink and its checkpoint are in the shared folder.

    A run that is cut off goes on from the checkpoint when it is started with the same paths.
    """
    spark = stream.sparkSession
    path = new_path(spark, f"stream-{name}")
    query: StreamingQuery = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
