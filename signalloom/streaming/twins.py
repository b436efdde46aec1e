"""Streaming forms of the windowed and sessionised operators.

Every function takes a streaming DataFrame with an event-time column and gives
back a streaming DataFrame; on a batch DataFrame the same calls give the batch
answer (except the stateful sequences, which have the batch twin
``operators.sequences.sequences``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalloom.operators.ordered import CHUNK, with_halo

KEYS = ["subject_id", "edf_id"]


def _late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def sliding_features(
    samples: DataFrame,
    ts: str = "ts",
    value: str = "v",
    length: str = "4 seconds",
    step: str = "2 seconds",
    delay: str | None = "1 minute",
    expected: int | None = None,
) -> DataFrame:
    """Statistics of overlapping event-time windows; ``expected`` drops partial ones."""
    table = _late(samples, ts, delay).groupBy(*KEYS, F.window(ts, length, step).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(F.col(value) * F.col(value)).alias("power"),
    )
    table = table if expected is None else table.where(F.col("n") == expected)
    return table.select(*KEYS, *_edges("w"), "n", "mean", "min", "max", "power")


def _edges(window: str) -> list[Column]:
    return [
        (F.unix_micros(F.col(f"{window}.start")) / 1e6).alias("start_sec"),
        (F.unix_micros(F.col(f"{window}.end")) / 1e6).alias("end_sec"),
    ]


def alarm_rate(
    predictions: DataFrame, ts: str = "ts", length: str = "1 hour", delay: str | None = "10 minutes"
) -> DataFrame:
    """Positive windows and all windows per tumbling hour and subject."""
    table = _late(predictions, ts, delay).groupBy("subject_id", F.window(ts, length).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_pred").cast("long")).alias("alarms")
    )
    return table.select("subject_id", *_edges("w"), "n", "alarms")


RATE = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("start_sec", T.DoubleType()),
        T.StructField("end_sec", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("alarms", T.LongType()),
        T.StructField("late", T.BooleanType()),
    ]
)


class WindowTotals(StatefulProcessor):
    """Totals of one window of a subject, given out when the watermark reaches its end.

    Rows that arrive after that come out as totals of their own, marked as late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", T.StructType([T.StructField("n", T.LongType()), T.StructField("alarms", T.LongType())]))

    def _row(self, key, n: int, alarms: int, late: bool) -> pd.DataFrame:
        subject, start, end = key
        return pd.DataFrame([(subject, start / 1e3, end / 1e3, n, alarms, late)], columns=RATE.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = alarms = 0
        for frame in rows:
            n += len(frame)
            alarms += int(frame["y_pred"].sum())
        if self.totals.exists():
            held = self.totals.get()
            self.totals.update((held[0] + n, held[1] + alarms))
        elif key[2] <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, n, alarms, True)
        else:
            self.totals.update((n, alarms))
            self.handle.registerTimer(key[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, alarms = self.totals.get()
        self.totals.clear()
        yield self._row(key, n, alarms, False)

    def close(self) -> None:
        pass


def alarm_rate_with_late(predictions: DataFrame, ts: str = "ts", length_sec: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """:func:`alarm_rate` that loses no row: late ones are returned as rows of their window with ``late`` set.

    A window comes out once when the watermark has reached its end, and once more for each batch with late rows of it.
    Needs the RocksDB state store (``STATE_STORE`` below) on the session.
    """
    length = length_sec * 1000
    start = F.floor(F.unix_millis(ts) / F.lit(length)).cast("long") * length
    # without the time column itself, by which Spark would drop late rows before the state sees them
    slim = predictions.withWatermark(ts, delay).select(
        "subject_id", start.alias("start_ms"), (start + length).alias("end_ms"), F.coalesce(F.col("y_pred").cast("long"), F.lit(0)).alias("y_pred")
    )
    return slim.groupBy("subject_id", "start_ms", "end_ms").transformWithStateInPandas(
        WindowTotals(), outputStructType=RATE, outputMode="Append", timeMode="EventTime"
    )


def alarm_sessions(
    predictions: DataFrame,
    ts: str = "ts",
    gap: str = "4 seconds",
    length_sec: float = 4.0,
    delay: str | None = "1 minute",
) -> DataFrame:
    """Sessions of positive windows by their starts.

    Starts exactly one gap apart share a session. A session window ends a gap
    after its last start, so the event ends ``length_sec`` after that start.
    """
    positives = _late(predictions, ts, delay).where(F.col("y_pred") == 1)
    table = positives.groupBy(*KEYS, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_positive_windows"),
        F.min(F.unix_micros(ts)).alias("_first"),
        F.max(F.unix_micros(ts)).alias("_last"),
    )
    return table.select(
        *KEYS,
        (F.col("_first") / 1e6).alias("start_sec"),
        (F.col("_last") / 1e6 + length_sec).alias("end_sec"),
        (F.col("_first") / 1e6 + length_sec).alias("detection_sec"),
        "n_positive_windows",
    )


SEQUENCE = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("edf_id", T.StringType()),
        T.StructField("start_index", T.LongType()),
        T.StructField("target_index", T.LongType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
        T.StructField("late", T.BooleanType()),
    ]
)


class LastWindows(StatefulProcessor):
    """Holds the windows of one chunk of a recording that a sequence may still need.

    A window is held until ``length - 1`` newer ones and ``slack`` further places
    have passed, so windows may arrive out of order by ``slack`` places; arrivals older
    than that when their batch begins come out marked as late. When the watermark is ``hold_ms`` past the
    newest time of a chunk, its whole state is cleared.

    The windows of a chunk are one value, read and written once a batch. Its timer stays where it was first set
    and is moved on only when it expires before the chunk does.
    """

    def __init__(self, length: int, size: int, slack: int, hold_ms: int):
        self.length, self.size, self.slack, self.hold_ms = length, size, slack, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        newest = T.StructType([T.StructField("index", T.LongType()), T.StructField("until", T.LongType())])
        self.newest = handle.getValueState("newest", newest)
        arrays = [("indices", T.ArrayType(T.LongType())), ("values", T.ArrayType(T.DoubleType()))]
        self.held = handle.getValueState("held", T.StructType([T.StructField(name, kind) for name, kind in arrays]))

    def _sequences(self, index: np.ndarray, value: np.ndarray, new: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and values of the sequences of this chunk that hold a new window; ``index`` ascends."""
        if len(index) < self.length:
            return np.zeros(0, np.int64), np.zeros((0, self.length))
        last = index[self.length - 1 :]
        arrived = np.concatenate([[0], np.cumsum(new)])
        whole = (last - index[: len(last)] == self.length - 1) & (arrived[self.length :] > arrived[: len(last)])
        at = np.flatnonzero(whole & (last // self.size == chunk))
        return index[at], np.lib.stride_tricks.sliding_window_view(value, self.length)[at]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        subject, recording, chunk = key
        state = self.newest.get()
        newest, until = state if state else (-1, 0)
        both = self.held.get() if state else ([], [])
        held_at, held = np.array(both[0], dtype=np.int64), np.array(both[1], dtype=float)
        arrays = [(f["window_index"].to_numpy(np.int64), f["value"].to_numpy(float), int(f["ms"].max())) for f in rows]
        at, value = (np.concatenate([a[k] for a in arrays]) for k in (0, 1))
        if not state:
            self.handle.registerTimer(max(a[2] for a in arrays) + self.hold_ms)
        until = max(until, *(a[2] + self.hold_ms for a in arrays))
        known = np.isin(at, held_at)
        old = ~known & (at <= newest - self.length - self.slack)
        late = at[old & (at // self.size == chunk)]  # the others are copies from the border of another chunk
        fresh_at, first = np.unique(at[~known & ~old], return_index=True)
        fresh = value[~known & ~old][first]
        order = np.argsort(np.concatenate([held_at, fresh_at]))
        every_at, every = np.concatenate([held_at, fresh_at])[order], np.concatenate([held, fresh])[order]
        starts, values = self._sequences(every_at, every, order >= len(held_at), chunk)
        newest = max([newest, *fresh_at[-1:].tolist()])
        stays = every_at > newest - self.length - self.slack
        self.newest.update((newest, until))
        self.held.update((every_at[stays].tolist(), every[stays].tolist()))
        n = len(starts) + len(late)
        if n:
            # columns, not rows: a frame of rows takes longer to build than all of the above
            out = {
                "subject_id": [subject] * n,
                "edf_id": [recording] * n,
                "start_index": pd.array([*starts.tolist(), *[None] * len(late)], dtype="Int64") if len(late) else starts,
                "target_index": np.concatenate([starts + self.length - 1, late]),
                "values": [*values, *[None] * len(late)],
                "late": np.arange(n) >= len(starts),
            }
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.newest.get()[1]
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
        else:
            self.newest.clear()
            self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def causal_sequences(
    windows: DataFrame,
    length: int,
    value: str,
    slack: int = 256,
    size: int = 4096,
    ts: str = "ts",
    delay: str = "1 hour",
    hold_sec: int = 86_400,
) -> DataFrame:
    """Sequences of ``length`` consecutive windows as their last window arrives.

    State is kept per chunk of ``size`` windows of a recording; the last windows
    of a chunk are also sent to the next one. A backlog of one long recording is
    therefore worked off by many tasks. A chunk holds at most ``length + slack``
    windows and is cleared ``hold_sec`` of event time after its last window, so a
    recording may pause for that long. Windows that come later than the slack allows
    are returned with ``late`` set and no values. Needs the RocksDB state store
    (``STATE_STORE`` below) on the session.
    """
    slim = windows.withWatermark(ts, delay).select(
        *KEYS, F.col("window_index").cast("long"), F.col(value).cast("double").alias("value"), ts, F.unix_millis(ts).alias("ms")
    )
    spread = with_halo(slim, "window_index", max(size, length), behind=length - 1)
    return spread.groupBy(*KEYS, CHUNK).transformWithStateInPandas(
        LastWindows(length, max(size, length), slack, hold_sec * 1000),
        outputStructType=SEQUENCE,
        outputMode="Append",
        timeMode="EventTime",
    )


STATE_STORE: Sequence[tuple[str, str]] = (
    (
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    ),
)
