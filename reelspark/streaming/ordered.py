"""Operators on streams that need rows in order: what has come is held until the watermark has passed it.

State is a buffer a key, sorted by event time, of the rows that may still get company and of those that
later ones look back at. An event-time timer wakes a key when its next row is settled, or when it has been
silent for so long that its sequence counts as ended; rows behind the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from reelspark.streaming.windows import event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands settled rows on in order of time and ``tie``, each once; subclasses say what is made of them."""

    def __init__(self, key: str, idle: int):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "t long, tie long, x double")
        self.done = handle.getValueState("done", "kept long, until long, n long, last double, best double")

    def settled(self, rows: np.ndarray, first: int, n: int, memory: tuple[float, float], ended: bool) -> tuple[pd.DataFrame, int, int, tuple[float, float]]:
        """(output, rows at the front that aren't needed any more, rows put out in all, memory).

        rows: in order; those from ``first`` on are new, ``n`` have been put out before them and those behind
        them that still are to be; ``ended``: no more will come.
        """
        raise NotImplementedError

    def _go(self, key: Any, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        kept, until, n, last, best = self.done.get() if self.done.exists() else (0, -(2**62), 0, 0.0, 0.0)
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        rows = held[:kept] + sorted([*held[kept:], *(r for r in new if r[0] > until)])
        while True:
            settled = kept + sum(r[0] < now for r in rows[kept:])
            end = next((i for i in range(max(kept, 1), settled) if rows[i][0] - rows[i - 1][0] > self.idle), settled)
            ended = end < settled or (bool(rows) and rows[-1][0] + self.idle < now)
            out, drop, n, (last, best) = self.settled(np.array([r[2] for r in rows[:end]], float), kept, n, (last, best), ended)
            if len(out):
                at = out.pop("at").to_numpy()
                out.insert(0, "tie", [rows[i][1] for i in at])
                out.insert(0, "t", [rows[i][0] for i in at])
                out.insert(0, self.key, key[0])
                yield out
            if end == settled:
                break
            rows, kept, n = rows[end:], 0, 0
        if ended:
            self.rows.clear()
            self.done.clear()
            return
        rows = rows[drop:]
        self.rows.put(rows) if rows else self.rows.clear()
        self.done.update((settled - drop, max(until, now - 1), n, last, best))
        waits = [rows[settled - drop][0]] if settled - drop < len(rows) else []
        for t in [*waits, *([rows[-1][0] + self.idle] if rows else [])]:
            self.handle.registerTimer(t // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [r for b in rows for r in zip(b["t"].tolist(), b["tie"].tolist(), b["x"].astype(float).tolist(), strict=True)]
        yield from self._go(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


class Centred(InOrder):
    """Mean, spread and score of each row among its neighbours on both sides; the ends are reflected."""

    def __init__(self, key: str, idle: int, window: int):
        super().__init__(key, idle)
        self.window, self.half = window, window // 2

    def settled(self, rows, first, n, memory, ended):
        half, back = self.half, min(n, self.half)  # so many rows stand before the next one to put out
        total = n - back + len(rows)
        if total < self.window:  # too short for scores, unless more rows come
            at = np.arange(back, len(rows) if ended else back)
            return pd.DataFrame({"at": at, "x": rows[at], "mean": np.nan, "spread": np.nan, "score": rows[at]}), 0, n + len(at), memory
        at = np.arange(back, max(back, len(rows) if ended else len(rows) - half))
        if not len(at):
            return pd.DataFrame({"at": at}), 0, n, memory
        left = rows[1 : half + 1][::-1] if n == back else rows[:0]
        right = rows[-half - 1 : -1][::-1] if ended and half else rows[:0]
        near = np.lib.stride_tricks.sliding_window_view(np.concatenate([left, rows, right]), 2 * half + 1)[at - half + len(left)]
        mean, spread, x = near.mean(1), near.std(1), rows[at]
        score = x if self.window <= 3 else np.maximum((x - mean) / (spread + 1e-8), 0.0)
        n += len(at)
        return pd.DataFrame({"at": at, "x": x, "mean": mean, "spread": spread, "score": score}), back + len(at) - min(n, half), n, memory


class Running(InOrder):
    """Exponential average and best value so far."""

    def __init__(self, key: str, idle: int, beta: float):
        super().__init__(key, idle)
        self.beta = beta

    def settled(self, rows, first, n, memory, ended):
        new, (last, best) = rows[first:], memory
        if not len(new):
            return pd.DataFrame({"at": []}), 0, n, memory
        ema = pd.Series(np.append(last, new) if n else new).ewm(alpha=1 - self.beta, adjust=False).mean().to_numpy()[-len(new) :]
        top = np.maximum.accumulate(np.maximum(new, best) if n else new)
        out = pd.DataFrame({"at": first + np.arange(len(new)), "n": n + 1 + np.arange(len(new)), "ema": ema, "best": top})
        return out, len(rows) - 1, n + len(new), (float(ema[-1]), float(top[-1]))


def _micros(interval: str) -> int:
    return round(pd.Timedelta(interval).total_seconds() * 1e6)


def _ordered(events: DataFrame, key: str, ts: str, order: str, value: str, late: str, processor: InOrder, fields: str) -> DataFrame:
    spark = events.sparkSession
    if spark.conf.get(_PROVIDER, "").rpartition(".")[2] != _ROCKS.rpartition(".")[2]:
        spark.conf.set(_PROVIDER, _ROCKS)  # keeps lists and timers; the default provider doesn't
    e = event_time(events, ts).withWatermark(ts, late)
    key_type = events.schema[key].dataType.simpleString()
    rows = e.select(key, ts, F.unix_micros(ts).alias("t"), F.col(order).cast("long").alias("tie"), F.col(value).cast("double").alias("x"))
    out = rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {key_type}, t long, tie long, {fields}", "append", "eventTime")
    return out.withColumns({ts: F.timestamp_micros("t"), order: F.col("tie")}).select(key, ts, order, *[c for c in out.columns if c not in (key, "t", "tie")])


def centred(events: DataFrame, key: str, ts: str, order: str, value: str, late: str, idle: str, window: int = 11) -> DataFrame:
    """(key, ts, order, x, mean, spread, score): each row among ``window`` neighbours of its key, half on either side.

    The streaming form of ``signal.local_zscore``: a row comes out once the rows after it are settled; the last
    ones when the key has been silent for more than ``idle``, which ends its sequence. ``late`` is how far rows may be out
    of order. A sequence shorter than the window keeps its values as scores.
    """
    return _ordered(events, key, ts, order, value, late, Centred(key, _micros(idle), window), "x double, mean double, spread double, score double")


def running(events: DataFrame, key: str, ts: str, order: str, value: str, late: str, idle: str, beta: float = 0.9) -> DataFrame:
    """(key, ts, order, n, ema, best): exponential average and best value of each key after each row, in order of time.

    Rows that come in any order within ``late`` give what they give in order; state is the rows that aren't settled, and
    four numbers. A key that is silent for ``idle`` begins anew.
    """
    return _ordered(events, key, ts, order, value, late, Running(key, _micros(idle), beta), "n long, ema double, best double")
