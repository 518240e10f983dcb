"""Settlement of signals as a stateful stream: what is open waits in state, event-time timers decide it, and every signal closes once.

The clock of the stream is `known_at`, the time at which a row became known; a bar that is published late has a late `known_at` and an old `ts`. So a decision
at some time rests on the rows known by then, whatever micro-batches they came in, and a restart from the checkpoint gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_OUTCOME = "symbol string, t long, checked_t long, attempt int, bars long, status string"


@dataclass(frozen=True)
class Rules:
    """A short position from `entry`: its target lies `move` below, its stop `move` above. Times are in seconds."""

    step: int
    horizon: int
    move: float
    most_missing: float = 0.05
    #: a signal whose bars are incomplete is looked at again after `again`, at most `attempts` times in all
    again: int = 86_400
    attempts: int = 3


def verdict(rules: Rules, entry: float, path: list[tuple[int, float, float]]) -> str:
    """From the bars (ts, high, low) of the horizon: a bar that touches both counts as the stop."""
    down = min((t for t, _, low in path if low <= entry * (1 - rules.move)), default=None)
    up = min((t for t, high, _ in path if high >= entry * (1 + rules.move)), default=None)
    if up is not None and (down is None or up <= down):
        return "CLOSED_STOP"
    if down is not None:
        return "CLOSED_TARGET"
    return "CLOSED_TIME" if len(path) >= (1 - rules.most_missing) * (rules.horizon // rules.step) else "POSTPONED"


class Settler(StatefulProcessor):
    """State of a symbol: its open signals by time, each with entry, next check and attempts so far, and the bars that an open or coming signal may need."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signals = handle.getMapState("signals", "ts long", "entry double, due long, attempt int")
        self.bars = handle.getMapState("bars", "ts long", "high double, low double, known long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for kind, t, known, entry, high, low in zip(part["kind"], part["t"].tolist(), part["known_t"].tolist(), part["entry"], part["high"], part["low"]):
                if kind == "bar":
                    if not self.bars.containsKey((t,)):  # the first version of a bar counts
                        self.bars.updateValue((t,), (high, low, known))
                elif not self.signals.containsKey((t,)):
                    due = t + self.rules.horizon + self.rules.step  # when the last bar of the horizon closes
                    self.signals.updateValue((t,), (entry, due, 0))
                    self.handle.registerTimer(due * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs() // 1000
        path = sorted((t[0], high, low, known) for t, (high, low, known) in self.bars.iterator())
        out, still_open = [], []
        for (t,), (entry, due, attempt) in sorted(self.signals.iterator()):
            # a check that is due by now is made now, each with what was known at its own time; only one that lies ahead gets a timer
            while due <= clock:
                attempt += 1
                own = [b[:3] for b in path if t < b[0] <= t + self.rules.horizon and b[3] <= due]
                status = verdict(self.rules, entry, own)
                if status != "POSTPONED" or attempt >= self.rules.attempts:
                    self.signals.removeKey((t,))
                    out.append((key[0], t, due, attempt, len(own), status if status != "POSTPONED" else "ABANDONED"))
                    break
                due += self.rules.again
            else:
                still_open.append(t)
                if attempt:
                    self.signals.updateValue((t,), (entry, due, attempt))
                    self.handle.registerTimer(due * 1000)
        self._forget(min([*still_open, clock - self.rules.step]))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "t", "checked_t", "attempt", "bars", "status"])

    def _forget(self, until: int) -> None:
        """Drops bars that neither an open signal nor one that is still to come (known after now, so from a bar of the last step on) can need."""
        for t in [t for t, _ in self.bars.iterator() if t[0] <= until]:
            self.bars.removeKey(t)

    def close(self) -> None:
        pass


def settled_stream(signals: DataFrame, bars: DataFrame, rules: Rules, late: str) -> DataFrame:
    """Outcomes of signals (symbol, ts, entry, known_at), one row each when it closes: CLOSED_TARGET, CLOSED_STOP, CLOSED_TIME, or ABANDONED after the last attempt with too few bars (symbol, ts, high, low, known_at). A signal is known when its bar closes, one step after ts.

    Needs the RocksDB state store (`state_store`)."""
    t, known = F.unix_seconds("ts"), F.unix_seconds("known_at")
    nothing = F.lit(None).cast("double")
    one = signals.select("symbol", "known_at", F.lit("signal").alias("kind"), t.alias("t"), known.alias("known_t"), F.col("entry").cast("double").alias("entry"), nothing.alias("high"), nothing.alias("low"))
    two = bars.select("symbol", "known_at", F.lit("bar").alias("kind"), t.alias("t"), known.alias("known_t"), nothing.alias("entry"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"))
    both = one.unionByName(two).withWatermark("known_at", late)
    out = both.groupBy("symbol").transformWithStateInPandas(Settler(rules), outputStructType=_OUTCOME, outputMode="append", timeMode="eventTime")
    return out.select("symbol", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("checked_t").alias("checked_at"), "attempt", "bars", "status")


#: What a stateful processor needs; set it on the session that starts the stream.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
