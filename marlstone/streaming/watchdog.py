"""Dead sources: no data for some seconds, or only zeros for some seconds, told apart; as a stream and as a batch.

A source is 'no data' when nothing has come for ``seconds``, 'only zeros' when data come but the last signal (a value
other than 0) is ``seconds`` old, else 'alive'; before its first signal a source counts from its first row. Each change of
state is a row (source, at, state), at the moment when it begins; a source begins alive. A row that comes just when a
state would begin comes first.

The stream keeps rows until the watermark has passed them and then takes them in order of time, so late and mixed-up
rows (within the watermark's delay) change nothing; event-time timers tell of silence when no further row comes. Rows
without source or time are left out, a null value is no signal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SECONDS = 3.0
_SPAN = "source string, at timestamp, state string"


def changes(samples: DataFrame, until: str | None = None, seconds: float = SECONDS) -> DataFrame:
    """The batch form over samples (source, ts, value): all changes of state up to ``until`` (a timestamp), or to the end
    of what the last rows bring about."""
    rows = samples.where("source is not null and ts is not null").select(F.col("source").cast("string").alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.coalesce("value", F.lit(0)) != 0).alias("_signal"))
    moments = rows.groupBy("source", "t").agg(F.max("_signal").alias("_signal"))  # rows of one moment are one
    limit = int(seconds * 1_000_000)
    w = Window.partitionBy("source").orderBy("t")
    seen = moments.withColumns({
        "_s": F.coalesce(F.max(F.when(F.col("_signal"), F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("t").over(w.rowsBetween(Window.unboundedPreceding, 0))),
        "_next": F.lead("t").over(w),
    })
    t, s, following = F.col("t"), F.col("_s"), F.coalesce("_next", F.lit(2**62))
    possible = F.array(
        F.struct(t.alias("t"), F.lit(0).alias("k"), F.when(t - s >= limit, "only zeros").otherwise("alive").alias("state")),
        F.when((s + limit > t) & (s < t) & (s + limit < following), F.struct((s + limit).alias("t"), F.lit(1).alias("k"), F.lit("only zeros").alias("state"))),
        F.when(t + limit < following, F.struct((t + limit).alias("t"), F.lit(2).alias("k"), F.lit("no data").alias("state"))),
    )
    each = seen.select("source", F.explode(possible).alias("x")).where("x is not null").select("source", "x.*")
    if until is not None:
        each = each.where(F.col("t") <= F.unix_micros(F.lit(until).cast("timestamp")))
    before = F.lag("state", 1, "alive").over(Window.partitionBy("source").orderBy("t", "k"))
    return each.withColumn("_b", before).where(F.col("state") != F.col("_b")).select("source", F.timestamp_micros("t").alias("at"), "state")


def _frame(rows: list[tuple[str, int, str]]) -> pd.DataFrame:
    text = lambda i: pd.Series([r[i] for r in rows], dtype=object)
    return pd.DataFrame({"source": text(0), "at": pd.to_datetime(pd.Series([r[1] for r in rows], dtype="int64"), unit="ms"), "state": text(2)})


class _Watch(StatefulProcessor):
    """State of a source: its waiting rows, and the times in milliseconds of its last data, signal and look, with its state."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, signal boolean")
        self.last = handle.getValueState("last", "data long, signal long, seen long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        known = {x if isinstance(x, int) else x[0] for x in known}
        for part in rows:
            new = [(int(t.timestamp() * 1000), bool(v is not None and v == v and v != 0)) for t, v in zip(part["ts"], part["value"])]
            self.waiting.appendList(new)
            for t in {t for t, _ in new} - known:
                self.handle.registerTimer(t)
        yield _frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        data, signal, seen, state = self.last.get() if self.last.exists() else (None, None, None, "alive")
        waiting = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        out = []

        def change(at: int, to: str) -> None:
            nonlocal state
            if to != state:
                out.append((key[0], at, to))
                state = to

        def silence(end: int, past: bool) -> None:
            """What begins after the last look and data and before ``end`` (at it too, if ``past``)."""
            if data is None:
                return
            for at, to in ((signal + self.limit, "only zeros"), (data + self.limit, "no data")):
                if data < at and seen < at and (at < end or past and at == end) and (to == "no data" or signal < data and at < data + self.limit):
                    change(at, to)

        moments: dict[int, bool] = {}
        for t, sign in ready:
            moments[t] = moments.get(t, False) or sign
        for t, sign in sorted(moments.items()):
            silence(t, False)
            data, seen, signal = t, t, t if sign or signal is None else signal
            change(t, "only zeros" if t - signal >= self.limit else "alive")
        silence(now, True)
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
            for at in {signal + self.limit, data + self.limit}:
                if at > now:
                    self.handle.registerTimer(at)
        if data is not None:
            self.last.update((data, signal, now, state))
        yield _frame(out)

    def close(self) -> None:
        pass


def watch(samples: DataFrame, late: str = "10 seconds", seconds: float = SECONDS) -> DataFrame:
    """The stream form over samples (source, ts, value), times to the millisecond; needs the RocksDB state store."""
    rows = samples.where("source is not null and ts is not null").select(F.col("source").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    return rows.withWatermark("ts", late).groupBy("source").transformWithStateInPandas(_Watch(int(seconds * 1000)), _SPAN, "Append", "EventTime")


#: The setting that ``watch`` needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

