"""Minute bars as they arrive: the batch operators' semantics on a streaming DataFrame.

Rows count as long as the watermark hasn't passed them.  A correction that comes later is the batch job's: it recomputes
the day and replaces its partition (:func:`tidepanel.sources.files.replace_partitions`).  What the watermark hasn't
passed yet stays in the state; :func:`closing_row` ends a source, so that all of it comes out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quality import in_session, validate

SLOT_US = 60_000_000  # waiting rows are kept by minute
# keyed state with timers is kept by this provider
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def closing_row(bars: DataFrame, ahead: str = "2 days") -> DataFrame:
    """A single row of the table's schema, later than all its rows by ``ahead`` and NULL but for ``ts``.

    Added to a source that has ended, it moves the watermark past everything that came before; itself it belongs to
    no instrument and gives no bar.  Without rows there is none.
    """
    end = bars.agg((F.max("ts") + F.expr(f"INTERVAL {ahead}")).alias("ts")).where(F.col("ts").isNotNull())
    return end.select(*[F.col("ts").cast(f.dataType).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in bars.schema])


def resample_stream(bars: DataFrame, minutes: int, delay: str | None = "10 minutes") -> DataFrame:
    """n-minute bars counted from each day's midnight, as :func:`tidepanel.operators.intraday.resample` makes them, once complete.

    Windows count from midnight in UTC, so the session's zone has to differ from it by a multiple of ``minutes`` (by
    nothing where ``minutes`` doesn't divide the day). ``delay`` is None for a stream that has its watermark already
    (:func:`keep_last_bars`).
    """
    if delay is not None:
        bars = bars.withWatermark("ts", delay)
    midnight = F.date_trunc("day", F.col("ts"))
    start = F.timestamp_add("MINUTE", (F.floor(F.timestamp_diff("SECOND", midnight, F.col("ts")) / (minutes * 60)) * minutes).cast("int"), midnight)
    priced = F.when(F.col("price").isNotNull(), F.col("ts"))
    span = minutes if 1440 % minutes == 0 else 1440  # of the window that closes a bucket: its own or the day's
    out = bars.groupBy("instrument_id", F.window("ts", f"{span} minutes").alias("w"), start.alias("start")).agg(
        F.max_by("price", priced).alias("price"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))
    return out.where(F.col("price").isNotNull()).select("instrument_id", F.col("start").alias("ts"), "price", "volume", "amount")


def keep_last_bars(bars: DataFrame, order: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """One row per (instrument, ts): the last by ``order``, as the batch operator keeps it, once the watermark has passed ``ts``.

    Equal orders are decided by the rest of the row. The state has one row per key that is still open.
    """
    keys = ["instrument_id", "ts"]
    rest = [c for c in dict.fromkeys([*order, *bars.columns]) if c not in keys]
    last = bars.withWatermark("ts", delay).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in bars.columns])


def distinct_bars(bars: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row per (instrument, ts) as soon as it arrives: the first one. :func:`keep_last_bars` waits for the last."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["instrument_id", "ts"])


def quality_sink(rules: Sequence[Mapping], data_path: str, report_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the rule report of each batch is kept, and rows in session are written.

    A batch that is run again after a failure overwrites its own folder, so nothing is there twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        validate(batch, rules).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{report_path}/batch={batch_id}")
        batch.where(in_session(F.col("ts"))).write.mode("overwrite").parquet(f"{data_path}/batch={batch_id}")
        batch.unpersist()
    return write


class _RunningMean(StatefulProcessor):
    """Exponential mean of one instrument: rows wait, by minute, until the watermark has passed them."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mean = handle.getValueState("mean", "at long, mean double")
        self.waiting = handle.getMapState("waiting", "slot long", "ts array<long>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest = None
        for frame in rows:  # one at a time; each goes to the state
            frame = frame[frame["value"].notna()]
            if key[0] is None or frame.empty:
                continue
            for slot, part in frame.groupby(frame["us"] // SLOT_US, sort=False):
                ts, value = part["us"].tolist(), part["value"].tolist()
                if self.waiting.containsKey((int(slot),)):
                    held = self.waiting.getValue((int(slot),))
                    ts, value = [*held[0], *ts], [*held[1], *value]
                self.waiting.updateValue((int(slot),), (ts, value))
            first = int(frame["us"].min())
            soonest = first if soonest is None else min(soonest, first)
        if soonest is not None:
            self._wake(soonest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, fired = timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs()
        for slot in sorted(k[0] for k in self.waiting.keys()):
            if slot * SLOT_US > passed:
                self._wake(slot * SLOT_US, fired)
                return
            ts, value = (list(x) for x in self.waiting.getValue((slot,)))
            rows = sorted(zip(ts, value))
            done = [r for r in rows if r[0] <= passed]
            if len(done) == len(rows):
                self.waiting.removeKey((slot,))
            else:
                left = rows[len(done):]
                self.waiting.updateValue((slot,), ([r[0] for r in left], [r[1] for r in left]))
            if done:
                start = [self.mean.get()[1]] if self.mean.exists() else []
                chain = pd.Series(start + [v for _, v in done], dtype="float64").ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
                self.mean.update((done[-1][0], float(chain[-1])))
                yield pd.DataFrame({"instrument_id": key[0], "us": [t for t, _ in done], "value": [v for _, v in done], "ema": chain[len(start):]})
            if len(done) < len(rows):
                self._wake(rows[len(done)][0], fired)
                return

    def _wake(self, us: int, fired: int | None = None) -> None:
        """One timer per instrument, at its earliest waiting row; ``fired`` is the one that goes off just now."""
        at = -(-us // 1000)
        known = [t for t in self.handle.listTimers() if t != fired]
        if not known or at < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def running_ema(bars: DataFrame, span: int, value: str = "price", delay: str | None = "10 minutes") -> DataFrame:
    """(instrument_id, ts, value, ema): the exponential mean over each instrument's rows in the order of ``ts``.

    Rows that arrive out of order wait in the state until the watermark has passed them and are then taken in order;
    those that come later still don't count, and neither do rows without a value or an instrument. An instrument's state is its mean and, per minute, the rows that wait.
    ``delay`` is None for a stream that has its watermark already. The session's state store has to be ``ROCKS``.
    """
    if delay is not None:
        bars = bars.withWatermark("ts", delay)
    # rows without a value or an instrument are left out by the processor: a filter here would keep them from the watermark
    source = bars.select(
        "instrument_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col(value).cast("double").alias("value"))
    kind = source.schema["ts"].dataType.simpleString()
    made = source.groupBy("instrument_id").transformWithStateInPandas(
        _RunningMean(2.0 / (span + 1)), "instrument_id string, us long, value double, ema double", "Append", "EventTime")
    return made.select("instrument_id", F.timestamp_micros("us").cast(kind).alias("ts"), "value", "ema")
