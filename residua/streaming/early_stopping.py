"""Early stopping of runs whose epochs arrive as a stream, in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..contracts import ConfigError

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EarlyStopping(StatefulProcessor):
    """Per run: the best score, since when it stands, and epochs that wait for the watermark.

    An epoch is judged when the watermark has passed its time, together with all that arrived before
    it in the order of (time, epoch); a timer of the epoch's time calls for that. A run that has stopped
    keeps its state, so that it stops once.
    """

    def __init__(self, patience: int, sign: int) -> None:
        self.patience, self.sign = patience, sign

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stamp bigint, epoch bigint", "score double, scored boolean")
        self.progress = handle.getValueState("progress", "best double, best_epoch bigint, stale bigint, stamp bigint, epoch bigint, stopped boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        so_far = self.progress.get() if self.progress.exists() else None
        stopped, judged = (so_far[5], (so_far[3], so_far[4])) if so_far else (False, (-(1 << 62), 0))
        for part in rows:
            for stamp, epoch, score, scored in zip(part["stamp_us"], part["epoch_no"], part["score_or_zero"], part["is_scored"], strict=True):
                at = int(stamp), int(epoch)
                if not stopped and at > judged:
                    self.waiting.updateValue(at, (float(score) if scored else 0.0, bool(scored)))
                    self.handle.registerTimer(at[0] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        best, best_epoch, stale, stamp, epoch, stopped = self.progress.get() if self.progress.exists() else (0.0, -1, 0, -(1 << 62), 0, False)
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((at, own) for at, own in self.waiting.iterator() if at[0] < until)
        out = []
        for (stamp, epoch), (score, scored) in due:
            if not stopped and scored:
                if best_epoch < 0 or self.sign * score > self.sign * best:
                    best, best_epoch, stale = score, epoch, 0
                else:
                    stale += 1
                stopped = stale >= self.patience
                if stopped:
                    out.append((key[0], pd.Timestamp(stamp, unit="us"), epoch, best, best_epoch))
            self.waiting.removeKey((stamp, epoch))
        if due:
            self.progress.update((best, best_epoch, stale, stamp, epoch, stopped))
        if stopped:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["run_key", "stamp", "epoch", "best", "best_epoch"])

    def close(self) -> None:
        pass


def stream_stops(epochs: DataFrame, key: str, stamp: str, epoch: str, score: str, patience: int, delay: str = "10 minutes", mode: str = "max") -> DataFrame:
    """key, stamp, epoch, best, best_epoch of each run at the epoch where `patience` scored epochs in a row have not improved.

    `epochs` is a stream; `epoch` counts from 0 within a run. Epochs may arrive in any order within
    `delay` of the newest one; later ones are not judged. A score improves when it is greater (mode max) or less (min). Null and NaN scores never count, a repeated
    (stamp, epoch) counts once, and a run is reported once. Open runs hold their unjudged epochs in the
    state store, which must be that of RocksDB.
    """
    spark = epochs.sparkSession
    if patience < 1:
        raise ConfigError(f"patience is 1 or more, not {patience}")
    if mode not in ("min", "max"):
        raise ConfigError(f"mode is min or max, not {mode!r}")
    if spark.conf.get(PROVIDER) != ROCKS:
        raise ConfigError(f"set {PROVIDER} to {ROCKS}")
    kind = epochs.schema[key].dataType.simpleString()
    scored = F.col(score).isNotNull() & ~F.isnan(score)
    rows = epochs.withWatermark(stamp, delay).filter(F.col(stamp).isNotNull() & F.col(epoch).isNotNull())
    rows = rows.select(F.col(key).alias("run_key"), F.unix_micros(stamp).alias("stamp_us"), F.col(epoch).cast("bigint").alias("epoch_no"), F.when(scored, F.col(score)).otherwise(0.0).cast("double").alias("score_or_zero"), scored.alias("is_scored"), F.col(stamp).alias("event_time"))
    schema = f"run_key {kind}, stamp timestamp, epoch bigint, best double, best_epoch bigint"
    stopped = rows.groupBy("run_key").transformWithStateInPandas(EarlyStopping(patience, 1 if mode == "max" else -1), schema, "append", "eventTime")
    return stopped.withColumnRenamed("run_key", key)
