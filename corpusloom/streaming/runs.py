"""Steps of many training runs as a stream with state: checkpoints that are due and throughput over the last steps.

Each run has a state of its own: the second of its last save, the tokens and seconds of the last ``WINDOW`` steps, and the
steps that have come but may still be overtaken. A step waits until the watermark passes its time; a timer then releases
all steps up to there in the order of time and step, so files may come in any order within the delay, and the rows are those
that a batch over everything gives. A restart goes on from the checkpoint and gives no row twice.

The state of a run is bounded: the window, and what comes within the delay. Steps that are older than the watermark when
they come are dropped, as Spark's own windows do, because later ones have been decided. With ``idle`` a run that has sent no step for
so many seconds of event time is forgotten, and begins anew if it sends one.

Edge cases: a step without a run, a number or a time is dropped; null tokens or seconds count as none, and a rate over no
seconds is null; repeated steps are steps of their own; of steps at one time the smaller number goes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW = 100
WAITING = "at long, step long, tokens long, used long, seconds double"  # at in milliseconds
STEPS = "run string, step long, due boolean, tokens_per_sec double, step_time_ms double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(run: str, rows: list[tuple], last: float | None, used: list[int], seconds: list[float], every: int, batch_tokens: int, most: float, window: int):
    """``STEPS`` of ``rows`` (``WAITING``, in order) and the state after them."""
    out = []
    for at, step, tokens, now_used, now_seconds in rows:
        second = at // 1000
        last = second if last is None else last
        due = tokens % every < batch_tokens or (second - last) / 60.0 >= most
        last = second if due else last
        used, seconds = [*used, now_used][-window:], [*seconds, now_seconds][-window:]
        total = sum(seconds)
        out.append((run, step, due, sum(used) / total if total else None, total / len(seconds) * 1000))
    return out, last, used, seconds


class RunMonitor(StatefulProcessor):
    def __init__(self, every: int, batch_tokens: int, most: float, window: int = WINDOW, idle: int | None = None):
        self.settings, self.idle = (every, batch_tokens, most, window), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "saved double, seen long")
        self.recent = handle.getValueState("recent", "used array<long>, seconds array<double>")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        passed, new = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            new += [tuple(r) for r in batch[["at", "step", "tokens", "used", "seconds"]].itertuples(index=False) if r.at > passed]
        if new:
            self.waiting.appendList([(int(a), int(s), int(t), int(u), float(x)) for a, s, t, u, x in new])
            for at in {int(r[0]) for r in new}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        saved, seen = self.clock.get() if self.clock.exists() else (None, None)
        if not ready:  # an earlier timer of this batch released them, or this is the one that ends an idle run
            if self.idle is not None and not rest and seen is not None and seen + 1000 * self.idle <= passed:
                self.clock.clear()
                self.recent.clear()
            return
        used, seconds = self.recent.get() if self.recent.exists() else ([], [])
        out, saved, used, seconds = advance(key[0], ready, saved, list(used), list(seconds), *self.settings)
        self.clock.update((float(saved), ready[-1][0]))
        self.recent.update((used, seconds))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if self.idle is not None:
            self.handle.registerTimer(ready[-1][0] + 1000 * self.idle)
        yield pd.DataFrame(out, columns=["run", "step", "due", "tokens_per_sec", "step_time_ms"])

    def close(self) -> None:
        pass


def _prepared(steps: DataFrame) -> DataFrame:
    whole = steps.filter(F.col("run").isNotNull() & F.col("step").isNotNull() & F.col("ts").isNotNull())
    zero = F.lit(0).cast("long")
    return whole.select(
        F.col("run").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("step").cast("long").alias("step"),
        F.coalesce(F.col("tokens").cast("long"), zero).alias("tokens"), F.coalesce(F.col("used").cast("long"), zero).alias("used"), F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)).alias("seconds"),
    )


def monitored(steps: DataFrame, delay: str, every: int, batch_tokens: int, most: float = 20.0, window: int = WINDOW, idle: int | None = None) -> DataFrame:
    """``STEPS`` of a stream of steps (run, step, ts, tokens so far, tokens used, seconds), once the watermark has passed them."""
    rows = _prepared(steps).withWatermark("ts", delay)
    monitor = RunMonitor(every, batch_tokens, most, window, idle)
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=monitor, outputStructType=STEPS, outputMode="Append", timeMode="EventTime")


def start_monitor(metrics: DataFrame, path: str, checkpoint: str):
    """Append to Parquet, each batch once; take what is there, release what the watermark passes, and stop."""
    spark: SparkSession = metrics.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return metrics.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
