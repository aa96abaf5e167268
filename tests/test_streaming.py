import os
import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import telemetry
from corpusloom.operators.telemetry import step_metrics
from corpusloom.streaming.logs import start_metrics_sink, stream_step_metrics
from corpusloom.streaming.runs import monitored, start_monitor

LINE = "[Ph1|Step {}] loss=2.5000 | lr=3.00e-04 | gnorm=0.512 | tok/s=29,200 | MFU=41.2% | mem=20.1/34.0GB"


def test_stream_equals_batch(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("logs", "out", "state"))
    os.makedirs(folder)
    for k in range(3):
        with open(f"{folder}/{k}.log", "w") as f:
            f.write("\n".join([LINE.format(10 * k + i) for i in range(5)] + ["noise"]) + "\n")
        start_metrics_sink(stream_step_metrics(spark, folder), out, state).awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, step_metrics(spark.read.text(folder)).collect())) and len(got) == 15


def steps_of(n=300, seed=4):
    r = random.Random(seed)
    rows = []
    for run in ("a", "b", "c"):
        at, tokens = 1_700_000_000, 0
        for step in range(n):
            at, used = at + r.choice([0, 1, 30, 400]), r.randint(0, 5000)
            tokens += used
            rows.append((run, step, datetime.fromtimestamp(at, UTC).replace(tzinfo=None), tokens, used, r.choice([0.0, 0.5, 2.0])))
    return sorted(rows, key=lambda x: (x[2], x[0], x[1]))


SCHEMA = "run string, step long, ts timestamp, tokens long, used long, seconds double"


def test_runs_with_state_equal_the_batch_across_a_restart(spark, tmp_path):
    rows, (folder, out, state) = steps_of(), (str(tmp_path / n) for n in ("steps", "out", "state"))
    end = max(x[2] for x in rows)
    extra = [("z", 0, end + timedelta(days=9), 0, 0, 1.0), (None, 1, end, 1, 1, 1.0), ("a", None, end, 1, 1, 1.0)]
    parts = [rows[:250], rows[250:300], rows[300:620], rows[620:] + extra]
    parts[0], parts[1] = parts[0][:200] + parts[1], parts[0][200:]  # one file overtakes another, within the delay
    for part in parts:  # each time a new query goes on from the checkpoint
        random.Random(1).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = monitored(spark.readStream.schema(SCHEMA).parquet(folder), "5 days", 20_000, 3_000, 15.0, window=10)
        start_monitor(stream, out, state).awaitTermination(120)
    got = sorted((r["run"], r["step"], r["due"], r["tokens_per_sec"] and round(r["tokens_per_sec"], 6), round(r["step_time_ms"], 6)) for r in spark.read.parquet(out).collect())
    df = spark.createDataFrame(rows, SCHEMA)
    due = telemetry.checkpoint_times(df.withColumn("at", F.unix_timestamp("ts")), "run", "step", "tokens", "at", 20_000, 3_000, 15.0)
    w = W.partitionBy("run").orderBy("step").rowsBetween(-9, 0)
    rate = df.select("run", "step", F.try_divide(F.sum("used").over(w), F.sum("seconds").over(w)).alias("rate"), (F.avg("seconds").over(w) * 1000).alias("ms"))
    want = sorted((r["run"], r["step"], r["due"], r["rate"] and round(r["rate"], 6), round(r["ms"], 6)) for r in due.join(rate, ["run", "step"]).collect())
    assert len(want) == 900 and got == want


def test_late_steps_are_dropped_and_idle_runs_forgotten(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("steps", "out", "state"))
    t = lambda s: datetime.fromtimestamp(1_700_000_000 + s, UTC).replace(tzinfo=None)
    for part in ([("a", 1, t(0), 50, 50, 1.0), ("z", 0, t(100), 0, 0, 1.0)], [("a", 0, t(-50), 9, 9, 1.0), ("a", 2, t(101), 90, 50, 1.0), ("z", 1, t(9000), 0, 0, 1.0)], [("a", 3, t(9100), 95, 50, 1.0), ("z", 2, t(99_000), 0, 0, 1.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        start_monitor(monitored(spark.readStream.schema(SCHEMA).parquet(folder), "10 seconds", 1000, 10, 5.0, idle=600), out, state).awaitTermination(120)
    got = sorted((r["step"], r["tokens_per_sec"], r["due"]) for r in spark.read.parquet(out).filter("run = 'a'").collect())
    assert got == [(1, 50.0, False), (2, 50.0, False), (3, 50.0, False)]  # step 0 came too late; step 3 begins anew, or it were due
