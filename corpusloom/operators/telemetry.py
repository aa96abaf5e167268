"""Metrics of training runs: schedules, throughput, cost, checkpoints and log lines."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Dense BF16 peak TFLOPS, first name that occurs wins; multiprocessors of a whole device.
PEAK_TFLOPS = {
    "b300": 2500.0, "b200": 2250.0, "h100": 989.0, "h200": 989.0, "mi300": 653.7, "a100": 312.0, "a40": 37.4, "l40": 181.0,
    "rtx 4090": 82.6, "rtx 3090": 35.6, "v100": 14.1,
}
WHOLE_SMS = {"b300": 144, "b200": 144, "h100": 132, "h200": 132, "a100": 108}
DEFAULT_SMS = 144
#: Log line patterns, the run's size and its metering.
STEP_LINE = r"\[Ph(\d+)\|Step\s+([\d,]+)\]\s+loss=([\d.]+).*?lr=([\d.e\-]+)\s+\|\s+gnorm=([\d.]+)\s+\|\s+tok/s=([\d,]+)\s+\|\s+MFU=([\d.]+)%.*?mem=([\d.]+)/"
MICRO_LINE = r"\[accum\s+\d+/\d+\]\s+micro-loss=([\d.]+)"
FETCH_LINE = r"Fetching \d+ files:\s+(\d+)%\s+\|\s+(\d+)/(\d+)"
TOKENS_A_STEP, RUN_TOKENS = 1_048_576, 15_000_000_000
HOURLY_RATE, START_BALANCE, RUN_HOURS = 2.06, 440.49, 143.0
SFT_TOKENS, DPO_TOKENS = 500_000_000, 60_000_000


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def learning_rate(tokens: Column, lr_max: float, lr_min: float, warmup: int, total: int, multiplier: float = 1.0) -> Column:
    """Linear warm-up from the minimum, then a cosine back to it."""
    span = lr_max - lr_min
    progress = F.least(F.lit(1.0), (tokens - warmup) / max(1, total - warmup))
    rising = lr_min + span * (tokens / max(1, warmup))
    falling = lr_min + span * 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress))
    return multiplier * F.when(tokens < warmup, rising).otherwise(falling)


def constant_rate(rate: float) -> Column:
    return F.lit(rate)


def throughput(rows: DataFrame, order: str, window: int = 100, flops_per_token: float = 7.02e9, peak_tflops: float = 989.0, world: int = 1, streams: tuple[str, ...] = ()) -> DataFrame:
    """Tokens a second, MFU and milliseconds a step over the last ``window`` rows (tokens, seconds).

    ``tokens`` are those of all devices, so nothing is multiplied by ``world``; the peak is.
    """
    w = W.partitionBy(*streams).orderBy(order).rowsBetween(-(window - 1), 0)
    rate = F.sum("tokens").over(w) / F.sum("seconds").over(w)
    return rows.select(
        *streams, order, rate.alias("tokens_per_sec"), (rate / world).alias("tokens_per_sec_per_gpu"),
        (rate * flops_per_token / 1e12 / (peak_tflops * world)).alias("mfu"), (F.avg("seconds").over(w) * 1000).alias("step_time_ms"),
    )


def peak_tflops(device: Column, sms: Column, clock_ghz: Column | None = None) -> Column:
    """Peak of a device by name; slices get their share of it; unknown devices are estimated from their size."""
    name = F.lower(device)
    whole = F
    for key, peak in PEAK_TFLOPS.items():
        share = F.when(F.contains(name, F.lit("mig")), sms / WHOLE_SMS.get(key, DEFAULT_SMS)).otherwise(1.0)
        whole = whole.when(F.contains(name, F.lit(key)), peak * share)
    clock = F.coalesce(clock_ghz, F.lit(1.5)) if clock_ghz is not None else F.lit(1.5)
    return whole.otherwise(sms * 256 * clock / 1e3)


def stage_seconds(phase: Column, tokens: Column, rate: Column, p1: int = 0, p2: int = 11_000_000_000, p3: int = 0) -> dict[str, Column]:
    """Seconds until each stage ends, in order; null while the rate is too low to tell."""
    left1 = F.when(phase == 1, F.greatest(F.lit(0), F.lit(p1) - tokens)).otherwise(F.lit(0))
    left2 = F.when(phase == 1, F.lit(p2)).when(phase == 2, F.greatest(F.lit(0), F.lit(p2) - (tokens - p1))).otherwise(F.lit(0))
    left3 = F.lit(0)
    if p3 > 0:
        left3 = F.when(phase <= 2, F.lit(p3)).when(phase == 3, F.greatest(F.lit(0), F.lit(p3) - (tokens - p1 - p2))).otherwise(F.lit(0))
    out, total = {}, F.lit(0)
    for name, left in (("phase1", left1), ("phase2", left2), ("phase3", left3), ("sft", F.lit(SFT_TOKENS)), ("dpo", F.lit(DPO_TOKENS))):
        total = total + left
        out[name] = F.when(rate > 100, total / rate)
    return out


def budget_state(cost: Column, budget: float) -> Column:
    return F.when(cost > budget, "stop").when(cost > budget * 0.95, "warn").otherwise("ok")


def checkpoint_due(tokens: Column, every: int, batch_tokens: int, minutes: Column | None = None, most: float = 20.0) -> Column:
    """By tokens, or by the minutes since the last save where these are known."""
    due = tokens % every < batch_tokens
    return due | (minutes >= most) if minutes is not None else due


def checkpoint_times(steps: DataFrame, run: str, order: str, tokens: str, seconds: str, every: int, batch_tokens: int, most: float = 20.0) -> DataFrame:
    """``steps`` with ``due``: by tokens, or where ``most`` minutes have passed since the last save or the run's first second.

    Each save starts the clock anew, whatever came before it, and a save by tokens is known from its row alone. So a run falls
    into stretches that begin with such saves; only a stretch, which ``every`` bounds, is a fold over its narrow rows, and all
    stretches of all runs go side by side. Null tokens are none due; steps that tie in ``order`` go by their second.
    """
    from ..functions.ordering import running_total
    from ..functions.tables import written

    kind = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    hit = F.coalesce(F.col(tokens) % every < batch_tokens, F.lit(False))
    rows = written(steps.select(run, order, F.col(seconds).alias("_at"), hit.alias("_hit")), "steps")
    rows = running_total(rows, F.col("_hit").cast("long"), order, "_hits", (run,), ("_at",))
    rows = rows.withColumn("_stretch", F.col("_hits") + F.col("_hit").cast("long")).drop("_hits")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, "_at"], kind="stable")
        last, due = rows["_at"].iloc[0], []
        for hit, at in zip(rows["_hit"], rows["_at"], strict=True):
            due.append(bool(hit or (at - last) / 60.0 >= most))
            last = at if due[-1] else last
        return rows[[run, order]].assign(due=due)

    return rows.groupBy(run, "_stretch").applyInPandas(fold, f"{run} {kind[run]}, {order} {kind[order]}, due boolean")


def surplus_checkpoints(saved: DataFrame, keep: int, order: str, ties: str, run: tuple[str, ...] = ()) -> DataFrame:
    """Regular checkpoints beyond the newest ``keep``; emergency saves are left alone."""
    w = W.partitionBy(*run).orderBy(F.desc(order), F.desc(ties))
    return saved.filter("NOT is_emergency").withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") > keep).drop("_nth")


def latest(saved: DataFrame, order: Column, value: str) -> DataFrame:
    return saved.agg(F.max_by(value, order).alias(value))


def metered(now: Column, start: int, rate: float = HOURLY_RATE, balance: float = START_BALANCE, hours: float = RUN_HOURS) -> dict[str, Column]:
    """Elapsed time, money spent and left, as numbers and as text."""
    elapsed = F.greatest(F.lit(0), now - start).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h = F.floor(elapsed / 3600)
    spent = elapsed / 3600.0 * rate
    left = F.greatest(F.lit(0.0), balance - spent)
    total = round(hours * rate, 2)
    return {
        "elapsed_str": F.concat(F.when(h < 100, two(h)).otherwise(h.cast("string")), F.lit("h "), two(F.floor(elapsed % 3600 / 60)), F.lit("m "), two(elapsed % 60), F.lit("s")),
        "spent": spent, "balance": left, "est_total": F.lit(total), "est_surplus": left - total,
    }


def step_metrics(lines: DataFrame, line: str = "value") -> DataFrame:
    """Typed metrics of the step lines. Thousands separators in numbers are read; other lines are left out."""
    hit = lines.filter(F.col(line).rlike(STEP_LINE))
    group = lambda i: F.regexp_extract(line, STEP_LINE, i)
    whole = lambda i: F.replace(group(i), F.lit(","), F.lit("")).try_cast("long")
    real = lambda i: group(i).try_cast("double")
    rest = [c for c in lines.columns if c != line]
    return hit.select(
        *rest, whole(1).cast("int").alias("phase"), whole(2).alias("step"), F.round(real(3), 4).alias("loss"), real(4).alias("lr"),
        F.round(real(5), 3).alias("gnorm"), whole(6).alias("tok_s"), F.round(real(7), 1).alias("mfu"), F.round(real(8), 1).alias("mem"),
    )


def micro_losses(lines: DataFrame, order: str, line: str = "value", last: int = 160) -> DataFrame:
    """The last losses of accumulation steps, numbered from 1."""
    hit = lines.filter(F.col(line).rlike(MICRO_LINE)).select(order, F.round(F.regexp_extract(line, MICRO_LINE, 1).try_cast("double"), 4).alias("micro_loss"))
    tail = hit.orderBy(F.desc(order)).limit(last)  # a limit is the feature
    return tail.withColumn("micro_index", F.row_number().over(W.orderBy(order))).select("micro_index", "micro_loss")


def log_tail(lines: DataFrame, order: str, last: int = 60) -> DataFrame:
    return lines.orderBy(F.desc(order)).limit(last)  # a limit is the feature


def progress(metrics: DataFrame, order: str) -> DataFrame:
    """The last step and how much of the run is behind it."""
    last = metrics.agg(F.max_by(F.struct("step", "loss", "tok_s"), order).alias("m")).select("m.*")
    tokens = F.col("step") * TOKENS_A_STEP
    return last.select("step", "loss", "tok_s", tokens.alias("tokens"), F.least(F.lit(100.0), tokens / RUN_TOKENS * 100).alias("progress_pct"))


def fetch_progress(lines: DataFrame, order: str, line: str = "value") -> DataFrame:
    """The last line about files fetched."""
    hit = lines.filter(F.col(line).rlike(FETCH_LINE))
    last = hit.agg(F.max_by(line, order).alias("l"))
    return last.select(*[F.regexp_extract("l", FETCH_LINE, i).try_cast("long").alias(n) for i, n in ((1, "percent"), (2, "done"), (3, "files"))])


def gradient_stats(values: DataFrame, name: str, value: str) -> DataFrame:
    """Mean, deviation, largest size and norm by parameter, and whether they look wrong."""
    v = F.col(value)
    out = values.groupBy(name).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(F.abs(v)).alias("max_abs"), F.sqrt(F.sum(v * v)).alias("norm"))
    return out.withColumn("flagged", (F.col("max_abs") > 100) | F.coalesce(F.col("std") == 0, F.lit(False)))


def balance_loss(routed: DataFrame, groups: int, target: str = "domain", probability: str = "probability") -> DataFrame:
    """Share of rows and mean probability by routing target, and groups times the sum of their products.

    ``routed`` has one row a token and target: ``chosen`` 1 if the token went there, and the router's probability.
    """
    per = routed.groupBy(target).agg(F.avg(F.col("chosen").cast("double")).alias("f"), F.avg(probability).alias("p"))
    return per.agg((groups * F.sum(F.col("f") * F.col("p"))).alias("loss"), F.min("f").alias("least_share"), F.max("f").alias("largest_share"))


def within_capacity(routed: DataFrame, expert: str, order: str, experts: int, factor: float = 1.25) -> DataFrame:
    """At most ceil(factor * rows / experts) rows of each expert, the first in order."""
    from ..functions.ordering import row_index

    cap = math.ceil(factor * routed.count() / experts)
    return row_index(routed, order, "_nth", (expert,)).filter(F.col("_nth") < cap).drop("_nth")


def gpu_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Other columns, and the fields of 'index, name, memory used, memory total, utilization' text; what cannot be read becomes null."""
    part = F.transform(F.split(line, ","), lambda x: F.trim(x))
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    return lines.select(
        *[c for c in lines.columns if c != line], number(1).cast("int").alias("device"), F.try_element_at(part, F.lit(2)).alias("name"),
        number(3).alias("memory_used_mb"), number(4).alias("memory_total_mb"), number(5).alias("utilization_pct"),
    )


def health_flags(metrics: DataFrame) -> DataFrame:
    """Rows (metric, value) held against their fixed bounds."""
    value = F.col("value")
    rules = {
        "grad_norm": value > 5.0, "gate_mean": ~value.between(0.3, 0.7), "gate_std": value <= 0.1, "expert_utilization_std": value >= 0.15, "gpu_util": value <= 90.0,
    }
    flag = F
    for name, bad in rules.items():
        flag = flag.when(F.col("metric") == name, bad)
    return metrics.withColumn("flagged", F.coalesce(flag.otherwise(F.lit(False)), F.lit(False)))


def long_metrics(rows: DataFrame, step: str) -> DataFrame:
    """One row a step and metric."""
    names = [c for c in rows.columns if c != step]
    return rows.select(step, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([step], names, "metric", "value")


def step_line(phase: Column, step: Column, loss: Column, lr: Column, gnorm: Column, tok_s: Column, mfu: Column, mem: Column, total: Column) -> Column:
    """The log line that :func:`step_metrics` reads; ``mfu`` is a share."""
    return F.format_string(
        "[Ph%d|Step %,d] loss=%.4f | ppl=%.2f | lr=%.2e | gnorm=%.3f | tok/s=%,.0f | MFU=%.1f%% | mem=%.1f/%.1fGB",
        phase, step, loss, perplexity(loss), lr, gnorm, tok_s.cast("double"), mfu * 100, mem, total,
    )


def summary_table(manifest: DataFrame, domain: str = "domain") -> DataFrame:
    """One printable line a domain of a manifest with train_tokens and, where it failed, error."""
    good = F.format_string("  %-15s %,18d tokens", F.col(domain), F.coalesce("train_tokens", F.lit(0)).cast("long"))
    return manifest.select(domain, F.when(F.col("error").isNotNull(), F.format_string("  %-15s FAILED: %s", domain, "error")).otherwise(good).alias("line"))


def dashboard(lines: DataFrame, order: str, now: Column, start: int, line: str = "value", points: int = 20_000) -> DataFrame:
    """One row of JSON: the last step, progress, the chart series, the log's tail and the cost.

    Series and tail are what a page shows, so they meet in one row by intent; the series hold the newest ``points`` entries.
    """
    steps = step_metrics(lines, line)
    newest = lambda rows, by: rows.orderBy(F.desc(by)).limit(points)  # noqa: E731  the limit is the feature
    series = ["step", "loss", "lr", "gnorm", "tok_s", "mfu", "mem"]
    pick = lambda name: F.transform("s", lambda x: x[name]).alias(name)
    charts = newest(steps, order).agg(F.array_sort(F.collect_list(F.struct(order, *series))).alias("s")).select(F.struct(*map(pick, series)).alias("charts"))
    micro = newest(micro_losses(lines, order, line), "micro_index").agg(F.array_sort(F.collect_list(F.struct("micro_index", "micro_loss"))).alias("micro"))
    tail = log_tail(lines, order).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(line).alias("text")))).alias("t")).select(F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("logs"))
    last = progress(steps, order)
    cost = F.struct(*[c.alias(n) for n, c in metered(now, start).items()]).alias("cost")
    rows = last.join(charts, F.lit(True)).join(micro, F.lit(True)).join(tail, F.lit(True))  # one row each
    return rows.select(F.to_json(F.struct(*last.columns, "charts", "micro", "logs", cost)).alias("payload"))
