"""Quota accounting: trailing windows, provider-local days, waiting times and snapshots.

Events have scope, provider, ts (epoch seconds, double) and tokens; a bucket is (scope, provider)."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.operators.folds import fold

# Hours from UTC at which a provider's day begins.
DAY_OFFSETS = {"gemini": -8, "gemma": -8, "qwen": 8}
BUCKET = ("scope", "provider")
MARGIN = 0.25


def sliding(events: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Requests and tokens of the trailing window at each event, itself and one just `seconds` old included.

    A bucket is a user's calls to one provider, so windows stay small; buckets spread over tasks."""
    micros = F.round(F.col("ts") * 1_000_000).cast("long")  # range frames need whole numbers
    w = Window.partitionBy(*BUCKET).orderBy(micros).rangeBetween(-int(seconds * 1_000_000), 0)
    return events.withColumns({"rpm_used": F.count("*").over(w), "tpm_used": F.sum("tokens").over(w)})


def day_of(ts: Column, provider: Column, offsets: dict[str, int] = DAY_OFFSETS) -> Column:
    """The provider's calendar day of an instant."""
    hours = F.lit(0)
    for name, h in offsets.items():
        hours = F.when(provider == name, h).otherwise(hours)
    return F.to_date(F.timestamp_seconds(ts + hours * 3600))


def next_reset(ts: Column, provider: Column, offsets: dict[str, int] = DAY_OFFSETS) -> Column:
    """Epoch seconds of the provider's next midnight."""
    hours = F.lit(0)
    for name, h in offsets.items():
        hours = F.when(provider == name, h).otherwise(hours)
    return (F.floor((ts + hours * 3600) / 86400) + 1) * 86400 - hours * 3600


def daily(events: DataFrame, offsets: dict[str, int] = DAY_OFFSETS) -> DataFrame:
    day = day_of(F.col("ts"), F.col("provider"), offsets)
    return events.groupBy(*BUCKET, day.alias("day")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def snapshot(events: DataFrame, limits: DataFrame, now: float, seconds: float = 60.0, offsets: dict[str, int] = DAY_OFFSETS) -> DataFrame:
    """Use and limits of each bucket at an instant; limits: provider, rpm, tpm, rpd."""
    at = F.lit(now)
    recent = (F.col("ts") <= at) & (at - F.col("ts") <= seconds)
    today = (F.col("ts") <= at) & (day_of(F.col("ts"), F.col("provider"), offsets) == day_of(at, F.col("provider"), offsets))
    used = events.groupBy(*BUCKET).agg(F.count_if(recent).alias("rpm_used"), F.coalesce(F.sum(F.when(recent, F.col("tokens"))), F.lit(0)).alias("tpm_used"), F.count_if(today).alias("rpd_used"))
    out = used.join(F.broadcast(limits), "provider")  # a row a provider
    left = {f"{k}_left": F.greatest(F.lit(0), F.col(k) - F.col(f"{k}_used")) for k in ("rpm", "tpm", "rpd")}
    return out.withColumns({**left, "resets_at": next_reset(at, F.col("provider"), offsets)})


def waits(events: DataFrame, requests: DataFrame, limits: DataFrame, seconds: float = 60.0, offsets: dict[str, int] = DAY_OFFSETS) -> DataFrame:
    """Seconds until each request (scope, provider, request_id, now, tokens) may go: 0 if at once, null if the
    day's requests are used up. The wait ends when the oldest call leaves the window if the calls are at their
    limit, and when enough tokens have left it; no limit where it is 0 or below. Requests have ids of their own."""
    r = requests.join(F.broadcast(limits), "provider")  # a row a provider
    # Calls of the day: one running count over calls and requests of each day.
    day = lambda ts: day_of(ts, F.col("provider"), offsets).alias("_day")
    both = events.select(*BUCKET, day(F.col("ts")), F.col("ts").alias("_at"), F.lit(1).alias("_n"), F.lit(None).cast(r.schema["request_id"].dataType).alias("request_id"))
    both = both.unionByName(r.select(*BUCKET, day(F.col("now")), F.col("now").alias("_at"), F.lit(0).alias("_n"), "request_id"))
    so_far = Window.partitionBy(*BUCKET, "_day").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    daily_use = both.withColumn("rpd_used", F.sum("_n").over(so_far)).filter("request_id IS NOT NULL").select(*[F.col(k).alias(f"_{k}") for k in BUCKET], F.col("request_id").alias("_request"), F.col("_at").alias("_now"), "rpd_used").distinct()
    # Calls of the window lie in the request's slot of time or the one before.
    slot = lambda ts: F.floor(ts / F.lit(float(seconds)))
    e = events.select(*[F.col(k).alias(f"_{k}") for k in BUCKET], slot(F.col("ts")).alias("_slot"), F.col("ts").alias("_ts"), F.col("tokens").alias("_tokens"))
    asked = r.select(*BUCKET, "request_id", "now", F.explode(F.array(slot(F.col("now")) - 1, slot(F.col("now")))).alias("slot"))
    near = asked.join(e, (F.col("scope") == F.col("_scope")) & (F.col("provider") == F.col("_provider")) & (F.col("slot") == F.col("_slot")) & (F.col("_ts") <= F.col("now")) & (F.col("now") - F.col("_ts") <= seconds))
    calls_near = near.groupBy(*[F.col(k).alias(f"_{k}2") for k in BUCKET], F.col("request_id").alias("_request2"), F.col("now").alias("_now2")).agg(F.array_sort(F.collect_list(F.struct(F.col("_ts").alias("ts"), F.col("_tokens").alias("tokens")))).alias("w"))
    used = r.join(daily_use, (F.col("scope") == F.col("_scope")) & (F.col("provider") == F.col("_provider")) & (F.col("request_id") == F.col("_request")) & (F.col("now") == F.col("_now")))
    used = used.join(calls_near, (F.col("scope") == F.col("_scope2")) & (F.col("provider") == F.col("_provider2")) & (F.col("request_id") == F.col("_request2")) & (F.col("now") == F.col("_now2")), "left")
    used = used.withColumn("w", F.coalesce("w", F.array().cast("array<struct<ts:double,tokens:long>>")))
    used = used.withColumn("tpm_used", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    need = F.when(F.col("tokens") >= F.col("tpm"), F.col("tpm_used")).otherwise(F.col("tpm_used") + F.greatest(F.col("tokens"), F.lit(0)) - F.col("tpm"))

    def leaves(ts: Column) -> Column:
        return F.greatest(F.lit(0.0), F.lit(seconds) - (F.col("now") - ts) + MARGIN)

    start = F.struct(F.lit(0).cast("long").alias("freed"), F.lit(None).cast("double").alias("at"))
    freeing = F.aggregate("w", start, lambda s, x: F.struct((s["freed"] + x["tokens"]).alias("freed"), F.coalesce(s["at"], F.when(s["freed"] + x["tokens"] >= need, x["ts"])).alias("at")), lambda s: s["at"])
    calls = F.when((F.col("rpm") > 0) & (F.size("w") >= F.col("rpm")), leaves(F.get(F.col("w"), F.lit(0))["ts"]))
    tokens = F.when((F.col("tpm") > 0) & (F.size("w") > 0) & (need > 0), leaves(freeing))
    wait = F.when((F.col("rpd") > 0) & (F.col("rpd_used") >= F.col("rpd")), F.lit(None).cast("double")).otherwise(F.coalesce(F.greatest(calls, tokens), F.lit(0.0)))
    return used.select("scope", "provider", "request_id", "now", "tokens", "rpd_used", F.size("w").cast("long").alias("rpm_used"), "tpm_used", wait.alias("wait_seconds"))


def schedule(requests: DataFrame, limits: DataFrame, seconds: float = 60.0, offsets: dict[str, int] = DAY_OFFSETS) -> DataFrame:
    """requests (scope, provider, seq, ready: epoch seconds, tokens) with start: when each may go, in order of seq within a
    bucket, so that no window of the calls so scheduled passes a limit; null once the day's requests are used up.

    A call starts at the latest of its own time, the start before it, and what its limits ask: `seconds` and a margin after
    the start of the call that has to leave the window for it. What is kept of a bucket is its last window; a bucket's
    calls are as many as its limits let through, so one task takes them as a stream."""
    known = requests.join(F.broadcast(limits.select("provider", "rpm", "tpm", "rpd")), "provider")  # a row a provider
    timed = known.withColumn("_ready", F.round(F.col("ready") * 1_000_000).cast("long"))
    window, apart = int(seconds * 1_000_000), int((seconds + MARGIN) * 1_000_000)

    def step(state, provider, ready, tokens, rpm, tpm, rpd):
        calls, used, last, day, today = state or (deque(), 0, 0, None, 0)
        at = max(ready, last)
        while calls and at - calls[0][0] > window:
            used -= calls.popleft()[1]
        leaving = 0
        if rpm > 0 and len(calls) >= rpm:
            leaving = len(calls) - rpm + 1
        need = max(0, int(tokens or 0))
        free = used if need >= tpm else used + need - tpm
        if tpm > 0 and free > 0:
            freed = 0
            for n, (_, t) in enumerate(calls, 1):
                freed += t
                if freed >= free:
                    leaving = max(leaving, n)
                    break
        if leaving:
            at = max(at, calls[leaving - 1][0] + apart)
        now = (at // 1_000_000 + offsets.get(provider, 0) * 3600) // 86_400
        today = today if now == day else 0
        if rpd > 0 and today >= rpd:
            return (calls, used, last, now, today), None
        calls.append((at, need))
        return (calls, used + need, at, now, today + 1), at

    told = fold(timed, [*BUCKET], ["seq"], ["provider", "_ready", "tokens", "rpm", "tpm", "rpd"], (), step, T.StructField("_start", T.LongType()))
    return told.select(*requests.columns, (F.col("_start") / 1_000_000).alias("start"))


def record(events: DataFrame, more: DataFrame) -> DataFrame:
    """Events with the calls of more (scope, provider, ts, tokens_in, tokens_out) appended."""
    return events.unionByName(more.select("scope", "provider", "ts", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens")))


def limits_of(spark, rows: list[tuple[str, int, int, int, int]] | None = None) -> DataFrame:
    """provider, rpm, tpm, rpd, max_output_tokens."""
    # Default limits.
    known = [("gemini", 15, 250_000, 500, 65_536), ("gemma", 30, 15_000, 14_400, 8_192), ("qwen", 60, 100_000, 500, 16_384)]
    return spark.createDataFrame(rows or known, "provider string, rpm int, tpm int, rpd int, max_output_tokens int")
