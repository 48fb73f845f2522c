"""Quota windows and lock-outs over streams, with state kept for each bucket or user while it can still count.

An extension: the windows by processing time of the batch operators, by event time. ts is seconds of an epoch; rows that
come later than `late` behind the newest one are left out, as their windows may be gone."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_OUT = "scope string, provider string, event_id long, ts double, tokens long, rpm_used long, tpm_used long"
LOCK_OUT = "user_id long, event_id long, ts double, success boolean, failures int, locked boolean"


#: Watermarks begin at the epoch; set back by a day, they leave out nothing that stands there.
BEGIN = 86_400


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("_at", F.timestamp_micros(F.round((F.col("ts") + BEGIN) * 1_000_000).cast("long"))).withWatermark("_at", late)


def _until(state: GroupState, ts: float) -> None:
    """Ends the state once the watermark has passed ts."""
    state.setTimeoutTimestamp(max(int((ts + BEGIN) * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def sliding(events: DataFrame, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """rpm_used and tpm_used at each event (scope, provider, event_id, ts, tokens), as quota.sliding gives them, for
    events that come in order of ts within a bucket. The state holds a bucket's last window, and goes with it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, tokens = (deque(x) for x in state.get) if state.exists else (deque(), deque())
        total = sum(tokens)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        calls, used = [], []
        for ts, n in zip(rows["ts"], rows["tokens"], strict=True):
            times.append(float(ts))
            tokens.append(int(n))
            total += int(n)
            while ts - times[0] > seconds:
                times.popleft()
                total -= tokens.popleft()
            calls.append(len(times))
            used.append(total)
        state.update((list(times), list(tokens)))
        _until(state, times[-1] + seconds)
        yield rows.assign(scope=key[0], provider=key[1], rpm_used=calls, tpm_used=used)[["scope", "provider", "event_id", "ts", "tokens", "rpm_used", "tpm_used"]]

    return _timed(events, late).groupBy("scope", "provider").applyInPandasWithState(step, WINDOW_OUT, "times array<double>, tokens array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def lockouts(attempts: DataFrame, most: int = 8, seconds: float = 300.0, late: str = "10 minutes") -> DataFrame:
    """failures and locked after each attempt (user_id, event_id, ts, success), as accounts.lockouts gives them. A user
    without failures has no state, and a lock's state ends with it; failures below `most` count until one succeeds."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for ts, ok in zip(rows["ts"], rows["success"], strict=True):
            if count >= most and ts >= until:
                count, until = 0, 0.0
            locked = count >= most
            if not locked:
                count = 0 if ok else count + 1
                until = ts + seconds if count >= most else 0.0
            out.append((count, locked))
        if count:
            state.update((int(count), float(until)))
            if count >= most:
                _until(state, until)
        elif state.exists:
            state.remove()
        yield rows.assign(user_id=key[0], failures=[c for c, _ in out], locked=[x for _, x in out])[["user_id", "event_id", "ts", "success", "failures", "locked"]]

    return _timed(attempts, late).groupBy("user_id").applyInPandasWithState(step, LOCK_OUT, "count int, until double", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user (ts as timestamp): start, end and events, once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests and tokens by bucket and day (ts as timestamp)."""
    return events.withWatermark("ts", late).groupBy("scope", "provider", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select("scope", "provider", F.col("w.start").alias("day"), "requests", "tokens")
