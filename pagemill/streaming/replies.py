"""Progress of replies that come in chunks: how many items each has closed so far, while it still runs.

A reply's state is what a scanner of JSON needs to go on: the open brackets, whether it stands in a string and behind a
backslash. Each chunk is read once, wherever it was cut. The batch operators say the same of whole texts
(replies.count_closed and replies.is_open)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROGRESS_OUT = "reply_id string, seq long, items long, open boolean"
STATE = "due long, brackets string, quoted boolean, escaped boolean, items long, balance long, some boolean, seqs array<long>, chunks array<string>, lasts array<boolean>"


class Scanner:
    """Reads chunks one after the other."""

    SIGNS = re.compile(r'["{}\[\]]')
    QUOTED = re.compile(r'["\\]')

    def __init__(self, brackets: str = "", quoted: bool = False, escaped: bool = False, items: int = 0, balance: int = 0, some: bool = False) -> None:
        self.brackets, self.quoted, self.escaped, self.items, self.balance, self.some = brackets, quoted, escaped, items, balance, some

    def read(self, chunk: str) -> None:
        self.some = self.some or bool(chunk)
        at = 0
        while at < len(chunk):
            if self.escaped:
                self.escaped, at = False, at + 1
                continue
            found = (self.QUOTED if self.quoted else self.SIGNS).search(chunk, at)
            if not found:
                return
            sign, at = found.group(), found.end()
            if self.quoted:
                self.escaped, self.quoted = sign == "\\", sign == "\\"
            elif sign == '"':
                self.quoted = True
            else:
                self._bracket(sign)

    def _bracket(self, sign: str) -> None:
        if sign in "{[":
            self.brackets, self.balance = self.brackets + sign, self.balance + 1
            return
        self.balance -= 1
        if self.brackets[-1:] == {"}": "{", "]": "["}[sign]:
            self.brackets = self.brackets[:-1]
            self.items += sign == "}" and self.brackets[-1:] == "["

    @property
    def open(self) -> bool:
        return self.some and (self.quoted or self.balance > 0)

    @property
    def state(self) -> tuple:
        return self.brackets, self.quoted, self.escaped, self.items, self.balance, self.some


def progress(chunks: DataFrame, late: str = "10 minutes", idle_seconds: float = 600.0) -> DataFrame:
    """items and open after each chunk of chunks (reply_id, seq from 0, chunk, last, at: timestamp).

    Chunks may come in any order: one that comes early waits in the state until those before it are there. A reply's state
    ends with its last chunk, or once nothing has come for idle_seconds of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        due, *held, seqs, texts, lasts = state.get if state.exists else (0, "", False, False, 0, 0, False, [], [], [])
        scanner, waiting = Scanner(*held), {s: (t, x) for s, t, x in zip(seqs, texts, lasts, strict=True)}
        rows = pd.concat(list(batches), ignore_index=True)
        for s, t, x in zip(rows["seq"], rows["chunk"], rows["last"], strict=True):
            if s >= due:  # one that was read already comes again after a replay
                waiting.setdefault(int(s), ("" if t is None else t, bool(x)))
        out, ended = [], False
        while due in waiting and not ended:
            text, ended = waiting.pop(due)
            scanner.read(text)
            out.append((key[0], due, scanner.items, scanner.open))
            due += 1
        if ended:
            if state.exists:
                state.remove()
        else:
            order = sorted(waiting)
            state.update((due, *scanner.state, order, [waiting[s][0] for s in order], [waiting[s][1] for s in order]))
            newest = int(rows["at"].max().timestamp() * 1000) if rows["at"].notna().any() else 0
            state.setTimeoutTimestamp(max(newest + int(idle_seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["reply_id", "seq", "items", "open"])

    timed = chunks.select(F.col("reply_id").cast("string").alias("reply_id"), F.col("seq").cast("long").alias("seq"), "chunk", F.coalesce("last", F.lit(False)).alias("last"), "at").withWatermark("at", late)
    return timed.groupBy("reply_id").applyInPandasWithState(step, PROGRESS_OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
