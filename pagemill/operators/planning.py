"""Translation planning: units are counted once, looked up in the cache, sized and packed into batches."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import text as X
from pagemill.operators.batching import numbered_batches


def explode_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and text of each line that holds a letter, which cleaning neither takes nor adds."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return lines.filter(X.has_letter(F.col("raw"))).select("doc_id", "line_no", X.clean(F.col("raw")).alias("text"))


def unique_texts(units: DataFrame, keys: list[str], seq: str = "line_no") -> DataFrame:
    """Distinct texts that are not blank, within keys, with the place where each was first seen."""
    some = units.filter(F.length(X.strip(F.col("text"))) > 0)
    return some.groupBy(*keys, "text").agg(F.min(seq).alias("first_seen"), F.count("*").alias("uses"))


def with_hash(units: DataFrame, lang: str, user: str) -> DataFrame:
    return units.withColumn("hash", X.segment_hash(F.col("text"), F.lit(lang), F.lit(user)))


def cache_lookup(units: DataFrame, cache: DataFrame, user: str = "global") -> DataFrame:
    """units (hash, ...) with translated_text where the user's cache has it: one join for all lookups."""
    own = cache.filter(F.col("user_id") == user).select(F.col("hash").alias("_hash"), "translated_text").dropDuplicates(["_hash"])
    return units.join(own, F.col("hash") == F.col("_hash"), "left").drop("_hash")


def cache_misses(units: DataFrame, cache: DataFrame, user: str = "global") -> DataFrame:
    return units.join(cache.filter(F.col("user_id") == user).select("hash"), "hash", "left_anti")


def with_tokens(units: DataFrame) -> DataFrame:
    """units with input_tokens and output_tokens; a text's own tokens are counted once for both."""
    sized = units.withColumn("_source", X.source_tokens(F.col("text")))
    return sized.withColumns({"input_tokens": X.item_input(F.col("_source")), "output_tokens": X.output(F.col("_source"))}).drop("_source")


def batches(items: DataFrame, keys: list[str], seq: str, tpm: int, max_output: int, max_items: int = 200) -> DataFrame:
    """batch_no (from 0) of each item: items of a job fill a batch in order until it has max_items or one of
    its token budgets would be passed; an item beyond a budget goes alone. Jobs are independent, and a job's items may be
    spread over any number of tasks."""
    return numbered_batches(items, keys, [seq, "input_tokens", "output_tokens"], X.input_budget(tpm), X.output_budget(max_output), max_items, X.BATCH_OVERHEAD)


def batch_totals(batched: DataFrame, keys: list[str]) -> DataFrame:
    """Items and estimated tokens of each batch, with what a request costs besides its items."""
    total = F.sum(F.col("input_tokens") + F.col("output_tokens")) + X.BATCH_OVERHEAD
    return batched.groupBy(*keys, "batch_no").agg(F.count("*").alias("items"), total.alias("total_tokens"))


def with_fallback(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Each unit's translation by its text, or the text itself where there is none or an empty one."""
    known = translations.select(F.col("text").alias("_text"), F.col("translated_text").alias("_translated")).dropDuplicates(["_text"])
    joined = units.join(known, F.col("text") == F.col("_text"), "left")
    return joined.withColumn("translation", F.coalesce(F.when(F.col("_translated") != "", F.col("_translated")), F.col("text"))).drop("_text", "_translated")


@dataclass
class Reply:
    texts: list[str]
    input_tokens: int = 0
    output_tokens: int = 0


class BatchFailed(Exception):
    """A reply that can't be used; a smaller batch may do."""


class Unavailable(Exception):
    """A provider that can't answer now: its status (0 without any answer), and how long it asks to be left alone."""

    def __init__(self, status: int, wait: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


Provider = Callable[[list[str]], Reply]


def stand_in(prefix: str = "vi:", most: int = 4) -> Provider:
    """A provider for tests: replies with prefix and text, and fails for batches of more than `most` texts."""

    def reply(texts: list[str]) -> Reply:
        if len(texts) > most:
            raise BatchFailed(f"{len(texts)} texts")
        return Reply([prefix + t for t in texts])

    return reply


def retrying(provider: Provider, delays: tuple[float, ...] = (1.0, 3.0, 8.0), passing: tuple[int, ...] = (0, 500, 502, 503, 504), sleep: Callable[[float], None] = time.sleep) -> Provider:
    """The provider, tried once more after each delay while its status is a passing one; other failures show at once.

    A request is retried within its task: a retried task would send all of its requests again."""

    def reply(texts: list[str]) -> Reply:
        for delay in (*delays, None):
            try:
                return provider(texts)
            except Unavailable as e:
                if delay is None or e.status not in passing:
                    raise
                sleep(delay if e.wait is None else max(e.wait, 0.0))
        raise AssertionError("the last try returns or raises")

    return reply


def falling_back(first: Provider, second: Provider) -> Provider:
    """The first provider's reply (say, a streamed one), or the second's where that is empty."""

    def reply(texts: list[str]) -> Reply:
        got = first(texts)
        return got if any(got.texts) else second(texts)

    return reply


def provider_of(registry: dict[str, Provider], name: str) -> Provider:
    """The provider of that name; the registry's order is that of display."""
    if name not in registry:
        raise KeyError(f"no provider {name}; there are {', '.join(registry)}")
    return registry[name]


RESULT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("text", T.StringType()), T.StructField("translated_text", T.StringType()), T.StructField("requests", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("error", T.StringType())])


def translate(batched: DataFrame, keys: list[str], provider: Provider, starts: DataFrame | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Sends every batch (keys, batch_no) through provider on the executors. Finished halves of a failing
    batch are kept: what can't be translated alone carries its error.

    starts (keys, batch_no, start: epoch seconds) are those of quota.schedule: a batch waits for its start, one whose start
    is null is not sent, and one that starts names not at all goes at once."""
    gathered = batched.groupBy(*keys, "batch_no").agg(F.array_sort(F.collect_list(F.struct(F.col("first_seen").cast("long").alias("seq"), "text", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens")))).alias("items"))
    schema = T.StructType([*gathered.select(*keys, "batch_no").schema.fields, *RESULT.fields])
    if starts is None:
        timed = gathered.withColumn("_start", F.lit(0.0))
    else:
        told = starts.select(*keys, "batch_no", F.coalesce("start", F.lit(float("nan"))).alias("_start"))
        timed = gathered.join(told, [*keys, "batch_no"], "left").withColumn("_start", F.coalesce("_start", F.lit(0.0))).sortWithinPartitions("_start")

    def settle(items: list[dict]) -> tuple[dict[int, tuple[str | None, str | None]], list[int]]:
        """place -> (translation, error), and the tokens of each request; ranges that fail are cut in two."""
        done: dict[int, tuple[str | None, str | None]] = {}
        spent: list[int] = []
        ranges = [(0, len(items))]
        while ranges:
            lo, hi = ranges.pop()
            estimate = X.BATCH_OVERHEAD + sum(int(x["tokens"]) for x in items[lo:hi])
            try:
                reply = provider([x["text"] for x in items[lo:hi]])
                if len(reply.texts) != hi - lo:
                    raise BatchFailed(f"{len(reply.texts)} replies for {hi - lo} texts")
            except BatchFailed as e:
                spent.append(estimate)
                mid = (lo + hi) // 2
                if hi - lo == 1:
                    done[lo] = None, str(e)
                else:
                    ranges += [(mid, hi), (lo, mid)]
                continue
            spent.append(reply.input_tokens + reply.output_tokens or estimate)
            done |= {lo + k: (x, None) for k, x in enumerate(reply.texts)}
        return done, spent

    def run(parts):
        import pandas as pd

        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                items = list(r["items"])
                if r["_start"] == r["_start"]:
                    sleep(max(0.0, r["_start"] - clock()))
                    done, spent = settle(items)
                else:
                    done, spent = dict.fromkeys(range(len(items)), (None, "the day's requests are used up")), []
                rows += [(*(r[k] for k in keys), r["batch_no"], x["seq"], x["text"], done[i][0], len(spent), sum(spent), done[i][1]) for i, x in enumerate(items)]
            yield pd.DataFrame(rows, columns=schema.names)

    return timed.mapInPandas(run, schema)


def progress(done: Column, total: Column, base: Column, batch: Column) -> Column:
    """Documents done so far: what a batch reports, within its size, on top of what was done before."""
    return F.least(base + F.greatest(F.lit(0), F.least(done, batch)), total)


def system_prompt(glossary: DataFrame, opening: str, language: str | None = None, batch: bool = False) -> DataFrame:
    """One row: the opening, the target language, the glossary's terms in its order (seq) and, for a batch, what its
    reply has to look like."""
    pairs = F.array_sort(F.collect_list(F.when((F.col("mode") == "translate") & (F.col("target") != ""), F.struct("seq", F.concat("source", F.lit(" -> "), "target").alias("t")))))
    kept = F.array_sort(F.collect_list(F.when(F.col("mode") == "keep", F.struct("seq", F.col("source").alias("t")))))
    parts = glossary.agg(F.array_join(F.transform(pairs, lambda x: x["t"]), "; ").alias("pairs"), F.array_join(F.transform(kept, lambda x: x["t"]), "; ").alias("kept"))
    lines = [F.lit(opening)]
    if language:
        lines.append(F.lit(f"Translate into {language}."))
    lines += [F.when(F.col("pairs") != "", F.concat(F.lit("Translate these terms exactly: "), "pairs", F.lit("."))), F.when(F.col("kept") != "", F.concat(F.lit("Keep these terms as they are: "), "kept", F.lit(".")))]
    if batch:
        lines.append(F.lit('Reply with JSON only: {"translations": [{"id": <the item\'s id>, "text": <its translation>}]}, one item for each id, in any order.'))
    return parts.select(F.array_join(F.array_compact(F.array(*lines)), "\n").alias("prompt"))


def batch_prompts(batched: DataFrame, keys: list[str], seq: str = "first_seen") -> DataFrame:
    """The user's part of each batch's request: its items as JSON, ids from 0 in order."""
    items = F.array_sort(F.collect_list(F.struct(seq, "text")))
    said = F.to_json(F.transform("items", lambda x, i: F.struct(i.alias("id"), x["text"].alias("text"))))
    return batched.groupBy(*keys, "batch_no").agg(items.alias("items")).select(*keys, "batch_no", F.size("items").alias("items"), said.alias("prompt"))
