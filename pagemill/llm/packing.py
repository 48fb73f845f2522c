"""Packing of tokenised documents into sequences of at most `capacity` tokens.

The lengths' histogram (at most `capacity` bins, whatever the number of documents) gives a configuration
linear program: a configuration is a multiset of lengths that fits one sequence, and uses of configurations
cover the count of each length. Multiplicative weights solve it over the configurations known so far and give
prices of lengths; a knapsack dynamic program over the prices finds new ones and a lower bound; both go on in
turn until uses and bound are within `gap`. The uses are rounded down, and what is left is packed best fit, on
the histogram too. The plan is a table of runs (length, first place, configuration), so each piece finds its
sequence from its own place among the pieces of its length.

Defined cases: null text is empty (one token: the end id); repeated rows are packed each; pieces of equal length
are placed by checksum, then doc_id and piece, so reruns agree; an empty table gives an empty result; texts of any
length are read whole; other columns are ignored, whatever their names."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagemill.llm.shared import running_total, text_of, written

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
#: Code points that str.split() takes for white space and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"


class WordTokens:
    """Token ids (little-endian uint32 bytes) of texts, for the lower-case word BPE of word_bpe_49k.json.

    That tokenizer treats the white-space separated parts of a text one by one, and runs of letters,
    digits and other signs within a part one by one. So parts and runs are looked up in bounded caches,
    which outlive the task, and only new runs of letters are encoded. Parts beyond Latin-1, where lower
    case and normal forms need more care, are encoded whole."""

    #: The tokenizer's split pattern within Latin-1 in lower case, where no white space is left.
    RUN = r"'(?:[stmd]|re|ve|ll)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"

    def __init__(self, path: str, most: int = 600_000) -> None:
        import re

        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.parts: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.find = re.compile(self.RUN).findall
        ends = self.tokenizer.get_vocab(True)
        self.last = np.zeros(max(ends.values()) + 1, bool)
        self.last[[i for w, i in ends.items() if w.endswith("</w>")]] = True

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> None:
        cut, odd = {}, []
        for w in missing:
            if w.isascii() or max(w) <= "ÿ":
                if "<|" in w or "\x85" in w or "\xa0" in w:
                    odd.append(w)
                else:
                    cut[w] = self.find(w.lower())
            else:
                odd.append(w)
        if odd:
            self.parts.update(zip(odd, self.plain(odd), strict=True))
        runs = self.runs
        fresh = list({r for x in cut.values() for r in x if r not in runs})
        if fresh:
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(fresh):
                data, at = ids.tobytes(), 0
                for r, e in zip(fresh, (ends * 4).tolist(), strict=True):
                    runs[r] = data[at:e]
                    at = e
            else:
                runs.update(zip(fresh, self.plain(fresh), strict=True))
        for w, x in cut.items():
            self.parts[w] = b"".join([runs[r] for r in x])

    def ids(self, text: str) -> bytes:
        if any(c in text for c in _ODD):
            return self.plain([text])[0]
        words, parts = text.split(), self.parts
        try:
            return b"".join(map(parts.__getitem__, words))
        except KeyError:
            missing = [w for w in set(words) if w not in parts]
        if len(parts) + len(missing) > self.most or len(self.runs) > self.most:
            parts.clear()
            self.runs.clear()
            missing = list(set(words))
            if len(missing) > self.most:
                return self.plain([text])[0]
        self._learn(missing)
        return b"".join(map(parts.__getitem__, words))


def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, so that its caches serve all of the worker's tasks."""
    import sys

    held = sys.modules.setdefault("_pagemill_words", type(sys)("_pagemill_words"))
    if path not in vars(held):
        setattr(held, path, WordTokens(path))
    return getattr(held, path)


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document: its ids, then end_id."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *PIECES.fields[1:]])

    def cut(batches):
        import os
        import zlib

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = word_tokens(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = words.ids(t) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for x, v in zip(rows, (d, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field("doc_id").type), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, schema)


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to capacity the best total price of lengths (sorted) that fit, and the place in lengths of
    one that such a filling holds (-1: none more than a room of one less)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
    if (capacity // lengths).sum() < 4 * capacity:
        # Few or long lengths: one length after another, in blocks of its own size.
        for i, length in enumerate(lengths.tolist()):
            for lo in range(length, capacity + 1, length):
                hi = min(lo + length, capacity + 1)
                value = best[lo - length : hi - length] + price[i]
                better = value > best[lo:hi] + 1e-15
                best[lo:hi][better] = value[better]
                last[lo:hi][better] = i
        return best, last
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        value = best[room - lengths[: fit[room]]] + price[: fit[room]]
        i = int(value.argmax())
        best[room] = best[room - 1]
        if value[i] > best[room] + 1e-15:
            best[room], last[room] = value[i], i
    return best, last


def _filling(lengths: np.ndarray, last: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while room >= lengths[0]:
        i = int(last[room])
        if i < 0:
            room -= 1
        else:
            out[i] = out.get(i, 0) + 1
            room -= int(lengths[i])
    return out


def best_fit(left: dict[int, int], capacity: int, opened: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """(configuration, times): left[length] pieces packed best fit, longest first, into opened sequences and new
    ones. Sequences of equal configuration move together, so the work grows with distinct lengths."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(config: dict[int, int], times: int) -> None:
        room = capacity - sum(k * v for k, v in config.items())
        groups.setdefault(room, []).append((config, times))
        if len(groups[room]) == 1:
            insort(rooms, room)

    rooms: list[int] = []
    for config, times in opened:
        put(config, times)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                v = min(capacity // length, n)
                put({length: v}, n // v)
                n %= v
                continue
            room = rooms[at]
            config, times = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            k = min(times, n)
            if k < times:
                put(config, times - k)
            put({**config, length: config.get(length, 0) + 1}, k)
            n -= k
    return [x for g in groups.values() for x in g]


def _weighed(entries: tuple[np.ndarray, np.ndarray, np.ndarray], m: int, x: np.ndarray, steps: int, end: float):
    """Multiplicative weights over known configurations: columns x cover every length; a length's weight falls
    exponentially with its cover, and a column grows or shrinks by what it is worth at these weights.

    entries: column, length and share of the length's pieces that one sequence of the column holds. Gives the best
    cover, its sum, the weights' average, their value, and the last columns. Ends when both values meet."""
    col, row, share = entries
    k = len(x)
    cover = lambda x: np.bincount(row, share * x[col], m)
    least, best, value, weights, spread = np.inf, x, 0.0, np.full(m, 1 / m), 0.2
    while True:
        eta, w_sum, x_sum = np.log(m + 1) / spread, np.zeros(m), np.zeros(k)
        for step in range(1, steps + 1):
            c = cover(x)
            x, c = x / c.min(), c / c.min()
            total = x.sum()
            if total < least:
                least, best = total, x
            w = np.exp(-eta * (c - 1))
            w /= w.sum()
            w_sum += w
            x_sum += x / total
            worth = np.bincount(col, share * w[row], k)
            x = x * np.exp(0.7 / eta * np.clip(worth * total - 1, -3, 3))
            if step % 50 == 0:
                mean = w_sum / w_sum.sum()
                bound = 1 / np.bincount(col, share * mean[row], k).max()
                if bound > value:
                    value, weights = bound, mean
                even = x_sum / cover(x_sum).min()
                if even.sum() < least:
                    least, best = even.sum(), even
                if least <= value * (1 + spread / 2):
                    break
                if step % 200 == 0:
                    w_sum *= 0.3
                    x_sum *= 0.3
        x = np.maximum(x, 1e-7 * x.max() / k)
        if spread <= end or least <= value * (1 + end):
            return best, least, weights, value, x
        spread /= 2.5


def linear_program(counts: dict[int, int], capacity: int = 4096, gap: float = 0.003, rounds: int = 40, columns: int = 512, steps: int = 1500) -> tuple[list[dict[int, int]], np.ndarray, float]:
    """Configurations, how often each is used (fractions) and a lower bound on the number of sequences.

    Minimises the sum of uses that cover every length's count. Rounds of multiplicative weights over the known
    configurations give prices of lengths; a knapsack over the prices finds better configurations and proves a
    bound: prices at which no configuration is worth more than 1 sum up to no more than the least number. Ends when
    cover and bound differ by less than `gap`, or after `rounds`. The first configurations are best fit's."""
    if not counts:
        return [], np.zeros(0), 0.0
    lengths = np.asarray(sorted(counts), np.int64)
    n = np.asarray([counts[x] for x in lengths.tolist()], float)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    configs: list[dict[int, int]] = []
    seen: set[tuple] = set()
    parts: list[list] = [[], [], []]

    def add(config: dict[int, int]) -> bool:
        key = tuple(sorted(config.items()))
        if key in seen:
            return False
        seen.add(key)
        for i, v in key:
            for p, y in zip(parts, (len(configs), i, v / n[i]), strict=True):
                p.append(y)
        configs.append(config)
        return True

    uses: list[float] = []
    for config, times in best_fit(counts, capacity):
        if add({place[k]: v for k, v in config.items()}):
            uses.append(float(times))
    x, price, bound = np.asarray(uses), lengths / capacity, 0.0
    least, best = float(x.sum()), x  # best fit covers each length as often as it has to
    whole, marks = int(x.sum()), []
    for _ in range(rounds):
        worth, last = knapsack(lengths, price, capacity)
        bound = max(bound, float(price @ n) / worth[capacity])
        if least <= bound * (1 + gap) or whole <= math.ceil(bound - 1e-6):
            break
        marks.append((least, bound))
        if len(marks) > 5 and marks[-6][0] - least + bound - marks[-6][1] < 1e-4 * least:
            break
        value = price + worth[capacity - lengths]
        fresh = 0
        for i in np.argsort(-value, kind="stable")[:columns].tolist():
            config = _filling(lengths, last, capacity - int(lengths[i]))
            config[i] = config.get(i, 0) + 1
            fresh += add(config)
        x = np.concatenate([x, np.full(fresh, max(x.sum(), 1.0) * 0.2 / max(fresh, 1))])
        entries = tuple(np.asarray(p) for p in parts)
        some, total, weights, known, x = _weighed(entries, len(lengths), x, steps, gap / 2)
        price = weights / n * known
        if total < least:
            least, best = total, some
    uses = np.zeros(len(configs))
    uses[: len(best)] = best
    named = [{int(lengths[i]): v for i, v in c.items()} for c in configs]
    return named, uses, bound


def rounded(counts: dict[int, int], configs: list[dict[int, int]], uses: np.ndarray, capacity: int, up: float) -> list[tuple[dict[int, int], int]]:
    """Uses rounded down (after adding `up`), the most used first, each as far as pieces are left; then best fit."""
    left, out = dict(counts), []
    for c in np.argsort(-uses, kind="stable").tolist():
        times = int(uses[c] + up)
        if not times:
            break
        config = configs[c]
        while times:
            # What is covered more than once runs out: the configuration goes on without it.
            config = {k: min(v, left[k]) for k, v in config.items() if left[k]}
            if not config:
                break
            now = min(times, *(left[k] // v for k, v in config.items()))
            out.append((config, now))
            for k, v in config.items():
                left[k] -= now * v
            times -= now
    return best_fit({k: v for k, v in left.items() if v}, capacity, out)


def plan(counts: dict[int, int], capacity: int = 4096, **how) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) that pack counts[length] pieces of each length: the linear program's uses, rounded
    down; of a few ways of rounding the one with the fewest sequences."""
    configs, uses, _ = linear_program(counts, capacity, **how)
    tries = [rounded(counts, configs, uses, capacity, up) for up in (0.0, 0.02, 0.25, 0.5, 0.75)]
    return min([*tries, best_fit(counts, capacity)], key=lambda x: sum(n for _, n in x)) if counts else []


def pack(pieces: DataFrame, capacity: int = 4096, **how) -> DataFrame:
    """Adds sequence_id and offset (long) to pieces (doc_id, piece, length in 1..capacity, ...).

    Only the histogram comes to the driver, and only the plan's runs go out; both are bounded by capacity,
    rounds and columns."""
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence, seen = 0, {}
    for config, times in plan(counts, capacity, **how):
        at = 0
        for length, v in config.items():
            runs.setdefault(length, []).append((seen.get(length, 0), sequence, v, at))
            seen[length] = seen.get(length, 0) + times * v
            at += length * v
        sequence += times
    table = {k: np.asarray(v, np.int64) for k, v in runs.items()}
    from pyspark.sql import functions as F

    placed = running_total(pieces.withColumn("_one", F.lit(1).cast("long")), ["length"], ["ids_crc32", "doc_id", "piece"], "_one", "_place").drop("_one", "_row")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def place(batches):
        import pyarrow as pa

        for b in batches:
            length, at = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_place"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                r, k = table[int(length[rows[0]])], at[rows] - 1
                i = np.searchsorted(r[:, 0], k, "right") - 1
                k = k - r[i, 0]
                seq[rows] = r[i, 1] + k // r[i, 2]
                off[rows] = r[i, 3] + k % r[i, 2] * length[rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return placed.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    return pack(written(tokenised(docs, tokenizer, capacity), "pieces"), capacity)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)
