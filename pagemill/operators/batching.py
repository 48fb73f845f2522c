"""Batches of a job's items in order, for jobs of any size.

Where a batch ends that begins at an item is a search in prefix sums. A job is cut into blocks of items; for each block,
pointers are doubled until they leave it, which says for every item that a batch may begin with where the next block's
first batch begins, and how many batches begin here. A job's blocks, not its items, are then gone through in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.folds import fold, numbered, starts, whole_groups
from pagemill.session import kept

#: Items of a job that one task takes at a time; more than a batch has.
BLOCK = 1 << 14


def _numbers(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _ends(table, first: np.ndarray, into: int | None, out: int | None, most: int, overhead: int) -> np.ndarray:
    """Where the batch ends that begins at each row of the groups that begin at `first`: the row behind it."""
    n = table.num_rows
    rows, end = np.arange(n), np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    reach = np.minimum(rows + most, end)
    for name, budget in (("input_tokens", None if into is None else into - overhead), ("output_tokens", out)):
        if budget is not None:
            total = np.concatenate([[0], np.cumsum(_numbers(table, name))])
            reach = np.minimum(reach, np.searchsorted(total, total[:-1] + budget, "right") - 1)
    return np.maximum(reach, rows + 1)


def _jumps(items: DataFrame, keys: list[str], limits: tuple) -> DataFrame:
    """Of each block: exits (the item of the next one at which its first batch begins) and begun (batches that begin here),
    for each of the block's first items that a batch may begin with."""
    most = limits[2]
    group = [*keys, "_block"]
    schema = T.StructType([*[items.schema[k] for k in group], T.StructField("exits", T.ArrayType(T.IntegerType())), T.StructField("begun", T.ArrayType(T.IntegerType()))])
    # A block sees the items behind it that its last batch may still take.
    ahead = F.when((F.col("_block") > 0) & (F.col("_at") % BLOCK < most), F.array(F.col("_block"), F.col("_block") - 1)).otherwise(F.array("_block"))
    seen = items.withColumn("_block", F.explode(ahead))

    def jump(batches):
        import pyarrow as pa

        for table in whole_groups(batches, group):
            first = np.flatnonzero(starts(table, group))
            sizes = np.diff(np.append(first, table.num_rows))
            to, inside = _ends(table, first, *limits), _numbers(table, "_at") // BLOCK == _numbers(table, "_block")
            at = np.append(to, 0)[: table.num_rows + 1]
            at = np.where(np.append(inside, False), at, np.arange(table.num_rows + 1))
            begun = np.append(inside, False).astype(np.int64)
            for _ in range(int(sizes.max()).bit_length()):
                # The row behind all, and behind a group, stands for itself once it is reached.
                begun, at = begun + np.where(begun > 0, _within(begun, at, first, sizes), 0), _follow(at, first, sizes)
            own = np.add.reduceat(inside.astype(np.int64), first)
            rows = [(slice(f, f + min(most, k)), f + k) for f, k in zip(first.tolist(), own.tolist(), strict=True)]
            columns = [table.column(k).take(pa.array(first)).combine_chunks() for k in group]
            lists = [pa.array([(at[s] - e).tolist() for s, e in rows], pa.list_(pa.int32())), pa.array([begun[s].tolist() for s, _ in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[c if not isinstance(c, pa.ChunkedArray) else c.chunk(0) for c in columns], *lists], names=[*group, "exits", "begun"])

    return seen.repartition(*group).sortWithinPartitions(*group, "_at").mapInArrow(jump, schema)


def _follow(at: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at of at, but what points behind its own group stays."""
    end = np.append(np.repeat(first + sizes, sizes), len(at))
    return np.where(at < end, at[np.minimum(at, len(at) - 1)], at)


def _within(value: np.ndarray, at: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """value where at points, none behind its own group."""
    end = np.append(np.repeat(first + sizes, sizes), len(at))
    return np.where(at < end, value[np.minimum(at, len(at) - 1)], 0)


def numbered_batches(items: DataFrame, keys: list[str], order: list[str], into: int | None, out: int | None, most: int, overhead: int) -> DataFrame:
    """items (input_tokens, output_tokens) with batch_no, from 0 in each job (keys)."""
    if most > BLOCK:
        raise ValueError(f"a batch has at most {BLOCK} items")
    limits = (into, out, most, overhead)
    # Ranges are drawn from a pass of their own, which would size every item once more.
    placed = kept(numbered(kept(items, "sized"), keys, order, "_at").withColumn("_block", F.expr(f"_at div {BLOCK}")), "items")
    group = [*keys, "_block"]
    large = placed.filter(F.col("_at") >= BLOCK)
    if large.isEmpty():
        entered = placed.withColumn("_entry", F.lit(0).cast("long"))
    else:
        some = large.select(*keys).distinct()
        jumps = _jumps(_beside(placed, some, keys, "left_semi").select(*keys, "_at", "_block", "input_tokens", "output_tokens"), keys, limits)

        def step(state, exits, begun):
            entry, before = state
            following = (exits[entry], before + begun[entry]) if entry < len(exits) else (0, before)
            return following, before << 20 | entry

        entries = fold(jumps, keys, ["_block"], ["exits", "begun"], (0, 0), step, T.StructField("_entry", T.LongType())).select(*group, "_entry")
        entered = _beside(placed, entries, group, "left").withColumn("_entry", F.coalesce("_entry", F.lit(0).cast("long")))
    names = items.columns
    schema = T.StructType([*items.schema.fields, T.StructField("batch_no", T.IntegerType())])

    def number(batches):
        import pyarrow as pa

        for table in whole_groups(batches, group):
            first = np.flatnonzero(starts(table, group))
            sizes, to, entry = np.diff(np.append(first, table.num_rows)), _ends(table, first, *limits), _numbers(table, "_entry")[first]
            begins, at, end = np.zeros(table.num_rows, np.int64), first + (entry & ((1 << 20) - 1)), first + sizes
            while len(at):  # the next batch of every group at once
                inside = at < end
                at, end = at[inside], end[inside]
                begins[at] = 1
                at = to[at]
            seen = np.cumsum(begins)
            base = np.repeat((entry >> 20) - seen[first] + begins[first], sizes)
            yield from table.select(names).append_column("batch_no", pa.array((base + seen - 1).astype(np.int32))).to_batches()

    return entered.repartition(*group).sortWithinPartitions(*group, "_at").mapInArrow(number, schema)


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys of which any may be null."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])
