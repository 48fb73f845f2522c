"""Folds over ordered rows, in one pass: what a row gets depends on the rows of its group before it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.session import kept


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: tuple, step: Callable, out: T.StructField) -> DataFrame:
    """df with `out`. step(state, *inputs of the row) gives the next state and the row's value; each group (keys)
    begins with start. Rows stream through in order, so no group is gathered anywhere, whatever its size."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, out])

    def run(batches):
        import pyarrow as pa

        kind = {"int": pa.int32(), "bigint": pa.int64()}[out.dataType.simpleString()]
        group, state = None, start
        for b in batches:
            rows = zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), *(b.column(c).to_pylist() for c in inputs), strict=True)
            values = []
            for key, *row in rows:
                if key != group:
                    group, state = key, start
                state, value = step(state, *row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, kind)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def starts(rows, names: list[str]) -> np.ndarray:
    """Of ordered Arrow rows: which differ from the one before in names; the first one does."""
    import pyarrow.compute as pc

    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in names:
        c = rows.column(name)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        new[1:] |= ~pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False).astype(bool)
    return new


def whole_groups(batches, names: list[str]):
    """Tables of whole groups, equal in names, out of ordered batches: a group that ends with its batch waits for the
    next one."""
    import pyarrow as pa

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(np.flatnonzero(starts(table, names))[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """df with `out`: the row's place within its group (keys), from 0, in order.

    Rows are dealt by ranges of keys and order and counted there, so a group may span any number of tasks; what stands
    before a range in its first group comes from a table of one row a range at most."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = starts(b, keys)
            first = tuple(b.column(k)[0].as_py() for k in keys)
            begin = np.flatnonzero(new)
            base = np.repeat(begin, np.diff(np.append(begin, b.num_rows)))
            local = np.arange(b.num_rows, dtype=np.int64) - base
            if first == last:
                local[: begin[1] if len(begin) > 1 else b.num_rows] += seen
            last, seen = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(local)], names=schema.names)

    here = kept(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(count, schema), "places")
    ends = here.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ends.withColumn("_before", before).filter("_before > 0").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_before")
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = here.join(F.broadcast(offsets), on, "left")  # one row for each range at most
    return joined.select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(out))
