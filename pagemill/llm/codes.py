"""Vector codes: vectors are cut into parts, and each part is replaced by its nearest entry of a trained codebook.

Vectors are kept as columnar blocks in a written table. Each round of training is one treeAggregate over them: a
block's distances to the entries accumulate dimension by dimension, np.add.at adds its parts to int64 tensors of sums
and counts, and the tensors, whose size is that of the codebooks, merge through a reduction tree. All arithmetic is
that of whole numbers, so results do not depend on the order of merging.

Defined cases: vectors that are null or hold null or non-finite components are left out; zero vectors are not; rows
equal in id, or in all, are rows of their own, and those of equal id come by their vectors where the first entries are
chosen; null ids come last there; vectors of each length have codebooks of their own; a length that the number of parts
does not divide gives the first parts one component more, and parts without components have the code 00 and no error;
fewer vectors than entries give as many entries as vectors; distances that tie go to the smaller index; whole numbers
beyond 64 bits are reckoned exactly, and an error that is larger than a long is given as the largest long; null labels
are one label; an empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import partitions, quoted, written

SCALE = 4096
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
LARGEST = 2**63 - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and v (doubles) of the vectors that take part."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad)


def blocks(rows: DataFrame) -> DataFrame:
    """rows as columnar blocks of one length of vector each: dim, ids, labels and columns (doubles, a column at a time).
    Nothing is shuffled."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("columns", T.BinaryType())])

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            v = b.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == d)
                step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(d, 1))))
                for at in range(0, len(which), step):
                    some = which[at : at + step]
                    columns = flat[starts[some][:, None] + np.arange(d)].T
                    lists = [pa.ListArray.from_arrays([0, len(some)], b.column(c).take(pa.array(some))) for c in ("id", "label")]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *lists, pa.array([np.ascontiguousarray(columns, "<f8").tobytes()], pa.binary())], names=["dim", "ids", "labels", "columns"])

    return written(rows.mapInArrow(pack, schema), "vector_blocks")


def whole(columns: bytes, dim: int, n: int, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of a block, dim x n: as int64, or as Python's whole numbers where those do not suffice."""
    x = np.frombuffer(columns, "<f8").reshape(dim, n)
    if not wide:
        return np.floor(x * scale).astype(np.int64)
    # From 2**52 on a double is a whole number, and its product may be beyond doubles.
    return np.array([int(v) * scale if abs(v) >= 2**52 else math.floor(v * scale) for v in x.ravel().tolist()], object).reshape(dim, n)


def edges(dim: int, parts: int) -> list[tuple[int, int]]:
    """First and last+1 component of each part: equal parts, the first ones longer by one where they can't be."""
    ends = np.cumsum([dim // parts + (p < dim % parts) for p in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def assigned(x: np.ndarray, book: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Code (parts x n) and squared distance of each part of a block x (dim x n) to book (dim x entries)."""
    codes, errors = np.zeros((parts, x.shape[1]), np.int64), np.zeros((parts, x.shape[1]), x.dtype)
    for p, (lo, hi) in enumerate(edges(len(x), parts)):
        if lo == hi:
            continue
        far = np.zeros((book.shape[1], x.shape[1]), x.dtype)
        for j in range(lo, hi):
            gap = x[j][None, :] - book[j][:, None]
            far += gap * gap
        codes[p] = far.argmin(axis=0)
        errors[p] = np.take_along_axis(far, codes[p][None, :], axis=0)[0]
    return codes, errors


class Codebooks:
    """Trained entries for each length of vector: `books` has one dim x entries tensor for each."""

    def __init__(self, books: dict[int, np.ndarray], parts: int, scale: int, wide: dict[int, bool]) -> None:
        self.books, self.parts, self.scale, self.wide = books, parts, scale, wide

    def entries(self, dim: int) -> list[list[list[int]]]:
        """By part, entry and position within the part."""
        return [[[int(v) for v in self.books[dim][lo:hi, e]] for e in range(self.books[dim].shape[1])] for lo, hi in edges(dim, self.parts)]

    def sha256(self, dim: int) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries(dim) for entry in part for v in entry).encode()).hexdigest()

    def decoded(self, dim: int, code: str) -> list[int]:
        """The whole numbers that a code stands for."""
        return [v for p, part in enumerate(self.entries(dim)) if part[0] for v in part[int(code[2 * p : 2 * p + 2], 16)]]


def _first(table: DataFrame, entries: int, scale: int) -> dict[int, tuple[int, float, list]]:
    """For each length: how many vectors, the largest component and the vectors of the smallest ids."""

    def add(state, row):
        n, d = len(row.ids), row.dim
        x = np.frombuffer(bytes(row["columns"]), "<f8").reshape(d, n)
        held = state.get(d, (0, 0.0, []))
        # A block's smallest ids and those equal to the last of them, so that ties go by vectors.
        ids = [(i is None, 0 if i is None else i) for i in row.ids]
        last = heapq.nsmallest(entries, ids)[-1]
        new = [(key, whole(np.ascontiguousarray(x[:, i : i + 1]).tobytes(), d, 1, scale, True)[:, 0].tolist()) for i, key in enumerate(ids) if key < last]
        same = heapq.nsmallest(entries - len(new), (whole(np.ascontiguousarray(x[:, i : i + 1]).tobytes(), d, 1, scale, True)[:, 0].tolist() for i, key in enumerate(ids) if key == last))
        new += [(last, v) for v in same]
        state[d] = (held[0] + n, max(held[1], float(np.abs(x).max(initial=0.0))), heapq.nsmallest(entries, held[2] + new))
        return state

    def join(a, b):
        for d, (n, top, some) in b.items():
            held = a.get(d, (0, 0.0, []))
            a[d] = (held[0] + n, max(held[1], top), heapq.nsmallest(entries, held[2] + some))
        return a

    return table.select("dim", "ids", "columns").rdd.treeAggregate({}, add, join)


def trained(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> Codebooks:
    """Codebooks of the blocks in table."""
    first = _first(table, entries, scale)
    # int64 where no distance of a vector and no sum of a round can leave it.
    reach = {d: int(top) * scale + scale for d, (_, top, _) in first.items()}
    wide = {d: max(4 * max(d, 1) * reach[d] ** 2, n * reach[d]) >= 2**62 for d, (n, _, _) in first.items()}
    books = {d: np.array([v for _, v in some], object).reshape(len(some), d).T.astype(object if wide[d] else np.int64) for d, (_, _, some) in first.items()}
    for _ in range(rounds):

        def add(state, row, books=books):
            d, n = row.dim, row.n
            x, book = whole(bytes(row["columns"]), d, n, scale, wide[d]), books[d]
            if d not in state:
                state[d] = (np.zeros(book.shape, book.dtype), np.zeros((parts, book.shape[1]), np.int64))
            sums, counts = state[d]
            codes, _ = assigned(x, book, parts)
            for p, (lo, hi) in enumerate(edges(d, parts)):
                np.add.at(counts[p], codes[p], 1)
                for j in range(lo, hi):
                    np.add.at(sums[j], codes[p], x[j])
            return state

        def join(a, b):
            for d, (sums, counts) in b.items():
                a[d] = (a[d][0] + sums, a[d][1] + counts) if d in a else (sums, counts)
            return a

        found = table.select("dim", F.size("ids").alias("n"), "columns").rdd.treeAggregate({}, add, join)
        new = {}
        for d, (sums, counts) in found.items():
            of_each = np.concatenate([np.broadcast_to(counts[p], (hi - lo, counts.shape[1])) for p, (lo, hi) in enumerate(edges(d, parts))])
            new[d] = np.where(of_each > 0, sums // np.maximum(of_each, 1), books[d])
        books = new
    return Codebooks(books, parts, scale, wide)


def encoded(table: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code, error and codebooks_sha256 of each vector in the blocks of table."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    schema = T.StructType([T.StructField("id", kinds["ids"].elementType), T.StructField("label", kinds["labels"].elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    digests = {d: books.sha256(d) for d in books.books}
    digits = np.array([f"{i:02x}" for i in range(256)])

    def code(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                d, ids, labels = b.column("dim")[i].as_py(), b.column("ids")[i].values, b.column("labels")[i].values
                codes, errors = assigned(whole(b.column("columns")[i].as_py(), d, len(ids), books.scale, books.wide[d]), books.books[d], books.parts)
                text = digits[codes.T]
                total = [min(int(e), LARGEST) for e in errors.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(["".join(t) for t in text.tolist()], pa.string()), pa.array(total, pa.int64()), pa.array([digests[d]] * len(ids), pa.string())], names=["id", "label", "code", "error", "codebooks_sha256"])

    return table.mapInArrow(code, schema)


def with_sums(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows with `out`: the sum of value (long) over the rows equal in key, nulls together.

    Sums are made before anything is shuffled. A key with more than its share of all rows gets its sum by a broadcast,
    which holds as many keys as there are partitions at most; the others meet theirs in a join that none of them can
    make lopsided."""
    share = partitions(rows.sparkSession)
    sums = written(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(F.col(value).cast("decimal(20,0)")).alias("_sum"), F.count("*").alias("_n")), "sums")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    sums = sums.select("_key", F.least(F.col("_sum"), F.lit(LARGEST).cast("decimal(20,0)")).cast("long").alias(out), (F.col("_n") * share > total).alias("_hot"))
    hot, cold = sums.filter("_hot").drop("_hot"), sums.filter("NOT _hot").drop("_hot")
    on = F.col(key).eqNullSafe(F.col("_key"))
    often = rows.join(F.broadcast(hot), on).drop("_key")
    seldom = rows.join(F.broadcast(hot.select("_key")), on, "left_anti").join(cold, on).drop("_key")
    return often.unionByName(seldom)


def compressed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """id, label, code, error, codebooks_sha256 and label_error of each usable vector, and the codebooks."""
    table = blocks(usable(vectors, id_col, vector_col, label_col))
    books = trained(table, parts, entries, rounds, scale)
    return with_sums(written(encoded(table, books), "codes"), "label", "error", "label_error"), books


def op11_codes(spark, sf_dir: str) -> DataFrame:
    rows, _ = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> str:
    """Each part a row, each round a step of its own; sums are floored by what is left over."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT p.rid, p.part, c.entry, coalesce(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0)::HUGEINT AS far
  FROM p JOIN c{r} c ON c.dim = p.dim AND c.part = p.part),
a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM d{r} GROUP BY rid, part)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT dim, part, entry, pos, sum(v) AS s, count(*) AS n FROM (
    SELECT p.dim, p.part, a.entry, unnest(p.x) AS v, unnest(range(1, len(p.x) + 1)) AS pos FROM p JOIN a{r} a ON a.rid = p.rid AND a.part = p.part) GROUP BY ALL),
u{r} AS (SELECT dim, part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS x FROM s{r} GROUP BY dim, part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.dim, c.part, c.entry, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN u{r} u ON u.dim = c.dim AND u.part = c.part AND u.entry = c.entry)""")
    chain = ",\n".join(steps)
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, len(embedding) AS dim, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY vec_id NULLS LAST, w) - 1 AS place FROM e),
p AS MATERIALIZED (SELECT rid, dim, place, k AS part, w[k * (dim // {parts}) + least(k, dim % {parts}) + 1 : (k + 1) * (dim // {parts}) + least(k + 1, dim % {parts})] AS x FROM b, range({parts}) t(k)),
c0 AS MATERIALIZED (SELECT dim, part, place AS entry, x FROM p WHERE place < {entries}),
{chain},
h AS (SELECT dim, sha256(array_to_string(flatten(list(x ORDER BY part, entry)), ',')) AS codebooks_sha256 FROM c{rounds} GROUP BY dim),
o AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT e.vec_id, o.code, o.error, sum(o.error) OVER (PARTITION BY e.label)::BIGINT AS label_error, h.codebooks_sha256
FROM e JOIN o USING (rid) JOIN h USING (dim)
"""


ORACLE = _oracle()
