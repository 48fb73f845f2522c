"""Exact nearest neighbours by inner product: a block matrix join with int8 tiles.

Vectors are packed into blocks. Each block of queries meets each block of rows as one tile: an int8 product
gives every inner product with a bound on its quantisation error. Pairs whose upper bound reaches the k-th
best lower bound are recomputed in double precision, and heaps of k merge the tiles.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
vectors with a null id; of rows that are equal in id and vector one counts; several vectors under one id
are rows of their own, as queries too (each has a list), but no row is compared with its own id; vectors of other lengths than the query's are
no candidates of it; ties go to the smaller id; fewer candidates than k give them all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import written

BLOCK = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])
FOUND = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("query_no", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("scores", T.BinaryType())])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~bad & some).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).dropDuplicates()


def blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """rows (id, v) in blocks of about per_block by a hash of the whole row; of one length of vector each."""
    n = max(1, -(-rows.count() // per_block))
    keyed = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias("block"), "id", "v")

    def pack(table):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        d = table.column("dim")[0].as_py()
        flat = table.column("v").combine_chunks()
        flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return pa.table({"dim": pa.array([d], pa.int32()), "block": table.column("block").slice(0, 1), "ids": [ids[order].tobytes()], "vectors": [np.ascontiguousarray(flat.reshape(-1, d)[order]).tobytes()]})

    return keyed.groupBy("dim", "block").applyInArrow(pack, BLOCK)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and the sum of absolute quantised values of each row."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # the largest component underflows when divided
    q = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    return q, scale, scale * np.abs(q.astype(np.int32)).sum(axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, component after component, so equal rows give equal sums."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Heaps:
    """The k best of each query so far: scores falling, ids rising among equals."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def push(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        import heapq

        for r, lo, hi in zip(*_groups(rows), strict=True):
            held = [(-s, i) for s, i in zip(self.scores[r], self.ids[r], strict=True) if i != np.iinfo(np.int64).max]
            best = heapq.nsmallest(self.k, [*held, *zip(-scores[lo:hi], ids[lo:hi], strict=True)])
            self.scores[r, : len(best)] = [-s for s, _ in best]
            self.ids[r, : len(best)] = [i for _, i in best]


def _groups(rows: np.ndarray):
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    return rows[at].tolist(), at.tolist(), [*at[1:].tolist(), len(rows)]


def tile(heaps: Heaps, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> None:
    qa, sa, na = quantised(q)
    qb, sb, nb = quantised(x)
    d = q.shape[1]
    approx = np.zeros((len(q), len(x)))
    for c in range(0, d, 1024):  # sums of 1024 products of int8 stay below 2**24: exact in float32
        approx += qa[:, c : c + 1024].astype(np.float32) @ qb[:, c : c + 1024].astype(np.float32).T
    approx *= sa[:, None] * sb
    bound = 0.5 * (sa[:, None] * nb + na[:, None] * sb) + d * 0.25 * sa[:, None] * sb
    bound = bound * (1 + 1e-9) + 1e-12 * (np.abs(approx) + bound)
    own = q_ids[:, None] == ids
    low = np.where(own, -np.inf, approx - bound)
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        floor = np.full(len(q), -np.inf)
    floor = np.maximum(floor, heaps.scores[:, -1])
    rows, cols = np.nonzero((approx + bound >= floor[:, None]) & ~own)
    for a in range(0, len(rows), 1 << 16):
        r, c = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
        heaps.push(r, ids[c], exact(q[r], x[c]))


def nearest(queries: DataFrame, base: DataFrame, k: int = 20, query_block: int = 512, base_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of base (id, v) with the largest inner products, for each
    of queries (id, v), but those with the query's own id."""
    b = written(blocks(base, base_block), "base_blocks")
    a = written(blocks(queries, query_block), "query_blocks")
    # A query block goes to every block of rows: that is the tiles of the product, each made once.
    by_dim = b.groupBy(F.col("dim").alias("_dim")).agg(F.max("block").alias("_last"))
    sent = a.join(F.broadcast(by_dim), F.col("dim") == F.col("_dim")).select("dim", F.col("block").alias("query_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), "_last")).alias("block"))
    tiles = sent.join(b, ["dim", "block"]).select("dim", "query_block", "q_ids", "q_vectors", "ids", "vectors")

    def multiply(batches):
        import pyarrow as pa

        held: dict = {}

        def flush():
            ids, dims, nos, tops, scores = [], [], [], [], []
            for (no, d), (q_ids, _, heaps) in held.items():
                for i in range(len(q_ids)):
                    full = heaps.ids[i] != np.iinfo(np.int64).max
                    ids.append(int(q_ids[i]))
                    dims.append(d)
                    nos.append((no << 32) + i)
                    tops.append(heaps.ids[i][full].tobytes())
                    scores.append(heaps.scores[i][full].tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(nos, pa.int64()), pa.array(tops, pa.binary()), pa.array(scores, pa.binary())], names=["query_id", "dim", "query_no", "ids", "scores"])

        for batch in batches:
            for d, no, qi, qv, bi, bv in zip(*(batch.column(c).to_pylist() for c in ("dim", "query_block", "q_ids", "q_vectors", "ids", "vectors")), strict=True):
                if (no, d) not in held:
                    if len(held) >= 256:  # heaps of 131,072 queries
                        yield flush()
                    q_ids = np.frombuffer(qi, np.int64)
                    held[no, d] = (q_ids, np.frombuffer(qv).reshape(-1, d), Heaps(len(q_ids), k))
                q_ids, q, heaps = held[no, d]
                ids, x = np.frombuffer(bi, np.int64), np.frombuffer(bv).reshape(-1, d)
                for s in range(0, len(ids), base_block):  # a block of copies may be larger
                    tile(heaps, q_ids, q, ids[s : s + base_block], x[s : s + base_block], k)
        if held:
            yield flush()

    partial = tiles.mapInArrow(multiply, T.StructType([T.StructField("query_id", T.LongType()), *FOUND.fields]))

    def merge(key, table):
        import heapq

        import pyarrow as pa

        rows = (zip(-np.frombuffer(s), np.frombuffer(i, np.int64), strict=True) for i, s in zip(table.column("ids").to_pylist(), table.column("scores").to_pylist(), strict=True))
        best = heapq.nsmallest(k, dict.fromkeys((float(s), int(i)) for r in rows for s, i in r))
        n = len(best)
        return pa.table({"query_id": pa.array([key[0].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array([i for _, i in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.float64())})

    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    return partial.groupBy("query_id", "dim", "query_no").applyInArrow(merge, out)


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = written(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors")
    return nearest(rows.filter("id % 20 = 0"), rows)


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, q.e AS query, b.vec_id, list_reduce(list_transform(list_zip(q.e, b.e), lambda p: p[1] * p[2]), lambda x, y: x + y) AS score
      FROM v q JOIN v b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id AND len(b.e) = len(q.e)),
r AS (SELECT query_id, query, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
