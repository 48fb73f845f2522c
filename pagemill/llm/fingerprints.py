"""MinHash fingerprints of documents, and near-duplicates by banded signatures.

A signature holds, for each of `perms` universal hash functions, the least value over the text's shingles of
five words. The share of equal places of two signatures estimates the Jaccard similarity of the shingle
sets. Signatures are cut in bands, bands are joined in Spark, and what meets in a band is verified.

Defined cases: null text is empty; a text of fewer than five words is one shingle of all its words; empty
texts share one signature, of no shingle, and are alike; repeated rows are each fingerprinted; rows of equal doc_id
come by text; rows without doc_id come last, by a hash of the text, then the text; texts of any length are read
whole, in pieces; an empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import WordHasher, mixed, partitions, shingles, text_of

PERMS, SHINGLE = 128, 5


class MinHasher:
    """Universal hashing on 32 bits: h(x) = a x + b mod 2**32 with odd a."""

    def __init__(self, perms: int = PERMS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, perms, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, perms, dtype=np.uint64).astype(np.uint32)[:, None]
        self.words = WordHasher()

    def of_shingles(self, x: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32) if into is None else into.copy()
        x = (x >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 512):
            np.minimum(out, (self.a * x[i : i + 512] + self.b).min(axis=1), out=out)
        return out

    def shingles(self, text: str, k: int = SHINGLE) -> np.ndarray:
        return shingles(self.words.words(text.encode("utf-8", "surrogatepass"))[2], k)

    def signature(self, text: str) -> np.ndarray:
        return self.of_shingles(self.shingles(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) in ranges by falling doc_id, and by a hash of the text where there is none; each range
    also holds, as ghosts, the first row of the next one (of the first, for the last). Columns: _range, _ghost,
    _hash, then docs'.

    Only the ranges' borders and first keys come to the driver: a few for each partition."""
    n = partitions(docs.sparkSession) * 4
    none = F.col("doc_id").isNull()
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0]
    cuts = sorted({c for c in cuts or [] if c is not None})
    # Range 0 holds the largest ids; rows without an id come last, in ranges of their hashes.
    more = len(cuts) + 1
    # The hash's high bits, as 0 .. 2**31, times n over 2**31.
    dealt = F.shiftright((F.shiftright("_hash", 33) + F.lit(1 << 30)) * F.lit(n), 31)
    keyed = docs.withColumn("_hash", F.when(none, F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    ranged = keyed.withColumn("_range", F.when(none, dealt + more).otherwise(len(cuts) - _below(cuts)).cast("int"))
    heads = {r["_range"]: (r["id"], r["h"]) for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("id"), F.min("_hash").alias("h")).collect()}
    full = sorted(heads)
    if not full:
        return ranged.withColumn("_ghost", F.lit(False))
    before = {r: full[i - 1] for i, r in enumerate(full)}  # the first range comes after the last
    table = F.array(*[F.struct(F.lit(heads.get(r, (None,))[0]).cast("long").alias("id"), F.lit(heads[r][1] if r in heads else None).cast("long").alias("h"), F.lit(before.get(r)).cast("int").alias("to")) for r in range(full[-1] + 1)])
    ranged = ranged.withColumn("_head", F.get(table, F.col("_range")))
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("g"))
    ghost = F.struct(F.col("_head.to").alias("r"), F.lit(True).alias("g"))
    first = F.col("doc_id").cast("long").eqNullSafe(F.col("_head.id")) & (F.col("_hash") == F.col("_head.h"))
    places = F.when(first, F.array(own, ghost)).otherwise(F.array(own))
    return ranged.withColumn("_to", F.explode(places)).withColumns({"_range": F.col("_to.r"), "_ghost": F.col("_to.g")}).drop("_to", "_head")


def _below(cuts: list[int]):
    """How many of cuts are below doc_id: counted over every s-th cut, then among s of them."""
    if not cuts:
        return F.lit(0)
    s = int(len(cuts) ** 0.5) + 1
    parts = [cuts[i : i + s] for i in range(0, len(cuts), s)]
    tops = F.array(*[F.lit(x[-1]) for x in parts])
    lists = F.array(*[F.array(*map(F.lit, x)) for x in parts])
    less = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("doc_id")))
    at = less(tops)
    return F.when(at == len(parts), len(cuts)).otherwise(at * s + less(F.get(lists, at)))


OUT = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def edited_fingerprints(docs: DataFrame, perms: int = PERMS) -> DataFrame:
    """For each document its fingerprint (hex), that of its text with the last third replaced by the start of
    the next document's, and their likeness; next is by falling doc_id, then as the module says; the first follows the last."""
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in OUT]])
    dealt = _in_order(docs.select("doc_id", text_of().alias("text")))
    # A ghost comes after all rows of its range and only the first counts.
    dealt = dealt.repartition(partitions(spark), "_range").sortWithinPartitions("_range", "_ghost", F.desc_nulls_last("doc_id"), "_hash", "text")

    def scan(batches):
        import hashlib

        import pyarrow as pa

        hasher = MinHasher(perms)
        cols: list[list] = [[] for _ in range(1 + len(OUT))]
        kind = None
        waiting = None  # the row whose next is to come

        def done(row, after):
            d, text, x, sig = row
            text2, sig2 = after[1], after[3]
            cut = len(text) // 3
            keep = text[: len(text) - cut]
            edited = keep + text2[:cut]
            esig = sig if edited == text else hasher.signature(edited)
            values = (d, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), sig.astype(">u4").tobytes().hex(), esig.astype(">u4").tobytes().hex(), likeness(sig, esig), likeness(sig, sig2))
            for c, v in zip(cols, values, strict=True):
                c.append(v)

        def flush():
            arrays = [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])]
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for b in batches:
            kind = b.schema.field("doc_id").type
            for r, g, d, t in zip(*(b.column(c).to_pylist() for c in ("_range", "_ghost", "doc_id", "text")), strict=True):
                if waiting is not None and waiting[0] != r:
                    waiting = None  # the range ended; its last row met its ghost already
                if g and waiting is None:
                    continue
                row = (d, t, None, hasher.signature(t))
                if waiting is not None:
                    done(waiting[1], row)
                waiting = None if g else (r, row)
            if cols[0]:
                yield flush()

    return dealt.select("_range", "_ghost", "doc_id", "text").mapInArrow(scan, schema)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, perms: int = PERMS, bands: int = 32) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, first and key of each row, as chosenpath.join gives them, with bands of
    the MinHash signature as buckets: texts that meet in a band are verified by whole shingle sets, in blocks, so
    no pair is ever written. Texts of equal shingle sets are copies, of which one takes part."""
    from pagemill.llm import chosenpath

    rows = perms // bands

    def banded(place, tokens, items, tools):
        if "hasher" not in tools:
            tools["hasher"] = MinHasher(perms)
        sig = tools["hasher"].of_shingles(tokens).reshape(bands, rows).astype(np.uint64)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(rows):
            out = mixed(out * np.uint64(0x9FB21C651E98DF25) + sig[:, j])
        return [(int(x), place) for x in out.view(np.int64)]

    return chosenpath.join(docs, threshold, buckets=banded)
