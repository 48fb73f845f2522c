"""Substring dedup with fixed-block anchors.

Every passage of `window` words holds one whole aligned block of `block` = (window + 1) // 2 words of any
document that repeats it. So (1) the aligned blocks of all documents are indexed and every rolling window of
`block` words probes the index; (2) a hit, where a probe meets a block of another document, extends over the windows
of `window` words around it: each is compared by 128 bits with all others that hold a hit, and gives the smallest
document that holds it; (3) adjoining repeated windows make up maximal repeats, whose words go from all but the
smallest document. A hit is not extended against each of the documents that hold its block, as a passage of a third
of all documents would make pairs by the square; windows of equal words meet once, however many hold them.

Texts stay in compressed batches. A batch sends each hash once, however often it occurs (so a passage that
a third of all documents share sends one row a batch), as sorted arrays for a range of hashes; what comes
back is one bit for each hash. The number of ranges follows the bytes of text.

At 128 bits, two of 10**13 different windows are taken for one with a probability under 10**-12.

Defined cases: null text has no words; repeated rows of one doc_id do not count against each other; rows
without a doc_id count as smaller than none and lose to any document; of ties (several smaller documents) any one
decides alike; texts of any length are read whole; an empty table gives an empty result; other columns are ignored,
whatever their names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import WordHasher, packed, ranges_for, text_of, unpack, windows, written

WINDOW = 13
NO_ID = np.iinfo(np.int64).max


class Batch:
    """The words of a batch of texts: hash, start and end of each, and the document of each."""

    def __init__(self, hasher: WordHasher, ends: bytes, text: bytes) -> None:
        to, data = unpack(ends, text)
        self.data, self.n = data, len(to)
        s, e, self.hash = hasher.words(_spaced(np.frombuffer(data, np.uint8), to))
        self.doc = np.searchsorted(to + np.arange(len(to)), s, "right")
        self.start, self.end = s - self.doc, e - self.doc

    def windows(self, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word numbers) of windows of k words within one document; their hashes."""
        h = windows(self.hash, k, seed)
        ok = self.doc[: len(h)] == self.doc[k - 1 :][: len(h)]
        return np.flatnonzero(ok), h[ok]


def _spaced(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The texts with a space after each."""
    out = np.full(len(raw) + len(ends), 0x20, np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    out[at] = raw
    return out


def _dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range, of n, of each hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(_dealt(sorted_hashes, n), np.arange(n + 1))


def _first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of sorted pairs is the first of its kind."""
    return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]


def _planes(x: np.ndarray) -> bytes:
    """Bytes by place, so that equal high bytes lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed (long) and kept_text: the words kept, joined by one space."""
    block = (window + 1) // 2
    kind = docs.schema["doc_id"].dataType
    texts = packed(docs.select("doc_id", text_of().cast("binary").alias("text")), ["doc_id"], "texts")
    parts = ranges_for(texts)

    def probe_of(b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Distinct probes of a batch, sorted: 32 bits within the range; flags: 1 if a block of the index
        starts there, 2 if it occurs in more than one document of the batch."""
        at, h = b.windows(block, 1)
        first = np.searchsorted(b.doc, np.arange(b.n))
        aligned = (at - first[b.doc[at]]) % block == 0 if len(at) else np.zeros(0, bool)
        order = np.argsort(h, kind="stable")
        h, d, aligned = h[order], b.doc[at][order], aligned[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        group = np.flatnonzero(new)
        flags = np.zeros(len(group), np.uint8)
        if len(group):
            flags |= np.bitwise_or.reduceat(aligned.astype(np.uint8), group)
            flags |= 2 * (np.maximum.reduceat(d, group) != np.minimum.reduceat(d, group)).astype(np.uint8)
        return h[group], flags

    def probes(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for x in batches:
            for no, ends, text in zip(x.column("batch").to_pylist(), x.column("ends").to_pylist(), x.column("text").to_pylist(), strict=True):
                h, flags = probe_of(Batch(hasher, ends, text))
                cut = _cuts(h, parts)
                keys = ((h >> np.uint64(32)) * np.uint64(parts)).astype(np.uint32)  # what the range leaves open
                low = (h & np.uint64(0xFF)).astype(np.uint8)
                some = [r for r in range(parts) if cut[r + 1] > cut[r]]
                delta = [np.diff(keys[cut[r] : cut[r + 1]], prepend=np.uint32(0)) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([no] * len(some), pa.int64()), pa.array([_planes(d) for d in delta], pa.binary()), pa.array([low[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()), pa.array([np.packbits(np.concatenate([flags[cut[r] : cut[r + 1]] & 1, flags[cut[r] : cut[r + 1]] >> 1])).tobytes() for r in some], pa.binary())], names=["range", "batch", "keys", "low", "flags"])

    sent = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("low", T.BinaryType()), T.StructField("flags", T.BinaryType())])
    bits = T.StructType([T.StructField("batch", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("bits", T.BinaryType())])

    def hits(table):
        """For each batch, a bit for each of its probes: some document's block meets another document."""
        import pyarrow as pa

        keys = [np.cumsum(_unplanes(k, "<u4"), dtype=np.uint32).astype(np.uint64) << np.uint64(8) | np.frombuffer(low, np.uint8) for k, low in zip(table.column("keys").to_pylist(), table.column("low").to_pylist(), strict=True)]
        sizes = [len(k) for k in keys]
        flag = [np.unpackbits(np.frombuffer(f, np.uint8))[: 2 * n].reshape(2, n) for f, n in zip(table.column("flags").to_pylist(), sizes, strict=True)]
        every, blocks, many = np.concatenate(keys), np.concatenate([f[0] for f in flag]), np.concatenate([f[1] for f in flag])
        order = np.argsort(every, kind="stable")
        every = every[order]
        group = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        size = np.diff(np.append(group, len(every)))
        hit = (np.maximum.reduceat(blocks[order], group) > 0) & ((size > 1) | (np.maximum.reduceat(many[order], group) > 0))
        out = np.zeros(len(every), np.uint8)
        out[order] = np.repeat(hit, size)
        cut = np.cumsum([0, *sizes])
        return pa.table({"batch": table.column("batch"), "range": table.column("range"), "bits": pa.array([np.packbits(out[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def by_batch(answers: DataFrame, name: str) -> DataFrame:
        """One row a batch: the ranges it asked and the answers' bits."""
        return answers.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("range", "bits"))).alias("x")).select(F.col("batch").alias(f"{name}_batch"), F.col("x.bits").alias(name))

    found = written(texts.select("batch", "ends", "text").mapInArrow(probes, sent).groupBy("range").applyInArrow(hits, bits), "hits")
    marked = texts.join(by_batch(found, "hit"), F.col("batch") == F.col("hit_batch"), "left")

    def joined(answers: list[bytes] | None, cut: np.ndarray) -> np.ndarray:
        """The bits of all ranges, in the order of the sorted hashes."""
        size = np.diff(cut)
        return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(a, np.uint8))[:n].astype(bool) for a, n in zip(answers or [], size[size > 0].tolist(), strict=True))])

    def candidates(b: Batch, answers: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and hashes (two of 64 bits) of the windows that hold a hit."""
        at, h = b.windows(block, 1)
        known = np.unique(h)
        hit = joined(answers, _cuts(known, parts))
        alive = np.zeros(len(b.hash) + 1, np.int64)
        if len(h):
            alive[at + 1] = hit[np.searchsorted(known, h)]
        total = np.cumsum(alive)
        w, g = b.windows(window, 2)
        keep = total[w + window - block + 1] > total[w] if len(w) else np.zeros(0, bool)
        return w[keep], g[keep], b.windows(window, 3)[1][keep]

    def least(b: Batch, ids: np.ndarray, w: np.ndarray, g: np.ndarray, g2: np.ndarray):
        """Distinct windows by both hashes, sorted, the smallest document of each here, and each window's place."""
        order = np.lexsort((g2, g))
        new = _first(g[order], g2[order])
        back = np.empty(len(g), np.int64)
        back[order] = np.cumsum(new) - 1
        low = np.full(int(new.sum()), NO_ID)
        np.minimum.at(low, back, ids[b.doc[w]])
        return g[order][new], g2[order][new], low, back

    def ids_of(x) -> np.ndarray:
        return np.asarray([NO_ID if i is None else i for i in x], np.int64)

    COLS = ("batch", "ends", "text", "doc_id", "hit")

    def seen(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for x in batches:
            for no, ends, text, ids, hit in zip(*(x.column(c).to_pylist() for c in COLS), strict=True):
                b = Batch(hasher, ends, text)
                known, other, low, _ = least(b, ids_of(ids), *candidates(b, hit))
                cut = _cuts(known, parts)
                some = [r for r in range(parts) if cut[r + 1] > cut[r]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([no] * len(some), pa.int64()), *(pa.array([_planes(x[cut[r] : cut[r + 1]]) for r in some], pa.binary()) for x in (known, other, low))], names=["range", "batch", "keys", "other", "low"])

    def firsts(table):
        """For each batch, a bit for each of its windows: a smaller document elsewhere holds it."""
        import pyarrow as pa

        keys = [_unplanes(k, "<u8") for k in table.column("keys").to_pylist()]
        other = np.concatenate([_unplanes(k, "<u8") for k in table.column("other").to_pylist()])
        low = np.concatenate([_unplanes(k, "<i8") for k in table.column("low").to_pylist()])
        every = np.concatenate(keys)
        order = np.lexsort((other, every))
        group = np.flatnonzero(_first(every[order], other[order]))
        size = np.diff(np.append(group, len(every)))
        out = np.zeros(len(every), np.uint8)
        out[order] = np.repeat(np.minimum.reduceat(low[order], group), size) < low[order]
        cut = np.cumsum([0, *map(len, keys)])
        return pa.table({"batch": table.column("batch"), "range": table.column("range"), "bits": pa.array([np.packbits(out[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    sent2 = T.StructType([sent["range"], sent["batch"], sent["keys"], T.StructField("other", T.BinaryType()), sent["low"]])
    smaller = written(marked.select(*COLS).mapInArrow(seen, sent2).groupBy("range").applyInArrow(firsts, bits), "firsts")
    decided = marked.join(by_batch(smaller, "first"), F.col("batch") == F.col("first_batch"), "left")
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for x in batches:
            idt = x.schema.field("doc_id").type.value_type
            for no, ends, text, ids, hit, first in zip(*(x.column(c).to_pylist() for c in (*COLS, "first")), strict=True):
                b = Batch(hasher, ends, text)
                w, g, g2 = candidates(b, hit)
                own = ids_of(ids)
                known, _, low, back = least(b, own, w, g, g2)
                less = joined(first, _cuts(known, parts))
                repeated = w[less[back] | (own[b.doc[w]] > low[back])] if len(w) else w
                mark = np.zeros(len(b.hash) + 1, np.int64)
                np.add.at(mark, repeated, 1)
                np.add.at(mark, repeated + window, -1)
                gone = np.cumsum(mark)[:-1] > 0
                first_word = np.searchsorted(b.doc, np.arange(b.n + 1))
                n_words = np.diff(first_word)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first_word])
                start, end, data, kept = b.start.tolist(), b.end.tolist(), b.data, []
                for i in range(b.n):
                    lo, hi = int(first_word[i]), int(first_word[i + 1])
                    if removed[i]:
                        kept.append(b" ".join([data[start[j] : end[j]] for j in (lo + np.flatnonzero(~gone[lo:hi])).tolist()]))
                    else:
                        kept.append(b" ".join([data[s:e] for s, e in zip(start[lo:hi], end[lo:hi], strict=True)]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, idt), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return decided.select(*COLS, "first").mapInArrow(cut, out)


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
r AS (SELECT k.doc_id, k.i FROM k JOIN f USING (win) WHERE f.first < k.doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
o AS (SELECT x.doc_id, count(*) FILTER (WHERE g.j IS NOT NULL) AS n, coalesce(string_agg(x.word, ' ' ORDER BY x.j) FILTER (WHERE g.j IS NULL), '') AS kept
      FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(o.n, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)
"""
