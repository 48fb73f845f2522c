"""A quality classifier by language-model perplexity.

For each language an interpolated modified Kneser-Ney model of byte 5-grams is trained on all trusted text.
Counts are sharded by (language, third and fourth byte): an n-gram of order 3 to 5, its contexts and its
suffixes then lie in one shard, while orders 1 and 2 are tables of at most 256 x 256 entries a language.
Each batch of documents asks the shards for its distinct n-grams (a join with the sharded counts), gets one
probability for each, and sums them by document. A document goes when its mean is above its language's
threshold, a high quantile over the language's trusted documents held out of training.

Defined cases: null text is empty; an empty text has no perplexity and is kept; a null language is a language
of its own; a document in a language of fewer than two trusted documents is kept, as it has no threshold; of
others at least one is held out; repeated rows are treated alike (a repeated label counts as trusted if one of its
rows says so); texts of any length are scored whole; an empty table gives an empty result; other columns, whatever
their names, pass through the stage unchanged.

Tables of fixed size (256 KB) for each language that has trusted text go to the driver and the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import as_struct, mixed, packed, ranges_for, row_key, text_of, unpack, written

ORDER = 5
#: Scores are sent as -ln p in steps of 1/2048, up to 32.
STEP = 2048
#: Bytes of average text that every document's mean is shrunk with, as short texts vary.
SHRINK = 64
#: One trusted document in so many is held out of training, for the thresholds.
HELD_OUT = 10
#: The quantile over held-out documents that is a threshold; how many documents' worth all languages together count
#: beside a language's own, as a quantile of few is vague.
QUANTILE, POOLED = 0.995, 25
#: A shard's requests are split among groups of so many batches.
BATCHES = 2048


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5 bytes that end at each byte of each text, as one int64 (four zero bytes come before a text);
    the end of each text's keys."""
    raw = np.frombuffer(b"".join(b"\0\0\0\0" + t for t in texts) + b"\0\0\0\0", np.uint8)
    size = np.asarray([len(t) for t in texts], np.int64)
    key = np.zeros(max(len(raw) - 4, 0), np.int64)
    for j in range(ORDER):
        key <<= 8
        key |= raw[j : len(raw) - 4 + j]
    start = np.cumsum(size + 4) - size - 4
    keep = np.ones(len(key), bool)
    for j in range(4):  # the last byte of these is a zero byte before the next text
        keep[(start + size + j)[start + size + j < len(key)]] = False
    return key[keep], np.cumsum(size)


def shard_of(keys: np.ndarray, lang: str, parts: int) -> np.ndarray:
    import zlib

    pair = ((keys >> 8) & 0xFFFF).astype(np.uint64) | np.uint64(zlib.crc32(lang.encode()) << 16)
    return ((mixed(pair) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _sharded(keys: np.ndarray, lang: str, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct keys by (shard, key); the shards that occur; where each begins, and the end."""
    shard = shard_of(keys, lang, parts)
    order = np.lexsort((keys, shard))
    some, at = np.unique(shard[order], return_index=True)
    return order, some, np.append(at, len(keys))


def _by_lang(langs: list[str | None], picked=None) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, x in enumerate(langs):
        if picked is None or i in picked:
            out.setdefault(x or "", []).append(i)
    return out


def _texts(ends: bytes, text: bytes) -> list[bytes]:
    to, data = unpack(ends, text)
    return [data[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values of sorted x begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Level:
    """One order of a shard: sorted n-grams with counts, and what their contexts need."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, discounts: np.ndarray) -> None:
        self.grams = grams
        at = _runs(grams >> 8)
        self.contexts = (grams >> 8)[at]
        total = np.add.reduceat(counts, at) if len(at) else counts
        # A count of 1, 2, or more loses D1, D2, D3; the context's lower order gets what was lost.
        loss = np.minimum(discounts[np.minimum(counts, 3)], counts)
        lost = np.add.reduceat(loss, at) if len(at) else loss
        size = np.diff(np.append(at, len(grams)))
        self.alpha = (counts - loss) / np.repeat(total, size) if len(at) else np.zeros(0)
        self.gamma = lost / total if len(at) else np.zeros(0)

    def mix(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return _look(self.grams, self.alpha, grams, 0.0) + _look(self.contexts, self.gamma, grams >> 8, 1.0) * lower


def _look(keys: np.ndarray, values: np.ndarray, ask: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(ask), other)
    at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
    return np.where(keys[at] == ask, values[at], other)


def lower_order(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (the last `bits` bits) of distinct n-grams and in how many they occur."""
    return np.unique(grams & ((1 << bits) - 1), return_counts=True)


def discounts_of(n: np.ndarray) -> np.ndarray:
    """D0..D3 from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n = np.maximum(n.astype(float), 1e-9)
    y = n[0] / (n[0] + 2 * n[1])
    d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return np.asarray([0.0, *(min(max(v, 0.1), i - 0.05) for i, v in zip((1, 2, 3), d, strict=True))])


def tally(counts: np.ndarray) -> np.ndarray:
    return np.asarray([(counts == i).sum() for i in (1, 2, 3, 4)], np.int64)


def pair_table(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """256 x 256 of p(last | one before) by orders 2, 1 and 0, from pairs with their continuation counts."""
    n = np.zeros((256, 256))
    n[pairs >> 8, pairs & 255] = counts
    kinds = (n > 0).sum(axis=0)  # how many bytes each byte follows
    d = discounts_of(tally(kinds))
    loss = np.minimum(d[np.minimum(kinds, 3)], kinds)
    one = (kinds - loss + loss.sum() / 256) / max(kinds.sum(), 1) if kinds.sum() else np.full(256, 1 / 256)
    d = discounts_of(tally(counts))
    loss = np.minimum(d[np.minimum(n, 3).astype(int)], n)
    total = n.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, (n - loss) / total + loss.sum(axis=1, keepdims=True) / total * one, one[None, :])


def score(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """key (of doc_id, lang and text), doc_id, lang, n_bytes, nll (sum of -ln p; double) and held_out
    (trusted, but not in training) of each row of docs (doc_id, text, lang); trusted has doc_id."""
    spark = docs.sparkSession
    key = row_key("doc_id", "lang", "text")
    texts = packed(docs.select(text_of().cast("binary").alias("text"), "doc_id", "lang", key.alias("key")), ["doc_id", "lang", "key"], "lm")
    parts = ranges_for(texts)
    ids = trusted.select(F.col("doc_id").alias("_trusted")).dropna().distinct()
    every = F.posexplode(F.arrays_zip("doc_id", F.transform("lang", lambda x: F.coalesce(x, F.lit(""))).alias("lang"))).alias("_pos", "_x")
    each = texts.select("batch", every).select("batch", "_pos", F.col("_x.doc_id").alias("_id"), F.col("_x.lang").alias("_l")).join(ids, F.col("_id") == F.col("_trusted"))
    drawn = F.pmod(F.xxhash64("_id"), F.lit(HELD_OUT)) == 0
    # A language of which none is drawn holds out one document.
    none = each.groupBy(F.col("_l").alias("_l2")).agg(F.count_if(drawn).alias("_n"), F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_n = 0 and _least <> _most").select("_l2", "_least")
    # Joined by id, as one language may have most documents.
    each = each.join(none, (F.col("_id") == F.col("_least")) & (F.col("_l") == F.col("_l2")), "left")
    held = drawn | F.col("_least").isNotNull()
    picked = each.groupBy(F.col("batch").alias("_b")).agg(F.collect_list(F.when(~held, F.col("_pos"))).alias("train"), F.collect_list(F.when(held, F.col("_pos"))).alias("held"))
    flagged = written(picked, "trusted")
    marked = texts.join(flagged, F.col("batch") == F.col("_b"), "left")

    def count(batches):
        import pandas as pd
        import pyarrow as pa

        for b in batches:
            for ends, text, langs, train in zip(*(b.column(c).to_pylist() for c in ("ends", "text", "lang", "train")), strict=True):
                if not train:
                    continue
                own = _texts(ends, text)
                for lang, rows in _by_lang(langs, set(train)).items():
                    codes, grams = pd.factorize(gram_keys([own[i] for i in rows])[0])
                    order, some, at = _sharded(grams, lang, parts)
                    grams, n = grams[order], np.bincount(codes, minlength=len(grams))[order].astype(np.int32)
                    cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([lang] * len(some), pa.string()), pa.array([grams[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([n[x:y].tobytes() for x, y in cut], pa.binary())], names=["shard", "lang", "grams", "counts"])

    def merge(table):
        import pyarrow as pa

        grams = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("grams").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(grams, kind="stable")
        grams, n = grams[order], n[order]
        at = _runs(grams)
        grams, n = grams[at], np.add.reduceat(n, at)
        four, n4 = lower_order(grams, 32)
        three, n3 = lower_order(four, 24)
        two, n2 = lower_order(three, 16)
        stats = np.concatenate([tally(n), tally(n4), tally(n3)])
        return pa.table({"shard": table.column("shard").slice(0, 1), "lang": table.column("lang").slice(0, 1), "grams": [grams.tobytes()], "counts": [n.tobytes()], "stats": [stats.tobytes()], "pairs": [two.tobytes()], "pair_counts": [n2.astype(np.int64).tobytes()]})

    sent = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("grams", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    shards = written(marked.select("ends", "text", "lang", "train").mapInArrow(count, sent).groupBy("shard", "lang").applyInArrow(merge, T.StructType([*sent.fields, *[T.StructField(c, T.BinaryType()) for c in ("stats", "pairs", "pair_counts")]])), "shards")

    def sum_up(key, table):
        import pyarrow as pa

        stats = np.sum([np.frombuffer(x, np.int64) for x in table.column("stats").to_pylist()], axis=0)
        pairs = np.zeros(1 << 16, np.int64)
        for k, v in zip(table.column("pairs").to_pylist(), table.column("pair_counts").to_pylist(), strict=True):
            if v is None:  # a sum already
                pairs += np.frombuffer(k, np.int64)
            else:
                np.add.at(pairs, np.frombuffer(k, np.int64), np.frombuffer(v, np.int64))
        return pa.table({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py() if len(key) > 1 else 0], pa.int32()), "stats": [stats.tobytes()], "pairs": [pairs.tobytes()]})

    # Two steps, so that no task gathers all shards of a language; then one row of fixed size a language.
    summed = "lang string, part int, stats binary, pairs binary"
    partial = shards.withColumn("part", F.col("shard") % 64).select("lang", "part", "stats", "pairs", "pair_counts").groupBy("lang", "part").applyInArrow(sum_up, summed)
    whole = partial.withColumn("pair_counts", F.lit(None).cast("binary")).groupBy("lang").applyInArrow(sum_up, summed)
    tables = {}
    for r in whole.collect():  # one row of fixed size a language
        stats, pairs = np.frombuffer(r["stats"], np.int64), np.frombuffer(r["pairs"], np.int64)
        some = np.flatnonzero(pairs)
        tables[r["lang"]] = ([discounts_of(x) for x in stats.reshape(3, 4)], pair_table(some, pairs[some]).astype(np.float32))
    sent_tables = spark.sparkContext.broadcast(tables)  # 256 KB a language

    groups = max(1, texts.select("batch").count() // BATCHES)

    def ask(batches):
        import pandas as pd
        import pyarrow as pa

        for b in batches:
            for no, ends, text, langs in zip(*(b.column(c).to_pylist() for c in ("batch", "ends", "text", "lang")), strict=True):
                own = _texts(ends, text)
                for lang, rows in _by_lang(langs).items():
                    grams = pd.unique(gram_keys([own[i] for i in rows])[0])
                    order, some, at = _sharded(grams, lang, parts)
                    grams, n = grams[order], len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([lang] * n, pa.string()), pa.array([no % groups] * n, pa.int32()), pa.array([no] * n, pa.int64()), pa.array([_narrow(grams[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["shard", "lang", "salt", "batch", "asked"])

    asked = texts.select("batch", "ends", "text", "lang").mapInArrow(ask, "shard int, lang string, salt int, batch long, asked binary")
    counted = shards.select("shard", "lang", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("salt"), "grams", "counts")

    def answer(key, asks, counts):
        import pyarrow as pa

        lang = key[1].as_py()
        grams = np.frombuffer(counts.column("grams")[0].as_py(), np.int64) if counts.num_rows else np.zeros(0, np.int64)
        n = np.frombuffer(counts.column("counts")[0].as_py(), np.int64) if counts.num_rows else np.zeros(0, np.int64)
        d, two = sent_tables.value.get(lang, ([discounts_of(np.zeros(4))] * 3, np.full((256, 256), 1 / 256)))
        four, n4 = lower_order(grams, 32)
        three, n3 = lower_order(four, 24)
        levels = [(Level(three, n3, d[2]), 24), (Level(four, n4, d[1]), 32), (Level(grams, n, d[0]), 40)]
        out = []
        for a in asks.column("asked").to_pylist():
            g = _widen(a)
            p = two[(g >> 8) & 255, g & 255].astype(float)
            for level, bits in levels:
                p = level.mix(g & ((1 << bits) - 1), p)
            out.append(np.minimum(-np.log(np.maximum(p, 1e-13)) * STEP, 65535).astype("<u2").tobytes())
        return pa.table({"batch": asks.column("batch"), "lang": asks.column("lang"), "shard": asks.column("shard"), "scores": pa.array(out, pa.binary())})

    answers = asked.groupBy("shard", "lang", "salt").cogroup(counted.groupBy("shard", "lang", "salt")).applyInArrow(answer, "batch long, lang string, shard int, scores binary")
    back = answers.groupBy(F.col("batch").alias("_b2")).agg(F.sort_array(F.collect_list(F.struct("lang", "shard", "scores"))).alias("x")).select("_b2", F.col("x.lang").alias("a_lang"), F.col("x.scores").alias("a_scores"))
    scored = marked.join(back, F.col("batch") == F.col("_b2"), "left")

    def total(batches):
        import pandas as pd
        import pyarrow as pa

        for b in batches:
            kinds = [b.schema.field(c).type.value_type for c in ("doc_id", "lang", "key")]
            for ends, text, ids, langs, keys, held, a_lang, a_scores in zip(*(b.column(c).to_pylist() for c in ("ends", "text", "doc_id", "lang", "key", "held", "a_lang", "a_scores")), strict=True):
                own = _texts(ends, text)
                got: dict[str, list[bytes]] = {}
                for x, s in zip(a_lang or [], a_scores or [], strict=True):
                    got.setdefault(x, []).append(s)
                sums = np.zeros(len(own))
                for lang, rows in _by_lang(langs).items():
                    grams, to = gram_keys([own[i] for i in rows])
                    if not len(grams):
                        continue
                    codes, uniques = pd.factorize(grams)
                    order = _sharded(uniques, lang, parts)[0]
                    value = np.empty(len(uniques))
                    value[order] = np.frombuffer(b"".join(got[lang]), "<u2") / STEP
                    cum = np.concatenate([[0.0], np.cumsum(value[codes])])
                    sums[rows] = np.diff(np.concatenate([[0.0], cum[to]]))
                apart = np.zeros(len(own), bool)
                apart[held or []] = True
                yield pa.RecordBatch.from_arrays([pa.array(keys, kinds[2]), pa.array(ids, kinds[0]), pa.array(langs, kinds[1]), pa.array([len(t) for t in own], pa.int64()), pa.array(np.round(sums, 6)), pa.array(apart)], names=["key", "doc_id", "lang", "n_bytes", "nll", "held_out"])

    out = T.StructType([T.StructField("key", T.StringType()), docs.schema["doc_id"], docs.schema["lang"], T.StructField("n_bytes", T.LongType()), T.StructField("nll", T.DoubleType()), T.StructField("held_out", T.BooleanType())])
    return written(scored.select("ends", "text", "doc_id", "lang", "key", "held", "a_lang", "a_scores").mapInArrow(total, out), "scores")


def _narrow(grams: np.ndarray) -> bytes:
    """Sorted 40-bit keys, byte plane after byte plane."""
    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _widen(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).reshape(5, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :5] = x.T
    return out.view(np.int64).ravel()


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """key, doc_id, lang, n_bytes, perplexity (by byte), threshold and keep of each row of docs.

    A document's mean -ln p is shrunk towards its language's with SHRINK bytes. A language's threshold is the
    quantile of its held-out trusted documents. With few of them it leans on all languages' together: their
    quantile of what lies above the own language's median counts as POOLED more documents."""
    scores = score(docs, trusted)
    good = scores.filter("n_bytes > 0 and held_out")
    spread = good.groupBy(F.col("lang").alias("_lang")).agg((F.sum("nll") / F.sum("n_bytes")).alias("_mean"))
    near = scores.join(F.broadcast(spread), F.col("lang").eqNullSafe(F.col("_lang")), "left")  # a row a trusted language
    near = near.withColumn("_shrunk", (F.col("nll") + F.col("_mean") * SHRINK) / (F.col("n_bytes") + SHRINK))
    own = near.filter("n_bytes > 0 and held_out").select("lang", "_shrunk")
    at = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(100_000))
    by_lang = own.groupBy(F.col("lang").alias("_lang2")).agg(at("_shrunk", 0.5).alias("_mid"), at("_shrunk", quantile).alias("_high"), F.count("*").alias("_n"))
    above = own.join(F.broadcast(by_lang), F.col("lang").eqNullSafe(F.col("_lang2"))).agg(at(F.col("_shrunk") - F.col("_mid"), quantile).alias("_above"))
    limit = (F.col("_n") * F.col("_high") + POOLED * (F.col("_mid") + F.col("_above"))) / (F.col("_n") + POOLED)
    cut = by_lang.join(F.broadcast(above), F.lit(True)).select("_lang2", limit.alias("_limit"))
    out = near.join(F.broadcast(cut), F.col("lang").eqNullSafe(F.col("_lang2")), "left")
    keep = F.coalesce((F.col("n_bytes") == 0) | (F.col("_shrunk") <= F.col("_limit")), F.lit(True))
    ppl = F.when(F.col("n_bytes") > 0, F.exp(F.col("nll") / F.col("n_bytes")))
    return out.select("key", "doc_id", "lang", "n_bytes", ppl.alias("perplexity"), F.exp("_shrunk").alias("shrunk_perplexity"), F.exp("_limit").alias("threshold"), keep.alias("keep"))


def _trusted(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs.select("doc_id", "text", "lang"), _trusted(spark, sf_dir)).drop("key")


def good_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier keeps, unchanged."""
    judged = classify(docs.select("doc_id", "text", "lang"), _trusted(spark, sf_dir))
    bad = judged.filter("not keep").select(F.col("key").alias("_bad")).distinct()
    own = docs.select(as_struct(docs).alias("_doc"), row_key("doc_id", "lang", "text").alias("_key"))
    return own.join(bad, F.col("_key") == F.col("_bad"), "left_anti").select("_doc.*")
