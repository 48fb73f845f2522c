"""What the operators of this subpackage share: the cluster's shared folder, written tables,
distributed running totals, packed text batches and vectorised word hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_WRITTEN: list[str] = []
_TABLES: list[str] = []
_OWN: dict[str, str] = {}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    temporary folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="pagemill-")
        found = _OWN[app]
    return f"{found.rstrip('/')}/pagemill-{app}"


def forget(spark: SparkSession) -> None:
    """Removes the tables that the operators wrote in this session; their results can't be read after that.

    Called at exit too, for a session that still runs then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        where.getFileSystem(conf).delete(where, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        forget(spark)
    for folder in _OWN.values():
        shutil.rmtree(folder, ignore_errors=True)


atexit.register(_at_exit)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which forget() removes."""
    _WRITTEN.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, computes df once, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written(), bucketed by key: joins on key then shuffle only their other side."""
    spark = df.sparkSession
    table = f"pagemill_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    _WRITTEN.append(path)
    _TABLES.append(table)
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).saveAsTable(table)
    return spark.table(table)


def text_of(c: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_struct(docs: DataFrame) -> Column:
    """A row's own columns as one struct, so that columns added beside it clash with none of them."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])


def changed(docs: DataFrame, doc: str, new: dict[str, Column]) -> list[Column]:
    """The columns of docs out of their struct `doc`, those named in new replaced."""
    return [new.get(c, F.col(f"{doc}.{quoted(c)}")).alias(c) for c in docs.columns]


def row_key(*columns: str) -> Column:
    """128 bits of a row's columns, as text: rows are matched by it with what was decided for them.

    It is the first half of the SHA-256 of all values, each behind its length and nulls as a sign of their own, so no two
    rows are written alike."""
    values = [F.col(quoted(c)).cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.left(F.sha2(F.concat(*told), 256), F.lit(32))


def rest_of(docs: DataFrame, *columns: str) -> Column:
    """An order of rows that are equal in columns, by all their other ones, so that reruns agree."""
    others = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in columns]
    return F.xxhash64(F.to_json(F.struct(*others), {"ignoreNullFields": "false"})) if others else F.lit(0).cast("long")


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` (long) up to and with the row, in `order` within `group`, and
    `_row`: a unique long.

    Rows are dealt by ranges of (group, order), so one group may hold any share of them: tasks sum their
    own range, and a group that spans ranges gets the totals of those before. That table of offsets has at
    most one group for each border between ranges, so its size is bounded by the number of partitions."""
    spark = df.sparkSession
    keys = [*group, *order]
    parts = partitions(spark)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_local", T.LongType())])

    def local(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, seen, last, total = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            cum = np.cumsum(v)
            new = np.zeros(len(v), bool)
            for g in group:
                c = b.column(g)
                lead, trail = c.slice(1), c.slice(0, len(c) - 1)
                diff = pc.not_equal(lead, trail).fill_null(True).to_numpy(zero_copy_only=False) & ~(lead.is_null().to_numpy(zero_copy_only=False) & trail.is_null().to_numpy(zero_copy_only=False))
                new[1:] |= diff
            first = tuple(b.column(g)[0].as_py() for g in group)
            carry = total if first == last else 0
            starts = np.flatnonzero(new)
            which = np.cumsum(new)
            base = np.concatenate([[-carry], cum[starts - 1] if len(starts) else []]).astype(np.int64)
            local_sum = cum - base[which]
            last, total = tuple(b.column(g)[b.num_rows - 1].as_py() for g in group), int(local_sum[-1])
            row = (np.int64(part) << np.int64(40)) + seen + np.arange(len(v), dtype=np.int64)
            seen += len(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(row), pa.array(local_sum)], names=[*b.schema.names, "_part", "_row", "_local"])

    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    here = written(dealt.mapInArrow(local, schema), "totals")
    sums = here.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.sum("_sum").over(before)).filter("_before <> 0").select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_before")
    on = F.col("_part") == F.col("_p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = here.join(F.broadcast(offsets), on, "left")  # at most one row for each partition
    return joined.withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0))).select(*df.columns, "_row", out)


# ---- text batches -------------------------------------------------------------------------------

BATCH_BYTES = 4 << 20
#: Texts in a batch, for those that have few bytes or none.
BATCH_TEXTS = 1 << 16


def packed(docs: DataFrame, columns: list[str], name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Texts in compressed batches of about batch_bytes, bucketed by batch, for operators that pass over
    the texts more than once and send only hashes through shuffles.

    docs has a binary `text` (UTF-8) and `columns`. Rows: batch long, n int, bytes long (of its texts), ends binary (int64 end of each
    text in bytes), text binary (zstd), columns as arrays. One row is one batch, so a batch is the same
    whichever task reads it. A text longer than batch_bytes is a batch of its own; a batch has BATCH_TEXTS texts at
    most."""
    spark = docs.sparkSession
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("ends", T.BinaryType()), T.StructField("text", T.BinaryType()), *[T.StructField(c, T.ArrayType(kinds[c])) for c in columns]])

    def pack(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, seq, size, texts, rest = TaskContext.get().partitionId(), 0, 0, [], {c: [] for c in columns}
        squeeze = zstandard.ZstdCompressor(level=6)
        arrow = pa.schema([("batch", pa.int64()), ("n", pa.int32()), ("bytes", pa.int64()), ("ends", pa.binary()), ("text", pa.binary())])

        def row():
            ends = np.cumsum([len(t) for t in texts]).astype("<i8").tobytes()
            first = [[(part << 32) + seq], [len(texts)], [size], [ends], [squeeze.compress(b"".join(texts))]]
            more = [pa.array([rest[c]], pa.list_(types[c])) for c in columns]
            return pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(first, arrow, strict=True)), *more], names=[*arrow.names, *columns])

        types: dict = {}
        for b in batches:
            types = {c: b.schema.field(c).type for c in columns}
            own = {c: b.column(c).to_pylist() for c in columns}
            for i, t in enumerate(b.column("text").to_pylist()):
                if texts and (size + len(t) > batch_bytes or len(texts) == BATCH_TEXTS):
                    yield row()
                    seq, size, texts = seq + 1, 0, []
                    rest = {c: [] for c in columns}
                texts.append(t)
                size += len(t)
                for c in columns:
                    rest[c].append(own[c][i])
        if texts:
            yield row()

    return bucketed(docs.select("text", *columns).mapInArrow(pack, schema), name, "batch")


def ranges_for(texts: DataFrame, each: int = 8 << 20, most: int = 1 << 16, whole: int = 256 << 20) -> int:
    """Into how many ranges of hashes packed texts are dealt: one for `each` bytes up to `most` of them, then so many
    that none has more than `whole` bytes. A task holds one range at a time, whatever the data's size."""
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    return max(partitions(texts.sparkSession), min(-(-total // each), most), -(-total // whole))


def unpack(ends: bytes, text: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    return np.frombuffer(ends, "<i8"), zstandard.ZstdDecompressor().decompress(text)


# ---- word hashes --------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_B = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(base & (2**64 - 1)), np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 text, many words at a time."""

    STEP = 1 << 18

    def __init__(self) -> None:
        self.up = _powers(self.STEP, int(_B))
        self.down = _powers(self.STEP, _inverse(int(_B)))

    def words(self, text: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end (bytes) and hash of each word."""
        data = np.frombuffer(text, np.uint8) if not isinstance(text, np.ndarray) else text
        gap = np.concatenate([[True], _SPACE[data], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        out = np.zeros(len(start), np.uint64)
        lo = 0
        with np.errstate(over="ignore"):
            while lo < len(start):
                hi = int(np.searchsorted(end, start[lo] + self.STEP, "right"))
                if hi == lo:  # one word longer than STEP
                    out[lo] = self._long(data[start[lo] : end[lo]])
                    lo += 1
                    continue
                at = int(start[lo])
                piece = data[at : int(end[hi - 1])].astype(np.uint64)
                piece += np.uint64(1)
                piece *= self.up[: len(piece)]
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece, dtype=np.uint64)])
                s, e = start[lo:hi] - at, end[lo:hi] - at
                out[lo:hi] = (total[e] - total[s]) * self.down[s]
                lo = hi
        with np.errstate(over="ignore"):
            return start, end, mixed(out + (end - start).astype(np.uint64))

    def _long(self, data: np.ndarray) -> np.uint64:
        total, scale = np.uint64(0), np.uint64(1)
        step = self.up[-1] * _B
        for i in range(0, len(data), self.STEP):
            piece = data[i : i + self.STEP].astype(np.uint64) + np.uint64(1)
            total += scale * np.sum(piece * self.up[: len(piece)], dtype=np.uint64)
            scale *= step
        return total


def windows(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(seed), np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9FB21C651E98DF25) + words[j : j + n]
        return mixed(out)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order; a shorter text is one shingle of all its words; none if empty."""
    return windows(words, min(k, len(words))) if len(words) else np.zeros(0, np.uint64)
