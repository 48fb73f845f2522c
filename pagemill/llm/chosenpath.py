"""Jaccard join of documents' shingle sets by chosen paths.

Sets are split recursively on sampled tokens: in each run every set takes the few of its tokens whose hash, for
that run and path, is below a bound by the set's size, so similar sets take the same ones. Sets that share a
path form a node. A node of one set ends; a small one is searched by brute force; a large one is split again,
unless its sets are so alike that splitting can't part them: then it is searched in blocks. Runs repeat until
pairs at the threshold are met with the target recall.

Brute force has two steps: 64-byte sketches drop what is clearly not alike, then whole sets are compared
exactly. Found groups are keyed by their first document, so that the same group found by many runs is
compared once, and a pair that two groups hold counts in the smaller one. Pairs are never written: a group
gives each document's number of links and its link to the group's first connected document.

Texts stay in compressed batches; a document is known by its place (batch and position), and what a pass
needs of it goes to its batch.

Defined cases: null text is empty; texts of equal shingle sets (empty ones too) are copies: one class, of
which one takes part; a text of fewer than five words is one shingle; repeated rows are copies; rows without
doc_id take part and come last as a class's first; an empty table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.fingerprints import MinHasher
from pagemill.llm.shared import WordHasher, as_struct, mixed, packed, partitions, rest_of, row_key, shingles, text_of, unpack, written

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Tokens that a set takes at each step, on average.
TAKEN = 1 / 0.6
#: Largest node that is searched at once; deepest path; likeness within a node from which it isn't split.
SMALL, DEPTH, ALIKE = 1024, 10, 0.4
#: Sketch places that must agree, of 64: four standard deviations below the threshold's mean.
AGREE = 38
#: Bytes of texts in a batch, and of rows that a pass holds before it hands them on.
BATCH, FLUSH = 2 << 20, 2 << 20
#: A block of a large group: so many documents, so many shingles at most.
BLOCK_DOCS, BLOCK_TOKENS = 1024, 500_000


def runs_needed(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold shares a node of any depth with probability `recall`.

    Each step keeps a Poisson number of common tokens with mean m; a run loses the pair with the
    probability q = exp(m (q - 1)) that such a branching process dies out."""
    m, q = threshold * TAKEN, 0.0
    for _ in range(200):
        q = math.exp(m * (q - 1))
    return math.ceil(math.log(1 - recall) / math.log(q))


def _sets(hasher: WordHasher, ends: bytes, text: bytes, picked=None):
    """(position, distinct shingles sorted) of a batch's texts."""
    to, data = unpack(ends, text)
    at = [0, *to.tolist()]
    for i in range(len(to)) if picked is None else picked:
        yield i, np.unique(shingles(hasher.words(data[at[i] : at[i + 1]])[2], SHINGLE))


def _take(tokens: np.ndarray, path: np.uint64) -> np.ndarray:
    """The paths on which a set goes on from `path`."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    bound = min(TAKEN / len(tokens), 1.0) * 2.0**32
    with np.errstate(over="ignore"):
        x = (tokens ^ path) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return mixed(x[(x >> np.uint64(32)) < bound] + path)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


PLACE = 20  # bits of a place that hold the position: a batch has fewer texts than that


def _place(batch: int, i: int) -> int:
    # batch is partition << 32 | number; places order as batches do, and stay below 2**63
    return ((batch >> 32) << 42 | (batch & 0x3FFFFF) << PLACE) + i


def _ask(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (place, columns...) gathered by batch: _batch, items."""
    batch = F.shiftleft(F.shiftright("place", 42), 32) + F.shiftright("place", PLACE).bitwiseAND(F.lit(0x3FFFFF))
    position = F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    return rows.select(batch.alias("_batch"), position.alias("i"), *columns).groupBy("_batch").agg(F.collect_list(F.struct("i", *columns)).alias("items"))


def _visit(texts: DataFrame, rows: DataFrame, columns: list[str], fn, schema: T.StructType) -> DataFrame:
    """Calls fn(place, tokens, items) for each document that rows name, with its rows; fn gives tuples."""
    asked = texts.join(_ask(rows, columns), F.col("batch") == F.col("_batch"))

    def visit(batches):
        hasher, tools = WordHasher(), {}
        for b in batches:
            for no, ends, text, items in zip(*(b.column(c) for c in ("batch", "ends", "text", "items")), strict=True):
                flat = items.values
                pos = flat.field("i").to_numpy()
                cols = [flat.field(c).to_pylist() for c in columns]
                order = np.argsort(pos, kind="stable").tolist()
                of: dict[int, list[int]] = {}
                for k in order:
                    of.setdefault(int(pos[k]), []).append(k)
                out: list[tuple] = []
                size = 0
                for i, tokens in _sets(hasher, ends.as_py(), text.as_py(), of):
                    for row in fn(_place(no.as_py(), i), tokens, [tuple(c[k] for c in cols) for k in of[i]], tools):
                        out.append(row)
                        size += sum(len(v) for v in row if isinstance(v, bytes)) + 64
                    if size > FLUSH:
                        yield _batch_of(out, schema)
                        out, size = [], 0
                if out:
                    yield _batch_of(out, schema)

    return asked.select("batch", "ends", "text", "items").mapInArrow(visit, schema)


def _batch_of(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)], names=schema.names)


def _runs(df: DataFrame, keys: list[str], fn, schema: T.StructType, parts: int) -> DataFrame:
    """Groups by keys, many at a time: fn gets a pyarrow table of whole groups, sorted, and where each begins."""
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches):
        import pyarrow as pa

        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy() for k in keys])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and tuple(held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys) == tuple(b.column(k)[0].as_py() for k in keys):
                first = int(new[0]) if len(new) else b.num_rows
                held.append(b.slice(0, first))
                if first == b.num_rows:
                    continue
                b, new = b.slice(first), new[1:] - first if len(new) else new
            if held:
                yield from call(held)
                held = []
            last = int(new[-1]) if len(new) else 0
            if last:
                yield from call([b.slice(0, last)])
            held = [b.slice(last)]
        if held:
            yield from call(held)

    def call(parts_):
        import pyarrow as pa

        table = pa.Table.from_batches(parts_).combine_chunks()
        key = np.stack([table.column(k).to_numpy() for k in keys])
        at = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        yield from fn(table, np.append(at, table.num_rows))

    return dealt.mapInArrow(run, schema)


def _fields(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


def _first_step(texts: DataFrame, doc_type, runs: int) -> DataFrame:
    """place, doc_id, key, h1, h2 (of the set), n and the paths of all runs, of every document."""
    seeds = mixed(np.arange(1, runs + 1, dtype=np.uint64))
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("doc_id", doc_type), T.StructField("key", T.StringType()), *_fields("h1:long h2:long n:int paths:longs").fields])

    def scan(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for b in batches:
            for no, ends, text, ids, keys in zip(*(b.column(c).to_pylist() for c in ("batch", "ends", "text", "doc_id", "key")), strict=True):
                place, h1, h2, n, paths = [], [], [], [], []
                for i, s in _sets(hasher, ends, text):
                    place.append(_place(no, i))
                    with np.errstate(over="ignore"):
                        h1.append(int(np.sum(s, dtype=np.uint64).view(np.int64)))
                        h2.append(int(np.sum(mixed(s + np.uint64(9)), dtype=np.uint64).view(np.int64)))
                    n.append(len(s))
                    paths.append(_signed(np.concatenate([_take(s, x) for x in seeds])) if len(s) else np.zeros(0, np.int64))
                kind = b.schema.field("doc_id").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(ids, kind), pa.array(keys, pa.string()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32()), pa.array(paths, pa.list_(pa.int64()))], names=schema.names)

    return texts.select("batch", "ends", "text", "doc_id", "key").mapInArrow(scan, schema)


def _bits(tokens: np.ndarray, tools: dict) -> int:
    """32 one-bit minima: two sets agree in a bit with probability (1 + J) / 2."""
    if "one" not in tools:
        tools["one"] = MinHasher(32, 11)
    return int(((tools["one"].of_shingles(tokens) & 1) << np.arange(32, dtype=np.uint32)).sum())


def _leaves(texts: DataFrame, rows: DataFrame, depth_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, place) to search: small ones, and those of sets too alike to split, each with its first place.

    With depth_most 1 no node is split: large ones are searched whole, in blocks."""
    depth_most = DEPTH if depth_most is None else depth_most
    small: list[DataFrame] = []
    alike: list[DataFrame] = []
    for depth in range(1, depth_most + 1):
        sizes = rows.groupBy(F.col("path").alias("_path")).agg(F.count("*").alias("_size"), F.min("place").alias("first")).filter("_size > 1")
        sized = written(rows.join(sizes, F.col("path") == F.col("_path")).select("path", "place", "_size", "first"), f"paths{depth}")
        small.append(sized.filter(f"_size <= {SMALL}").select("path", "place"))
        large = sized.filter(f"_size > {SMALL}")
        if large.isEmpty():
            break
        if depth == depth_most:
            alike.append(large.select("first", "place"))
            break

        def split(place, tokens, items, tools):
            bits = _bits(tokens, tools)
            return [(path, place, first, bits, _signed(_take(tokens, np.uint64(path & (2**64 - 1)))).tolist()) for path, first in items]

        next_step = written(_visit(texts, large, ["path", "first"], split, _fields("path:long place:long first:long bits:long next:longs")), f"steps{depth}")
        ones = [F.avg(F.shiftright("bits", i).bitwiseAND(F.lit(1)).cast("double")) for i in range(32)]
        agree = sum((p * p + (1 - p) * (1 - p) for p in ones[1:]), ones[0] * ones[0] + (1 - ones[0]) * (1 - ones[0])) / 32
        kind = next_step.groupBy(F.col("path").alias("_path")).agg((2 * agree - 1).alias("_alike"))
        judged = next_step.join(kind, F.col("path") == F.col("_path"))
        alike.append(judged.filter(F.col("_alike") >= ALIKE).select("first", "place"))
        # Written, as the sizes and the join with them would each make the rows anew.
        rows = written(judged.filter(F.col("_alike") < ALIKE).select(F.explode("next").alias("path"), "place"), f"next{depth}")
    return _union(texts, small, "path long, place long"), _union(texts, alike, "first long, place long")


def _union(texts: DataFrame, parts: list[DataFrame], columns: str) -> DataFrame:
    out = texts.sparkSession.createDataFrame([], columns) if not parts else parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _sketched(texts: DataFrame, small: DataFrame, parts: int) -> DataFrame:
    """(first, place) of the groups within small nodes whose sketches agree."""

    def sketch(place, tokens, items, tools):
        if "sketch" not in tools:
            tools["sketch"] = MinHasher(64, 13)
        s = (tools["sketch"].of_shingles(tokens) >> np.uint32(24)).astype(np.uint8).tobytes()
        return [(path, place, s) for (path,) in items]

    rows = _visit(texts, small, ["path"], sketch, _fields("path:long place:long sketch:binary"))

    def groups(table, at):
        import pyarrow as pa

        place = table.column("place").to_numpy()
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, 64)
        start, size = at[:-1], np.diff(at)
        # All pairs within each node: i is each row, j the rows after it in its node.
        end = np.repeat(start + size, size)
        n_after = end - np.arange(len(place)) - 1
        keep_i, keep_j = [], []
        row = 0
        cum = np.concatenate([[0], np.cumsum(n_after)])
        while row < len(place):
            stop = max(row + 1, int(np.searchsorted(cum, cum[row] + 200_000, "right")) - 1)
            n = n_after[row:stop]
            i = np.repeat(np.arange(row, stop), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            ok = (marks[i] == marks[j]).sum(axis=1) >= AGREE if len(i) else np.zeros(0, bool)
            keep_i.append(i[ok])
            keep_j.append(j[ok])
            row = stop
        i, j = np.concatenate(keep_i), np.concatenate(keep_j)
        label = _components(len(place), i, j)
        linked = np.unique(np.concatenate([i, j]))
        first = np.full(len(place), np.iinfo(np.int64).max)
        np.minimum.at(first, label, place)
        pairs = np.unique(np.stack([first[label[linked]], place[linked]], axis=1), axis=0) if len(linked) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["first", "place"])

    return _runs(rows, ["path"], groups, _fields("first:long place:long"), parts)


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _common(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of left shares with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    if len(left) == 1 and len(right) == 1:
        out[0, 0] = len(np.intersect1d(tokens[left[0]], tokens[right[0]], assume_unique=True))
        return out
    who = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    every = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(every) else new  # others can't be in common
    who, column = who[shared], column[shared]
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        width = 1024
        for a in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            x = np.zeros((len(tokens), width), np.float32)
            x[who[lo:hi], column[lo:hi] - a] = 1
            out += x[left] @ x[right].T
    return out


def _links(texts: DataFrame, groups: DataFrame, threshold: float, parts: int) -> DataFrame:
    """place, links (of those pairs that count in a group) and root: each group's exact links."""
    sizes = groups.groupBy(F.col("first").alias("_first")).agg(F.count("*").alias("_docs"), F.sum("n").alias("_tokens"))
    n_blocks = F.greatest(F.ceil(F.col("_docs") / BLOCK_DOCS), F.ceil(F.col("_tokens") / BLOCK_TOKENS), F.lit(1)).cast("int")
    rows = groups.join(sizes.select("_first", n_blocks.alias("blocks")), F.col("first") == F.col("_first")).select("first", "place", "blocks")

    def send(place, tokens, items, tools):
        import zlib

        own = sorted(x for x, _ in items)
        data = tokens.tobytes()
        out = []
        for first, blocks in items:
            mine = zlib.crc32(place.to_bytes(8, "little")) % blocks
            also = [x for x in own if x < first]
            for other in range(blocks):
                out.append((first, min(mine, other), max(mine, other), place, mine, data, also))
        return out

    sent = _visit(texts, rows, ["first", "blocks"], send, _fields("first:long a:int b:int place:long block:int tokens:binary also:longs"))

    def compare(table, at):
        import pyarrow as pa

        place, block = table.column("place").to_numpy(), table.column("block").to_numpy()
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        out: list[np.ndarray] = []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").slice(s, e - s).to_pylist()]
            also = [np.asarray(x, np.int64) for x in table.column("also").slice(s, e - s).to_pylist()]
            same = a[s] == b[s]
            left = np.arange(e - s) if same else np.flatnonzero(block[s:e] == a[s])
            right = left if same else np.flatnonzero(block[s:e] == b[s])
            if not len(left) or not len(right):
                continue
            size = np.asarray([len(t) for t in tokens], np.float32)
            common = _common(tokens, left, right)
            linked = common >= threshold * (size[left][:, None] + size[right] - common) - 1e-3
            linked &= place[s:e][left][:, None] != place[s:e][right]
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            counted = linked & ~(_common(also, left, right) > 0) if any(len(x) for x in also) else linked
            n = np.zeros(e - s, np.int64)
            n[left] += counted.sum(axis=1)
            if not same:
                n[right] += counted.sum(axis=0)
            label = _components(e - s, left[i], right[j])
            ids = place[s:e]
            first = np.full(e - s, np.iinfo(np.int64).max)
            np.minimum.at(first, label, ids)
            who = np.unique(np.concatenate([left[i], right[j]]))
            out.append(np.stack([ids[who], n[who], first[label[who]]], axis=1))
        rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["place", "links", "root"])

    return _runs(sent, ["first", "a", "b"], compare, _fields("place:long links:long root:long"), parts)


def components(edges: DataFrame) -> DataFrame:
    """(place, root): the smallest place that each one is connected with; edges has place and root.

    Large-star and small-star steps in turn: each joins every neighbour to the smallest one."""
    now = written(edges.filter("place <> root").select(F.greatest("place", "root").alias("u"), F.least("place", "root").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("_u")).select("u", "v", "m")
        now = written(small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.countDistinct("u")).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("place"), F.col("v").alias("root"))
        seen = mark


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, buckets=None) -> DataFrame:
    """doc_id, key (of doc_id and text), class_id (the smallest doc_id of the class), n_links (other shingle sets at
    least `threshold` alike), n_copies (rows of the same set) and first (true for one row of each class).

    buckets, a function as _visit takes, gives other (path, place) rows than the chosen paths' to search; each such
    bucket is searched whole."""
    spark = docs.sparkSession
    parts = partitions(spark)
    key = row_key("doc_id", "text")
    texts = packed(docs.select(text_of().cast("binary").alias("text"), "doc_id", key.alias("key")), ["doc_id", "key"], "sets", BATCH)
    every = written(_first_step(texts, docs.schema["doc_id"].dataType, runs_needed(threshold, recall)), "documents")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    copies = written(every.groupBy("h1", "h2", "n").agg(F.min(rank).alias("r"), F.count("*").alias("n_copies")).select("h1", "h2", "n", F.col("r.place").alias("rep"), F.col("r.doc_id").alias("rep_id"), "n_copies"), "copies")
    alone = every.select("place", "paths").join(copies.select(F.col("rep").alias("_rep"), "n"), F.col("place") == F.col("_rep")).filter("n > 0")
    if buckets is not None:
        paths = _visit(texts, alone.select("place"), [], buckets, _fields("path:long place:long"))
        small, alike = _leaves(texts, paths, 1)
    else:
        small, alike = _leaves(texts, alone.select(F.explode(F.array_distinct("paths")).alias("path"), "place"))
    sizes = copies.select(F.col("rep").alias("_rep"), "n")
    groups = _sketched(texts, small, parts).unionByName(alike).distinct()
    groups = written(groups.join(sizes, F.col("place") == F.col("_rep")).select("first", "place", "n"), "groups")
    found = written(_links(texts, groups, threshold, parts), "links")
    root = components(found.select("place", "root"))
    links = found.groupBy(F.col("place").alias("_place")).agg(F.sum("links").alias("links"))
    classed = copies.join(links, F.col("rep") == F.col("_place"), "left").drop("_place").join(root.select(F.col("place").alias("_place"), "root"), F.col("rep") == F.col("_place"), "left").withColumn("root", F.coalesce("root", "rep"))
    classed = written(classed.select("h1", "h2", "n", "rep", "rep_id", "n_copies", F.coalesce("links", F.lit(0)).alias("n_links"), "root"), "classed")
    lead = classed.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep")).alias("r")).select("_root", F.col("r.rep_id").alias("class_id"), F.col("r.rep").alias("lead"))
    classed = classed.join(lead, F.col("root") == F.col("_root")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("n").alias("_n"), "n_copies", "n_links", "class_id", "lead")
    out = every.select("place", "doc_id", "key", "h1", "h2", "n").join(classed, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n")))
    return out.select("doc_id", "key", "class_id", "n_links", "n_copies", (F.col("place") == F.col("lead")).alias("first"))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs).select("doc_id", "class_id", "n_links", "n_copies", F.col("first").alias("is_first"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one with the smallest doc_id; of repeated rows one."""
    stay = join(docs.select("doc_id", "text")).filter("first").select(F.col("key").alias("_stay"))
    own = docs.select(as_struct(docs).alias("_doc"), row_key("doc_id", "text").alias("_key"), rest_of(docs, "doc_id", "text").alias("_order"))
    kept = own.join(stay, F.col("_key") == F.col("_stay"), "left_semi")
    return kept.groupBy("_key").agg(F.min_by("_doc", "_order").alias("_doc")).select("_doc.*")
