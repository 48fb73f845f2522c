"""Line dedup by pairwise alignment.

Lines are hashed; of each line hash that several documents hold, the first document (by doc_id) is its owner.
So it is of each run of lines that has MIN_CHARS characters and none to spare, and of texts of fewer, as a whole.
A document is paired with the owners of its runs: two rows a line at most, however many documents hold
it. Patience diff aligns each pair, anchored on lines that occur once in both; blocks of aligned lines are
deleted from the later document. Lines that stay though earlier documents hold them are tried with the next
holders, one of each form (see _holders), till they go or none is left: what goes is what an alignment with
every earlier document would delete. Decisions look at the input, not at what is
left of it.

An aligned block of fewer than MIN_CHARS characters is left, unless it is the whole of both texts. Runs count
however many documents hold them.

Defined cases: null text is empty (and stays null); blank lines are aligned within blocks only; equal texts,
repeated rows too, lose all lines but in the first, unless all of them are blank; a text that loses all is empty, its row stays; rows
without doc_id come after all others; an empty table gives an empty result; other columns are unchanged but
n_chars, which follows the text."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm.shared import _B, _inverse, _powers, as_struct, changed, mixed, rest_of, row_key, running_total, text_of, written

MIN_CHARS = 20


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both, of equals the one that ends earlier in the second; pairs come
    sorted by their first."""
    from bisect import bisect_left

    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of a and b, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        once: dict[int, int] = {}
        for k in range(i, i2):
            once[a[k]] = -1 if a[k] in once else k
        other: dict[int, int] = {}
        for k in range(j, j2):
            if b[k] in once:
                other[b[k]] = -1 if b[k] in other else k
        anchors = _longest_rising(sorted((once[h], k) for h, k in other.items() if k >= 0 and once[h] >= 0))
        li, lj = i, j
        for x, y in anchors:
            # A gap between anchors is aligned on its own, and so is what follows each.
            if x >= li and y >= lj:
                todo.append((li, x, lj, y))
                out.append((x, y))
                li, lj = x + 1, y + 1
        if anchors:
            todo.append((li, i2, lj, j2))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], lengths: list[int], least: int = MIN_CHARS) -> list[int]:
    """Positions in a of aligned blocks with b of at least `least` characters; lengths are those of a's lines."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(lengths[k] for k in block) >= least:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def _windows(hashes, lengths, ends):
    """Runs of lines that reach MIN_CHARS, of the documents laid end to end (ends: where each ends): start, end
    (inclusive), key, and whether the run is told by its start, by its end, or both: then no shorter run is in it.

    A block that deletes a line holds the shortest run from that line on, or the shortest up to it, or a run
    around it that has no shorter one in it; so whoever can delete a line holds one of these keys."""
    n = len(hashes)
    doc = np.searchsorted(ends, np.arange(n), "right")
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = np.concatenate([[0], ends])[doc]
    right = np.searchsorted(total, total[:-1] + MIN_CHARS, "left") - 1
    left = np.searchsorted(total, total[1:] - MIN_CHARS, "right") - 1
    s = np.concatenate([np.arange(n), left])
    e = np.concatenate([right, np.arange(n)])
    by_start = np.repeat([True, False], n)
    both = np.concatenate([right < ends[doc], left >= first])
    s, e, by_start = s[both], e[both], by_start[both]
    tight = (left[e] == s) & (right[s] == e)
    keep = by_start | ~tight  # a tight run is found both ways
    s, e, by_start, tight = s[keep], e[keep], by_start[keep], tight[keep]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * _powers(n, int(_B)), dtype=np.uint64)])
        key = mixed((sums[e + 1] - sums[s]) * _powers(n, _inverse(int(_B)))[s] + (e - s + 1).astype(np.uint64)).view(np.int64)
    return doc[s], s, e, key, by_start, tight


def _short_texts(hashes, lengths, ends) -> dict[int, int]:
    """Keys of whole documents that have characters, but fewer than MIN_CHARS."""
    import hashlib

    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    size = total[ends] - total[starts]
    return {int(i): int.from_bytes(hashlib.blake2b(hashes[starts[i] : ends[i]].tobytes(), digest_size=8, person=b"whole").digest(), "little", signed=True) for i in np.flatnonzero((size > 0) & (size < MIN_CHARS))}


def _flat(column):
    """Values of a list column end to end, and where each row ends."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def _keys(batches):
    """pos, h: the keys by which documents meet."""
    import pyarrow as pa

    for b in batches:
        (hashes, ends), (lengths, _) = _flat(b.column("hashes")), _flat(b.column("lengths"))
        doc, s, e, key, _, _ = _windows(hashes, lengths, ends)
        short = _short_texts(hashes, lengths, ends)
        doc, key = (np.concatenate([x, np.array(list(y), np.int64)]) for x, y in ((doc, short), (key, short.values())))
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])[: len(doc)]
        yield pa.RecordBatch.from_arrays([b.column("pos").take(pa.array(doc[new])), pa.array(key[new])], names=["pos", "h"])


def _left(batches):
    """pos, keys: those of each row's keys by which a line that is not gone yet could go."""
    import pyarrow as pa

    for b in batches:
        out = []
        for hashes, lengths, keys, lists in zip(*(b.column(c).to_pylist() for c in ("hashes", "lengths", "keys", "lists")), strict=True):
            stays = np.ones(len(hashes), bool)
            for x in lists or ():
                stays[x] = False
            count = np.concatenate([[0], np.cumsum(stays)])
            _, s, e, key, by_start, tight = _windows(np.array(hashes, np.int64), np.array(lengths, np.int64), np.array([len(hashes)]))
            open_ = np.where(tight, count[e + 1] > count[s], stays[np.where(by_start, s, e)])
            out.append(sorted(set(key[open_].tolist()) & set(keys)))  # short texts went whole with their first holder
        yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array(out, pa.list_(pa.int64()))], names=["pos", "keys"])


def _align(batches):
    import pyarrow as pa

    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("hashes", "lengths", "other")), strict=True)
        gone = [list(range(len(x))) if x == y and sum(n) else common_blocks(x, y, n) for x, n, y in rows]
        yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array([len(x) for x in b.column("hashes").to_pylist()], pa.int32()), pa.array(gone, pa.list_(pa.int32()))], names=["pos", "n", "gone"])


def _forms(batches):
    """pos, form: a hash of the lines, where runs of lines that no other document holds are all alike."""
    import hashlib

    import pyarrow as pa

    for b in batches:
        out = []
        for hashes, shared in zip(b.column("hashes").to_pylist(), b.column("shared").to_pylist(), strict=True):
            known, form = set(shared or ()), []
            for x in hashes:
                y = x if x in known else None
                if y is not None or not form or form[-1] is not None:
                    form.append(y)
            out.append(int.from_bytes(hashlib.blake2b(repr(form).encode(), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array(out, pa.int64())], names=["pos", "form"])


def _flags(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for n, lists in zip(b.column("n").to_pylist(), b.column("lists").to_pylist(), strict=True):
            x = np.zeros(n, bool)
            for y in lists:
                x[y] = True
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array(out, pa.list_(pa.bool_()))], names=["pos", "gone"])


def _aligned(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """pos, n, gone: what goes by each pair (pos, owner); written."""
    later = pairs.join(seqs.select(F.col("pos").alias("_p"), "hashes", "lengths"), F.col("pos") == F.col("_p")).drop("_p")
    both = later.join(seqs.select(F.col("pos").alias("_o"), F.col("hashes").alias("other")), F.col("owner") == F.col("_o")).select("pos", "hashes", "lengths", "other")
    return written(both.mapInArrow(_align, "pos long, n int, gone array<int>").filter("size(gone) > 0"), "aligned")


def _together(aligned: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, aligned).groupBy("pos").agg(F.max("n").alias("n"), F.collect_list("gone").alias("lists"))


def _unsettled(keys: DataFrame, seqs: DataFrame, aligned: list[DataFrame]) -> DataFrame:
    """pos, keys: what may still delete lines, of keys (pos, keys); written."""
    gone = _together(aligned).select(F.col("pos").alias("_g"), "lists")
    rows = keys.join(seqs.select(F.col("pos").alias("_p"), "hashes", "lengths"), F.col("pos") == F.col("_p")).join(gone, F.col("pos") == F.col("_g"), "left")
    return written(rows.select("pos", "hashes", "lengths", "keys", "lists").mapInArrow(_left, "pos long, keys array<long>").filter("size(keys) > 0"), "unsettled")


def _holders(keys: DataFrame, each: DataFrame, seqs: DataFrame) -> DataFrame:
    """h, owner, rank: of each key in keys (pos, keys) its holders in order, the first one of each form; written.

    Documents that differ only in lines which no other holder of these keys has align alike with all of them."""
    wanted = written(keys.select(F.explode("keys").alias("_h")).distinct(), "wanted")
    holders = written(each.join(wanted, F.col("h") == F.col("_h")).select("h", "pos"), "holders")
    some = holders.select(F.col("pos").alias("_p")).distinct()
    own = written(seqs.join(some, F.col("pos") == F.col("_p")).select("pos", "hashes"), "holding")
    lines = own.select("pos", F.explode(F.array_distinct("hashes")).alias("x"))
    several = written(lines.groupBy(F.col("x").alias("_x")).agg(F.count("*").alias("n")).filter("n > 1").select("_x"), "several")
    shared = lines.join(several, F.col("x") == F.col("_x")).groupBy(F.col("pos").alias("_p")).agg(F.collect_list("x").alias("shared"))
    forms = own.join(shared, F.col("pos") == F.col("_p"), "left").select("pos", "hashes", "shared").mapInArrow(_forms, "pos long, form long")
    first = holders.join(forms.withColumnRenamed("pos", "_p"), F.col("pos") == F.col("_p")).groupBy("h", "form").agg(F.min("pos").alias("owner"))
    ranked = running_total(written(first.select("h", "owner", F.lit(1).cast("long").alias("one")), "first"), ["h"], ["owner"], "one", "rank")
    return written(ranked.select("h", "owner", "rank"), "ranked")


def decide(docs: DataFrame) -> DataFrame:
    """key (of doc_id and text), n, own and rest of all rows of that key that lose lines: of rows equal in both, n lose
    lines; the first of those loses own (array<boolean>: which lines go), the others rest. docs has doc_id and text."""
    lines = F.transform(F.split(text_of(), "\n"), lambda x: F.trim(F.regexp_replace(x, "[\r\t]", " ")))
    base = docs.select("doc_id", row_key("doc_id", "text").alias("key"), lines.alias("l"))
    base = base.select(F.col("doc_id").isNull().cast("int").alias("none"), "doc_id", "key", F.transform("l", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("l", lambda x: F.length(x)).alias("lengths"), F.lit(1).cast("long").alias("one"), F.lit(0).alias("all"))
    ranked = running_total(written(base, "lines"), ["all"], ["none", "doc_id", "key"], "one", "pos")
    seqs = written(ranked.select("pos", "doc_id", "key", "hashes", "lengths"), "sequences")
    each = written(seqs.select("pos", "hashes", "lengths").mapInArrow(_keys, "pos long, h long"), "keys")
    owners = each.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("n"), F.min("pos").alias("owner")).filter("n > 1")
    # Written, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    owners = written(owners, "owners")
    held = written(each.join(owners, F.col("h") == F.col("_h")).filter("owner <> pos").select("pos", "h", "owner"), "held")
    aligned = [_aligned(held.select("pos", "owner").distinct(), seqs)]
    keys = _unsettled(held.groupBy("pos").agg(F.collect_list("h").alias("keys")), seqs, aligned)
    if not keys.isEmpty():
        # Lines that the first holder leaves are tried with the next ones, more of them each time, till they go
        # or no holder is left.
        holders = _holders(keys, each, seqs)
        done, last = 1, holders.agg(F.max("rank")).first()[0]
        while done < last:
            some = holders.filter((F.col("rank") > done) & (F.col("rank") <= 4 * done)).select(F.col("h").alias("_h"), "owner")
            pairs = keys.select("pos", F.explode("keys").alias("h")).join(some, F.col("h") == F.col("_h")).filter("owner < pos").select("pos", "owner").distinct()
            aligned.append(_aligned(pairs, seqs))
            done *= 4
            if done < last:
                keys = _unsettled(keys, seqs, aligned)
                if keys.isEmpty():
                    break
    gone = _together(aligned).mapInArrow(_flags, "pos long, gone array<boolean>")
    named = gone.join(seqs.select(F.col("pos").alias("_p"), "key"), F.col("pos") == F.col("_p")).drop("_p")
    # Of equal rows the first keeps its lines unless an earlier document takes them; the others lose all of them.
    return named.groupBy("key").agg(F.count("*").alias("n"), F.min_by("gone", "pos").alias("own"), F.max_by("gone", "pos").alias("rest"))


def cut_rows(docs: DataFrame) -> DataFrame:
    """_doc (struct of docs' columns, repeated blocks of lines deleted), n_lines and n_removed."""
    decided = written(decide(docs.select("doc_id", "text")), "gone").select(F.col("key").alias("_k"), "n", "own", "rest")
    own = docs.select(as_struct(docs).alias("_doc"), row_key("doc_id", "text").alias("_key"), rest_of(docs, "doc_id", "text").alias("_order"))
    # Numbered and joined by key alone, so the texts are shuffled once. Rows beyond the n that lose lines keep them.
    own = own.withColumn("_copy", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_order"))))
    out = own.join(decided, F.col("_key") == F.col("_k"), "left")
    out = out.withColumn("_gone", F.when(F.col("_copy") < F.col("n"), F.col("rest")).when(F.col("_copy") == F.col("n"), F.col("own")))
    text = F.col("_doc.text")
    kept = F.array_join(F.filter(F.zip_with(F.split(text, "\n"), "_gone", lambda x, g: F.when(~F.coalesce(g, F.lit(False)), x)), lambda x: x.isNotNull()), "\n")
    new = {"text": F.when(F.col("_gone").isNull(), text).otherwise(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_doc.n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    removed = F.coalesce(F.size(F.filter("_gone", lambda g: g)), F.lit(0))
    return out.select(F.struct(*changed(docs, "_doc", new)).alias("_doc"), F.size(F.split(text_of(text), "\n")).cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated blocks of lines deleted."""
    return cut_rows(docs).select("_doc.*")


def op2_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_rows(docs).select("_doc.doc_id", "n_lines", "n_removed", F.sha2(text_of(F.col("_doc.text")), 256).alias("kept_sha256"), F.col("_doc.text").alias("kept_text"))


def deduplicated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without the blocks of lines that an earlier one holds."""
    return without_repeats(docs)
