"""Conversation structure repair by a min-plus scan of matrices.

A repaired conversation has an optional system turn and then pairs of user and assistant, or nothing: an automaton of
four states (nothing yet, after system, after user, after assistant). Each row is a 4x4 matrix of (cost, audit)
elements, from state to state: keep, delete or give another role, with the closure of insertions behind it. Elements add
by the smaller one and multiply by adding costs and joining audits. As no audit of a block is the beginning of another one
of equal cost (the longer one inserts more), the product is associative and keeps the ASCII-least audit. Rows are dealt
by ranges of (conversation, turn), so a conversation may span any number of tasks: each reduces its own rows as a tree,
and the matrices of conversations at the borders of ranges merge, 16 at a time, in a tree of groupings.

A row's first fault counts: blank (none but white space), duplicate (role and text stand earlier in the conversation),
truncated (does not end in one of ".!?").

Defined cases: null role and text count as one space; a role counts by its first letter, and one of another letter than
s, u and a can't be kept; rows of equal turn come by role and the MD5 of their text; null turns come first; texts are told
by their MD5; a null conv_id is a conversation of its own; a conversation of which no row is left has zeros and an empty
audit; texts of any length count whole; an empty table gives an empty result; other columns are ignored, whatever their
names. The rows of one conversation, once repaired, pass through one task as a stream where they are hashed."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import partitions, running_total, written

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Rows whose product is looked up as a whole, and how many matrices one task of the merging tree takes.
BLOCK, FAN = 8, 16
#: Products that a task keeps.
KNOWN = 1 << 14
#: Kinds of rows: 2 * place of the initial here + 1 if truncated; the last kind must be deleted.
INITIALS = ("s", "u", "a", "")
GONE = 8
LEGAL = {"su", "ua", "au"}

Element = tuple[int, bytes] | None
Matrix = list[Element]


def least(*some: Element) -> Element:
    return min((x for x in some if x is not None), default=None)


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for i in range(0, 16, 4):
        for j in range(4):
            best: Element = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost < best[0]:
                    best = (cost, x[1] + y[1])
                elif cost == best[0]:
                    best = min(best, (cost, x[1] + y[1]))
            out.append(best)
    return out


def _matrix(cells: dict[tuple[int, int], Element]) -> Matrix:
    return [cells.get((i, j)) for i in range(4) for j in range(4)]


ONE = _matrix({(i, i): (0, b"") for i in range(4)})
_INSERTED = {(0, 2): (INSERT, b"I"), (1, 2): (INSERT, b"I"), (3, 2): (INSERT, b"I"), (2, 3): (INSERT, b"I")}


def _closure() -> Matrix:
    """Any number of insertions: powers until nothing gets smaller."""
    step = _matrix(_INSERTED | {(i, i): (0, b"") for i in range(4)})
    out = ONE
    while (new := times(out, step)) != out:
        out = new
    return out


CLOSURE = _closure()


def _of_kind(kind: int) -> Matrix:
    cells: dict[tuple[int, int], Element] = {(i, i): (DELETE, b"D") for i in range(4)}
    if kind != GONE:
        initial, cut = INITIALS[kind // 2], kind % 2
        keeps = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)], "": []}[initial]
        for at in [(0, 2), (1, 2), (3, 2), (2, 3)]:
            cells[at] = (REROLE + cut, b"R")
        for at in keeps:
            cells[at] = least(cells.get(at), (KEEP + cut, b"K"))
    return times(_matrix(cells), CLOSURE)


KINDS = [_of_kind(k) for k in range(GONE + 1)]


def block(kinds: bytes, known: dict[bytes, Matrix]) -> Matrix:
    """The product of at most BLOCK rows; `known` keeps products."""
    if len(kinds) < 2:
        return KINDS[kinds[0]] if kinds else ONE
    if kinds not in known:
        if len(known) >= KNOWN:
            known.clear()
        half = len(kinds) // 2
        known[kinds] = times(block(kinds[:half], known), block(kinds[half:], known))
    return known[kinds]


class Rows:
    """What is known of a stretch of a conversation's rows."""

    def __init__(self, known: dict[bytes, Matrix]) -> None:
        self.known = known
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None
        self.waiting, self.tree = bytearray(), []

    def add(self, n: int, turn: int | None, initial: str, blank: bool, again: bool, cut: bool) -> None:
        """n equal rows, of which all but the first are duplicates."""
        if not n:
            return
        self._beside(initial)
        self.illegal += n - 1 if initial + initial not in LEGAL else 0
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.last = initial
        self.n += n
        if blank:
            self.blank += n
        else:
            self.duplicate += n - (not again)
            self.truncated += cut and not again
        if not blank and not again:
            place = INITIALS.index(initial) if initial in INITIALS else 3
            self._push(bytes([2 * place + cut]))
            n -= 1
        for at in range(0, n, BLOCK):
            self._push(bytes([GONE]) * min(BLOCK, n - at))

    def _beside(self, initial: str) -> None:
        if self.n == 0:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1

    def _push(self, kinds: bytes) -> None:
        self.waiting += kinds
        while len(self.waiting) >= BLOCK:
            self._hang(1, block(bytes(self.waiting[:BLOCK]), self.known))
            del self.waiting[:BLOCK]

    def _hang(self, size: int, m: Matrix) -> None:
        """Equal sizes merge at once, so each row takes part in as many products as the tree is deep."""
        while self.tree and self.tree[-1][0] <= size:
            left, a = self.tree.pop()
            size, m = left + size, times(a, m)
        self.tree.append((size, m))

    def product(self) -> Matrix:
        m = block(bytes(self.waiting), self.known)
        for _, a in reversed(self.tree):
            m = times(a, m)
        return m


def best(m: Matrix) -> tuple[int, bytes]:
    """The cheapest way from the start to nothing or to an assistant's turn."""
    whole = times(CLOSURE, m)
    return least(whole[0], whole[3])


COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
ENDS = {"first_turn": T.LongType(), "last_turn": T.LongType(), "first": T.StringType(), "last": T.StringType()}


def _stretch_fields(conv: T.DataType) -> list[T.StructField]:
    fields = [T.StructField("conv_id", conv), T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, t) for c, t in ENDS.items()]]
    return [*fields, T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.BinaryType())), T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.LongType()))]


def scanned(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, key, n, blank, cut, again) in order, a task a range. Rows: kind 0, what may be kept,
    with its place in its stretch; 1, a conversation that ends in its range, with its cost and audit; 2, the first and last
    conversation of a range, with its matrix."""
    conv = turns.schema["conv_id"].dataType
    fields = [T.StructField("kind", T.IntegerType()), *_stretch_fields(conv), T.StructField("at", T.LongType()), T.StructField("role", T.StringType()), T.StructField("key", T.BinaryType())]
    schema = T.StructType(fields)
    names = [f.name for f in fields]

    def scan(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        types: dict = {"kind": pa.int32(), "part": pa.int32(), "role": pa.string(), "key": pa.binary(), "first": pa.string(), "last": pa.string(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.binary()), "parts": pa.list_(pa.int32()), "sizes": pa.list_(pa.int64())}
        out: list[dict] = []

        def flush():
            arrays = [pa.array([r.get(c) for r in out], types.get(c, pa.int64())) for c in names]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def close(conv_id, rows, open_):
            m = rows.product()
            cells = m if open_ else [best(m)]
            told = {c: int(getattr(rows, c)) for c in COUNTS} | {c: getattr(rows, c) for c in ENDS}
            costs, audits = [c and c[0] for c in cells], [c and c[1] for c in cells]
            out.append({"kind": 2 if open_ else 1, "conv_id": conv_id, "part": part, "costs": costs, "audits": audits, "parts": [part], "sizes": [rows.n], **told})

        held, rows, leading, known = None, None, True, {}
        for b in batches:
            types["conv_id"] = b.schema.field("conv_id").type
            for conv_id, turn, role, key, n, blank, cut, again in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "key", "n", "blank", "cut", "again")), strict=True):
                if rows is None or conv_id != held:
                    if rows is not None:
                        close(held, rows, leading)
                        leading = False
                    held, rows = conv_id, Rows(known)
                if n and not blank and not again:
                    out.append({"kind": 0, "conv_id": conv_id, "part": part, "at": rows.n, "role": role, "key": key})
                rows.add(n, turn, role[:1], blank, again, cut)
                if len(out) >= 1 << 13:
                    yield flush()
        if rows is not None:
            close(held, rows, True)
        if out:
            yield flush()

    keys = ["conv_id", "turn", "role", "key"]
    dealt = turns.repartitionByRange(partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    return written(dealt.mapInArrow(scan, schema), "scanned_turns")


def merged(pieces: DataFrame, parts: int) -> DataFrame:
    """The matrices of stretches, one for each conversation: a tree of groupings of FAN stretches at most."""
    schema = T.StructType(_stretch_fields(pieces.schema["conv_id"].dataType))
    names = [f.name for f in schema.fields]

    def join(key, table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        out, m = rows[0], [None if c is None else (c, a) for c, a in zip(rows[0]["costs"], rows[0]["audits"], strict=True)]
        for r in rows[1:]:
            m = times(m, [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)])
            if out["n"] and r["n"]:
                out["illegal"] += out["last"] + r["first"] not in LEGAL
            out["turns"] -= out["last_turn"] is not None and out["last_turn"] == r["first_turn"]
            for c in COUNTS:
                out[c] += r[c]
            for c in ("first", "first_turn"):
                out[c] = r[c] if out[c] is None else out[c]
            for c in ("last", "last_turn"):
                out[c] = out[c] if r[c] is None else r[c]
            out["parts"], out["sizes"] = out["parts"] + r["parts"], out["sizes"] + r["sizes"]
        out |= {"costs": [c and c[0] for c in m], "audits": [c and c[1] for c in m], "part": key[1].as_py()}
        return pa.table({c: pa.array([out[c]], table.schema.field(c).type) for c in names})

    level = pieces.select(*names)
    for _ in range(max(1, math.ceil(math.log(max(parts, 2), FAN)))):
        level = level.groupBy("conv_id", F.expr(f"part div {FAN}").cast("int").alias("_next")).applyInArrow(join, schema)
    return level


def _finished(stretches: DataFrame) -> DataFrame:
    """Stretches that are whole conversations, with their cost and audit in place of the matrix."""

    def finish(batches):
        import pyarrow as pa

        for b in batches:
            found = [best([None if c is None else (c, a) for c, a in zip(cs, xs, strict=True)]) for cs, xs in zip(b.column("costs").to_pylist(), b.column("audits").to_pylist(), strict=True)]
            arrays = {c: b.column(c) for c in b.schema.names} | {"costs": pa.array([[c] for c, _ in found], pa.list_(pa.int64())), "audits": pa.array([[a] for _, a in found], pa.list_(pa.binary()))}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return stretches.mapInArrow(finish, stretches.schema)


def _edits(report: DataFrame) -> DataFrame:
    """Each turn of the repaired conversations: conv_id, seq, edit, part and place of the row it comes from (null where
    inserted) and the role it gets (null where the row keeps its own)."""
    schema = T.StructType([T.StructField("conv_id", report.schema["conv_id"].dataType), T.StructField("seq", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("given", T.StringType())])

    def told(conv_id, audit, parts, sizes):
        seq, row, which = 0, 0, 0
        odd = (len(audit) - audit.count("D")) % 2  # one turn more than pairs: it begins with system
        for edit in audit:
            if edit != "I":
                while row >= sizes[which]:
                    row, which = row - sizes[which], which + 1
                place = (parts[which], row)
                row += 1
                if edit == "D":
                    continue
            else:
                place = (None, None)
            yield conv_id, seq, edit, *place, None if edit == "K" else ("user", "assistant")[(seq - odd) % 2]
            seq += 1

    def spread(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        names = [f.name for f in schema.fields]
        for b in batches:
            kind = b.schema.field("conv_id").type
            some: list = []

            def flush(kind=kind, some=some):
                columns = list(zip(*some, strict=True))
                some.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types], strict=True)], names=names)

            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "parts", "sizes")), strict=True):
                for turn in told(*row):
                    some.append(turn)
                    if len(some) >= 1 << 14:
                        yield flush()
            if some:
                yield flush()

    return report.select("conv_id", "audit", "parts", "sizes").mapInArrow(spread, schema)


def repaired(rows: DataFrame, copies: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text), each as often as `copies` says: a report (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit) for each conversation, and the repaired turns (conv_id, seq, role, text, edit)."""
    spark = rows.sparkSession
    text = F.coalesce(F.col("text"), F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACE))
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.md5(text)).alias("key"), text.alias("text"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), (F.lit(1) if copies is None else copies).cast("long").alias("n"))
    # Equal rows count from here on, so a row that stands a million times is one.
    equal = base.groupBy("conv_id", "turn", "role", "key").agg(F.sum("n").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"))
    seen = running_total(written(equal, "turns"), ["conv_id", "role", "key"], ["turn"], "n", "until")
    scan = scanned(seen.select("conv_id", "turn", "role", "key", "n", "blank", "cut", (F.col("until") > F.col("n")).alias("again")))
    stretches = T.StructType(_stretch_fields(scan.schema["conv_id"].dataType)).names
    ends = scan.filter("kind = 1").select(*stretches).unionByName(_finished(merged(scan.filter("kind = 2"), partitions(spark))))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    report = written(ends.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].cast("string").alias("audit"), "parts", "sizes"), "repairs")

    edits = _edits(report)
    kept = scan.filter("kind = 0").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("at").alias("_at"), F.col("role").alias("_role"), F.col("key").alias("_key"))
    found = edits.filter("part IS NOT NULL").join(kept, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("at") == F.col("_at")))
    texts = base.filter("NOT blank AND n > 0").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("key").alias("_k")).agg(F.any_value("text").alias("_text"))
    taken = found.join(texts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_role") == F.col("_r")) & (F.col("_key") == F.col("_k")))
    whole = taken.select("conv_id", "seq", F.coalesce("given", "_role").alias("role"), F.col("_text").alias("text"), "edit")
    inserted = edits.filter("part IS NULL").select("conv_id", "seq", F.col("given").alias("role"), F.lit("").alias("text"), "edit")
    return report.drop("parts", "sizes"), whole.unionByName(inserted)


def digests(turns: DataFrame) -> DataFrame:
    """_conv and sha256 of each conversation's turns as lines `role:text`, joined by line ends: its rows pass as a stream."""
    schema = T.StructType([T.StructField("_conv", turns.schema["conv_id"].dataType), T.StructField("sha256", T.StringType())])

    def digest(batches):
        import pyarrow as pa

        held, state, kind = None, None, pa.int64()
        for b in batches:
            kind, done = b.schema.field("conv_id").type, []
            for conv_id, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if state is None or conv_id != held:
                    if state is not None:
                        done.append((held, state.hexdigest()))
                    held, state = conv_id, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([s for _, s in done], pa.string())], names=schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([state.hexdigest()], pa.string())], names=schema.names)

    lines = turns.select("conv_id", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(digest, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, as columns of the rows: role, text and n (how often the row is left)."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    told = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    what = F.crc32(told) % 20
    return rows.select("conv_id", "turn", F.when(what == 4, "user").otherwise(role).alias("role"), F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("n"))


def op13_turns(spark, sf_dir: str) -> DataFrame:
    report, turns = repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("n"))
    out = report.join(digests(turns), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.select(*[c for c in out.columns if c != "sha256"], F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same by dynamic programming over positions: a state's cheapest (cost, audit), row after row. CRC-32 is reckoned byte
#: by byte from a table made here.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)), i)) AS tab),
t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT) AS told FROM conversations),
w AS (SELECT t.*, xor(list_reduce(told, lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS what FROM t, crc),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM w),
o AS (SELECT *, coalesce(conv_id::VARCHAR, 'none') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
r AS MATERIALIZED (SELECT c, pos, role, text, i, (cut AND NOT blank AND NOT again)::INT AS cut, blank OR again AS gone FROM f),
ins(p, q, cost, audit, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']),
  (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
s AS (SELECT r.c, 0::BIGINT AS pos, ins.q, {'cost': ins.cost::BIGINT, 'audit': ins.audit, 'lines': ins.lines} AS best FROM (SELECT DISTINCT c FROM r) r, ins WHERE ins.p = 0
  UNION ALL
  SELECT c, pos, q, min({'cost': cost::BIGINT, 'audit': audit, 'lines': lines}) FROM (
    SELECT e.c, e.pos, ins.q, e.cost + ins.cost AS cost, e.audit || ins.audit AS audit, e.lines || ins.lines AS lines FROM (
      SELECT s.c, r.pos, s.q, s.best.cost + 3 AS cost, s.best.audit || 'D' AS audit, s.best.lines AS lines FROM s JOIN r ON r.c = s.c AND r.pos = s.pos + 1
      UNION ALL SELECT s.c, r.pos, CASE r.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, s.best.cost + r.cut, s.best.audit || 'K', s.best.lines || [r.role || ':' || r.text] FROM s JOIN r ON r.c = s.c AND r.pos = s.pos + 1
        AND NOT r.gone AND CASE r.i WHEN 's' THEN s.q = 0 WHEN 'u' THEN s.q <> 2 WHEN 'a' THEN s.q = 2 ELSE false END
      UNION ALL SELECT s.c, r.pos, CASE s.q WHEN 2 THEN 3 ELSE 2 END, s.best.cost + 2 + r.cut, s.best.audit || 'R', s.best.lines || [CASE s.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text] FROM s JOIN r ON r.c = s.c AND r.pos = s.pos + 1 AND NOT r.gone
    ) e JOIN ins ON ins.p = e.q) GROUP BY c, pos, q),
l AS (SELECT s.c, min(s.best) AS best FROM s JOIN (SELECT c, max(pos) AS pos FROM r GROUP BY c) m ON m.c = s.c AND m.pos = s.pos WHERE s.q IN (0, 3) GROUP BY s.c),
n AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT a.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(l.best.cost, 0)::BIGINT AS cost, coalesce(l.best.audit, '') AS audit, sha256(coalesce(array_to_string(l.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS c FROM conversations) a LEFT JOIN n USING (c) LEFT JOIN l USING (c)
"""
