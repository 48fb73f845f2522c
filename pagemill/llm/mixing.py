"""Mixing sources to target weights by weighted fair queueing.

Every source gets a share of the total budget by its weight. Its documents, in a fixed shuffled order, get
virtual finish times: the source's cumulative tokens divided by its target. Sorted globally by finish time
and cut at the budget, the sources advance together, so each ends near its target. A source with a target
above its size is passed over again, at most `cap` times in all.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; documents of equal place in the shuffled order (equal doc_id) come by size, and finish times that tie by
source, place and pass; repeated rows count once each; texts of any length count whole; an empty table gives an
empty result; other columns are ignored, whatever their names, and the stage keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.shared import as_struct, changed, rest_of, row_key, running_total, text_of, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(c: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text_of(c), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target of sized (source, size).

    Sources in code-point order, null last, take the weights in turn and share the total of all sizes.
    A target stops at cap times its source's size; what is over goes to the others by weight."""
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"_none": F.col("source").isNull().cast("int"), "_one": F.lit(1).cast("long"), "_all": F.lit(0)})
    ranked = running_total(each, ["_all"], ["_none", "source"], "_one", "_rank")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (((F.col("_rank") - 1) % len(weights)) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", pick.cast("long").alias("weight")), "sources")
    total, share, capped = table.agg(F.sum("source_size")).first()[0] or 0, 0.0, None
    while True:  # each turn caps at least one more source, and mostly all that will be; sums only come here
        over = F.col("source_size") * cap < F.col("weight") * F.lit(share)
        n, full, left = table.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size") * cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped:
            break
        capped, share = n, (total - (full or 0)) / left if left else share
    return table.select("source", "source_size", F.least(F.lit(share) * F.col("weight"), (F.col("source_size") * cap).cast("double")).alias("target"))


def mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Adds source_size, target and taken (words that the mix takes of the row) to sized: doc_id, source,
    size and what else it holds. The order within a source is that of the MD5 of doc_id."""
    base = written(sized.withColumns({"_shuffle": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))}), "sized")
    goal = targets(base.select("source", "size"), weights, cap)
    queued = running_total(base, ["source"], ["_shuffle", "doc_id", "size"], "size", "_cum")
    g = goal.select(F.col("source").alias("_source"), "source_size", "target")
    queued = written(queued.join(g, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "queue")
    budget = goal.agg(F.sum("source_size")).first()[0] or 0
    turn = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1, F.lit(0)))).alias("_pass")
    items = queued.filter("size > 0").select("_row", "source", "size", "_shuffle", "_cum", "source_size", "target", turn)
    items = items.withColumns({"_finish": (F.col("_pass") * F.col("source_size") + F.col("_cum")) / F.col("target"), "_all": F.lit(0)})
    ordered = running_total(items.withColumnRenamed("_row", "_item").select("_item", "source", "size", "_shuffle", "_finish", "_pass", "_all"), ["_all"], ["_finish", "source", "_shuffle", "_pass", "_item"], "size", "_until")
    take = F.greatest(F.least(F.col("size"), F.lit(budget) - F.col("_until") + F.col("size")), F.lit(0))
    taken = ordered.withColumn("_take", take).filter("_take > 0").groupBy("_item").agg(F.sum("_take").alias("taken"))
    out = queued.join(taken, F.col("_row") == F.col("_item"), "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("_item", "_row", "_shuffle", "_cum")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", word_count().alias("size"))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them; the one that the budget cuts is cut there.

    Rows equal in doc_id, source and text are numbered, and so are their decisions, the larger ones first."""
    equal = ("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", word_count().alias("size"), row_key(*equal).alias("_key"))
    n = mix(sized).filter("taken > 0").groupBy("_key", "size", "taken").agg(F.count("*").alias("n"))
    # How often each number of words is taken of equal rows: a few numbers a key, as passes are few.
    steps = n.groupBy(F.col("_key").alias("_k"), F.col("size").alias("_size")).agg(F.sort_array(F.collect_list(F.struct("taken", "n")), False).alias("_steps"))
    full = docs.select(as_struct(docs).alias("_doc"), row_key(*equal).alias("_key"), rest_of(docs, *equal).alias("_order"))
    # Numbered and joined by key alone, so the texts are shuffled once.
    full = full.withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy("_order")).cast("long"))
    joined = full.join(steps, F.col("_key") == F.col("_k"))
    start = F.struct(F.col("_at").alias("left"), F.lit(0).cast("long").alias("taken"))
    pick = F.aggregate("_steps", start, lambda s, x: F.struct((s["left"] - x["n"]).alias("left"), F.when((s["left"] > 0) & (s["left"] <= x["n"]), x["taken"]).otherwise(s["taken"]).alias("taken")), lambda s: s["taken"])
    joined = joined.withColumn("_taken", pick).filter("_taken > 0")
    parts = F.expr("CASE WHEN _taken % _size = 0 THEN array_repeat(_size, cast(_taken div _size as int)) ELSE concat(array_repeat(_size, cast(_taken div _size as int)), array(_taken % _size)) END")
    rows = joined.withColumn("_words", F.explode(parts))
    whole = F.col("_words") == F.col("_size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(f"({WORD})"), 1), F.lit(1), F.col("_words").cast("int")), " ")
    new = {"text": F.when(whole, F.col("_doc.text")).otherwise(cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("_doc.n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return rows.select(*changed(docs, "_doc", new))


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM d GROUP BY source),
t AS (SELECT *, 3.0 * source_size / w AS r FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_size,
        sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w, sum(source_size) OVER () AS total FROM t),
l AS (SELECT arg_min((total - 3 * before_size) / left_w, r) FILTER (WHERE (total - 3 * before_size) / left_w <= r) AS share FROM c),
g AS (SELECT source, source_size, least((SELECT share FROM l) * w, 3.0::DOUBLE * source_size)::DOUBLE AS target FROM s),
q AS (SELECT row_number() OVER () AS rid, d.doc_id, d.source, d.size, md5(coalesce(d.doc_id::VARCHAR, '')) AS sh, g.source_size, g.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
i AS (SELECT q.*, p.k, (p.k * q.source_size + q.cum)::DOUBLE / q.target AS f FROM q JOIN range(3) p(k) ON p.k = 0 OR p.k < ceil(q.target / q.source_size) WHERE size > 0),
o AS (SELECT rid, size, sum(size) OVER (ORDER BY f, source NULLS FIRST, sh, k ROWS UNBOUNDED PRECEDING) AS until FROM i),
x AS (SELECT rid, sum(greatest(least(size, (SELECT sum(size) FROM d) - until + size), 0)) AS taken FROM o GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0)::BIGINT AS taken FROM q LEFT JOIN x USING (rid)
"""
