from pyspark.sql import functions as F

from pagemill.llm import shared as S


def test_batches_end_by_texts_too(spark):
    rows = spark.range(0, 200_001, 1, 1).select(F.lit("").cast("binary").alias("text"), F.col("id").alias("doc_id"))
    got = S.packed(rows, ["doc_id"], "empty").select("n", F.size("doc_id").alias("m")).collect()
    assert max(r["n"] for r in got) == S.BATCH_TEXTS and sum(r["n"] for r in got) == 200_001 == sum(r["m"] for r in got)


def test_a_long_text_is_a_batch_of_its_own(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "long word " * 2_000_000), (3, "b")], "doc_id long, text string").coalesce(1)
    got = S.packed(rows.withColumn("text", F.col("text").cast("binary")), ["doc_id"], "long").collect()
    assert sorted(r["doc_id"] for r in got) == [[1], [2], [3]]
    assert {r["doc_id"][0]: len(S.unpack(r["ends"], r["text"])[1]) for r in got} == {1: 1, 2: 20_000_000, 3: 1}


def test_running_totals_of_ties_and_of_one_hot_group(spark):
    rows = spark.range(5000).select((F.col("id") % 3 > 0).cast("int").alias("g"), F.lit(0).alias("o"), F.lit(1).cast("long").alias("v"))
    got = S.running_total(rows, ["g"], ["o"], "v", "at").groupBy("g").agg(F.countDistinct("at").alias("n"), F.min("at").alias("a"), F.max("at").alias("b")).collect()
    assert sorted(map(tuple, got)) == [(0, 1667, 1, 1667), (1, 3333, 1, 3333)]


def test_what_was_written_can_be_removed(spark):
    kept = list(S._WRITTEN), list(S._TABLES)
    S._WRITTEN.clear(), S._TABLES.clear()
    out = S.bucketed(spark.range(3), "gone", "id")
    name = S._TABLES[0]
    assert out.count() == 3 and spark.catalog.tableExists(name)
    S.forget(spark)
    assert not spark.catalog.tableExists(name) and not S._WRITTEN
    S._WRITTEN.extend(kept[0]), S._TABLES.extend(kept[1])


def test_row_keys_tell_nulls_and_swapped_values(spark):
    values = [None, "", "-", "a", "1:a", "a b c", "3:-1"]
    rows = [(a, b, c) for a in values for b in values for c in values]
    got = spark.createDataFrame(rows, "x string, y string, z string").select(S.row_key("x", "y", "z").alias("k")).collect()
    assert len({r.k for r in got}) == len(rows)
