import random

import pytest

from pagemill.functions import text as X
from pagemill.operators import batching as B
from pagemill.operators import folds
from pagemill.operators import layout as L
from pagemill.operators import planning as P


def plain(items, into, out, most):
    """Batch of each (job, seq) by filling one batch after the other."""
    found, state = {}, {}
    for job, seq, i, o in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])):
        no, n, a, b = state.get(job, (-1, most, 0, 0))
        if n >= most or (into is not None and a + i > into) or (out is not None and b + o > out):
            no, n, a, b = no + 1, 0, X.BATCH_OVERHEAD, 0
        state[job] = (no, n + 1, a + i, b + o)
        found[job, seq] = no
    return found


@pytest.mark.parametrize("block,most,tpm,limit", [(8, 5, 2000, 900), (16, 16, 0, 300), (8, 3, 0, 0), (1 << 14, 200, 900, 0)])
def test_against_filling_in_turn(spark, monkeypatch, block, most, tpm, limit):
    monkeypatch.setattr(B, "BLOCK", block)
    r = random.Random(block + most)
    items = [(job, s, r.choice([1, 20, 60, 200, 5000]), r.choice([0, 17, 90, 2000])) for job, n in ((1, 500), (2, 8), (3, 9), (4, 1), (None, 40), (6, 64), (7, 16)) for s in r.sample(range(10_000), n)]
    df = spark.createDataFrame(items, "job int, seq int, input_tokens long, output_tokens long").repartition(3)
    got = {(x.job, x.seq): x.batch_no for x in P.batches(df, ["job"], "seq", tpm, limit, most).collect()}
    assert got == plain(items, X.input_budget(tpm), X.output_budget(limit), most)


def test_a_large_job_runs_over_many_tasks(spark):
    items = spark.range(400_000).selectExpr("1 as job", "id as seq", "20 + id % 90 as input_tokens", "20 + id % 70 as output_tokens")
    got = P.batches(items, ["job"], "seq", 10_000, 8_000)
    assert got.selectExpr("spark_partition_id() as p").distinct().count() > 1
    sums = P.batch_totals(got, ["job"]).agg({"items": "sum", "batch_no": "max", "total_tokens": "max"}).first()
    assert sums["sum(items)"] == 400_000 and sums["max(total_tokens)"] <= 8_000 + 7_200 + X.BATCH_OVERHEAD
    expected = plain([(1, s, 20 + s % 90, 20 + s % 70) for s in range(400_000)], 8_000, 7_200, 200)
    assert sums["max(batch_no)"] == expected[1, 399_999]
    assert got.filter("seq = 300000").first().batch_no == expected[1, 300_000]


def test_no_items(spark):
    df = spark.createDataFrame([], "job int, seq int, input_tokens long, output_tokens long")
    assert P.batches(df, ["job"], "seq", 100, 100).count() == 0


def test_places_of_a_group_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 5 = 0 THEN NULL ELSE 1 END AS g", "id", "id % 7 AS o")
    rows = folds.numbered(df, ["g"], ["o", "id"], "at").collect()
    for g in (None, 1):
        mine = sorted((x for x in rows if x.g == g), key=lambda x: (x.o, x.id))
        assert [x.at for x in mine] == list(range(len(mine)))


STYLE = "struct<size:double,bold:boolean,italic:boolean,serif:boolean,color:int>"
BLOCKS = f"doc_id long, page_index int, block_no long, kind string, text string, style {STYLE}, rect struct<x0:double,y0:double,x1:double,y1:double>, page_height double"


def test_links_of_a_long_document(spark):
    """Each odd block goes on in the right column, and the next even one on the next page's head."""
    style = (10.0, False, False, True, 0)
    n = 200_000
    df = spark.range(n).selectExpr("1L AS doc_id", "int(id div 2) AS page_index", "id AS block_no", "'paragraph' AS kind", "CASE WHEN id % 10 = 9 THEN 'it ends.' ELSE 'it goes' END AS text", "named_struct('size', 10.0D, 'bold', false, 'italic', false, 'serif', true, 'color', 0) AS style", "named_struct('x0', 50.0D + 260 * (id % 2), 'y0', 40.0D, 'x1', 300.0D + 260 * (id % 2), 'y1', 760.0D) AS rect", "792.0D AS page_height")
    assert df.schema["style"].dataType.simpleString() == STYLE and style
    heads = L.link_blocks(df).groupBy("head").count().collect()
    assert len(heads) == n / 10 and {h["count"] for h in heads} == {10}


def test_chains_keep_their_first_size(spark):
    at = (50.0, 40.0, 300.0, 760.0)
    rows = [(1, p, 0, "paragraph", "goes", (10.0 + 0.4 * p, False, False, True, 0), at, 792.0) for p in range(5)]
    rows += [(2, 0, 0, "paragraph", "goes", (None, False, False, True, 0), at, 792.0), (2, 1, 0, "paragraph", "goes", (10.0, False, False, True, None), at, 792.0), (2, 2, 0, "heading", "Head", (20.0, True, False, True, 0), at, 792.0), (2, 3, 0, "paragraph", "goes", (10.0, False, False, True, None), at, 792.0), (2, 2, 1, "paragraph", "goes", (10.2, False, False, True, None), at, 792.0)]
    got = {(r.doc_id, r.page_index, r.block_no): tuple(r.head) for r in L.link_blocks(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert [got[1, p, 0][0] for p in range(5)] == [0, 0, 2, 2, 4]
    assert [got[2, *k] for k in ((0, 0), (1, 0), (2, 0), (2, 1), (3, 0))] == [(0, 0), (1, 0), (2, 0), (1, 0), (1, 0)]


