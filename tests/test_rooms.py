import random
import time

from pyspark.sql import functions as F

from pagemill.operators import layout as L
from pagemill.operators import rooms as R

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = f"doc_id long, page_index int, block_no int, ink {RECT}, rect {RECT}, own array<{RECT}>, page_width double, page_height double"


def brute(block, occupied, least=0.15):
    """left, right, top, bottom by every rectangle of the page."""
    _, _, _, _, rect, own, width, height = block
    others = [(o, r) for o, r in occupied if r not in own]
    x0, top, x1, bottom = min(r[0] for r in own), min(r[1] for r in own), max(r[2] for r in own), max(r[3] for r in own)
    level = [r for o, r in others if o.startswith("line") and r[3] > top and r[1] < bottom]
    left = max([0.0, *(r[2] + 3 for r in level if r[2] <= x0)])
    right = min([width, *(r[0] - 3 for r in level if r[2] > x0 and r[0] >= x1)])

    def shares(r):
        narrow = min(rect[2] - rect[0], r[2] - r[0])
        return narrow > 0 and (min(rect[2], r[2]) - max(rect[0], r[0])) / narrow >= least

    near = [r for _, r in others if shares(r)]
    below = min([height * 0.97, *(r[1] - 2 for r in near if r[1] >= rect[3] - 1)])
    above = max([0.0, *(r[3] + 2 for r in near if r[3] <= rect[1] + 1)])
    return left, right, min(above, rect[1]), max(below, rect[3])


def made(r, n):
    """Rectangles on a coarse grid, so that many touch, tie or are equal."""
    out = []
    for i in range(n):
        x, y = r.randrange(0, 500, 5), r.randrange(0, 700, 4)
        out.append((r.choice(["line1", "image", f"line{i}"]), (float(x), float(y), float(x + r.choice([0, 5, 40, 200])), float(y + r.choice([0, 4, 12, 60])))))
    return out


def frames(spark, pages):
    blocks = [b for _, bs, _ in pages for b in bs]
    rows = [(1, p, o, q) for p, _, occupied in pages for o, q in occupied]
    return spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(rows, f"doc_id long, page_index int, owner string, rect {RECT}")


def test_against_every_rectangle(spark):
    r = random.Random(1)
    pages = []
    for p, n in enumerate((0, 1, 3, 30, 400)):
        occupied = made(r, n)
        blocks = []
        for i in range(min(40, n + 1)):
            own = [q for o, q in r.sample(occupied, min(n, r.randint(1, 3))) if o.startswith("line")] or [(10.0, 10.0, 60.0, 22.0)]
            rect = (min(q[0] for q in own) - 1, min(q[1] for q in own) - 1, max(q[2] for q in own) + 3, max(q[3] for q in own) + 1)
            blocks.append((1, p, i, rect, rect, own, 600.0, 792.0))
        pages.append((p, blocks, occupied))
    blocks, occupied = frames(spark, pages)
    got = {(x.page_index, x.block_no): (x.left_limit, x.right_limit, x.free_top, x.free_bottom) for x in R.free_space(R.horizontal_room(blocks, occupied), occupied).collect()}
    expected = {(p, b[2]): brute(b, rects) for p, bs, rects in pages for b in bs}
    assert got == expected
    fitted = R.room(blocks, occupied).collect()
    assert len(fitted) == len(expected)
    for x in fitted:
        left, right, *_ = got[x.page_index, x.block_no]
        lo, hi = min(q.x0 for q in x.own), max(q.x1 for q in x.own)
        rect = (min(max(x.ink.x0, left), lo), x.ink.y0, max(min(x.ink.x1, right), hi), x.ink.y1)
        own = [tuple(q) for q in x.own]
        again = brute((1, x.page_index, x.block_no, None, rect, own, 600.0, 792.0), pages[x.page_index][2])
        assert (x.fit_x0, x.fit_x1, x.free_top, x.free_bottom) == (rect[0], rect[2], *again[2:])


def test_a_page_of_50000_rectangles(spark):
    lines = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").cast("int").alias("line_no"), *[c.cast("double").alias(n) for n, c in (("x0", F.col("id") % 50 * 12), ("y0", F.floor(F.col("id") / 50) * 0.75), ("x1", F.col("id") % 50 * 12 + 9), ("y1", F.floor(F.col("id") / 50) * 0.75 + 0.5))])
    blocks = lines.select(*L.PAGE, F.col("line_no").alias("block_no"), L.box().alias("rect"), F.array(L.box()).alias("own"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    began = time.time()
    out = R.free_space(R.horizontal_room(blocks, L.line_boxes(lines)), L.line_boxes(lines)).cache()
    one = out.filter("block_no = 25025").first()
    # Column 25 of row 500: its neighbours stand at 288 to 297 and 312 to 321, the rows beside it within 1 of its edges.
    assert (one.left_limit, one.right_limit, one.free_top, one.free_bottom) == (300.0, 309.0, 375.0, 375.5)
    assert out.count() == 50_000
    held = L._inside(lines, blocks.select(*L.PAGE, F.col("block_no").alias("shape"), F.col("block_no").alias("ord"), "rect"), 0.6)
    assert held.count() == 50_000
    assert time.time() - began < 120


def test_shapes_that_cross_bands_hold_a_line_once(spark):
    lines = spark.createDataFrame([(1, 0, i, 10.0, 100.0 + 9 * i, 60.0, 140.0 + 9 * i) for i in range(20)], "doc_id long, page_index int, line_no int, x0 double, y0 double, x1 double, y1 double")
    shapes = spark.createDataFrame([(1, 0, "a", 0, (0.0, -300.0, 600.0, 900.0)), (1, 0, "b", 1, (0.0, 120.0, 600.0, 130.0))], f"doc_id long, page_index int, shape string, ord int, rect {RECT}")
    got = sorted((x.shape, x.line_no) for x in L._inside(lines, shapes, 0.2).collect())
    assert got == [("a", i) for i in range(20)] + [("b", 0), ("b", 1), ("b", 2)]


def test_many_pages_stream_by_together_small_and_large(spark):
    r = random.Random(2)
    pages = []
    for p in range(60):
        occupied = made(r, 700 if p in (7, 8, 30) else r.randrange(0, 12))
        blocks = [(1, p, i, q, q, [q], 600.0, 792.0) for i, (_, q) in enumerate(occupied[:15])]
        pages.append((p, blocks, occupied))
    blocks, occupied = frames(spark, pages)
    out = R.free_space(R.horizontal_room(blocks, occupied), occupied)
    # A grouping by page would call Python for every page.
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(x.page_index, x.block_no): (x.left_limit, x.right_limit, x.free_top, x.free_bottom) for x in out.collect()}
    assert got == {(p, b[2]): brute(b, rects) for p, bs, rects in pages for b in bs}
