import random

from pyspark.sql import functions as F

from pagemill.operators import ruled as R
from pagemill.operators import tables as T

STROKE = "doc_id long, page_index int, drawing_no int, x0 double, y0 double, x1 double, y1 double, type string, fill int"


def drawn(spark, sides, page=0):
    return spark.createDataFrame([(1, page, i, *map(float, s), "s", None) for i, s in enumerate(sides)], STROKE)


def grid(xs, ys, without=()):
    """Sides of a grid, each between two neighbours, but those in `without`."""
    flat = [(a, y, b, y) for y in ys for a, b in zip(xs, xs[1:], strict=False)]
    return [s for s in flat + [(x, a, x, b) for x in xs for a, b in zip(ys, ys[1:], strict=False)] if s not in without]


def cells(spark, sides):
    return {(c.table_no, c.x0, c.y0, c.x1, c.y1) for c in R.cells_of_tables(R.cells(R.points(R.edges(drawn(spark, sides))))).collect()}


def brute(sides):
    """Cells of whole numbers' grids: for each corner the first lower right one all of whose sides are drawn."""
    flat, up = set(), set()
    for x0, y0, x1, y1 in sides:
        (flat if y0 == y1 else up).update((x, y0) for x in range(x0, x1)) if y0 == y1 else up.update((x0, y) for y in range(y0, y1))
    xs, ys = sorted({s[0] for s in sides} | {s[2] for s in sides}), sorted({s[1] for s in sides} | {s[3] for s in sides})
    meets = {(x, y) for x in xs for y in ys if ((x, y) in flat or (x - 1, y) in flat) and ((x, y) in up or (x, y - 1) in up)}
    out = set()
    for x0, y0 in meets:
        for y1, x1 in ((b, a) for b in ys if b > y0 for a in xs if a > x0):
            level = all((x, y) in flat for x in range(x0, x1) for y in (y0, y1))
            if level and all((x, y) in up for y in range(y0, y1) for x in (x0, x1)) and {(x0, y1), (x1, y0), (x1, y1)} <= meets:
                out.add((x0, y0, x1, y1))
                break
    return out


def test_random_grids_against_brute_force(spark):
    r = random.Random(2)
    for _ in range(4):
        xs, ys = sorted(r.sample(range(0, 400, 20), 5)), sorted(r.sample(range(0, 400, 20), 5))
        sides = grid(xs, ys)
        sides = [s for s in sides if r.random() > 0.15]
        assert {c[1:] for c in cells(spark, sides)} == brute(sides)


def test_ends_are_joined_and_sides_snapped(spark):
    sides = [(10, 10, 50, 10.4), (52, 9.8, 110, 10.2), (10, 60, 110, 60), (9.5, 8, 10.5, 62), (60, 9, 60, 61), (110, 12, 110.2, 58.5)]
    got = R.ruled_tables(drawn(spark, sides)).collect()
    assert len(got) == 1 and got[0].cells == 2 and got[0].rect.x0 == 10 and abs(got[0].rect.y0 - 10.1) < 1e-9


def test_tables_apart_have_numbers_of_their_own(spark):
    two = grid([0, 50, 100], [200, 220]) + grid([0, 50, 100], [10, 30, 50])
    got = R.ruled_tables(drawn(spark, two)).orderBy("table_no").collect()
    assert [(t.table_no, t.cells, t.rect.y0) for t in got] == [(0, 4, 10.0), (1, 2, 200.0)]


def test_boxes_and_what_is_no_table(spark):
    boxes = [(0, 0, 50, 20), (50, 0, 100, 20)]  # strokes around cells
    assert R.ruled_tables(drawn(spark, boxes)).first().cells == 2
    assert R.ruled_tables(drawn(spark, [(0, 0, 50, 20)])).count() == 0  # one cell
    assert R.ruled_tables(drawn(spark, grid([0, 50], [0, 20, 40]))).count() == 0  # one column
    assert R.ruled_tables(drawn(spark, [(0, 0, 50, 0), (0, 20, 50, 20)])).count() == 0
    fills = drawn(spark, grid([0, 50, 100], [0, 20])).withColumn("type", F.lit("f"))
    assert R.ruled_tables(fills).count() == 0
    assert R.ruled_tables(drawn(spark, [])).count() == 0


def test_a_grid_of_lines_is_a_region(spark):
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id long, page_index int, width double, height double")
    lines = spark.createDataFrame([(1, 0, i, 45.0, 42.0 + 20 * i, 95.0, 52.0 + 20 * i) for i in range(3)], "doc_id long, page_index int, line_no int, x0 double, y0 double, x1 double, y1 double")
    got = T.regions(drawn(spark, grid([40, 100, 200], [40, 60, 80, 100])), pages, lines).collect()
    assert [(r.shape, tuple(r.rect)) for r in got] == [("p0_t0", (40.0, 40.0, 200.0, 100.0))]


def test_a_dense_page(spark):
    xs, ys = list(range(0, 620, 20)), list(range(0, 2020, 10))
    got = R.ruled_tables(drawn(spark, grid(xs, ys))).collect()
    assert [t.cells for t in got] == [(len(xs) - 1) * (len(ys) - 1)]


def test_tables_of_many_pages_are_numbered_in_a_stream(spark):
    from pagemill.operators.ruled import cells_of_tables

    found = spark.createDataFrame([(1, p, 0.0 + 20 * k, 0.0, 10.0 + 20 * k, 10.0) for p in range(40) for k in range(p % 4 + 1)], "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    out = cells_of_tables(found)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.page_index, x.table_no, x.x0) for x in out.collect()) == sorted((p, k, 20.0 * k) for p in range(40) for k in range(p % 4 + 1))
