"""Tables that lines are drawn for: rules are snapped and joined to edges, edges meet in points, four points are a cell,
and cells that share a corner are a table.

All steps are joins and windows within a page, but for the numbering of tables, which gathers a page's cells. Drawings
have doc_id, page_index, x0..y1 and type. Only strokes count: a fill has no edge of its own. A stroke no wider or higher
than 2.5 is an edge; any other one stands for the four sides of its rectangle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.operators.folds import starts, whole_groups
from pagemill.operators.layout import PAGE, paged

# How far apart edges are one, ends are joined and lines meet, and how long an edge is at least.
SNAP, JOIN, MEET, SHORTEST = 3.0, 3.0, 3.0, 3.0
THIN = 2.5
#: Bands of heights in which horizontal and vertical edges look for each other.
BAND = 64.0


def _sides(drawings: DataFrame) -> DataFrame:
    """flat (lies along x), at (its height or, if upright, its x), lo and hi (its ends) of each side that is drawn."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def side(flat: bool, at: Column, lo: str, hi: str) -> Column:
        return F.struct(F.lit(flat).alias("flat"), at.cast("double").alias("at"), F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi"))

    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    flat, upright = F.array(side(True, middle("y0", "y1"), "x0", "x1")), F.array(side(False, middle("x0", "x1"), "y0", "y1"))
    four = F.array(side(True, F.col("y0"), "x0", "x1"), side(True, F.col("y1"), "x0", "x1"), side(False, F.col("x0"), "y0", "y1"), side(False, F.col("x1"), "y0", "y1"))
    some = F.when((h <= THIN) & (w > THIN), flat).when((w <= THIN) & (h > THIN), upright).when((w > THIN) & (h > THIN), four)
    return drawings.filter(F.col("type") != "f").select(*PAGE, F.inline(some))


def edges(drawings: DataFrame) -> DataFrame:
    """Edges: edge (a number within the page, of one direction), flat, at, lo, hi. Sides follow one another within SNAP
    and move to their mean; on one line, those whose ends come within JOIN are one edge."""
    way = [*PAGE, "flat"]
    w = Window.partitionBy(*way).orderBy("at", "lo", "hi")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > SNAP, F.lit(True)).cast("int")
    line = _sides(drawings).withColumn("_new", new).withColumn("_line", F.sum("_new").over(w))
    snapped = line.withColumn("at", F.avg("at").over(Window.partitionBy(*way, "_line")))
    along = Window.partitionBy(*way, "_line").orderBy("lo", "hi")
    reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("lo") > reach + JOIN, F.lit(True)).cast("int")
    joined = snapped.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(along))
    whole = joined.groupBy(*way, "_line", "_run").agg(F.first("at").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    numbered = whole.filter(F.col("hi") - F.col("lo") >= SHORTEST).withColumn("edge", F.row_number().over(Window.partitionBy(*way).orderBy("at", "lo")))
    return numbered.select(*way, "edge", "at", "lo", "hi")


def points(found: DataFrame) -> DataFrame:
    """Where a flat edge h meets an upright edge v: x, y, h and v. They look for each other in bands of height, so an
    edge meets none that is far from it."""
    band = lambda c: F.floor(c / BAND)
    flat = found.filter("flat").select(*PAGE, F.col("edge").alias("h"), F.col("at").alias("y"), F.col("lo").alias("_x0"), F.col("hi").alias("_x1"), band(F.col("at")).alias("_band"))
    upright = found.filter("NOT flat").select(*PAGE, F.col("edge").alias("v"), F.col("at").alias("x"), F.col("lo").alias("_y0"), F.col("hi").alias("_y1"), F.explode(F.sequence(band(F.col("lo") - MEET), band(F.col("hi") + MEET))).alias("_band"))
    both = flat.join(paged(upright), [*PAGE, "_band"])
    return both.filter(F.col("y").between(F.col("_y0") - MEET, F.col("_y1") + MEET) & F.col("x").between(F.col("_x0") - MEET, F.col("_x1") + MEET)).select(*PAGE, "h", "v", "x", "y")


def cells(meet: DataFrame) -> DataFrame:
    """The smallest cell to the right of and below each point: h and v of its first corner, x0, y0, x1, y1.

    The flat edge below is the first one on the point's upright edge that shares another upright edge further right with
    the point's own flat edge. Mostly that is the next one; only points for which it is not look at all below them."""
    rows = meet.groupBy(*PAGE, "h").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_of"))
    own = meet.join(paged(rows), [*PAGE, "h"]).filter(F.col("x") < F.element_at("_of", -1)["x"])
    down = Window.partitionBy(*PAGE, "v").orderBy("y", "h")
    below = meet.withColumns({"_h2": F.lead("h").over(down), "_y2": F.lead("y").over(down)}).filter("_h2 IS NOT NULL").select(*PAGE, "h", "v", "_h2", "_y2")
    other = rows.withColumnsRenamed({"h": "_h2", "_of": "_of2"})
    first = F.array_min(F.filter(F.array_intersect("_of", "_of2"), lambda p: p["x"] > F.col("x")))["x"]
    corner = F.struct(F.col("_y2").alias("y1"), first.alias("x1"))

    nearest = own.join(paged(below), [*PAGE, "h", "v"]).join(paged(other), [*PAGE, "_h2"]).withColumn("_c", corner)
    done = nearest.filter("_c.x1 IS NOT NULL").select(*PAGE, "h", "v", "x", "y", "_c")
    left = nearest.filter("_c.x1 IS NULL").select(*PAGE, "h", "v", "x", "y", "_of")
    lower = meet.select(*PAGE, "v", F.col("h").alias("_h2"), F.col("y").alias("_y2"))
    far = left.join(paged(lower), [*PAGE, "v"]).filter("_y2 > y").join(paged(other), [*PAGE, "_h2"]).withColumn("_c", corner).filter("_c.x1 IS NOT NULL")
    rest = far.groupBy(*PAGE, "h", "v", "x", "y").agg(F.min("_c").alias("_c"))
    return done.unionByName(rest).select(*PAGE, "h", "v", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("_c.x1").alias("x1"), F.col("_c.y1").alias("y1"))


def cells_of_tables(found: DataFrame) -> DataFrame:
    """Cells with table_no: those that share a corner, by themselves or through others, are of one table; tables are
    numbered from 0, from the top down. A page's cells come together for it."""
    kinds = {f.name: f.dataType for f in found.schema.fields}
    names = ("x0", "y0", "x1", "y1")
    schema = T.StructType([*[T.StructField(p, kinds[p]) for p in PAGE], T.StructField("table_no", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def numbered(table):
        boxes = sorted(zip(*(table.column(c).to_pylist() for c in names), strict=True), key=lambda b: (b[1], b[0]))
        root = list(range(len(boxes)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        seen: dict = {}
        for i, (x0, y0, x1, y1) in enumerate(boxes):
            for corner in ((x0, y0), (x0, y1), (x1, y0), (x1, y1)):
                a, b = top(i), top(seen.setdefault(corner, i))
                root[max(a, b)] = min(a, b)
        numbers: dict = {}
        of = [numbers.setdefault(top(i), len(numbers)) for i in range(len(boxes))]
        return of, boxes

    def number(batches):
        import pyarrow as pa

        for table in whole_groups(batches, PAGE):
            first = np.flatnonzero(starts(table, PAGE))
            sizes = np.diff(np.append(first, table.num_rows))
            pages = [numbered(table.slice(f, n)) for f, n in zip(first.tolist(), sizes.tolist(), strict=True)]
            boxes = [b for _, of in pages for b in of]
            columns = [pa.array([n for of, _ in pages for n in of], pa.int32()), *[pa.array([b[i] for b in boxes], pa.float64()) for i in range(len(names))]]
            # A page's cells are as many as before, so its rows' keys stand where they stood.
            yield pa.RecordBatch.from_arrays([*[table.column(p).combine_chunks() for p in PAGE], *columns], names=schema.names)

    return found.select(*PAGE, *names).repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(number, schema)


def ruled_tables(drawings: DataFrame) -> DataFrame:
    """Tables of at least two columns: table_no, rect, cells (how many)."""
    g = cells_of_tables(cells(points(edges(drawings)))).groupBy(*PAGE, "table_no").agg(F.count("*").cast("int").alias("cells"), F.countDistinct("x0").alias("_l"), F.countDistinct("x1").alias("_r"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    return g.filter("_l >= 2 AND _r >= 2").select(*PAGE, "table_no", F.struct("x0", "y0", "x1", "y1").alias("rect"), "cells")
