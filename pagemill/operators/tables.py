"""Tables on pages: where drawings and lines show one, and the cells that its lines form.

Drawings have doc_id, page_index, drawing_no, x0..y1, type and fill. The folds over a page's rectangles keep
their order, as regions depend on it; each page is folded on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.functions import text as X
from pagemill.operators.layout import ALIGN_LEFT, PAGE, STYLE, TABLE_SHARE, _inside, box, chars, main_style, paged, told
from pagemill.operators.rooms import free_space
from pagemill.operators.ruled import ruled_tables

THIN, COLUMN_GAP = 2.5, 18.0
RECTS = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def drawing_features(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Drawings with feature: fill or rule, those that bleed off the page left out. A rule is no higher than 2.5,
    and may have no height at all."""
    d = drawings.join(paged(pages.select(*PAGE, F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1")).alias("_page"))), PAGE)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    filled = F.col("fill").isNotNull() & F.col("type").isin("f", "fs")
    feature = F.when(filled, F.when(h <= THIN, "rule").otherwise("fill")).when((h <= THIN) & (w > THIN), "rule")
    return d.filter(((w > 0) | (h > 0)) & ~G.bleeds(box(), F.col("_page"))).drop("_page").withColumn("feature", feature).filter("feature IS NOT NULL")


def count_inside(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """shapes (page, shape, ord, rect) with lines: how many lines lie in each by 60 %."""
    n = _inside(lines, shapes, TABLE_SHARE).groupBy(*PAGE, "shape").agg(F.count("*").alias("lines"))
    return shapes.join(paged(n), [*PAGE, "shape"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


def _union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def merged_rects(rects: Column) -> Column:
    """Rectangles, from the top down, each united with the first kept one that either overlaps by more than 15 %,
    in one pass: a union that comes to overlap another stays apart."""
    ordered = F.array_sort(F.transform(rects, lambda r: F.struct(r["y0"].alias("a"), r["x0"].alias("b"), r.alias("r"))))

    def step(kept: Column, x: Column) -> Column:
        r = x["r"]
        meets = F.transform(kept, lambda k: (G.overlap_ratio(r, k) > 0.15) | (G.overlap_ratio(k, r) > 0.15))
        at = F.coalesce(F.array_position(meets, True), F.lit(0))
        return F.when(at == 0, F.concat(kept, F.array(r))).otherwise(F.transform(kept, lambda k, i: F.when(i + 1 == at, _union(k, r)).otherwise(k)))

    return F.aggregate(ordered, F.array().cast(RECTS), step)


def rule_clusters(rules: Column, page_width: Column) -> Column:
    """Rectangles around at least three rules whose edges lie within 8 of their cluster's first; rules as wide as
    18 % of the page join the first cluster that fits, from left to right and down."""
    wide = F.filter(rules, lambda r: r["x1"] - r["x0"] >= F.greatest(page_width, F.lit(1.0)) * 0.18)
    ordered = F.array_sort(F.transform(wide, lambda r: F.struct(F.bround(r["x0"] / 8).alias("a"), r["y0"].alias("b"), r.alias("r"))))
    kind = "array<struct<head:struct<x0:double,y0:double,x1:double,y1:double>,all:struct<x0:double,y0:double,x1:double,y1:double>,n:int>>"

    def step(kept: Column, x: Column) -> Column:
        r = x["r"]
        fits = F.transform(kept, lambda k: (F.abs(k["head"]["x0"] - r["x0"]) <= 8) & (F.abs(k["head"]["x1"] - r["x1"]) <= 8))
        at = F.coalesce(F.array_position(fits, True), F.lit(0))
        new = F.struct(r.alias("head"), r.alias("all"), F.lit(1).alias("n"))
        return F.when(at == 0, F.concat(kept, F.array(new))).otherwise(F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(k["head"].alias("head"), _union(k["all"], r).alias("all"), (k["n"] + 1).alias("n"))).otherwise(k)))

    clusters = F.aggregate(ordered, F.array().cast(kind), step)
    return F.transform(F.filter(clusters, lambda k: k["n"] >= 3), lambda k: k["all"])


def row_rules(rect: Column, rules: Column) -> Column:
    """Heights of the rules within a region that overlap it by half their width."""
    inner = F.filter(rules, lambda r: ((r["y0"] + r["y1"]) / 2).between(rect["y0"] - 1, rect["y1"] + 1) & (G.horizontal_overlap(rect, r) >= 0.5))
    return F.array_sort(F.transform(inner, lambda r: (r["y0"] + r["y1"]) / 2))


def regions(drawings: DataFrame, pages: DataFrame, lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Table regions: shape (its number counts all merged candidates), ord, rect and row_rules. Candidates are
    large fills and clusters of rules with two lines in them, tables that are drawn as grids, and tables found elsewhere
    (page, rect)."""
    f = drawing_features(drawings, pages).withColumn("rect", box()).join(paged(pages.select(*PAGE, F.col("width").alias("_w"))), PAGE)
    big = (F.col("feature") == "fill") & (F.col("x1") - F.col("x0") >= F.greatest(F.col("_w"), F.lit(1.0)) * 0.22) & (F.col("y1") - F.col("y0") >= 22.0)
    fills = f.filter(big).select(*PAGE, F.col("rect"))
    ruled = f.filter("feature = 'rule'").groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("drawing_no", "rect"))), lambda x: x["rect"]).alias("rules"), F.first("_w").alias("_w"))
    clusters = ruled.select(*PAGE, F.explode(rule_clusters(F.col("rules"), F.col("_w"))).alias("rect"))
    some = fills.unionByName(clusters).withColumns({"ord": F.monotonically_increasing_id(), "shape": F.struct("rect.x0", "rect.y0", "rect.x1", "rect.y1").cast("string")}).dropDuplicates([*PAGE, "shape"])
    kept = count_inside(lines, some).filter("lines >= 2").select(*PAGE, "rect")
    every = kept.unionByName(ruled_tables(drawings).select(*PAGE, "rect"))
    every = every.unionByName(found.select(*PAGE, "rect")) if found is not None else every
    merged = every.groupBy(*PAGE).agg(merged_rects(F.collect_list("rect")).alias("m")).select(*PAGE, F.posexplode("m").alias("ord", "rect"))
    named = merged.withColumn("shape", F.format_string("p%d_t%d", F.col("page_index").cast("int"), F.col("ord")))
    full = count_inside(lines, named).filter("lines >= 2").drop("lines").join(paged(ruled.drop("_w")), PAGE, "left")
    return full.withColumn("row_rules", row_rules(F.col("rect"), F.coalesce("rules", F.array().cast(RECTS)))).drop("rules")


def table_columns(lines: DataFrame, region: str = "table_id") -> DataFrame:
    """col_no, col_x0 and col_x1 of each line of a region: lines whose left edges follow within 18 of the one
    before are a column, which may reach to 4 before the next."""
    keys = [*PAGE, region]
    w = Window.partitionBy(*keys).orderBy("x0", "line_no")
    new = F.coalesce(F.col("x0") - F.lag("x0").over(w) > COLUMN_GAP, F.lit(False)).cast("int")
    numbered = lines.dropna(subset=keys).withColumn("_new", new).withColumn("col_no", F.sum("_new").over(w)).drop("_new")
    by_column = Window.partitionBy(*keys).orderBy("col_no")
    own, following = by_column.rangeBetween(0, 0), by_column.rangeBetween(1, 1)
    return numbered.withColumns({"col_x0": F.min("x0").over(own), "col_x1": F.greatest(F.max("x1").over(own), F.min("x0").over(following) - 4.0)})


def table_cells(lines: DataFrame, found: DataFrame, region: str = "table_id") -> DataFrame:
    """Cells of each region: cell_no by height and left edge (from 0), rect, text, lines. A cell ends where the
    gap passes 1.8 sizes, the style changes or a rule lies between."""
    keys = [*PAGE, region]
    rules = found.select(*PAGE, F.col("shape").alias(region), "row_rules", F.col("rect").alias("region_rect"))
    # A line's text is gathered by itself: where it is not asked for, it does not go along.
    whole = "text" in lines.columns
    c = table_columns(lines.withColumn("_chars", chars(lines)), region).join(paged(rules), keys, "left")
    w = Window.partitionBy(*keys, "col_no").orderBy("y0", "x0", "line_no")
    prev = lambda x: F.lag(x).over(w)
    style = F.struct(*STYLE)
    c = c.withColumns({"_style": style, "_py1": prev("y1"), "_psize": prev("size")}).withColumn("_pstyle", prev("_style"))
    between = F.exists(F.coalesce("row_rules", F.array().cast("array<double>")), lambda y: (y >= F.col("_py1")) & (y <= F.col("y0")))
    ends = (F.col("y0") - F.col("_py1") > 1.8 * F.greatest(F.col("_psize"), F.lit(1.0))) | ~G.style_matches(F.col("_pstyle"), F.col("_style")) | between
    c = c.withColumn("_new", F.when(F.col("_py1").isNull(), 0).otherwise(ends.cast("int"))).withColumn("_cell", F.sum("_new").over(w))
    row = F.struct("y0", "x0", "line_no", *([] if whole else ["line_id"]), F.col("_chars").alias("chars"), box().alias("rect"), "size", F.struct(*STYLE).alias("style"))
    texts = [F.array_sort(F.collect_list(F.struct("y0", "x0", "line_no", "text"))).alias("t")] if whole else []
    own = [*keys, "col_no", "_cell"]
    g = c.groupBy(*own).agg(F.array_sort(F.collect_list(row)).alias("l"), *texts, F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.first("col_x0").alias("col_x0"), F.first("col_x1").alias("col_x1"), F.first("row_rules").alias("row_rules"), F.first("region_rect").alias("region_rect"))
    g = g.withColumn("style", main_style(F.col("l"), lambda x: x["chars"]))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.bround("top", 1), "col_x0", "_cell")) - 1
    first, last = F.element_at("l", 1), F.element_at("l", -1)
    rect = F.struct(F.col("col_x0").alias("x0"), F.col("top").alias("y0"), F.col("col_x1").alias("x1"), F.col("bottom").alias("y1"))
    said = X.join_lines(F.transform("t", lambda x: x["text"])).alias("text") if whole else F.transform("l", lambda x: x["line_id"]).alias("said")
    return g.select(*keys, number.alias("cell_no"), "col_no", rect.alias("rect"), said, F.size("l").alias("line_count"), G.line_height(first["y0"], last["y0"], F.size("l"), first["size"]).alias("line_height"), first["size"].alias("size0"), "style", F.transform("l", lambda x: x["rect"]).alias("own"), "row_rules", "region_rect")


def cell_bottom(free_bottom: Column, bottom: Column, rules: Column, region_bottom: Column) -> Column:
    """A cell may grow to the next rule below, never out of its region."""
    below = F.array_min(F.filter(F.coalesce(rules, F.array().cast("array<double>")), lambda y: y > bottom + 0.5))
    return F.greatest(F.least(free_bottom, F.coalesce(below - 1.0, free_bottom), region_bottom), bottom)


def cell_blocks(cells: DataFrame, pages: DataFrame, occupied: DataFrame, region: str = "table_id") -> DataFrame:
    """Blocks of cells, within what is free above and below them."""
    ink = F.struct(F.col("rect.x0").alias("x0"), (F.col("rect.y0") - 1.0).alias("y0"), F.col("rect.x1").alias("x1"), (F.col("rect.y1") + 1.0).alias("y1"))
    b = cells.withColumns({"rect": ink, "block_no": F.concat_ws("_c", F.col(region), F.col("cell_no").cast("string"))}).join(paged(pages.select(*PAGE, F.col("height").alias("page_height"))), PAGE)
    b = free_space(b, occupied)
    bottom = cell_bottom(F.col("free_bottom"), F.col("rect.y1"), F.col("row_rules"), F.col("region_rect.y1"))
    b = b.withColumn("max_bottom", bottom)
    flow = G.flow_rect(F.col("rect"), F.col("line_count"), F.col("size0"), F.col("line_height"), F.col("free_top"), F.col("max_bottom"))
    return b.select(*PAGE, F.col("block_no").alias("block_id"), region, "cell_no", F.lit("table_cell").alias("kind"), told(b), "style", flow.alias("rect"), "max_bottom", "page_height", F.lit(ALIGN_LEFT).alias("align"), "line_count", "line_height", F.col("own").alias("line_rects"))
