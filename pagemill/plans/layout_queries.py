"""Queries over pages: sizes, columns, reading order, paragraphs, blocks, tables and free space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import document as D
from pagemill.operators import layout as L
from pagemill.operators import render as R
from pagemill.operators import rooms as RM
from pagemill.operators import ruled as RU
from pagemill.operators import tables as TB
from pagemill.plans import inputs as I
from pagemill.session import kept


def span_lines(spark, d: str) -> DataFrame:
    """Lines put together from two spans each, the first half bold by its flags, the second one italic by its font; the
    longer one, the first of equals, gives the style. A span of the next line's number has no letter."""
    half = F.floor(F.length("text") / 2).cast("int")
    place = [*L.PAGE, F.lit(0).alias("block_no"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]]

    def span(no: int, text: F.Column, size: float, flags: int, font: str, below: int = 0) -> F.Column:
        return F.struct((F.col("line_no") + below).alias("line_no"), F.lit(no).alias("span_no"), text.alias("text"), F.lit(size).alias("size"), F.lit(flags).alias("flags"), F.lit(font).alias("font"), F.lit(no).alias("color"))

    every = F.array(span(0, F.substring(F.col("text"), F.lit(1), half), 10.04, 20, "Serif"), span(1, F.substring(F.col("text"), half + 1, F.length("text")), 9.96, 0, "Sans-Oblique"), span(0, F.lit("12 - 34"), 10.04, 20, "Serif", 1_000_000))
    spans = I.lines(spark, d).select(*place, F.inline(every))
    return L.make_lines(spans).select("doc_id", "page_index", "line_no", "text", "size", "bold", "italic", "serif", "color")


def dominant_size(spark, d: str) -> DataFrame:
    return L.dominant_size(I.lines(spark, d))


def dominant_style(spark, d: str) -> DataFrame:
    s = L.dominant_style(I.lines(spark, d), ["doc_id"], "line_no")
    return s.select("doc_id", "style.size", "style.serif", "style.color")


def column_assign(spark, d: str) -> DataFrame:
    return L.assign_columns(I.lines(spark, d)).select("doc_id", "line_no", "column")


def repeated_edges(spark, d: str) -> DataFrame:
    return L.column_bounds(L.assign_columns(I.lines(spark, d)))


def reading_order(spark, d: str) -> DataFrame:
    return L.reading_order(L.assign_columns(I.lines(spark, d))).select("doc_id", "line_no", "read_no")


def _grouped(lines: DataFrame) -> DataFrame:
    placed = L.assign_columns(lines)
    return L.group_lines(L.reading_order(placed), L.column_bounds(placed))


def paragraph_groups(spark, d: str) -> DataFrame:
    lines = kept(L.signs(I.lines(spark, d)).drop("text"), "signs")
    return _grouped(lines).select("doc_id", "line_no", "group_no")


def page_blocks(spark, d: str) -> DataFrame:
    """Blocks with flow rectangles."""
    lines = I.lines(spark, d)
    return L.make_blocks(_grouped(lines), I.pages_of(lines), L.dominant_size(lines), L.line_boxes(lines))


def block_texts(spark, d: str) -> DataFrame:
    b = page_blocks(spark, d)
    return b.select("doc_id", "page_index", "block_no", "kind", "text", "line_count")


def block_boxes(spark, d: str) -> DataFrame:
    b = page_blocks(spark, d)
    return b.select("doc_id", "page_index", "block_no", "block_id", *[F.col(f"rect.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], "max_bottom", "line_height")


def linked_blocks(spark, d: str) -> DataFrame:
    """Chains of blocks that go on across columns and pages."""
    return L.merge_linked(L.link_blocks(page_blocks(spark, d))).select("doc_id", "page_index", "block_no", "kind", F.size("areas").alias("parts"), "text", "line_count")


def linked_lines(spark, d: str) -> DataFrame:
    """The chain of each line taken as a block of its own, on pages of which columns reach the foot; a line in seven is a
    heading, and most texts are cut so that they go on."""
    text = F.when(F.length("text") % 3 == 0, F.col("text")).otherwise(F.lower(F.regexp_replace("text", "[.!?]+$", "")))
    blocks = I.lines(spark, d).select(*L.PAGE, F.col("line_no").cast("long").alias("block_no"), F.when(F.col("line_no") % 7 == 3, "heading").otherwise("paragraph").alias("kind"), text.alias("text"), F.struct(*L.STYLE).alias("style"), L.box().alias("rect"), F.lit(400.0).alias("page_height"))
    return L.link_blocks(blocks).select("doc_id", "page_index", F.col("block_no").alias("line_no"), "kind", F.col("head.page_index").alias("head_page"), F.col("head.block_no").alias("head_line"))


def draw_plans(spark, d: str) -> DataFrame:
    """Sizes and boxes for texts that grew by a third."""
    m = L.merge_linked(L.link_blocks(page_blocks(spark, d))).withColumns({"size": F.col("style.size"), "line_height": F.lit(1.15), "text": F.concat_ws(" ", "text", F.expr("left(text, cast(length(text) / 3 as int))"))})
    p = R.draw_plan(m)
    return p.select("doc_id", "page_index", "block_no", F.col("plan.size").alias("size"), F.col("plan.line_height").alias("line_height"), F.col("plan.borrowed").alias("borrowed"), F.col("plan.overflow").alias("overflow"), F.size("plan.chunks").alias("chunks"))


def table_columns(spark, d: str) -> DataFrame:
    lines = I.lines(spark, d).withColumn("table_id", F.lit("t"))
    return TB.table_columns(lines).select("doc_id", "line_no", "col_no", "col_x0", "col_x1")


def _region(spark, d: str) -> DataFrame:
    rect = G.rect(40, 50, 560, 400)
    return I.pages_of(I.lines(spark, d)).select("doc_id", "page_index", F.lit("t").alias("shape"), rect.alias("rect"), F.array(F.lit(90.5), F.lit(154.5)).alias("row_rules"))


def table_cells(spark, d: str) -> DataFrame:
    """Cells of each page taken as one table with two rules."""
    lines = I.lines(spark, d).withColumn("table_id", F.lit("t"))
    c = TB.table_cells(lines, _region(spark, d))
    return c.select("doc_id", "page_index", "cell_no", "col_no", "line_count", F.col("rect.x0").alias("x0"), F.col("rect.y0").alias("y0"), F.col("rect.x1").alias("x1"), F.col("rect.y1").alias("y1"))


def _shapes(lines: DataFrame) -> DataFrame:
    p = I.pages_of(lines).select("doc_id", "page_index")
    four = F.array(*[F.struct(F.lit(n).alias("shape"), F.lit(i).alias("ord"), G.rect(*r).alias("rect")) for i, (n, r) in enumerate((("head", (0, 0, 600, 100)), ("left", (0, 90, 200, 300)), ("right", (300, 0, 600, 400)), ("page", (0, 0, 600, 792))))])
    return p.select("*", F.explode(four).alias("s")).select("doc_id", "page_index", "s.*")


def spatial_containment(spark, d: str) -> DataFrame:
    lines = I.lines(spark, d)
    return L.first_containing(lines, _shapes(lines), L.TABLE_SHARE, "shape").select("doc_id", "line_no", "shape")


def lines_inside(spark, d: str) -> DataFrame:
    lines = I.lines(spark, d)
    return TB.count_inside(lines, _shapes(lines)).select("doc_id", "page_index", "shape", "lines")


def free_space(spark, d: str) -> DataFrame:
    """What is free above, below and beside each line."""
    lines = I.lines(spark, d)
    b = lines.select(*L.PAGE, F.col("line_no").alias("block_no"), L.box().alias("rect"), F.array(L.box()).alias("own"), F.lit(792.0).alias("page_height"), F.lit(600.0).alias("page_width"))
    out = RM.free_space(RM.horizontal_room(b, L.line_boxes(lines)), L.line_boxes(lines))
    return out.select("doc_id", F.col("block_no").alias("line_no"), "free_top", "free_bottom", "left_limit", "right_limit")


def rect_merge(spark, d: str) -> DataFrame:
    """Lines' boxes, grown to the next line, merged on each page."""
    grown = F.struct(F.col("x0"), F.col("y0"), F.col("x1"), (F.col("y1") + 10.0).alias("y1"))
    m = I.lines(spark, d).groupBy(*L.PAGE).agg(TB.merged_rects(F.collect_list(grown)).alias("m"))
    return m.select(*L.PAGE, F.posexplode("m").alias("ord", "r")).select(*L.PAGE, "ord", "r.*")


def ruled_tables(spark, d: str) -> DataFrame:
    """Tables of the grids drawn on each page, and their cells."""
    t = RU.ruled_tables(I.grids(I.lines(spark, d)))
    return t.select(*L.PAGE, "table_no", "cells", "rect.*")


def ruled_cells(spark, d: str) -> DataFrame:
    """Each cell of the grids drawn on each page."""
    return RU.cells_of_tables(RU.cells(RU.points(RU.edges(I.grids(I.lines(spark, d))))))


def ruled_regions(spark, d: str) -> DataFrame:
    """Regions of tables where grids are all that shows them: those of two lines."""
    lines = I.lines(spark, d)
    return TB.regions(I.grids(lines), I.pages_of(lines), lines).select(*L.PAGE, "shape", "rect.*")


def classified_lines(spark, d: str) -> DataFrame:
    """Kinds by tables, boxes, figures and footnotes as well as by text, then page furniture."""
    read = I.lines(spark, d)
    lines = kept(L.text_kinds(read, I.pages_of(read)).drop("text"), "kinds")
    pages, s = I.pages_of(lines), _shapes(lines)
    feet = pages.filter("page_index = 0").select(*L.PAGE, F.lit(300.0).alias("footnote_top"))
    c = L.classify(lines.drop("kind"), s.filter("shape = 'head'"), s.filter("shape = 'left'"), s.filter("shape = 'right'"), feet)
    return L.mark_furniture(c.select(*lines.columns, "table_id", "box_id"), pages).select("doc_id", "line_no", "kind", "table_id", "box_id")


def _document(spark, d: str) -> DataFrame:
    lines = kept(I.lines(spark, d), "input")  # pages, drawings and images are made from them
    return D.analyze(lines.drop("kind"), I.pages_of(lines), I.drawings(lines), I.images(lines))


def document_blocks(spark, d: str) -> DataFrame:
    """The blocks of whole documents: body, cells of tables and labels of figures."""
    return _document(spark, d).select("doc_id", "seq", "page_index", "block_id", "kind", "text", "line_count", F.size("areas").alias("parts"))


def document_lines(spark, d: str) -> DataFrame:
    """Lines of each kind of unit: none is lost on the way from lines to blocks."""
    k = F.when(F.col("kind").isin("table_cell", "figure_label"), F.col("kind")).otherwise("body")
    return _document(spark, d).groupBy("doc_id", k.alias("unit")).agg(F.sum("line_count").alias("lines"))


def document_labels(spark, d: str) -> DataFrame:
    """Labels of figures, loose and in boxes."""
    b = _document(spark, d).filter("kind = 'figure_label'")
    return b.select("doc_id", "page_index", "text", "line_count")


def erase_boxes(spark, d: str) -> DataFrame:
    """What is erased of each page before translations are drawn."""
    return R.erase_boxes(_document(spark, d)).select("doc_id", "page_index", "rect.*").distinct()


QUERIES = {f.__name__: f for f in (span_lines, dominant_size, dominant_style, column_assign, repeated_edges, reading_order, paragraph_groups, block_texts, block_boxes, linked_blocks, linked_lines, draw_plans, table_columns, table_cells, spatial_containment, lines_inside, free_space, rect_merge, ruled_tables, ruled_cells, ruled_regions, classified_lines, document_blocks, document_lines, document_labels, erase_boxes)}

_W = I.WS
_COLS = I.GEOMETRY_SQL + """,
ext AS (SELECT doc_id, page_index, min(x0) AS l, max(x1) AS r FROM lines GROUP BY ALL),
cols AS (SELECT lines.*, CASE WHEN x1 - x0 >= greatest(r - l, 1.0) * 0.72::DOUBLE THEN 2 WHEN (x0 + x1) / 2 < (l + r) / 2 THEN 0 ELSE 1 END AS "column" FROM lines JOIN ext USING (doc_id, page_index))"""
_BOUNDS = _COLS + """,
size_of AS (SELECT doc_id, page_index, "column", greatest(2, round_even(count(*) * 0.15::DOUBLE, 0)) AS least, min(x0) AS a, max(x1) AS b FROM cols GROUP BY ALL),
e0 AS (SELECT doc_id, page_index, "column", min(x0) AS e FROM (SELECT doc_id, page_index, "column", x0, count(*) AS n FROM cols GROUP BY ALL) JOIN size_of USING (doc_id, page_index, "column") WHERE n >= least GROUP BY ALL),
e1 AS (SELECT doc_id, page_index, "column", max(x1) AS e FROM (SELECT doc_id, page_index, "column", x1, count(*) AS n FROM cols GROUP BY ALL) JOIN size_of USING (doc_id, page_index, "column") WHERE n >= least GROUP BY ALL),
raw_b AS (SELECT s.doc_id, s.page_index, s."column", coalesce(e0.e, a) AS "left", coalesce(e1.e, b) AS "right" FROM size_of s LEFT JOIN e0 USING (doc_id, page_index, "column") LEFT JOIN e1 USING (doc_id, page_index, "column")),
bounds AS (SELECT doc_id, page_index, "column", "left", CASE WHEN "column" = 0 THEN least("right", coalesce(min("left") FILTER (WHERE "column" = 1) OVER (PARTITION BY doc_id, page_index) - 4.0, "right")) ELSE "right" END AS "right" FROM raw_b)"""
_READ = """,
band AS (SELECT *, sum(("column" = 2)::INT) OVER (PARTITION BY doc_id, page_index ORDER BY round(y0, 1), x0, line_no) AS band FROM cols),
reads AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY band, CASE WHEN "column" = 2 THEN -1 ELSE "column" END, round(y0, 1), x0, line_no) AS read_no FROM band)"""
_GROUPS = _BOUNDS + _READ + rf""",
p AS (SELECT r.*, "left", "right", lag(text) OVER w AS pt, lag(y1) OVER w AS py1, lag(x1) OVER w AS px1, lag(size) OVER w AS ps, lag("column") OVER w AS pc, lag("right") OVER w AS pr
  FROM reads r JOIN bounds USING (doc_id, page_index, "column") WINDOW w AS (PARTITION BY r.doc_id, r.page_index ORDER BY read_no)),
n AS (SELECT *, (pt IS NULL OR pc <> "column" OR abs(ps - size) > 0.6 OR regexp_matches(text, '^{_W}*([•▪◦‣∙·–—*]|\p{{Nd}}{{1,2}}[.)]|[a-z][.)]){_W}+') OR y0 - py1 > 0.85::DOUBLE * greatest(ps, 1) OR y0 - py1 < -ps
  OR (regexp_matches(pt, '[.!?]{_W}*[\x22''”’)\]}}»›]*{_W}*$') AND (px1 < pr - 2.5 OR x0 > "left" + 5.0)))::INT AS is_new FROM p),
groups AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id, page_index ORDER BY read_no) AS group_no FROM n)"""
_SHAPES = ", shapes AS (SELECT doc_id, page_index, s.* FROM (SELECT DISTINCT doc_id, page_index FROM lines), (VALUES ('head', 0, 0, 0, 600, 100), ('left', 1, 0, 90, 200, 300), ('right', 2, 300, 0, 600, 400), ('page', 3, 0, 0, 600, 792)) s(shape, ord, a0, b0, a1, b1)), inside AS (SELECT l.doc_id, l.page_index, line_no, shape, ord FROM lines l JOIN shapes s ON l.doc_id = s.doc_id AND l.page_index = s.page_index WHERE greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0) / ((x1 - x0) * (y1 - y0)) >= 0.6::DOUBLE)"
_CELLS = """,
t AS (SELECT *, coalesce(x0 - lag(x0) OVER (PARTITION BY doc_id, page_index ORDER BY x0, line_no) > 18, false)::INT AS is_new FROM lines),
c AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id, page_index ORDER BY x0, line_no) AS col_no FROM t),
g AS (SELECT doc_id, page_index, col_no, min(x0) AS col_x0, max(x1) AS mx FROM c GROUP BY ALL),
h AS (SELECT *, greatest(mx, coalesce(lead(col_x0) OVER (PARTITION BY doc_id, page_index ORDER BY col_no) - 4.0, mx)) AS col_x1 FROM g)"""

_BOXES = _GROUPS + rf""",
w AS (SELECT doc_id, page_index, size, sum(length(text)) AS n, min(line_no) AS s FROM lines GROUP BY ALL),
body AS (SELECT doc_id, page_index, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n DESC, s) AS k FROM w) WHERE k = 1),
boxed AS (SELECT doc_id, page_index, group_no, count(*) AS n, list({{'a': x0::DOUBLE, 'b': y0::DOUBLE, 'c': x1::DOUBLE, 'd': y1::DOUBLE}}) AS own, min(x0)::DOUBLE AS bx0, min(y0)::DOUBLE AS top, max(x1)::DOUBLE AS bx1, max(y1)::DOUBLE AS bottom,
  arg_min("left", read_no)::DOUBLE AS l, arg_min("right", read_no)::DOUBLE AS r, arg_min(text, read_no) AS head, arg_min(size, read_no)::DOUBLE AS size, arg_min(x0, read_no)::DOUBLE AS fx, arg_min(y0, read_no)::DOUBLE AS fy, arg_max(y0, read_no)::DOUBLE AS ly FROM groups GROUP BY ALL),
kinded AS (SELECT *, CASE WHEN n < 2 THEN 1.15::DOUBLE ELSE least(greatest((ly - fy) / (n - 1) / greatest(size, 1), 0.95::DOUBLE), 2) END AS line_height,
  CASE WHEN NOT regexp_matches(head, '^{_W}*([•▪◦‣∙·–—*]|\p{{Nd}}{{1,2}}[.)]|[a-z][.)]){_W}+') AND size >= body_size * 1.12::DOUBLE AND n <= 3 THEN bx0 ELSE least(bx0, l) END AS ix0, top - 1 AS iy0, greatest(r, bx1) AS ix1, bottom + 1 AS iy1 FROM boxed JOIN body USING (doc_id, page_index)),
beside AS (SELECT k.doc_id, k.page_index, k.group_no, greatest(0, coalesce(max(o.x1) FILTER (WHERE o.x1 <= bx0) + 3, 0))::DOUBLE AS ll, least(600, coalesce(min(o.x0) FILTER (WHERE o.x1 > bx0 AND o.x0 >= bx1) - 3, 600))::DOUBLE AS rl
  FROM kinded k LEFT JOIN lines o ON o.doc_id = k.doc_id AND o.page_index = k.page_index AND o.y1 > top AND o.y0 < bottom AND NOT list_contains(own, {{'a': o.x0::DOUBLE, 'b': o.y0::DOUBLE, 'c': o.x1::DOUBLE, 'd': o.y1::DOUBLE}}) GROUP BY ALL),
fitted AS (SELECT k.*, least(greatest(ix0, ll), bx0) AS x0, greatest(least(ix1, rl), bx1) AS x1 FROM kinded k JOIN beside USING (doc_id, page_index, group_no)),
freed AS (SELECT k.doc_id, k.page_index, k.group_no, max(o.y1) FILTER (WHERE o.y1 <= iy0 + 1)::DOUBLE AS above, min(o.y0) FILTER (WHERE o.y0 >= iy1 - 1)::DOUBLE AS below
  FROM fitted k LEFT JOIN lines o ON o.doc_id = k.doc_id AND o.page_index = k.page_index AND (least(k.x1, o.x1) - greatest(k.x0, o.x0)) / least(k.x1 - k.x0, o.x1 - o.x0) >= 0.15::DOUBLE AND NOT list_contains(own, {{'a': o.x0::DOUBLE, 'b': o.y0::DOUBLE, 'c': o.x1::DOUBLE, 'd': o.y1::DOUBLE}}) GROUP BY ALL),
room AS (SELECT k.*, greatest(least(792 * 0.97::DOUBLE, coalesce(below - 2, 1e9)), iy1) AS free_bottom, least(greatest(0, coalesce(above + 2, 0)), iy0) AS free_top,
  greatest(line_height, 1) * greatest(size, 1) AS pitch FROM fitted k JOIN freed USING (doc_id, page_index, group_no)),
led AS (SELECT *, greatest(0, pitch - (iy1 - iy0) / n) / 2 AS lead FROM room),
flows AS (SELECT *, greatest(iy0 - lead, free_top) AS y0 FROM led),
boxes AS (SELECT doc_id, page_index, group_no::BIGINT AS block_no, 'p' || page_index || '_x' || fx::INT || '_y' || fy::INT || '_n' || n AS block_id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, least(greatest(iy1 + lead, y0 + n * pitch), greatest(free_bottom, iy1))::DOUBLE AS y1, free_bottom::DOUBLE AS max_bottom, line_height::DOUBLE AS line_height FROM flows)"""

_UNITS = rf""", spot AS (SELECT *, x0 = 310 AND line_no % 20 < 5 AS on_shape, x0 = 310 AND line_no % 20 >= 15 AS on_image,
    lower({I.sql_strip(f"regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '{I.WS}+', ' ', 'g')")}) AS key, y0 < 792 * 0.12::DOUBLE OR y1 > 792 * 0.88::DOUBLE AS margin FROM lines),
often AS (SELECT doc_id, key FROM spot WHERE margin AND key <> '' GROUP BY ALL HAVING count(DISTINCT page_index) >= 3),
kinds AS (SELECT s.*, count(*) FILTER (WHERE on_shape) OVER (PARTITION BY s.doc_id, s.page_index) AS n_shape, margin AND o.key IS NOT NULL AS furniture FROM spot s LEFT JOIN often o ON o.doc_id = s.doc_id AND o.key = s.key)"""

_GRID = """,
grid AS (SELECT doc_id, page_index, least(count(*), 20)::INTEGER AS r, (count(*) % 3 + 2)::INTEGER AS c FROM lines GROUP BY ALL),
cell AS (SELECT doc_id, page_index, r, c, i, j, 40 + 90 * j AS x0, 57 + 16 * i AS y0, 40 + 90 * (j + CASE WHEN i = 0 AND j = 0 THEN 2 ELSE 1 END) AS x1, 57 + 16 * (i + 1) AS y1 FROM grid, range(20) a(i), range(4) b(j) WHERE i < r AND j < c AND NOT (i = 0 AND j = 1)),
tab AS (SELECT doc_id, page_index, count(*) AS n, max(x1) AS x1, max(y1) AS y1, count(DISTINCT cell.x0) AS l, count(DISTINCT cell.x1) AS k FROM cell GROUP BY ALL HAVING l >= 2 AND k >= 2)"""

ORACLES = {
    "ruled_cells": f"WITH {I.GEOMETRY_SQL}{_GRID} SELECT doc_id, page_index, 0 AS table_no, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM cell",
    "ruled_tables": f"WITH {I.GEOMETRY_SQL}{_GRID} SELECT doc_id, page_index, 0 AS table_no, n::INTEGER AS cells, 40::DOUBLE AS x0, 57::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM tab",
    "block_boxes": f"WITH {_BOXES} SELECT * FROM boxes",
    "linked_blocks": rf"""WITH {_BOXES},
        joined AS (SELECT doc_id, page_index, group_no, arg_min(text, read_no) AS head, arg_min(size, read_no) AS size, count(*) AS n, string_agg(text, ' ' ORDER BY read_no) AS text FROM groups GROUP BY ALL),
        whole AS (SELECT t.doc_id, t.page_index, t.group_no::BIGINT AS block_no, t.size, t.n, t.text, b.x0, b.x1, b.y0, b.y1, CASE WHEN regexp_matches(head, '^{_W}*([•▪◦‣∙·–—*]|\p{{Nd}}{{1,2}}[.)]|[a-z][.)]){_W}+') THEN 'list_item' WHEN t.size >= body_size * 1.12::DOUBLE AND n <= 3 THEN 'heading' ELSE 'paragraph' END AS kind
          FROM joined t JOIN body USING (doc_id, page_index) JOIN boxes b ON b.doc_id = t.doc_id AND b.page_index = t.page_index AND b.block_no = t.group_no),
        before AS (SELECT *, lag(page_index) OVER w AS pp, lag(x1) OVER w AS px, lag(y1) OVER w AS py, lag(text) OVER w AS pt, lag(kind) OVER w AS pk, lag(size) OVER w AS ps FROM whole WHERE kind <> 'heading' WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, block_no)),
        chained AS (SELECT *, sum((NOT coalesce(pk = kind AND abs(ps - size) <= 0.6 AND py >= 594 AND NOT regexp_matches(pt, '[.!?]{_W}*[\x22\x27\x27”’)\]}}»›]*{_W}*$') AND regexp_matches(text, '^\p{{Ll}}') AND CASE WHEN pp = page_index THEN x0 > px - 1 ELSE page_index = pp + 1 AND y0 <= 198 END, false))::INT) OVER (PARTITION BY doc_id ORDER BY page_index, block_no) AS chain FROM before)
        SELECT doc_id, arg_min(page_index, (page_index, block_no)) AS page_index, arg_min(block_no, (page_index, block_no)) AS block_no, any_value(kind) AS kind, count(*)::INTEGER AS parts, string_agg(text, ' ' ORDER BY page_index, block_no) AS text, sum(n)::INTEGER AS line_count FROM chained GROUP BY doc_id, chain
        UNION ALL SELECT doc_id, page_index, block_no, kind, 1, text, n::INTEGER FROM whole WHERE kind = 'heading'""",
    "span_lines": f"""WITH {I.GEOMETRY_SQL}, n AS (SELECT *, length(text) % 2 = 0 AS even FROM lines)
        SELECT doc_id, page_index, line_no, {I.sql_clean("text")} AS text, 10.0::DOUBLE AS size, even AS bold, NOT even AS italic, even AS serif, CASE WHEN even THEN 0 ELSE 1 END AS color FROM n""",
    "rect_merge": f"""WITH RECURSIVE {I.GEOMETRY_SQL},
        o AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, x1) AS rn, {{'x0': x0::DOUBLE, 'y0': y0::DOUBLE, 'x1': x1::DOUBLE, 'y1': y1::DOUBLE + 10}} AS r FROM lines),
        f AS (SELECT doc_id, page_index, rn, [r] AS kept FROM o WHERE rn = 1
          UNION ALL SELECT doc_id, page_index, rn, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(kept, r) ELSE list_transform(kept, lambda k, i: CASE WHEN i = hit THEN {{'x0': least(k.x0, r.x0), 'y0': least(k.y0, r.y0), 'x1': greatest(k.x1, r.x1), 'y1': greatest(k.y1, r.y1)}} ELSE k END) END FROM (
            SELECT o.doc_id, o.page_index, o.rn, o.r, f.kept, list_position(list_transform(f.kept, lambda k: greatest(least(k.x1, o.r.x1) - greatest(k.x0, o.r.x0), 0) * greatest(least(k.y1, o.r.y1) - greatest(k.y0, o.r.y0), 0) / least((k.x1 - k.x0) * (k.y1 - k.y0), (o.r.x1 - o.r.x0) * (o.r.y1 - o.r.y0)) > 0.15::DOUBLE), true) AS hit
            FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_index = f.page_index AND o.rn = f.rn + 1)),
        e AS (SELECT doc_id, page_index, arg_max(kept, rn) AS kept FROM f GROUP BY ALL)
        SELECT doc_id, page_index, (unnest(range(1, len(kept) + 1)) - 1)::INTEGER AS ord, unnest(kept).x0 AS x0, unnest(kept).y0 AS y0, unnest(kept).x1 AS x1, unnest(kept).y1 AS y1 FROM e""",
    "ruled_regions": f"""WITH {I.GEOMETRY_SQL}{_GRID},
        clustered AS (SELECT g.doc_id, g.page_index, count(*) AS n FROM grid g JOIN lines l ON l.doc_id = g.doc_id AND l.page_index = g.page_index WHERE r >= 2 AND greatest(least(l.x1, 40 + 90 * c) - greatest(l.x0, 86), 0) * greatest(least(l.y1, 57.5 + 16 * r) - greatest(l.y0, 57.5), 0) / ((l.x1 - l.x0) * (l.y1 - l.y0)) >= 0.6::DOUBLE GROUP BY ALL),
        region AS (SELECT t.doc_id, t.page_index, t.x1, t.y1 + CASE WHEN k.n >= 2 THEN 0.5 ELSE 0 END AS y1 FROM tab t LEFT JOIN clustered k USING (doc_id, page_index))
        SELECT r.doc_id, r.page_index, 'p' || r.page_index || '_t0' AS shape, 40::DOUBLE AS x0, 57::DOUBLE AS y0, r.x1::DOUBLE AS x1, r.y1::DOUBLE AS y1 FROM region r JOIN lines l ON l.doc_id = r.doc_id AND l.page_index = r.page_index
        WHERE greatest(least(l.x1, r.x1) - greatest(l.x0, 40), 0) * greatest(least(l.y1, r.y1) - greatest(l.y0, 57), 0) / ((l.x1 - l.x0) * (l.y1 - l.y0)) >= 0.6::DOUBLE GROUP BY ALL HAVING count(*) >= 2""",
    "linked_lines": rf"""WITH {I.GEOMETRY_SQL}, b AS (SELECT doc_id, page_index, line_no::BIGINT AS line_no, line_no % 7 = 3 AS heading, CASE WHEN length(text) % 3 = 0 THEN text ELSE lower(regexp_replace(text, '[.!?]+$', '')) END AS text, x0, x1, y0, y1 FROM lines),
        p AS (SELECT *, lag(page_index) OVER w AS pp, lag(x1) OVER w AS px, lag(y1) OVER w AS py, lag(text) OVER w AS pt FROM b WHERE NOT heading WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, line_no)),
        g AS (SELECT *, sum((NOT coalesce(py >= 300 AND NOT regexp_matches(pt, '[.!?]{_W}*[\x22''”’)\]}}»›]*{_W}*$') AND regexp_matches(text, '^\p{{Ll}}') AND CASE WHEN pp = page_index THEN x0 > px - 1 ELSE page_index = pp + 1 AND y0 <= 100 END, false))::INT) OVER (PARTITION BY doc_id ORDER BY page_index, line_no) AS chain FROM p)
        SELECT doc_id, page_index, line_no, 'paragraph' AS kind, first_value(page_index) OVER c AS head_page, first_value(line_no) OVER c AS head_line FROM g WINDOW c AS (PARTITION BY doc_id, chain ORDER BY page_index, line_no)
        UNION ALL SELECT doc_id, page_index, line_no, 'heading', page_index, line_no FROM b WHERE heading""",
    "document_labels": f"WITH {I.GEOMETRY_SQL}{_UNITS} SELECT doc_id, page_index, text, 1 AS line_count FROM kinds WHERE NOT furniture AND (on_image OR (on_shape AND n_shape = 1))",
    "document_lines": f"WITH {I.GEOMETRY_SQL}{_UNITS}, u AS (SELECT doc_id, 'body' AS unit FROM kinds WHERE furniture OR NOT (on_image OR on_shape) UNION ALL SELECT doc_id, 'table_cell' FROM kinds WHERE on_shape AND n_shape > 1 UNION ALL SELECT doc_id, 'figure_label' FROM kinds WHERE NOT furniture AND (on_image OR (on_shape AND n_shape = 1))) SELECT doc_id, unit, count(*) AS lines FROM u GROUP BY ALL",
    "erase_boxes": f"WITH {I.GEOMETRY_SQL} SELECT DISTINCT doc_id, page_index, x0 - 0.7::DOUBLE AS x0, y0::DOUBLE - 0.7::DOUBLE AS y0, x1 + 0.7::DOUBLE AS x1, y1::DOUBLE + 0.7::DOUBLE AS y1 FROM lines",
    "dominant_size": f"WITH {I.GEOMETRY_SQL}, w AS (SELECT doc_id, page_index, size, sum(length(text)) AS n, min(line_no) AS s FROM lines GROUP BY ALL) SELECT doc_id, page_index, size::DOUBLE AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n DESC, s) AS k FROM w) WHERE k = 1",
    "dominant_style": f"WITH {I.GEOMETRY_SQL}, w AS (SELECT doc_id, size, sum(length(text)) AS n, min(line_no) AS s FROM lines GROUP BY ALL) SELECT doc_id, size::DOUBLE AS size, true AS serif, 0 AS color FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS k FROM w) WHERE k = 1",
    "column_assign": f'WITH {_COLS} SELECT doc_id, line_no, "column" FROM cols',
    "repeated_edges": f'WITH {_BOUNDS} SELECT doc_id, page_index, "column", "left"::DOUBLE AS "left", "right"::DOUBLE AS "right" FROM bounds',
    "reading_order": f"WITH {_COLS}{_READ} SELECT doc_id, line_no, read_no::INTEGER AS read_no FROM reads",
    "paragraph_groups": f"WITH {_GROUPS} SELECT doc_id, line_no, group_no::BIGINT AS group_no FROM groups",
    "table_columns": f"WITH {I.GEOMETRY_SQL}{_CELLS} SELECT doc_id, line_no, col_no::BIGINT AS col_no, col_x0::DOUBLE AS col_x0, col_x1::DOUBLE AS col_x1 FROM c JOIN h USING (doc_id, page_index, col_no)",
    "table_cells": f"""WITH {I.GEOMETRY_SQL}{_CELLS}, q AS (SELECT *, lag(y1) OVER v AS py1, lag(size) OVER v AS ps FROM c WINDOW v AS (PARTITION BY doc_id, page_index, col_no ORDER BY y0, x0, line_no)),
        u AS (SELECT *, sum(CASE WHEN py1 IS NULL THEN 0 ELSE (y0 - py1 > 1.8::DOUBLE * greatest(ps, 1) OR abs(ps - size) > 0.6 OR 90.5 BETWEEN py1 AND y0 OR 154.5 BETWEEN py1 AND y0)::INT END) OVER (PARTITION BY doc_id, page_index, col_no ORDER BY y0, x0, line_no) AS cell FROM q),
        k AS (SELECT doc_id, page_index, col_no, cell, count(*) AS n, min(y0) AS y0, max(y1) AS y1 FROM u GROUP BY ALL)
        SELECT doc_id, page_index, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, col_x0, cell) - 1)::INTEGER AS cell_no, col_no::BIGINT AS col_no, n::INTEGER AS line_count, col_x0::DOUBLE AS x0, y0::DOUBLE AS y0, col_x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM k JOIN h USING (doc_id, page_index, col_no)""",
    "spatial_containment": f"WITH {I.GEOMETRY_SQL}{_SHAPES} SELECT l.doc_id, l.line_no, (SELECT arg_min(shape, ord) FROM inside i WHERE i.doc_id = l.doc_id AND i.page_index = l.page_index AND i.line_no = l.line_no) AS shape FROM lines l",
    "lines_inside": f"WITH {I.GEOMETRY_SQL}{_SHAPES} SELECT s.doc_id, s.page_index, s.shape, count(i.line_no) AS lines FROM shapes s LEFT JOIN inside i ON i.doc_id = s.doc_id AND i.page_index = s.page_index AND i.shape = s.shape GROUP BY ALL",
    "free_space": f"""WITH {I.GEOMETRY_SQL}, o AS (SELECT a.doc_id, a.line_no, a.x0, a.x1, a.y0, a.y1, b.x0 AS bx0, b.x1 AS bx1, b.y0 AS by0, b.y1 AS by1, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) AS share
        FROM lines a LEFT JOIN lines b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND (a.x0, a.y0, a.x1, a.y1) <> (b.x0, b.y0, b.x1, b.y1))
        SELECT doc_id, line_no, least(greatest(0, coalesce(max(by1 + 2) FILTER (WHERE share >= 0.15::DOUBLE AND by1 <= y0 + 1), 0)), any_value(y0))::DOUBLE AS free_top,
        greatest(least(792 * 0.97::DOUBLE, coalesce(min(by0 - 2) FILTER (WHERE share >= 0.15::DOUBLE AND by0 >= y1 - 1), 792 * 0.97::DOUBLE)), any_value(y1))::DOUBLE AS free_bottom,
        greatest(0, coalesce(max(bx1 + 3) FILTER (WHERE by1 > y0 AND by0 < y1 AND bx1 <= x0), 0))::DOUBLE AS left_limit,
        least(600, coalesce(min(bx0 - 3) FILTER (WHERE by1 > y0 AND by0 < y1 AND bx1 > x0 AND bx0 >= x1), 600))::DOUBLE AS right_limit FROM o GROUP BY doc_id, line_no""",
    "block_texts": f"""WITH {_GROUPS}, w AS (SELECT doc_id, page_index, size, sum(length(text)) AS n, min(line_no) AS s FROM lines GROUP BY ALL), body AS (SELECT doc_id, page_index, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n DESC, s) AS k FROM w) WHERE k = 1),
        b AS (SELECT doc_id, page_index, group_no, arg_min(text, read_no) AS head, arg_max(text, read_no) AS tail, arg_min(size, read_no) AS size, count(*) AS n, string_agg(text, ' ' ORDER BY read_no) AS text FROM groups GROUP BY ALL)
        SELECT doc_id, page_index, group_no::BIGINT AS block_no, CASE WHEN regexp_matches(head, '^{_W}*([•▪◦‣∙·–—*]|\\p{{Nd}}{{1,2}}[.)]|[a-z][.)]){_W}+') THEN 'list_item' WHEN size >= body_size * 1.12::DOUBLE AND n <= 3 THEN 'heading' ELSE 'paragraph' END AS kind, text, n::INTEGER AS line_count FROM b JOIN body USING (doc_id, page_index)""",
    "classified_lines": f"""WITH {I.GEOMETRY_SQL}{_SHAPES}, hit AS (SELECT l.doc_id, l.page_index, l.line_no, text, y0, y1, bool_or(coalesce(shape = 'head' AND share >= 0.6::DOUBLE, false)) AS in_table, bool_or(coalesce(shape = 'left' AND share >= 0.75::DOUBLE, false)) AS in_box, bool_or(coalesce(shape = 'right' AND share >= 0.55::DOUBLE, false)) AS in_figure
          FROM (SELECT l.*, s.shape, greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0) / ((x1 - x0) * (y1 - y0)) AS share FROM lines l JOIN shapes s ON l.doc_id = s.doc_id AND l.page_index = s.page_index) l GROUP BY ALL),
        k AS (SELECT *, CASE WHEN in_table THEN 'table_cell' WHEN in_box OR in_figure THEN 'figure_label' WHEN page_index = 0 AND y0 >= 300 THEN 'footnote' WHEN regexp_matches(text, '(?i)^{_W}*(table|box|bảng){_W}*\\p{{Nd}}') THEN 'table_title' WHEN regexp_matches(text, '(?i)^{_W}*(figure|fig\\.?|table|box|chart|plate|bảng|hình){_W}*\\p{{Nd}}+') THEN 'caption' ELSE 'paragraph' END AS kind,
          lower({I.sql_strip(f"regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '{I.WS}+', ' ', 'g')")}) AS key, y0 < 792 * 0.12::DOUBLE OR y1 > 792 * 0.88::DOUBLE AS margin FROM hit),
        often AS (SELECT doc_id, key FROM k WHERE margin AND key <> '' GROUP BY ALL HAVING count(DISTINCT page_index) >= 3)
        SELECT k.doc_id, k.line_no, CASE WHEN margin AND o.key IS NOT NULL THEN 'page_furniture' ELSE kind END AS kind, CASE WHEN in_table THEN 'head' END AS table_id, CASE WHEN in_box AND NOT in_table THEN 'left' END AS box_id FROM k LEFT JOIN often o ON o.doc_id = k.doc_id AND o.key = k.key""",
}
