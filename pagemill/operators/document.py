"""Whole documents: from lines, drawings and images to blocks in order, and from blocks and translations to what is
erased and drawn on each page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.operators import layout as L
from pagemill.operators import render as R
from pagemill.operators import tables as TB
from pagemill.operators.layout import PAGE
from pagemill.session import kept

#: Drawings of less area take no room.
LEAST_DRAWING = 12.0


def occupied(lines: DataFrame, drawings: DataFrame, images: DataFrame) -> DataFrame:
    """What takes room on pages: owner and rect of lines, images and drawings that are not tiny."""
    other = lambda df, name: df.select(*PAGE, F.lit(name).alias("owner"), L.box().alias("rect"))
    return L.line_boxes(lines).unionByName(other(images, "image")).unionByName(other(drawings.filter(G.area(L.box()) >= LEAST_DRAWING), "drawing"))


def classified(lines: DataFrame, pages: DataFrame, tables: DataFrame, boxes: DataFrame, drawings: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with kind, table_id, box_id and column, before and after page furniture is marked. Body sizes and columns
    are measured before. The first ones are written, as the second ones look at them twice."""
    shapes = L.figures(images).select(*PAGE, F.lit("figure").alias("shape"), F.lit(0).alias("ord"), L.box().alias("rect"))
    placed = kept(L.assign_columns(L.classify(lines.drop("kind"), tables, boxes, shapes, L.footnote_rule(drawings, pages))), "classified")
    return placed, kept(L.mark_furniture(placed, pages).drop("text_kind", "furniture_key"), "marked")


def _area() -> Column:
    return F.struct("page_index", "rect", "max_bottom", "page_height")


def _unit(blocks: DataFrame, part: int, order: Column) -> DataFrame:
    """A block that stands on one page, as a unit of the document."""
    rects = F.transform("line_rects", lambda r: F.struct(F.col("page_index").alias("page_index"), r.alias("rect")))
    return blocks.select(*PAGE, "block_id", "kind", "said", "style", F.array(_area()).alias("areas"), rects.alias("line_rects"), "align", "line_count", "line_height", F.lit(part).alias("_part"), order.alias("_order"))


def loose_lines(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """Lines on figures that no box holds, as groups of their own: group_no goes down from -1."""
    own = lines.filter((F.col("kind") == "figure_label") & F.col("box_id").isNull())
    return own.join(L.paged(bounds.select(*PAGE, "column", "left", "right")), [*PAGE, "column"], "left").withColumns({"read_no": F.lit(1), "group_no": -1 - F.col("line_no").cast("long")})


def loose_labels(blocks: DataFrame) -> DataFrame:
    """The blocks of loose lines, wider to the right where nothing stands."""
    return blocks.filter("block_no < 0").withColumns({"block_no": -1 - F.col("block_no"), "rect": L.widened(F.col("rect"), F.col("right_limit"))})


def analyze(lines: DataFrame, pages: DataFrame, drawings: DataFrame, images: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The blocks of documents: doc_id, seq (from 1), page_index, block_id, kind, text, style, areas (page_index, rect,
    max_bottom, page_height of each part), line_rects (page_index, rect), align, line_count and line_height.

    Body text comes first, in reading order, linked across columns and pages; then, page by page, what stands outside
    it: cells of tables, loose labels, labels in boxes. found: tables found elsewhere (page, rect).

    Texts are read for their signs and stay behind; they come to the finished blocks, where they are asked for."""
    pages, drawings, images = kept(pages, "pages"), kept(drawings, "drawings"), kept(images, "images")
    texts = kept(L.all_signs(lines, pages), "lines")
    lines = texts.drop("text")
    tables, boxes = kept(TB.regions(drawings, pages, lines, found), "tables"), kept(L.closed_boxes(drawings, pages, lines), "boxes")
    placed, marked = classified(lines, pages, tables, boxes, drawings, images)
    sizes, bounds = kept(L.dominant_size(placed), "sizes"), kept(L.column_bounds(placed), "bounds")
    room = occupied(lines, drawings, images)
    grouped = L.group_lines(L.reading_order(marked), bounds).unionByName(loose_lines(marked, bounds))
    blocks = kept(L.make_blocks(grouped, pages, sizes, room), "blocks")  # both look around on the same pages
    linked = L.link_blocks(blocks.filter("block_no > 0"))
    cells = TB.cell_blocks(TB.table_cells(marked.filter("table_id IS NOT NULL"), tables), pages, room)
    loose = loose_labels(blocks)
    boxed = L.boxed_labels(marked, boxes, pages)
    number = lambda c: F.struct(F.col(c).cast("long").alias("n"), F.lit("").alias("s"))
    name = lambda c: F.struct(F.lit(0).cast("long").alias("n"), F.col(c).alias("s"))
    parts = [
        L.merge_linked(linked).withColumns({"_part": F.lit(0), "_order": number("block_no")}).drop("block_no"),
        _unit(cells, 1, F.struct(F.col("cell_no").cast("long").alias("n"), F.col("table_id").alias("s"))),
        _unit(loose, 2, number("block_no")),
        _unit(boxed, 3, name("block_id")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("doc_id").orderBy(F.least("_part", F.lit(1)), "page_index", "_part", F.when(F.col("_part") == 1, F.col("_order.s")), "_order.n", "_order.s")
    every = kept(every.withColumn("seq", F.row_number().over(order)).drop("_part", "_order"), "units")
    return L.with_texts(every, texts).select(*PAGE, "block_id", "kind", "text", "style", "areas", "line_rects", "align", "line_count", "line_height", "seq")


def drawn(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """What is drawn on each page: doc_id, page_index (of the part), block_id, seq, rect, text (the part's share of the
    translation), size, line_height, align. Blocks without a translation keep their text; blank ones are not drawn.
    translations: doc_id, block_id, translated_text. Of blocks with one id on one page the last is drawn."""
    t = translations.select(F.col("doc_id").alias("_doc"), F.col("block_id").alias("_block"), F.nullif("translated_text", F.lit("")).alias("_t")).dropDuplicates(["_doc", "_block"])
    said = blocks.join(t, (F.col("doc_id") == F.col("_doc")) & (F.col("block_id") == F.col("_block")), "left").withColumns({"text": F.coalesce("_t", "text"), "size": F.col("style.size")})
    planned = R.draw_plan(said.filter(F.length(F.trim("text")) > 0))
    each = R.blocks_by_page(planned).select("*", F.posexplode("areas").alias("_i", "_area")).filter("_area.page_index = on_page")
    return each.select("doc_id", F.col("on_page").alias("page_index"), "block_id", "seq", F.col("_area.rect").alias("rect"), F.coalesce(F.get(F.col("plan.chunks"), F.col("_i")), F.lit("")).alias("text"), F.col("plan.size").alias("size"), F.col("plan.line_height").alias("line_height"), "align")
