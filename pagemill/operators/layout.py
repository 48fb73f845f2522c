"""Page layout: lines from spans, their kinds, columns and reading order, and the blocks they form.

Everything joins and groups by (doc_id, page_index) first, so rectangles meet within a page only. Lines have
line_no (their order on the page), text, x0, y0, x1, y1, size, bold, italic, serif, color and kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.functions import text as X
from pagemill.operators.folds import fold
from pagemill.operators.rooms import room

PAGE = ["doc_id", "page_index"]
LEFT, RIGHT, SPAN = 0, 1, 2
ALIGN_LEFT, ALIGN_CENTER, ALIGN_JUSTIFY = 0, 1, 3
# Kinds of blocks, and shares.
KINDS = ("paragraph", "heading", "list_item", "caption", "table_title", "table_cell", "footnote", "figure_label", "page_furniture")
FLOWING = ("paragraph", "list_item", "footnote")
BORROWING = ("paragraph", "list_item", "caption", "heading", "table_title", "table_cell", "footnote")
NOT_BODY = ("table_cell", "figure_label")
STYLE = ("size", "bold", "italic", "serif", "color")
SPAN_SHARE, BOX_SHARE, FIGURE_SHARE, TABLE_SHARE = 0.72, 0.75, 0.55, 0.6
#: Height of the bands of a page in which lines and shapes look for each other.
BAND = 128.0


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{n}").cast("double").alias(n) for n in ("x0", "y0", "x1", "y1")])


def paged(df: DataFrame) -> DataFrame:
    """df, of which each page has a few rows, for a join that deals both sides out by their keys. Such rows take 2 bytes each
    in a file, by which Spark would hold millions of them for small and send them whole through the driver to every task."""
    return df.hint("merge")


def chars(lines: DataFrame) -> Column:
    """The length of each line's text, which is taken from `chars` where the text stays behind."""
    return F.col("chars") if "chars" in lines.columns else F.length("text")


def told(blocks: DataFrame) -> str:
    """What tells a block's text: `text`, or `said`, the lines (line_id) whose texts it is, in order."""
    return "text" if "text" in blocks.columns else "said"


def order_y(c: Column | None = None) -> Column:
    return F.bround(F.col("y0") if c is None else c, 1)


# ---- lines --------------------------------------------------------------------------------------


def make_lines(spans: DataFrame) -> DataFrame:
    """Lines from spans (doc_id, page_index, block_no, line_no, span_no, text, size, flags, font, color, and the
    line's x0..y1). The longest span, the first of equals, gives the style; lines without a letter go."""
    some = spans.filter(F.length("text") > 0)
    s = F.array_sort(F.collect_list(F.struct("span_no", "text", "size", "flags", "font", "color")))
    grouped = some.groupBy(*PAGE, "block_no", "line_no").agg(s.alias("s"), *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    body = F.array_max(F.transform("s", lambda x: F.struct(F.length(x["text"]).alias("n"), (-x["span_no"]).alias("k"), x.alias("span"))))["span"]
    font = F.lower(F.coalesce(F.col("b.font"), F.lit("")))
    flag = lambda bit: F.coalesce(F.col("b.flags"), F.lit(0)).bitwiseAND(F.lit(bit)) > 0
    out = grouped.withColumns({"text": X.clean(F.array_join(F.transform("s", lambda x: x["text"]), "")), "b": body}).filter(X.has_letter(F.col("text")))
    style = {"size": F.bround("b.size", 1), "bold": flag(16) | font.contains("bold") | font.contains("black"), "italic": flag(2) | font.contains("italic") | font.contains("oblique"), "serif": flag(4), "color": F.coalesce(F.col("b.color"), F.lit(0))}
    return out.withColumns(style).drop("s", "b").withColumn("kind", F.lit("paragraph"))


def figures(images: DataFrame, least: float = 4000.0) -> DataFrame:
    """Images large enough that text on them is their label."""
    return images.filter(G.area(box()) >= least)


# ---- kinds --------------------------------------------------------------------------------------


def _inside(lines: DataFrame, shapes: DataFrame, share: float | Column) -> DataFrame:
    """(page, line_no, shape, ord) of lines that lie in a shape (doc_id, page_index, shape, ord, rect) by at least share,
    a column of the shapes if they differ in it."""
    r = shapes.select(*[F.col(c).alias(f"_{c}") for c in PAGE], "shape", "ord", "rect", *[c for c in shapes.columns if c == "share"], F.explode(_bands(F.col("rect"))).alias("_at"))
    own = lines.select(*PAGE, "line_no", box().alias("_b")).select("*", F.explode(_bands(F.col("_b"))).alias("_band"))
    both = own.join(paged(r), (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_index") == F.col("_page_index")) & (F.col("_band") == F.col("_at")))
    once = F.col("_band") == F.floor(F.greatest("_b.y0", "rect.y0") / BAND)  # the band in which both have begun
    return both.filter(once & (G.overlap_ratio(F.col("_b"), F.col("rect")) >= share)).select(*PAGE, "line_no", "shape", "ord")


def _bands(r: Column) -> Column:
    """The bands of a page that a rectangle reaches, so that it meets only what is at its height."""
    first = F.floor(r["y0"] / BAND)
    return F.sequence(first, F.greatest(first, F.floor(r["y1"] / BAND)))


def first_containing(lines: DataFrame, shapes: DataFrame, share: float, name: str) -> DataFrame:
    """lines with `name`: the first shape, in the page's order, that holds each."""
    hit = _inside(lines, shapes, share).groupBy(*PAGE, "line_no").agg(F.min_by("shape", "ord").alias(name))
    return lines.join(paged(hit), [*PAGE, "line_no"], "left")


def closed_boxes(drawings: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Small filled shapes that hold one to three lines: shape, ord, rect."""
    d = drawings.join(paged(pages.select(*PAGE, "width", "height")), PAGE)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fits = F.col("type").isin("f", "fs") & w.between(12, F.col("width") * 0.45) & h.between(8, F.col("height") * 0.15)
    on_page = (F.col("x0") >= -2) & (F.col("y0") >= -2) & (F.col("x1") <= F.col("width") + 2) & (F.col("y1") <= F.col("height") + 2)
    shapes = d.filter(fits & on_page).select(*PAGE, F.format_string("p%d_box%d", F.col("page_index").cast("int"), F.col("drawing_no").cast("int")).alias("shape"), F.col("drawing_no").alias("ord"), box().alias("rect"))
    n = _inside(lines, shapes, BOX_SHARE).groupBy(*PAGE, "shape").count().filter(F.col("count").between(1, 3))
    return shapes.join(paged(n.drop("count")), [*PAGE, "shape"], "left_semi")


def footnote_rule(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """The bottom of the highest thin line, a tenth to a half of the page wide, in the page's lower part."""
    d = drawings.join(paged(pages.select(*PAGE, "width", "height")), PAGE)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    thin = (h <= 2.5) & (h > 0) & (w > 0) & (w / F.col("width")).between(0.10, 0.50) & (F.col("y0") >= F.col("height") * 0.55)
    return d.filter(thin).groupBy(*PAGE).agg(F.min("y1").alias("footnote_top"))


def text_kinds(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with what their kinds ask of the text: text_kind, and furniture_key of those in a margin. After that the text
    need not go along."""
    sized = lines.join(pages.select(*PAGE, F.col("height").alias("_height")).hint("shuffle_hash"), PAGE)
    key = F.when(G.in_margin(F.col("y0"), F.col("y1"), F.col("_height")), X.furniture_key(F.col("text")))
    return sized.select(*[c for c in lines.columns if c not in ("text_kind", "furniture_key")], X.text_kind(F.col("text")).alias("text_kind"), key.alias("furniture_key"))


def classify(lines: DataFrame, tables: DataFrame, boxes: DataFrame, images: DataFrame, footnotes: DataFrame) -> DataFrame:
    """kind, table_id and box_id of each line; the first that holds: in a table, in a box, on a figure, below the
    footnote rule, a table's title, a caption, a paragraph. Where lines have a text_kind, their text is not asked."""
    sorts = (("table_id", tables, TABLE_SHARE), ("box_id", boxes, BOX_SHARE), ("_figure", images, FIGURE_SHARE))
    every = reduce(DataFrame.unionByName, [s.select(*PAGE, F.struct(F.lit(n).alias("sort"), F.col("shape").cast("string").alias("shape")).alias("shape"), F.col("ord").cast("long").alias("ord"), "rect", F.lit(share).alias("share")) for n, s, share in sorts])
    first = [F.min_by("shape.shape", F.when(F.col("shape.sort") == n, F.col("ord"))).alias(n) for n, _, _ in sorts]
    hit = _inside(lines, every, F.col("share")).groupBy(*PAGE, "line_no").agg(*first)
    out = lines.join(paged(hit), [*PAGE, "line_no"], "left").join(paged(footnotes), PAGE, "left")
    by_text = F.col("text_kind") if "text_kind" in lines.columns else X.text_kind(F.col("text"))
    kind = F.when(F.col("table_id").isNotNull(), "table_cell").when(F.col("box_id").isNotNull() | F.col("_figure").isNotNull(), "figure_label").when(F.col("y0") >= F.col("footnote_top"), "footnote").otherwise(by_text)
    return out.withColumns({"kind": kind, "box_id": F.when(F.col("table_id").isNull(), F.col("box_id"))}).drop("_figure", "footnote_top")


def mark_furniture(lines: DataFrame, pages: DataFrame, least: int = 3) -> DataFrame:
    """Lines in the margin whose text, without digits, recurs in margins of `least` pages become page furniture,
    whatever they were, in documents of that many pages. table_id stays as it was."""
    n_pages = pages.groupBy("doc_id").agg(F.countDistinct("page_index").alias("_pages")).filter(F.col("_pages") >= least)
    keyed = (lines if "furniture_key" in lines.columns else text_kinds(lines, pages)).withColumnRenamed("furniture_key", "_key")
    often = keyed.filter("_key <> ''").groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_often")).agg(F.countDistinct("page_index").alias("_n")).filter(F.col("_n") >= least)
    often = often.join(paged(n_pages), F.col("_doc") == F.col("doc_id"), "left_semi")
    hit = keyed.join(paged(often), (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_often")), "left").withColumnRenamed("_key", "furniture_key")
    return hit.withColumn("kind", F.when(F.col("_often").isNotNull(), "page_furniture").otherwise(F.col("kind"))).select(*lines.columns)


def dominant_size(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """The size that most text of each page has (the first seen of equals), of body text if there is any."""
    body = F.col("kind").isin("paragraph", "list_item", "heading")
    n = chars(lines)
    w = lines.groupBy(*keys, "size").agg(F.sum(n).alias("all"), F.sum(F.when(body, n)).alias("body"), F.min("line_no").alias("seq"), F.min(F.when(body, F.col("line_no"))).alias("body_seq"))
    best = w.groupBy(*keys).agg(F.max_by("size", F.struct("body", -F.col("body_seq"))).alias("b"), F.max("body").alias("n"), F.max_by("size", F.struct("all", -F.col("seq"))).alias("a"))
    return best.select(*keys, F.when(F.col("n").isNotNull(), F.col("b")).otherwise(F.col("a")).alias("body_size"))


def main_style(lines: Column, chars=lambda x: F.length(x["text"])) -> Column:
    """Of an array of lines (style, text, ...) the style that most text has, the first seen of equals."""
    styles = F.array_distinct(F.transform(lines, lambda x: x["style"]))
    weight = lambda s: F.aggregate(F.filter(lines, lambda x: x["style"] == s), F.lit(0), lambda a, x: a + chars(x))
    return F.array_max(F.transform(styles, lambda s, i: F.struct(weight(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]


def dominant_style(lines: DataFrame, keys: list[str], seq: str) -> DataFrame:
    w = lines.groupBy(*keys, *STYLE).agg(F.sum(F.length("text")).alias("n"), F.min(seq).alias("seq"))
    return w.groupBy(*keys).agg(F.max_by(F.struct(*STYLE), F.struct("n", -F.col("seq"))).alias("style"))


# ---- columns and reading order ------------------------------------------------------------------


def assign_columns(lines: DataFrame) -> DataFrame:
    """column of each line: across the page if it is wide, else by its middle."""
    w = Window.partitionBy(*PAGE)
    body = F.col("kind") != "table_cell"
    left, right = F.min(F.when(body, F.col("x0"))).over(w), F.max(F.when(body, F.col("x1"))).over(w)
    marked = lines.withColumns({"_l": left, "_r": right})
    wide = F.col("x1") - F.col("x0") >= F.greatest(F.col("_r") - F.col("_l"), F.lit(1.0)) * SPAN_SHARE
    side = F.when((F.col("x0") + F.col("x1")) / 2 < (F.col("_l") + F.col("_r")) / 2, LEFT).otherwise(RIGHT)
    return marked.withColumn("column", F.when(F.col("_l").isNull() | wide, SPAN).otherwise(side)).drop("_l", "_r")


def column_bounds(lines: DataFrame) -> DataFrame:
    """The edges of each column that enough of its lines share; the left column ends 4 before the right one."""
    flows = ~F.col("kind").isin(*NOT_BODY)
    pick = lambda c: F.collect_list(F.when(flows, F.col(c)))
    g = lines.groupBy(*PAGE, "column").agg(*[pick(c).alias(f"f{c}") for c in ("x0", "x1")], *[F.collect_list(c).alias(f"a{c}") for c in ("x0", "x1")])
    g = g.withColumns({c: F.when(F.size(f"f{c}") > 0, F.col(f"f{c}")).otherwise(F.col(f"a{c}")) for c in ("x0", "x1")})
    least = F.greatest(F.lit(2), F.bround(F.size("x0") * 0.15).cast("int"))
    edges = g.select(*PAGE, "column", G.repeated_edge(F.col("x0"), least, True).alias("left"), G.repeated_edge(F.col("x1"), least, False).alias("right"))
    other = F.min(F.when(F.col("column") == RIGHT, F.col("left"))).over(Window.partitionBy(*PAGE))
    return edges.withColumn("right", F.when((F.col("column") == LEFT) & other.isNotNull(), F.least("right", other - 4.0)).otherwise(F.col("right")))


def reading_order(lines: DataFrame) -> DataFrame:
    """read_no (from 1) of body lines: those across the page cut it into bands; within a band left comes before right.
    What stands outside the body (cells, labels) cuts nothing and is left out."""
    lines = lines.filter(~F.col("kind").isin(*NOT_BODY))
    across = (F.col("column") == SPAN).cast("int")
    key = [order_y(), F.col("x0"), F.col("line_no")]
    by_place = Window.partitionBy(*PAGE).orderBy(*key)
    banded = lines.withColumn("_band", F.sum(across).over(by_place))
    # A line across opens its band, so it comes before what follows it.
    rank = Window.partitionBy(*PAGE).orderBy("_band", F.when(F.col("column") == SPAN, -1).otherwise(F.col("column")), *key)
    return banded.withColumn("read_no", F.row_number().over(rank)).drop("_band")


# ---- blocks -------------------------------------------------------------------------------------


def signs(lines: DataFrame) -> DataFrame:
    """lines with bullet and ends (a sentence): what their grouping asks of the text, which need not go along then."""
    return lines.withColumns({"bullet": X.is_bullet(F.col("text")), "ends": X.ends_sentence(F.col("text"))})


def all_signs(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with all that kinds, groups, blocks and links ask of the text, and line_id, a number by which it is found again,
    once it is written. Each line has a letter, as make_lines leaves them, so a block starts as its first line does and ends
    as its last one."""
    asked = {"lower": X.starts_lower(F.col("text")), "chars": F.length("text"), "line_id": F.monotonically_increasing_id()}
    return signs(text_kinds(lines, pages)).withColumns(asked)


def with_texts(units: DataFrame, lines: DataFrame) -> DataFrame:
    """units (doc_id, seq, said) with text: their lines' as running text. Where it is not asked for, lines are not read."""
    places = units.select("doc_id", "seq", F.posexplode("said").alias("_n", "line_id"))
    each = lines.select("doc_id", "line_id", "text").join(paged(places), ["doc_id", "line_id"])
    texts = each.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_t"))
    return units.join(paged(texts), ["doc_id", "seq"], "left").withColumn("text", X.join_lines(F.transform("_t", lambda x: x["text"]))).drop("said", "_t")


def breaks(w) -> Column:
    """Whether a line (with its signs, and its column's bounds as left and right) starts a new group after the line before."""
    prev = lambda c: F.lag(c).over(w)
    gap = F.col("y0") - prev("y1")
    short = prev("x1") < F.coalesce(prev("right"), prev("x1")) - 2.5
    indented = F.col("x0") > F.coalesce(F.col("left"), F.col("x0")) + 5.0
    return (
        prev("kind").isNull()
        | (prev("kind") != F.col("kind"))
        | prev("kind").isin("page_furniture", "figure_label")
        | (prev("column") != F.col("column"))
        | ~G.style_compatible(prev("size"), prev("color"), F.col("size"), F.col("color"))
        | F.col("bullet")
        | (gap > 0.85 * F.greatest(prev("size"), F.lit(1.0)))
        | (gap < -prev("size"))
        | (prev("ends") & (short | indented))
    )


def group_lines(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """group_no (from 1) of each body line (with read_no and column): lines in reading order until a break. The signs of
    lines are taken as they are, if they have them."""
    columns = [c for c in lines.columns if c not in PAGE and c != "column"]
    lines = lines if {"bullet", "ends"} <= set(lines.columns) else signs(lines)
    b = bounds.select(*PAGE, "column", "left", "right")
    placed = lines.filter(~F.col("kind").isin(*NOT_BODY)).join(paged(b), [*PAGE, "column"], "left")
    w = Window.partitionBy(*PAGE).orderBy("read_no")
    return placed.withColumn("_new", F.coalesce(breaks(w), F.lit(True)).cast("int")).withColumn("group_no", F.sum("_new").over(w)).select(*PAGE, "column", *columns, "left", "right", "group_no")


def refine_kind(kind: Column, bullet: Column, ends: Column, size: Column, bold: Column, body_size: Column, n: Column) -> Column:
    """bullet of the block's first line, ends (a sentence) of its last one."""
    big = size >= body_size * 1.12
    head = (big | (bold & (n <= 3))) & (n <= 3) & (~ends | big)
    return F.when(kind != "paragraph", kind).when(bullet, "list_item").when(head, "heading").otherwise("paragraph")


def alignment(kind: Column, lines: Column, left: Column, right: Column) -> Column:
    """lines: array of rectangles in order."""
    n = F.size(lines)
    body, rest = F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0)))
    flush = F.forall(body, lambda r: F.abs(right - r["x1"]) <= 2.5) & F.forall(rest, lambda r: F.abs(r["x0"] - left) <= 2.5)
    center = F.forall(lines, lambda r: (F.abs((r["x0"] + r["x1"]) / 2 - (left + right) / 2) <= 3.0) & (r["x0"] - left > 8.0))
    return F.when(kind.isin(*NOT_BODY), ALIGN_LEFT).when((n >= 2) & flush & kind.isin(*FLOWING), ALIGN_JUSTIFY).when(center, ALIGN_CENTER).otherwise(ALIGN_LEFT)


def line_boxes(lines: DataFrame) -> DataFrame:
    """What lines occupy: owner and rect."""
    return lines.select(*PAGE, X.line_owner(F.col("page_index"), F.col("line_no")).alias("owner"), box().alias("rect"))


def make_blocks(grouped: DataFrame, pages: DataFrame, body_sizes: DataFrame, occupied: DataFrame) -> DataFrame:
    """Blocks of grouped lines (group_no, left, right): kind, text, style, flow rectangle, alignment, free bottom, and how
    far the right is free. Lines
    without text, but with all its signs, make blocks with `said`, and with the signs that their links ask for."""
    whole = "text" in grouped.columns
    asked = ["text"] if whole else ["line_id", "chars", "bullet", "ends", "lower"]
    row = F.struct("read_no", *asked, box().alias("rect"), "size", "bold", F.struct(*STYLE).alias("style"))
    keys = [*PAGE, "group_no"]
    g = grouped.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("l"), F.min_by("kind", "read_no").alias("kind0"), F.min_by("left", "read_no").alias("left"), F.min_by("right", "read_no").alias("right"))
    g = g.withColumn("style", main_style(F.col("l")) if whole else main_style(F.col("l"), lambda x: x["chars"])).join(paged(pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height"))), PAGE).join(paged(body_sizes), PAGE, "left")
    rects = F.transform("l", lambda x: x["rect"])
    first, last = F.element_at("l", 1), F.element_at("l", -1)
    said = {"text": X.join_lines(F.transform("l", lambda x: x["text"]))} if whole else {"said": F.transform("l", lambda x: x["line_id"]), "ends": last["ends"], "lower": first["lower"]}
    bullet, ends = (X.is_bullet(first["text"]), X.ends_sentence(last["text"])) if whole else (first["bullet"], last["ends"])
    b = g.withColumns({"block_no": F.col("group_no"), "own": rects, "n": F.size("l"), **said, "size0": first["size"], "left": F.coalesce("left", first["rect"]["x0"]), "right": F.coalesce("right", first["rect"]["x1"])})
    b = b.withColumns({"kind": refine_kind(F.col("kind0"), bullet, ends, first["size"], first["bold"], F.coalesce("body_size", F.lit(10.0)), F.col("n")), "line_height": G.line_height(first["rect"]["y0"], last["rect"]["y0"], F.col("n"), first["size"])})
    lo = lambda c: F.array_min(F.transform("own", lambda r: r[c]))
    hi = lambda c: F.array_max(F.transform("own", lambda r: r[c]))
    x0 = F.when(F.col("kind").isin(*FLOWING), F.least(lo("x0"), F.col("left"))).otherwise(lo("x0"))
    b = b.withColumn("ink", F.struct(x0.alias("x0"), (lo("y0") - 1.0).alias("y0"), F.greatest(F.col("right"), hi("x1")).alias("x1"), (hi("y1") + 1.0).alias("y1")))
    # What goes on is what is asked for, as all of it passes through Python.
    b = b.withColumn("block_id", X.block_id(F.col("page_index"), first["rect"]["x0"], first["rect"]["y0"], F.col("n"))).drop("l", "kind0", "body_size")
    b = room(b, occupied).withColumn("rect", F.struct(F.col("fit_x0").alias("x0"), F.col("ink.y0").alias("y0"), F.col("fit_x1").alias("x1"), F.col("ink.y1").alias("y1")))
    flow = G.flow_rect(F.col("rect"), F.col("n"), F.col("size0"), F.col("line_height"), F.col("free_top"), F.col("free_bottom"))
    return b.select(*PAGE, "block_no", "block_id", "kind", *said, "style", flow.alias("rect"), F.col("free_bottom").alias("max_bottom"), "page_height", alignment(F.col("kind"), F.col("own"), F.col("left"), F.col("right")).alias("align"), F.col("n").alias("line_count"), "line_height", F.col("own").alias("line_rects"), "right_limit")


def boxed_labels(lines: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """One label for each box: its lines' text, set within the box; centred if the gaps on both sides are alike."""
    own = lines.filter((F.col("kind") == "figure_label") & F.col("box_id").isNotNull())
    whole = "text" in own.columns
    g = own.groupBy(*PAGE, "box_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "line_no", *(["text"] if whole else ["line_id", "chars"]), "size", box().alias("rect"), F.struct(*STYLE).alias("style")))).alias("l"), F.min("x0").alias("lx0"), F.max("x1").alias("lx1"), F.max("y0").alias("last_y0"), F.min("y0").alias("first_y0"))
    j = g.join(paged(boxes.select(*PAGE, F.col("shape").alias("box_id"), F.col("rect").alias("b"))), [*PAGE, "box_id"]).join(paged(pages.select(*PAGE, F.col("height").alias("page_height"))), PAGE)
    centered = F.abs((F.col("lx0") - F.col("b.x0")) - (F.col("b.x1") - F.col("lx1"))) <= 4.0
    rect = F.struct(F.when(centered, F.col("b.x0") + 1.5).otherwise(F.col("lx0") - 1.0).alias("x0"), (F.col("b.y0") + 1.0).alias("y0"), (F.col("b.x1") - 1.5).alias("x1"), (F.col("b.y1") - 1.0).alias("y1"))
    said = X.join_lines(F.transform("l", lambda x: x["text"])).alias("text") if whole else F.transform("l", lambda x: x["line_id"]).alias("said")
    style = main_style(F.col("l")) if whole else main_style(F.col("l"), lambda x: x["chars"])
    return j.select(*PAGE, F.col("box_id").alias("block_id"), F.lit("figure_label").alias("kind"), said, style.alias("style"), rect.alias("rect"), (F.col("b.y1") - 1.0).alias("max_bottom"), "page_height", F.transform("l", lambda x: x["rect"]).alias("line_rects"), F.when(centered, ALIGN_CENTER).otherwise(ALIGN_LEFT).alias("align"), F.size("l").alias("line_count"), G.line_height(F.col("first_y0"), F.col("last_y0"), F.size("l"), F.element_at("l", 1)["size"]).alias("line_height"))


def widened(rect: Column, right_limit: Column) -> Column:
    """A loose label's box, up to 60 % wider to the right where nothing stands."""
    return F.struct(rect["x0"].alias("x0"), rect["y0"].alias("y0"), F.greatest(F.least(rect["x1"] + (rect["x1"] - rect["x0"]) * 0.6, right_limit), rect["x1"]).alias("x1"), rect["y1"].alias("y1"))


def link_blocks(blocks: DataFrame) -> DataFrame:
    """head: the (page_index, block_no) of the block that each one continues, itself if none.

    A flowing block goes on in the next flowing one if that has its kind and its chain's style, starts in lower
    case after an open sentence, and stands in the next column after the foot of this one, or at the head of
    the next page. What does not flow lies between without breaking it. A document's blocks stream by in order."""
    flows = blocks.filter(F.col("kind").isin(*FLOWING))
    signs = {"ends": F.col("ends"), "lower": F.col("lower")} if told(blocks) == "said" else {"ends": X.ends_sentence(F.col("text")), "lower": X.starts_lower(F.col("text"))}
    row = {"size": F.col("style.size"), "color": F.col("style.color"), **signs, "x0": F.col("rect.x0"), "x1": F.col("rect.x1"), "tail": G.at_tail(F.col("rect"), F.col("page_height")), "top": G.at_head(F.col("rect"), F.col("page_height"))}

    def step(state, page, kind, size, color, ends, lower, x0, x1, tail, top):
        chain, last_page, last_kind, chain_size, chain_color, open_foot, last_x1 = state
        goes_on = kind == last_kind and open_foot and lower and color == chain_color and size is not None and chain_size is not None and abs(chain_size - size) <= 0.6
        if goes_on:
            goes_on = x0 > last_x1 - 1.0 if page == last_page else page == last_page + 1 and top
        if not goes_on:
            chain, chain_size, chain_color = chain + 1, size, color
        return (chain, page, kind, chain_size, chain_color, ends is False and tail, x1), chain

    inputs = ["page_index", "kind", *row]
    thin = flows.select("doc_id", "page_index", "block_no", "kind", *[c.alias(n) for n, c in row.items()])
    chained = fold(thin, ["doc_id"], ["page_index", "block_no"], inputs, (0, None, None, None, None, False, None), step, T.StructField("_chain", T.LongType()))
    place = F.struct(F.col("page_index").cast("int").alias("page_index"), F.col("block_no").cast("bigint").alias("block_no"))
    heads = chained.select("doc_id", "page_index", "block_no", F.min(place).over(Window.partitionBy("doc_id", "_chain")).alias("head"))
    return blocks.join(paged(heads), ["doc_id", "page_index", "block_no"], "left").withColumn("head", F.coalesce("head", place))


def merge_linked(linked: DataFrame) -> DataFrame:
    """One row for each chain: text joined across its parts, areas, line_rects and line count; id, kind, style, alignment
    and line height are the first part's. block_no is the first part's on its page."""
    part = F.struct("page_index", "block_no", told(linked), "rect", "max_bottom", "page_height", "line_count", "line_rects", "block_id", "kind", "style", "align", "line_height")
    g = linked.groupBy("doc_id", "head").agg(F.array_sort(F.collect_list(part)).alias("p"))
    first = lambda c: F.element_at("p", 1)[c].alias(c)
    areas = F.transform("p", lambda x: F.struct(x["page_index"].alias("page_index"), x["rect"].alias("rect"), x["max_bottom"].alias("max_bottom"), x["page_height"].alias("page_height")))
    rects = F.flatten(F.transform("p", lambda x: F.transform(x["line_rects"], lambda r: F.struct(x["page_index"].alias("page_index"), r.alias("rect")))))
    each = F.transform("p", lambda x: x[told(linked)])
    said = X.join_lines(each).alias("text") if told(linked) == "text" else F.flatten(each).alias("said")
    return g.select("doc_id", F.col("head.page_index").alias("page_index"), F.col("head.block_no").alias("block_no"), *map(first, ("block_id", "kind")), said, first("style"), areas.alias("areas"), rects.alias("line_rects"), first("align"), F.aggregate("p", F.lit(0), lambda a, x: a + x["line_count"]).alias("line_count"), first("line_height"))
