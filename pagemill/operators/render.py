"""Draw plans: what to erase and where translated text goes. Pages are not drawn here: plans are rows.

Widths come from a declared model (em share of a character by class), not from font files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import geometry as G
from pagemill.functions import text as X
from pagemill.operators.layout import BORROWING, PAGE

# Scales of type, and the least size and line height.
SCALES = (1.0, 0.97, 0.94, 0.91, 0.88, 0.85)
LEAST_SIZE, LEAST_LINE = 5.5, 0.95
NARROW, WIDE = "iljtf.,:;'|!()[] ", "mwMW@%"
PLAN = T.StructType([T.StructField("size", T.DoubleType()), T.StructField("line_height", T.DoubleType()), T.StructField("borrowed", T.BooleanType()), T.StructField("chunks", T.ArrayType(T.StringType())), T.StructField("overflow", T.BooleanType())])


def ems(s: str) -> float:
    """The width of a text in ems."""
    return sum(0.3 if c in NARROW else 0.85 if c in WIDE else 0.62 if c.isupper() else 0.5 for c in s)


def text_width(s: str, size: float) -> float:
    return size * ems(s)


def pour(words: list[str], rects: list[tuple[float, float]], size: float, pitch: float, wide: list[float] | None = None) -> tuple[list[str], int]:
    """Words (of ems wide) set line by line into boxes (width, height) in turn; the text of each box and how many words
    fit."""
    wide = [ems(w) for w in words] if wide is None else wide
    blank = text_width(" ", size)
    out, at = [], 0
    for w, h in rects:
        start, rows = at, max(int((h + 1e-6) // (pitch * size)), 0)
        for _ in range(rows):
            x, first = 0.0, True
            while at < len(words):
                more = size * wide[at] + (0 if first else blank)
                if x + more > w + 1e-6:
                    break
                x, first, at = x + more, False, at + 1
            if at >= len(words) or first:
                break
        out.append(" ".join(words[start:at]))
    return out, at


def too_much(n: int, total: float, rects: list[tuple[float, float]], size: float, pitch: float) -> bool:
    """Whether n words of total ems can't fit into boxes however their lines fall: every word and, but for one a line,
    every blank is wider than all lines together."""
    rows = [max(int((h + 1e-6) // (pitch * size)), 0) for _, h in rects]
    most = sum(k * (max(w, 0.0) + 1e-6) for k, (w, _) in zip(rows, rects, strict=True))
    return size * total + text_width(" ", size) * max(n - sum(rows), 0) > most * (1 + 1e-9) + 1e-6


def settings(size: float, line: float, borrows: bool) -> list[tuple[float, float, float, bool]]:
    """What is tried in turn: font size, line pitch it is set at, line height it is drawn at, and whether room below is
    borrowed. Sizes down to 85 % come first, within the boxes and then with what may be borrowed; then half a point
    less at a time, down to LEAST_SIZE."""
    base, ways = max(size, LEAST_SIZE), [False, True][: 1 + borrows]
    tight = lambda share: max(LEAST_LINE, line if share >= 0.99 else line * 0.97)
    near = [(round(base * x, 1), x) for x in SCALES]
    table = [(s, tight(s / max(size, 1.0)), tight(x), way) for way in ways for s, x in near if s >= LEAST_SIZE]
    steps = int((base - LEAST_SIZE) * 2) + 1
    small = sorted({round(max(base - k / 2, LEAST_SIZE), 1) for k in range(1, steps + 1)}, reverse=True)
    return table + [(s, tight(s / max(size, 1.0)), LEAST_LINE, borrows) for s in small]


def fit(text: str, size: float, line: float, areas: list[tuple[float, float, float]], borrows: bool, known: dict[str, float] | None = None) -> tuple:
    """The first of settings() that holds all words; the last one, with the rest in the last box, if none does.
    areas: width, height, height with what may be borrowed. known: ems of words so far, as a word is measured once."""
    words, known = text.split(), {} if known is None else known
    known.update((w, ems(w)) for w in words if w not in known)
    wide = [known[w] for w in words]
    total, tried = sum(wide), settings(size, line, borrows)
    for k, (s, pitch, drawn, way) in enumerate(tried, 1):
        rects = [(w, more if way else h) for w, h, more in areas]
        if k < len(tried) and too_much(len(words), total, rects, s, pitch):
            continue
        chunks, n = pour(words, rects, s, pitch, wide)
        if n == len(words):
            return s, drawn, way, chunks, False
    return s, drawn, way, [*chunks[:-1], " ".join([chunks[-1], *words[n:]]).strip()], True


def draw_plan(blocks: DataFrame) -> DataFrame:
    """Adds plan to blocks (text, kind, size, line_height, areas: array of rect and max_bottom)."""
    areas = F.transform("areas", lambda a: F.struct((a["rect"]["x1"] - a["rect"]["x0"]).alias("w"), (a["rect"]["y1"] - a["rect"]["y0"]).alias("h"), (F.greatest(a["rect"]["y1"], a["max_bottom"]) - a["rect"]["y0"]).alias("more")))

    @F.pandas_udf(PLAN)
    def plan(text, size, line, areas, borrows):
        import pandas as pd

        known: dict[str, float] = {}
        rows = [fit(t or "", float(s), float(h), [(x["w"], x["h"], x["more"]) for x in a], bool(b), known) for t, s, h, a, b in zip(text, size, line, areas, borrows, strict=True)]
        return pd.DataFrame(rows, columns=PLAN.names)

    return blocks.withColumn("plan", plan("text", "size", "line_height", areas, F.col("kind").isin(*BORROWING)))


def blocks_by_page(blocks: DataFrame) -> DataFrame:
    """A block's row for each page that it has an area on; of blocks with one id on one page the last counts."""
    from pyspark.sql.window import Window

    each = blocks.select("*", F.explode("areas").alias("_a")).withColumn("on_page", F.col("_a.page_index")).drop("_a")
    last = Window.partitionBy("doc_id", "on_page", "block_id").orderBy(F.desc("seq"))
    return each.dropDuplicates(["doc_id", "on_page", "block_id", "seq"]).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def erase_boxes(blocks: DataFrame) -> DataFrame:
    """The padded box of each line that a block covers."""
    return blocks.select("doc_id", F.explode("line_rects").alias("l")).select("doc_id", F.col("l.page_index").alias("page_index"), G.padded(F.col("l.rect")).alias("rect"))


def positions(lines: DataFrame) -> DataFrame:
    """Where text stands: text and box to whole points."""
    return lines.filter(F.length(X.strip(F.col("text"))) > 0).select("doc_id", "page_index", "text", *[F.bround(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]).distinct()


def erase_strategy(before: DataFrame, after: DataFrame) -> DataFrame:
    """strategy of each page: redact, or patch where a trial left some text in a place where there was none.

    Texts are told apart by half of their SHA-256, and a page's places of before and after are met in one dealing by page."""
    def places(lines: DataFrame, was: bool) -> DataFrame:
        said = F.when(F.length(X.strip(F.col("text"))) > 0, F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
        return lines.select(*PAGE, said.alias("_said"), *[F.bround(c).cast("long").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], F.lit(was).alias("_was"))

    every = places(before, True).unionByName(places(after, False).filter("_said IS NOT NULL")).repartition(*PAGE)
    each = every.groupBy(*PAGE, "_said", "_x0", "_y0", "_x1", "_y1").agg(F.max("_was").alias("_was"))
    moved = each.groupBy(*PAGE).agg(F.max("_was").alias("_page"), F.min("_was").alias("_all")).filter("_page")
    return moved.select(*PAGE, F.when(F.col("_all"), "redact").otherwise("patch").alias("strategy"))


def background(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The colour that most pixels (keys, seq, red, green, blue) of each box have in steps of 8: the step's middle;
    the first seen of equals."""
    step = lambda c: F.floor(F.col(c) / 8).alias(c)
    n = pixels.select(*keys, "seq", *[step(c) for c in ("red", "green", "blue")]).groupBy(*keys, "red", "green", "blue").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = n.groupBy(*keys).agg(F.max_by(F.struct("red", "green", "blue"), F.struct("n", -F.col("first"))).alias("c"))
    return best.select(*keys, *[((F.col(f"c.{c}") * 8 + 4) / 255.0).alias(c) for c in ("red", "green", "blue")])


def font_for(blocks: DataFrame, fonts: DataFrame) -> DataFrame:
    """font of each block (style, text): that of its style if it has all signs, else the serif one of its weight
    or the fallback if that has what is missing, else its style's. fonts: serif, bold, italic, font, glyphs (a
    string of its signs), fallback."""
    f = fonts.filter("not fallback")
    own = f.select(F.col("serif").alias("_s"), F.col("bold").alias("_b"), F.col("italic").alias("_i"), F.col("font").alias("own"), F.col("glyphs").alias("own_glyphs"))
    serif = f.filter("serif").select(F.col("bold").alias("_b2"), F.col("italic").alias("_i2"), F.col("font").alias("other"), F.col("glyphs").alias("other_glyphs"))
    last = fonts.filter("fallback").select(F.col("font").alias("last"), F.col("glyphs").alias("last_glyphs"))
    j = blocks.join(F.broadcast(own), (F.col("style.serif") == F.col("_s")) & (F.col("style.bold") == F.col("_b")) & (F.col("style.italic") == F.col("_i")), "left")
    j = j.join(F.broadcast(serif), (F.col("style.bold") == F.col("_b2")) & (F.col("style.italic") == F.col("_i2")), "left").join(F.broadcast(last), F.lit(True), "left")  # fonts are a few rows
    signs = lambda c: F.array_distinct(F.split(F.coalesce(c, F.lit("")), ""))
    missing = F.array_except(signs(F.col("text")), signs(F.col("own_glyphs")))
    covers = lambda c: F.size(F.array_except(missing, signs(F.col(c)))) == 0
    return j.withColumn("font", F.when(F.size(missing) == 0, F.col("own")).when(covers("other_glyphs"), F.col("other")).when(covers("last_glyphs"), F.col("last")).otherwise(F.col("own"))).select(*blocks.columns, "font")


def alignment_name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("left", "center", "right", "justify"))), c + 1)
