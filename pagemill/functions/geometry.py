"""Rectangle expressions. A rectangle is a struct of doubles x0, y0, x1, y1; y grows downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    of = lambda v: F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*[of(v).cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)])


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def area(r: Column) -> Column:
    return F.greatest(width(r), F.lit(0.0)) * F.greatest(height(r), F.lit(0.0))


def overlap_ratio(inner: Column, outer: Column) -> Column:
    """The share of inner's area that lies in outer; 0 where they don't meet or inner has no area."""
    w = F.least(inner["x1"], outer["x1"]) - F.greatest(inner["x0"], outer["x0"])
    h = F.least(inner["y1"], outer["y1"]) - F.greatest(inner["y0"], outer["y0"])
    return F.when((w > 0) & (h > 0) & (area(inner) > 0), w * h / area(inner)).otherwise(0.0)


def horizontal_share(a: Column, b: Column) -> Column:
    """Horizontal overlap by the narrower width; negative where they lie apart."""
    narrow = F.least(width(a), width(b))
    return F.when(narrow > 0, (F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) / narrow).otherwise(0.0)


def horizontal_overlap(outer: Column, rule: Column) -> Column:
    return F.when(width(rule) > 0, (F.least(rule["x1"], outer["x1"]) - F.greatest(rule["x0"], outer["x0"])) / width(rule)).otherwise(0.0)


def extended(r: Column, max_bottom: Column) -> Column:
    return F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), F.greatest(r["y1"], max_bottom).alias("y1"))


def padded(r: Column, by: float = 0.7) -> Column:
    return F.struct((r["x0"] - by).alias("x0"), (r["y0"] - by).alias("y0"), (r["x1"] + by).alias("x1"), (r["y1"] + by).alias("y1"))


def bleeds(r: Column, page: Column, by: float = 2.0) -> Column:
    return (r["x0"] < page["x0"] - by) | (r["y0"] < page["y0"] - by) | (r["x1"] > page["x1"] + by) | (r["y1"] > page["y1"] + by)


def style_compatible(size_a: Column, color_a: Column, size_b: Column, color_b: Column) -> Column:
    """Running text may turn bold or italic, but keeps size and colour."""
    return (F.abs(size_a - size_b) <= 0.6) & color_a.eqNullSafe(color_b)


def style_matches(a: Column, b: Column) -> Column:
    out = style_compatible(a["size"], a["color"], b["size"], b["color"])
    for f in ("bold", "italic", "serif"):
        out = out & a[f].eqNullSafe(b[f])
    return out


def in_margin(y0: Column, y1: Column, page_height: Column, share: float = 0.12) -> Column:
    return (y0 < page_height * share) | (y1 > page_height * (1 - share))


def at_tail(r: Column, page_height: Column) -> Column:
    return (page_height > 0) & (r["y1"] >= page_height * 0.75)


def at_head(r: Column, page_height: Column) -> Column:
    return (page_height > 0) & (r["y0"] <= page_height * 0.25)


def line_height(first_y0: Column, last_y0: Column, n: Column, size: Column) -> Column:
    pitch = (last_y0 - first_y0) / F.greatest(n - 1, F.lit(1))
    return F.when(n < 2, 1.15).otherwise(F.least(F.greatest(pitch / F.greatest(size, F.lit(1.0)), F.lit(0.95)), F.lit(2.0)))


def flow_rect(ink: Column, n: Column, size: Column, line: Column, free_top: Column, free_bottom: Column) -> Column:
    """The box of n lines of text: ink is short of it by half a leading on both sides, within what is free."""
    pitch = F.greatest(line, F.lit(1.0)) * F.greatest(size, F.lit(1.0))
    lead = F.greatest(F.lit(0.0), pitch - height(ink) / F.greatest(n, F.lit(1))) / 2
    top = F.greatest(ink["y0"] - lead, free_top)
    bottom = F.least(F.greatest(ink["y1"] + lead, top + n * pitch), F.greatest(free_bottom, ink["y1"]))
    return F.struct(ink["x0"].alias("x0"), top.alias("y0"), ink["x1"].alias("x1"), bottom.alias("y1"))


def drawn_line_height(line: Column, scale: Column, least: float = 0.95) -> Column:
    return F.greatest(F.lit(least), F.when(scale >= 0.99, line).otherwise(line * 0.97))


def repeated_edge(values: Column, threshold: Column, prefer_min: bool, within: float = 3.0) -> Column:
    """The edge that enough values share: sorted values form clusters of those within 3 of a cluster's first;
    the least first, or the largest last, of clusters of at least threshold values; else the plain min or max."""
    def close(s: Column) -> Column:
        full = s["n"] >= threshold
        edge = F.when(full, s["first"] if prefer_min else s["last"])
        return F.least(s["best"], edge) if prefer_min else F.greatest(s["best"], edge)

    def state(first, last, n, best):
        return F.struct(first.cast("double").alias("first"), last.cast("double").alias("last"), n.cast("int").alias("n"), best.cast("double").alias("best"))

    def step(s: Column, v: Column) -> Column:
        joins = (s["n"] > 0) & (v - s["first"] <= within)
        return state(F.when(joins, s["first"]).otherwise(v), v, F.when(joins, s["n"] + 1).otherwise(1), F.when(joins | (s["n"] == 0), s["best"]).otherwise(close(s)))

    none = F.lit(None).cast("double")
    plain = F.array_min(values) if prefer_min else F.array_max(values)
    return F.coalesce(F.aggregate(F.array_sort(values), state(none, none, F.lit(0), none), step, close), plain)
