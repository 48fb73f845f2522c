"""What is free around blocks: a sweep over a page's rectangles in order of height.

Blocks and what else stands on their pages stream by in order of page. Small pages are compared pair by pair, many at
once. On a large one the rectangles are sorted by their tops and by their bottoms, so that a block looks only at those of
its own height, or at those next above and below it, in growing steps until one is in its way: a page of many thousand
rectangles is no square of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.folds import starts, whole_groups

PAGE = ["doc_id", "page_index"]
SIDES = ("x0", "y0", "x1", "y1")
#: Rectangles of the first step, which doubles.
STEP = 64
#: The most rectangles of a page that is compared pair by pair, and the pairs that are compared at a time.
SMALL, PAIRS = 512, 1 << 19
Rect = tuple[float, float, float, float]


class Occupied:
    """A page's rectangles: `lines` says which ones are of lines."""

    def __init__(self, rects: np.ndarray, lines: np.ndarray) -> None:
        down, up = np.argsort(rects[:, 1], kind="stable"), np.argsort(-rects[:, 3], kind="stable")
        self.down, self.up = rects[down], rects[up] * [1, -1, 1, -1]  # upwards is downwards on a page upside down
        self.lines = lines[down]
        self.tops, self.bottoms = self.down[:, 1].copy(), self.up[:, 3].copy()
        self.tallest = float((rects[:, 3] - rects[:, 1]).max(initial=0.0))

    def _next(self, rects: np.ndarray, edges: np.ndarray, sign: int, x0: float, x1: float, start: float, own: set[Rect], least: float) -> float | None:
        """The first edge from start on of a rectangle that shares at least `least` of the narrower width."""
        at, step = int(np.searchsorted(edges, start)), STEP
        while at < len(edges):
            some = rects[at : at + step]
            narrow = np.minimum(x1 - x0, some[:, 2] - some[:, 0])
            shared = np.minimum(x1, some[:, 2]) - np.maximum(x0, some[:, 0])
            share = np.divide(shared, narrow, out=np.zeros(len(some)), where=narrow > 0)
            for k in np.flatnonzero(share >= least).tolist():
                a, b, c, d = some[k].tolist()
                if (a, sign * b, c, sign * d) not in own:
                    return float(edges[at + k])
            at, step = at + step, step * 2
        return None

    def below(self, rect: Rect, own: set[Rect], least: float) -> float | None:
        return self._next(self.down, self.tops, 1, rect[0], rect[2], rect[3] - 1.0, own, least)

    def above(self, rect: Rect, own: set[Rect], least: float) -> float | None:
        found = self._next(self.up, self.bottoms, -1, rect[0], rect[2], -(rect[1] + 1.0), own, least)
        return None if found is None else -found

    def beside(self, rect: Rect, own: set[Rect]) -> tuple[float | None, float | None]:
        """The right edge of the nearest line on the left, and the left edge of that on the right, at the same height."""
        x0, top, x1, bottom = rect
        lo, hi = np.searchsorted(self.tops, [top - self.tallest - 1e-6, bottom])
        some = self.down[lo:hi]
        level = self.lines[lo:hi] & (some[:, 3] > top)
        ends = []
        for way, side in ((level & (some[:, 2] <= x0), 2), (level & (some[:, 2] > x0) & (some[:, 0] >= x1), 0)):
            values = np.where(way, some[:, side] if side else -some[:, side], -np.inf)
            best = None
            while len(values) and np.isfinite(values[k := int(values.argmax())]):
                if tuple(some[k].tolist()) not in own:
                    best = float(some[k, side])
                    break
                values[k] = -np.inf
            ends.append(best)
        return ends[0], ends[1]


class Crowd:
    """The rectangles of many pages, and the blocks that look around among them. On pages of up to SMALL rectangles all
    pairs are compared, many pages at once; a page that holds more is swept by itself."""

    def __init__(self, rects: np.ndarray, lines: np.ndarray, rect_pages: np.ndarray, own: np.ndarray, owners: np.ndarray, block_pages: np.ndarray) -> None:
        self.rects, self.lines = rects, lines
        n, self.of = int(max(rect_pages.max(initial=-1), block_pages.max(initial=-1))) + 1, block_pages
        counts = np.bincount(rect_pages, minlength=n)
        first = np.concatenate([[0], np.cumsum(counts)])
        self.start, self.seen = first[block_pages], np.where(counts > SMALL, 0, counts)[block_pages]
        # A block's own rectangles, found again by the numbers of equal ones.
        number = _numbered(np.concatenate([rects, own]) + 0.0)
        self.number, self.kinds = number[: len(rects)], len(number) + 1
        self.own = np.unique(owners * self.kinds + number[len(rects) :])
        at = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(block_pages)))])
        box = [f.reduceat(own[:, c], at[:-1]) if len(own) else own[:, c] for f, c in ((np.minimum, 0), (np.minimum, 1), (np.maximum, 2), (np.maximum, 3))]
        self.boxes = np.stack(box, axis=1)
        self.large = []
        for p in np.flatnonzero(counts > SMALL).tolist():
            some = slice(first[p], first[p + 1])
            mine = [(b, {tuple(r) for r in own[at[b] : at[b + 1]].tolist()}) for b in np.flatnonzero(block_pages == p).tolist()]
            self.large.append((Occupied(rects[some], lines[some]), mine))

    def _nearest(self, test, value) -> np.ndarray:
        """Of each block the least value(rectangles) of those of its page for which test(blocks, rectangles) holds and that
        are not its own; infinite if there are none."""
        out, total = np.full(len(self.of), np.inf), np.cumsum(self.seen)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
            some = lo + np.flatnonzero(self.seen[lo:hi])
            begin = np.concatenate([[0], np.cumsum(self.seen[some])])
            b = np.repeat(some, self.seen[some])
            r = np.arange(begin[-1]) + np.repeat(self.start[some] - begin[:-1], self.seen[some])
            k = np.flatnonzero(test(b, r))
            key = b[k] * self.kinds + self.number[r[k]]
            k = k[self.own[np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)] != key]
            best = np.full(begin[-1], np.inf)
            best[k] = value(r[k])
            if len(some):
                out[some] = np.minimum.reduceat(best, begin[:-1])
            lo = hi
        return out

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """As of Occupied, of each block's lines; infinite where nothing stands."""
        x0, top, x1, bottom = self.boxes.T
        level = lambda b, r: self.lines[r] & (self.rects[r, 3] > top[b]) & (self.rects[r, 1] < bottom[b])
        left = -self._nearest(lambda b, r: level(b, r) & (self.rects[r, 2] <= x0[b]), lambda r: -self.rects[r, 2])
        right = self._nearest(lambda b, r: level(b, r) & (self.rects[r, 2] > x0[b]) & (self.rects[r, 0] >= x1[b]), lambda r: self.rects[r, 0])
        for page, mine in self.large:
            for b, own in mine:
                a, z = page.beside(tuple(self.boxes[b].tolist()), own)
                left[b], right[b] = -np.inf if a is None else a, np.inf if z is None else z
        return left, right

    def stacked(self, rects: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The edges next above and below each block's rectangle; infinite where nothing stands."""
        x0, y0, x1, y1 = rects.T

        def shares(b, r):
            there = self.rects[r]
            narrow, shared = np.minimum(x1[b] - x0[b], there[:, 2] - there[:, 0]), np.minimum(x1[b], there[:, 2]) - np.maximum(x0[b], there[:, 0])
            return np.divide(shared, narrow, out=np.zeros(len(r)), where=narrow > 0) >= least

        above = -self._nearest(lambda b, r: (-self.rects[r, 3] >= -(y0[b] + 1.0)) & shares(b, r), lambda r: -self.rects[r, 3])
        below = self._nearest(lambda b, r: (self.rects[r, 1] >= y1[b] - 1.0) & shares(b, r), lambda r: self.rects[r, 1])
        for page, mine in self.large:
            for b, own in mine:
                rect = tuple(rects[b].tolist())
                a, z = page.above(rect, own, least), page.below(rect, own, least)
                above[b], below[b] = -np.inf if a is None else a, np.inf if z is None else z
        return above, below


def _numbered(rects: np.ndarray) -> np.ndarray:
    """A number for each rectangle, the same for equal ones."""
    order = np.lexsort(rects.T)
    some = rects[order]
    new = np.ones(len(some), np.int64)
    new[1:] = (some[1:] != some[:-1]).any(axis=1)
    out = np.empty(len(some), np.int64)
    out[order] = np.cumsum(new)
    return out


def _boxes(column) -> np.ndarray:
    """Rectangles of an Arrow array of structs."""
    return np.stack([column.field(s).to_numpy(zero_copy_only=False).astype(float) for s in SIDES], axis=1) if len(column) else np.zeros((0, 4))


def _swept(blocks: DataFrame, occupied: DataFrame, names: list[str], around) -> DataFrame:
    """blocks with doubles `names`: what around(crowd, blocks) says of the blocks of many pages.

    Blocks and what stands on their pages stream by together, ordered by page, so that a page costs no call of its own."""
    columns = blocks.columns
    schema = T.StructType([*blocks.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def sweep(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for table in whole_groups(batches, PAGE):
            page = np.cumsum(starts(table, PAGE)) - 1
            rect, row = (table.column(c).combine_chunks() for c in ("_rect", "_row"))
            is_block = pc.is_valid(row).to_numpy(zero_copy_only=False).astype(bool)
            if not is_block.any():
                continue
            stands, mine = pa.array(~is_block), pa.array(is_block)
            left = row.filter(mine)
            left = pa.RecordBatch.from_arrays([left.field(i) for i in range(left.type.num_fields)], names=columns)
            own = left.column("own")
            sizes = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
            lines = table.column("_line").filter(stands).to_numpy().astype(bool)
            crowd = Crowd(_boxes(rect.filter(stands)), lines, page[~is_block], _boxes(own.flatten()), np.repeat(np.arange(len(sizes)), sizes), page[is_block])
            found = around(crowd, left)
            yield pa.RecordBatch.from_arrays([*left.columns, *[pa.array(v, pa.float64()) for v in found]], names=schema.names)

    row = F.struct(*columns)
    here = blocks.select(*PAGE, row.alias("_row"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("_rect"), F.lit(None).cast("boolean").alias("_line"))
    there = occupied.select(*PAGE, F.lit(None).cast(here.schema["_row"].dataType).alias("_row"), F.col("rect").alias("_rect"), F.startswith("owner", F.lit("line")).alias("_line"))
    both = here.unionByName(there).repartition(*PAGE).sortWithinPartitions(*PAGE)
    return both.mapInArrow(sweep, schema)


def _doubles(blocks, name: str) -> np.ndarray:
    return blocks.column(name).to_numpy(zero_copy_only=False).astype(float)


def _sides(crowd: Crowd, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = crowd.beside()
    return np.maximum(0.0, left + 3.0), np.minimum(width, right - 3.0)


def _heights(crowd: Crowd, rects: np.ndarray, height: np.ndarray, least: float, pad: float) -> tuple[np.ndarray, np.ndarray]:
    above, below = crowd.stacked(rects, least)
    bottom = np.minimum(height * 0.97, below - pad)
    return np.maximum(bottom, rects[:, 3]), np.minimum(np.maximum(0.0, above + pad), rects[:, 1])


def horizontal_room(blocks: DataFrame, occupied: DataFrame) -> DataFrame:
    """left_limit and right_limit of blocks (…, own: the lines' rectangles, page_width): 3 from the nearest text at the
    same height on each side."""

    def around(crowd, table):
        return _sides(crowd, _doubles(table, "page_width"))

    return _swept(blocks, occupied, ["left_limit", "right_limit"], around)


def free_space(blocks: DataFrame, occupied: DataFrame, least: float = 0.15, pad: float = 2.0) -> DataFrame:
    """free_bottom and free_top of blocks (…, rect, own, page_height): up to what stands above and below in at least
    15 % of the narrower width, with 2 to spare."""

    def around(crowd, table):
        return _heights(crowd, _boxes(table.column("rect")), _doubles(table, "page_height"), least, pad)

    return _swept(blocks, occupied, ["free_bottom", "free_top"], around)


def room(blocks: DataFrame, occupied: DataFrame, least: float = 0.15, pad: float = 2.0) -> DataFrame:
    """Both for blocks (…, ink, own, page_width, page_height) in one grouping: what is free above and below is that of the
    block's ink once it is fitted between its sides, fit_x0 to fit_x1, though never narrower than its lines. right_limit is
    as of horizontal_room."""

    def around(crowd, table):
        ink, (left, right) = _boxes(table.column("ink")), _sides(crowd, _doubles(table, "page_width"))
        x0 = np.minimum(np.maximum(ink[:, 0], left), crowd.boxes[:, 0])
        x1 = np.maximum(np.minimum(ink[:, 2], right), crowd.boxes[:, 2])
        return x0, x1, *_heights(crowd, np.stack([x0, ink[:, 1], x1, ink[:, 3]], axis=1), _doubles(table, "page_height"), least, pad), right

    return _swept(blocks, occupied, ["fit_x0", "fit_x1", "free_bottom", "free_top", "right_limit"], around)
