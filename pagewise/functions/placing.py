"""Layout in numpy, over many whole pages at once: gutters, columns, lines, and what lines are made of.

Boxes come by page and box_idx. A number is its values and where it is null; in sorting nulls go first
and NaN last, and neither is near anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OVERLAP, CENTRE = 0.5, 0.75
BINS, GUTTER, MARGIN = 100, 0.04, 15
FIRST = "_n"

#: What stands for handwriting in text.
MARK = "[handwritten]"
REGION = pa.struct([("idx", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("h", pa.float64())])
CELL = pa.struct([("x", pa.float64()), ("text", pa.string())])
LINE = [("line_no", pa.int32()), ("col_no", pa.int32()), ("text", pa.string()), *[(n, pa.float64()) for n in ("baseline_y", "height", "top", "bottom")], ("n_boxes", pa.int64()), ("confidence", pa.float64()), ("min_confidence", pa.float64())]
LINE_DDL = "line_no:int,col_no:int,text:string,baseline_y:double,height:double,top:double,bottom:double,n_boxes:bigint,confidence:double,min_confidence:double"


class Number:
    def __init__(self, values: np.ndarray, null: np.ndarray):
        self.values, self.null = values, null

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Number:
        c = column.cast(pa.float64()).combine_chunks()
        return cls(np.asarray(c.fill_null(np.nan)), np.asarray(c.is_null()))

    def key(self) -> np.ndarray:
        return np.where(self.null, -np.inf, self.values)


def whole_pages(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """What `work` makes of the pages of each batch. FIRST counts the boxes of a page from 1; a page that a
    batch breaks off waits for its rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(np.asarray(batch.column(batch.schema.get_field_index(FIRST))) == 1)
        if len(starts):
            held.append(batch.slice(0, starts[-1]))
            yield from _made(held, work)
            held = []
            batch = batch.slice(starts[-1])
        held.append(batch)
    yield from _made(held, work)


def _made(held: list[pa.RecordBatch], work: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    if sum(b.num_rows for b in held):
        yield from work(pa.Table.from_batches(held)).combine_chunks().to_batches()


class Pages:
    """The boxes of whole pages: starts, the first row of each page, and page, the page of each row."""

    def __init__(self, table: pa.Table):
        first = np.asarray(table[FIRST]) == 1
        self.table, self.starts, self.page = table, np.flatnonzero(first), np.cumsum(first) - 1
        self.n = len(self.starts)

    def number(self, name: str) -> Number:
        return Number.of(self.table[name])

    def given(self, name: str) -> np.ndarray | None:
        return np.asarray(self.table[name]).astype(np.int64) if name in self.table.column_names else None

    def middles(self) -> Number:
        y, h = self.number("y"), self.number("h")
        return Number(y.values + h.values / 2, y.null | h.null)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(page, boundary): middles of the empty vertical strips in a page's inner bins."""
        x, w, given = self.number("x"), self.number("w"), self.number("page_width")
        width = np.fmax.reduceat(given.values, self.starts)
        wide = (width > 0) & (np.bincount(self.page, minlength=self.n) >= 4)
        with np.errstate(all="ignore"):
            step = np.where(wide, width, 1.0)[self.page] / BINS
            a, z = np.floor(x.values / step), np.ceil((x.values + w.values) / step)
        a, z = (np.clip(np.nan_to_num(v, posinf=BINS, neginf=0), 0, BINS).astype(np.int64) for v in (a, z))
        some = (z > a) & ~x.null & ~w.null
        count = lambda v: np.bincount(self.page[some] * (BINS + 1) + v[some], minlength=self.n * (BINS + 1)).reshape(self.n, BINS + 1)
        full = np.cumsum(count(a) - count(z), axis=1)[:, MARGIN : BINS - MARGIN] > 0
        empty = np.pad(~full & wide[:, None], ((0, 0), (1, 1)))
        # runs of empty bins begin and end where the bin before or after isn't empty
        page, start = np.nonzero(empty[:, 1:-1] & ~empty[:, :-2])
        length = np.nonzero(empty[:, 1:-1] & ~empty[:, 2:])[1] - start + 1
        keep = length >= -(-BINS * GUTTER // 1)
        page, start, length = page[keep], start[keep] + MARGIN, length[keep]
        return page, (start + length // 2) * width[page] / BINS

    def columns(self) -> np.ndarray:
        """The column of each box, counted from 0 over the columns that have boxes."""
        if (known := self.given("col_no")) is not None:
            return known
        page, boundary = self.edges()
        at = np.zeros(len(self.page), np.int64)
        if len(page):
            nth = np.arange(len(page)) - np.searchsorted(page, page)
            table = np.full((self.n, nth.max() + 1), np.inf)
            table[page, nth] = boundary
            x, w = self.number("x"), self.number("w")
            middle = np.where(x.null | w.null, -np.inf, np.where(np.isnan(x.values + w.values), np.inf, x.values + w.values / 2))
            at = (table[self.page] < middle[:, None]).sum(axis=1)
        kinds, which = np.unique(self.page * (BINS + 1) + at, return_inverse=True)
        return which - np.searchsorted(kinds, self.page * (BINS + 1))

    def lines(self, col: np.ndarray) -> np.ndarray:
        """The line of each box within its page: in a column from above, a box joins the one before if
        they share enough of their height and their middles are near."""
        if (known := self.given("line_no")) is not None:
            return known
        y, h, cy = self.number("y"), self.number("h"), self.middles()
        order = np.lexsort((cy.key(), col, self.page))
        page, c, m = self.page[order], col[order], cy.values[order]
        top, high = y.values[order], h.values[order]
        with np.errstate(all="ignore"):
            shorter = np.maximum(np.minimum(high[1:], high[:-1]), 1.0)
            shared = np.minimum((top + high)[1:], (top + high)[:-1]) - np.maximum(top[1:], top[:-1])
            same = (page[1:] == page[:-1]) & (c[1:] == c[:-1]) & (shared >= OVERLAP * shorter) & (np.abs(m[1:] - m[:-1]) <= CENTRE * shorter)
        line = np.cumsum(np.concatenate([[True], ~same]))
        out = np.empty(len(order), np.int64)
        out[order] = line - line[self.starts][page]
        return out

    def places(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by page, line and place from the left, and the first of each line among them."""
        order = np.lexsort((self.middles().key(), self.number("x").key(), line, self.page))
        page, at = self.page[order], line[order]
        return order, np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (at[1:] != at[:-1])]))

    def positions(self, line: np.ndarray) -> np.ndarray:
        order, firsts = self.places(line)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order)))) + 1
        return out

    def told(self, cells: bool) -> pa.Array:
        """The lines of each page, as LINE, with their boxes' texts as CELL if asked for."""
        col = self.columns()
        line = self.lines(col)
        order, firsts = self.places(line)
        sizes = np.diff(np.append(firsts, len(order)))
        y, h, cy, sure = self.number("y"), self.number("h"), self.middles(), self.number("confidence")
        texts = self.table["text"].combine_chunks().take(pa.array(order))
        said = np.asarray(texts.is_valid())
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(said, firsts, dtype=np.int64))])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts.drop_null()), " ")
        known = lambda v: ~np.logical_and.reduceat(v.null[order], firsts)

        def number(values: np.ndarray, ok: np.ndarray) -> pa.Array:
            return pa.array(values, pa.float64(), mask=~ok)

        def mean(v: Number) -> pa.Array:
            n = np.add.reduceat(~v.null[order], firsts, dtype=np.int64)
            return number(np.add.reduceat(np.where(v.null, 0.0, v.values)[order], firsts) / np.maximum(n, 1), n > 0)

        by_height = np.lexsort((h.values[order], h.null[order], np.repeat(np.arange(len(firsts)), sizes)))
        tall = np.add.reduceat(~h.null[order], firsts, dtype=np.int64)
        height = number(h.values[order][by_height][firsts + np.minimum(tall // 2, sizes - 1)], tall > 0)
        low = np.where(y.null | h.null, -np.inf, y.values + h.values)
        bottom = number(np.maximum.reduceat(low[order], firsts), known(Number(low, y.null | h.null)))
        least = np.nan_to_num(np.fmin.reduceat(np.where(sure.null, np.nan, sure.values)[order], firsts), posinf=np.inf, neginf=-np.inf)
        parts = [
            pa.array(line[order][firsts], pa.int32()), pa.array(col[order][firsts], pa.int32()), joined, mean(cy), height, number(np.fmin.reduceat(y.values[order], firsts), known(y)), bottom,
            pa.array(sizes, pa.int64()), mean(sure), pa.array(least, pa.float64()),
        ]
        fields = [pa.field(n, t) for n, t in LINE]
        if cells:
            x = self.number("x")
            at = pa.StructArray.from_arrays([number(x.values[order], ~x.null[order]), texts], fields=[pa.field(f.name, f.type) for f in CELL])
            parts.append(pa.ListArray.from_arrays(pa.array(np.append(firsts, len(order)), pa.int32()), at))
            fields.append(pa.field("cells", pa.list_(CELL)))
        lines_of_page = np.bincount(self.page[order][firsts], minlength=self.n)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lines_of_page)]), pa.int32()), pa.StructArray.from_arrays(parts, fields=fields))


def beside(table: pa.Table, cells: bool = False) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Of pages whose boxes (kind 0) and regions (kind 1) come as rows together: the first row, the lines and
    the regions of each."""
    first, kind = np.asarray(table[FIRST]) == 1, np.asarray(table["kind"])
    page, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    of = page[kind == 0]
    own = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    only = table.filter(pa.array(kind == 0))
    told = Pages(only.set_column(only.schema.get_field_index(FIRST), FIRST, pa.array(own.astype(np.int32)))).told(cells) if len(of) else None
    sizes = np.zeros(len(starts), np.int64)
    if told is not None:
        sizes[of[own]] = np.diff(np.asarray(told.offsets))
    line = pa.struct([*LINE, *([("cells", pa.list_(CELL))] if cells else [])])
    lines = pa.ListArray.from_arrays(ends(sizes), told.values if told is not None else pa.array([], line))
    marks = table.filter(pa.array(kind == 1))
    rows = pa.StructArray.from_arrays([marks[n].cast(f.type).combine_chunks() for n, f in zip(("box_idx", "x", "y", "h"), REGION, strict=True)], fields=list(REGION))
    return starts, lines, pa.ListArray.from_arrays(ends(np.bincount(page[kind == 1], minlength=len(starts))), rows)


def written(table: pa.Table) -> tuple[np.ndarray, pa.ListArray]:
    """Of pages as in beside(): the first row of each, and its lines with handwriting, as LINE and n_human."""
    starts, lines, regions = beside(table, cells=True)
    n, start, ls, rs = len(starts), np.asarray(lines.offsets), lines.values, regions.values
    number = lambda rows, name: np.asarray(rows.field(name).cast(pa.float64()).fill_null(np.nan))
    line_page, page = (np.repeat(np.arange(n), np.diff(np.asarray(a.offsets))) for a in (lines, regions))
    top, bottom, baseline = (number(ls, c) for c in ("top", "bottom", "baseline_y"))
    idx, x, y, h = (number(rs, c) for c in ("idx", "x", "y", "h"))
    middle = y + h / 2
    # every region with every line of its page
    many = np.diff(start)[page]
    r = np.repeat(np.arange(len(page)), many)
    at = start[page][r] + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
    shared = np.maximum(np.minimum((y + h)[r], bottom[at]) - np.maximum(y[r], top[at]), 0.0)
    part = shared / np.maximum(np.minimum((bottom - top)[at], h[r]), 1.0)
    fits = np.flatnonzero(part >= OVERLAP)
    fits = fits[np.lexsort((at[fits], part[fits]))]
    home, before, lower = np.full(len(page), -1), np.full(len(page), len(ls)), baseline[at] > middle[r]
    home[r[fits]] = at[fits]  # the last of a region's counts
    np.minimum.at(before, r[lower], at[lower])
    alone, joined = np.flatnonzero(home < 0), np.flatnonzero(home >= 0)
    marked, owner = np.unique(home[joined], return_inverse=True)
    # the texts of marked lines anew, with their marks among them
    cells = ls.field("cells")
    ends, flat = np.asarray(cells.offsets), cells.values
    sizes = ends[marked + 1] - ends[marked]
    k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    box = np.repeat(ends[marked], sizes) + k
    where = flat.field("x").take(pa.array(box))
    across = np.concatenate([np.where(np.asarray(where.is_null()), -np.inf, np.asarray(where.fill_null(0))), x[joined]])
    of = np.concatenate([np.repeat(np.arange(len(marked)), sizes), owner])
    order = np.lexsort((np.concatenate([k, idx[joined]]), np.repeat([0, 1], [len(box), len(joined)]), across, of))
    marks = lambda count: pa.array([MARK] * count, pa.string())
    texts = pa.concat_arrays([flat.field("text").take(pa.array(box)), marks(len(joined))]).take(pa.array(order))
    said = np.bincount(of[order][np.asarray(texts.is_valid())], minlength=len(marked))
    anew = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(said)]), pa.int32()), texts.drop_null()), " ")
    text_of = np.arange(len(ls) + len(alone))
    text_of[marked] = len(ls) + np.arange(len(marked))
    text_of[len(ls) :] = len(ls) + len(marked)
    # lines by their place, a region without one before the line below it
    pages = np.concatenate([line_page, page[alone]])
    lie = np.repeat([1, 0], [len(ls), len(alone)])
    order = np.lexsort((np.where(lie, 0, np.concatenate([np.zeros(len(ls)), idx[alone]])), np.concatenate([np.zeros(len(ls)), middle[alone]]), lie, np.concatenate([np.arange(len(ls)), before[alone]]), pages))
    first = np.concatenate([[0], np.cumsum(np.bincount(pages, minlength=n))])
    null, zero = (lambda t: pa.nulls(len(alone), t)), (lambda t: pa.array(np.zeros(len(alone)), t))
    more = {"col_no": null(pa.int32()), "top": null(pa.float64()), "bottom": null(pa.float64()), "baseline_y": pa.array(middle[alone], pa.float64(), from_pandas=True)}
    columns = {name: pa.concat_arrays([ls.field(name), more.get(name, zero(kind))]).take(pa.array(order)) for name, kind in LINE if name not in ("line_no", "text")}
    columns["line_no"] = pa.array(np.arange(len(order)) - first[:-1][pages[order]], pa.int32())
    columns["text"] = pa.concat_arrays([ls.field("text"), anew, marks(1)]).take(pa.array(text_of[order]))
    columns["n_human"] = pa.array(np.concatenate([np.bincount(home[joined], minlength=len(ls)), np.ones(len(alone), np.int64)])[order], pa.int32())
    fields = [*LINE, ("n_human", pa.int32())]
    return starts, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([columns[name] for name, _ in fields], fields=[pa.field(*f) for f in fields]))
