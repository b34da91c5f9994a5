"""Lines and columns of sorted glyphs, paragraphs of sorted lines, for many pages at once.

The functions see whole pages, sorted by y descending, x, glyph_no or line_no.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy()


def _firsts(groups: np.ndarray) -> np.ndarray:
    """Positions where sorted group numbers change."""
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, int)


def line_numbers(table: pa.Table, bounds: np.ndarray) -> np.ndarray:
    """Line of every glyph within its page; ``bounds`` are the first rows of the pages and the number of rows, or without it."""
    y, size = _floats(table, "y"), _floats(table, "size")
    n = len(y)
    first = bounds[bounds < n]
    lengths = np.diff(np.append(first, n))
    largest = np.repeat(np.fmax.reduceat(size, first), lengths)
    starts = np.ones(n, bool)
    starts[1:] = ~(y[:-1] - y[1:] <= np.fmax(2.2, largest[1:] * 0.5))
    starts[first] = True
    bands = np.flatnonzero(starts)
    ends = np.append(bands[1:], n)
    wide = ~(y[bands] - y[ends - 1] <= 2.2) & (ends - bands > 1)
    at, end = bands[wide], ends[wide]
    count, total, opened = np.ones(len(at)), y[at].copy(), size[at].copy()
    at = at + 1
    while len(at):
        tolerance = np.fmax(2.2, np.fmax(opened, size[at]) * 0.5)
        same = np.abs(y[at] - total / count) <= tolerance
        starts[at] = ~same
        count = np.where(same, count + 1, 1)
        total = np.where(same, total + y[at], y[at])
        opened = np.where(same, opened, size[at])
        at = at + 1
        more = at < end
        if not more.all():
            at, end, count, total, opened = at[more], end[more], count[more], total[more], opened[more]
    number = np.cumsum(starts) - 1
    return number - np.repeat(number[first], lengths)


def _most_before(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Largest earlier value of the group, by ranks so that no digit is lost; the first row of a group gets its own."""
    known, rank = np.unique(values, return_inverse=True)
    running = np.maximum.accumulate(groups * len(known) + rank) - groups * len(known)
    out = values.copy()
    later = groups[1:] == groups[:-1]
    out[1:][later] = known[running[:-1][later]]
    return out


def _spaces(g: dict, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Whether groups read from right to left, their reading order if any does, and the glyphs with a space before them.

    Rows come sorted by group, x, y descending, glyph_no.
    """
    first = _firsts(groups)
    lengths = np.diff(np.append(first, len(groups)))
    rtl = np.add.reduceat(np.nan_to_num(g["rtl"]), first) * 2 > lengths
    back = np.repeat(rtl, lengths)
    x, end = g["x"], g["x"] + g["gw"]
    order = None
    if rtl.any():
        order = np.lexsort((g["glyph_no"], -g["y"], np.where(back, -x, x), groups))
        x, end, back = x[order], end[order], back[order]
        gap = np.where(back, -_most_before(-x, groups) - end, x - _most_before(end, groups))
    else:
        gap = x - _most_before(end, groups)

    def read(name):
        return g[name] if order is None else g[name][order]

    per_char = read("gw") / np.maximum(1, read("chars"))
    least = np.maximum(0.8, np.minimum(read("size") * 0.32, per_char * 0.55))
    spaced = ~read("closing") & (gap > least)
    spaced[first] = False
    return rtl, order, spaced


def _pieces(g: dict, values: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Whether groups read from right to left, and their texts; rows as for ``_spaces``."""
    rtl, order, spaced = _spaces(g, groups)
    texts = values if order is None else values.take(pa.array(order))
    texts = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), texts, "")
    offsets = pa.array(np.append(_firsts(groups), len(groups)), pa.int32())
    return rtl, pc.binary_join(pa.ListArray.from_arrays(offsets, texts), "")


def _median_sizes(size: np.ndarray, weight: np.ndarray, groups: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Upper median size of each group, each size counted once per printed character."""
    order = np.lexsort((weight, size, groups))
    running = np.cumsum(weight[order])
    base = np.append(0, running)[first]
    lengths = np.diff(np.append(first, len(groups)))
    total = np.append(running[first[1:] - 1], running[-1]) - base
    hit = running - np.repeat(base, lengths) > np.repeat(total // 2, lengths)
    at = np.minimum.reduceat(np.where(hit, np.arange(len(groups)), len(groups)), first)
    return size[order][at]


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the known values of each group."""
    known = ~np.isnan(values)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.add.reduceat(np.where(known, values, 0.0), first) / np.add.reduceat(known.astype(float), first)


def _flags(values: np.ndarray, first: np.ndarray) -> pa.Array:
    most = np.fmax.reduceat(values, first)
    return pa.array(most == 1, mask=np.isnan(most))


def cell_texts(table: pa.Table, bounds: np.ndarray, keys: list[str]) -> pa.Table | None:
    """Text of each cell, its lines joined by newline, and whether one is bold; visible glyphs as for ``read_lines``, a cell for a page."""
    value = table.column("value")
    chars = pc.utf8_length(value).cast(pa.int32())
    facts = {"chars": chars, "closing": pc.match_substring_regex(value, r"^[,.;:!?%)\]}]"), "w": chars, "italic": pa.nulls(table.num_rows, pa.int32())}
    table = pa.table({**{c: table.column(c) for c in table.column_names}, **facts, **{c: table.column(c).cast(pa.int8()) for c in ("bold", "rtl")}})
    n = table.num_rows
    first = bounds[bounds < n]
    cell = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    found = read_lines(table.append_column("_cell", pa.array(cell)), bounds, [*keys, "_cell"])
    if found is None:
        return None
    first = _firsts(found.column("_cell").to_numpy())
    offsets = pa.array(np.append(first, found.num_rows), pa.int32())
    texts = pc.binary_join(pa.ListArray.from_arrays(offsets, found.column("text").combine_chunks()), "\n")
    out = {k: found.column(k).combine_chunks().take(pa.array(first)) for k in keys}
    return pa.table(out | {"text": texts, "bold": _flags(found.column("bold").cast(pa.int8()).cast(pa.float64()).to_numpy(), first)})


def read_lines(table: pa.Table, bounds: np.ndarray, keys: list[str]) -> pa.Table | None:
    """A1: one row per line with visible text, with its attributes and tokens; lines are found unless ``line_no`` states them."""
    number = table.column("line_no").to_numpy() if "line_no" in table.column_names else line_numbers(table, bounds)
    n = len(number)
    page = np.zeros(n, int)
    page[bounds[(bounds > 0) & (bounds < n)]] = 1
    line = np.concatenate([[0], np.cumsum((np.diff(number) != 0) | (page[1:] == 1))])
    shown = np.flatnonzero(pc.fill_null(pc.not_equal(table.column("value"), ""), False).to_numpy())
    if not len(shown):
        return None
    x, y, glyph = _floats(table, "x"), _floats(table, "y"), table.column("glyph_no").to_numpy()
    order = shown[np.lexsort((glyph[shown], -y[shown], x[shown], line[shown]))]
    line = line[order]
    values = table.column("value").combine_chunks().take(pa.array(order))
    g = {c: _floats(table, c)[order] for c in ("size", "gw", "rtl", "bold", "italic")}
    g |= {"x": x[order], "y": y[order], "glyph_no": glyph[order]}
    g |= {c: table.column(c).to_numpy()[order] for c in ("chars", "w")}
    g["closing"] = table.column("closing").to_numpy()[order].astype(bool)
    first = _firsts(line)
    m = len(order)
    end = g["x"] + g["gw"]
    cut = np.zeros(m, bool)
    cut[1:] = g["x"][1:] - end[:-1] > np.fmax(7.0, np.fmax(g["size"][:-1], g["size"][1:]) * 0.7)
    cut[first] = False
    opens = cut.copy()
    opens[first] = True
    token = np.cumsum(opens) - 1
    token_first = np.flatnonzero(opens)
    rtl, text = _pieces(g, values, line)
    _, token_text = _pieces(g, values, token)
    per_line = np.searchsorted(token_first, first)
    token_no = np.arange(len(token_first)) - np.repeat(per_line, np.diff(np.append(per_line, len(token_first))))
    items = pa.StructArray.from_arrays(
        [pa.array(token_no, pa.int32()), token_text, pa.array(g["x"][token_first]), pa.array(end[np.append(token_first[1:], m) - 1])],
        ["token_no", "text", "x", "x_end"],
    )
    largest, smallest = np.fmax.reduceat(g["size"], first), np.fmin.reduceat(g["size"], first)
    sizes = largest if (largest == smallest).all() else _median_sizes(g["size"], g["w"], line, first)
    mean = _means(g["y"], first)
    rows = pa.array(order[first])
    return pa.table({
        **{k: table.column(k).combine_chunks().take(rows) for k in keys},
        "line_no": pa.array(number[order[first]], pa.int32()), "text": text, "font_size": pa.array(sizes),
        "x": pa.array(g["x"][first]), "x_end": pa.array(end[np.append(first[1:], m) - 1]), "y": pa.array(mean, from_pandas=True),
        "height": pa.array(np.fmax(largest, 11.0)), "bold": _flags(g["bold"], first), "italic": _flags(g["italic"], first),
        "rtl": pa.array(rtl), "tokens": pa.ListArray.from_arrays(pa.array(np.append(per_line, len(token_first)), pa.int32()), items),
    })


def _extreme_before(values: np.ndarray, null: np.ndarray, groups: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Largest or least earlier value of the group and whether there is none; nulls are passed over, NaN is above all numbers."""
    known, rank = np.unique(values, return_inverse=True)  # one NaN, at the end
    rank = np.where(null, 0, rank + 1 if largest else len(known) - rank)
    running = np.maximum.accumulate(groups * (len(known) + 1) + rank) - groups * (len(known) + 1)
    before = np.append(0, running[:-1])
    before[_firsts(groups)] = 0
    return known[np.where(before == 0, 0, before - 1 if largest else len(known) - before)], before == 0


def _known_spaces(table: pa.Table, group: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The reading order if a group reads from right to left, and the glyphs with a space before them, as SQL has it for unknown places and sizes.

    Rows come sorted by group, x, y descending, glyph_no.
    """
    first = _firsts(group)
    lengths = np.diff(np.append(first, len(group)))
    back = np.repeat(np.add.reduceat(np.nan_to_num(_floats(table, "rtl")), first) * 2 > lengths, lengths)
    values = {c: _floats(table, c) for c in ("x", "y", "gw", "size")}
    null = {c: table.column(c).is_null().to_numpy() for c in values}
    order = None
    if back.any():

        def odd(c):
            return np.where(null[c], -1, np.isnan(values[c]))

        x, y = np.nan_to_num(values["x"]), np.nan_to_num(values["y"])
        order = np.lexsort((table.column("glyph_no").to_numpy(), -y, -odd("y"), np.where(back, -x, x), odd("x"), group))
        back = back[order]
        values, null = {c: v[order] for c, v in values.items()}, {c: v[order] for c, v in null.items()}
        table = table.combine_chunks().take(pa.array(order))
    x, end, no_end = values["x"], values["x"] + values["gw"], null["x"] | null["gw"]
    far, no_far = _extreme_before(end, no_end, group, True)
    near, no_near = _extreme_before(x, null["x"], group, False)
    gap = np.where(back, near - end, x - far)
    none = np.where(back, no_near | no_end, null["x"] | no_far)
    wide, tight = values["size"] * 0.32, values["gw"] / np.maximum(1, table.column("chars").to_numpy()) * 0.55
    least = np.fmin(wide, tight)
    unset = null["size"] & null["gw"]
    least = np.where(unset, 0.8, np.maximum(0.8, least))
    spaced = ~none & ((gap > least) | (np.isnan(gap) & ~np.isnan(least))) & ~table.column("closing").to_numpy().astype(bool)
    spaced[first] = False
    return order, spaced


def style_runs(table: pa.Table, bounds: np.ndarray, keys: list[str]) -> pa.Table:
    """Runs of alike style of each group of visible glyphs; rows come sorted by group, x, y descending, glyph_no."""
    n = table.num_rows
    first = bounds[bounds < n]
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    order, spaced = _known_spaces(table, group)
    if order is not None:
        table = table.combine_chunks().take(pa.array(order))
    size, unset = _floats(table, "size"), table.column("size").is_null().to_numpy()
    bold, italic = _known(table, "bold"), _known(table, "italic")
    font = pc.fill_null(table.column("font_family").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)

    def same(values, at):
        return values[at] == values[at - 1]

    # neighbours of equal style, and of these islands the ones that may differ in size only
    at = np.arange(1, n)
    equal = same(size, at) | (np.isnan(size[at]) & np.isnan(size[at - 1]) & same(unset, at))
    opens = np.append(True, ~(same(group, at) & equal & same(font, at) & same(bold, at) & same(italic, at)))
    head = np.flatnonzero(opens)
    at = head[1:]
    near = same(group, at) & same(font, at) & same(bold, at) & same(italic, at) & (bold[at] >= 0) & (italic[at] >= 0)
    near &= np.abs(size[at] - size[at - 1]) < 0.3
    opened, sizes = list(range(len(head))), size[head]
    for i in (np.flatnonzero(near) + 1).tolist():
        if abs(sizes[opened[i - 1]] - sizes[i]) < 0.15:
            opened[i] = opened[i - 1]
    run = head[np.array(opened, np.int64) == np.arange(len(head))]
    per_group = np.searchsorted(run, first)
    number = np.arange(len(run)) - per_group[group[run]]
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), table.column("value").combine_chunks(), "")
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(run, n), pa.int32()), pieces), "")
    rows = pa.array(run)
    out = {c: table.column(c).combine_chunks().take(rows) for c in [*keys, "size", "font_family", "bold", "italic"]}
    return pa.table({
        **{k: out[k] for k in keys}, "run_no": pa.array(number, pa.int32()), "text": texts, "font_size": out["size"],
        "font_family": out["font_family"], "bold": out["bold"], "italic": out["italic"],
    })


def _anchors(x: np.ndarray, line: np.ndarray, page: np.ndarray, pages: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean x of every group of tokens that two lines share, page by page, and where each page's begin."""
    order = np.lexsort((line, x, page))
    x, line, page = x[order], line[order], page[order]
    opens = np.ones(len(x), bool)
    opens[1:] = (page[1:] != page[:-1]) | (x[1:] - x[:-1] > gap)
    group = np.cumsum(opens) - 1
    size = np.bincount(group)
    pairs = np.unique(group * (line.max() + 1) + line)
    shared = np.bincount(pairs // (line.max() + 1), minlength=len(size)) >= 2
    mean = np.bincount(group, weights=x) / size
    begins = np.searchsorted(page[opens][shared], np.arange(pages + 1))
    return mean[shared], begins


def segment_lines(table: pa.Table, bounds: np.ndarray, gap: float = 10.0) -> dict[str, pa.Array]:
    """Columns ``anchors``, ``cells``, ``mode``, ``segment_no``, ``is_table`` and ``row_no`` of sorted lines of whole regions."""
    n = table.num_rows
    first = bounds[bounds < n]
    lengths = np.diff(np.append(first, n))
    page = np.repeat(np.arange(len(first)), lengths)
    top = np.repeat(first, lengths)
    tokens = table.column("tokens").combine_chunks()
    counts = tokens.value_lengths().to_numpy()
    each = tokens.flatten()
    line = np.repeat(np.arange(n), counts)
    x = each.field("x").to_numpy(zero_copy_only=False)
    anchors, begins = _anchors(x, line, page[line], len(first), gap)
    many = np.diff(begins)
    widest = np.maximum.reduceat(counts, first)
    anchored, padded = (many >= 2)[page], ((many < 2) & (widest >= 2))[page]

    # each token goes to its nearest anchor, the first of equal ones; padded lines keep their tokens apart
    col, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    base, limit = begins[page[line]], many[page[line]]
    for k in range(int(many.max(initial=0))):
        there = np.flatnonzero(limit > k)
        far = np.abs(x[there] - anchors[base[there] + k])
        nearer = far < best[there]
        col[there[nearer]], best[there[nearer]] = k, far[nearer]
    col = np.where(padded[line], each.field("token_no").to_numpy(zero_copy_only=False), col)
    order = np.lexsort((col, line))
    col, owner = col[order], line[order]
    opens = np.ones(len(col), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (col[1:] != col[:-1])
    heads = np.flatnonzero(opens)
    words = pa.ListArray.from_arrays(pa.array(np.append(heads, len(col)), pa.int32()), each.field("text").take(pa.array(order)))
    filled = np.bincount(owner[heads], minlength=n)
    cells = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(filled)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(col[heads], pa.int32()), pc.binary_join(words, " ")], ["col", "text"]),
        mask=pa.array((many == 0)[page] & ~padded),
    )

    # whether a line continues a table depends only on the line above it
    y, height, font = _floats(table, "y"), _floats(table, "height"), _floats(table, "font_size")
    at = np.arange(n)
    begin = at == top

    def above(values):
        return np.append(False, values[:-1]) & ~begin

    drop = np.append(np.nan, y[:-1] - y[1:])
    full = filled >= 2
    follows = ~begin & (drop <= np.fmax(48.0, height * 3.2)) & (full | ((filled == 1) & (np.abs(drop) < font * 1.8)))
    last_full = np.maximum.accumulate(np.where(full, at, -1))
    last_stop = np.maximum.accumulate(np.where(~full & ~follows, at, -1))
    inside = (last_full >= top) & (last_full > last_stop)
    opens = full & ~(follows & above(inside))
    candidate = np.cumsum(opens | begin) - 1
    rows = np.bincount(candidate, weights=inside & full)
    leading = np.bincount(candidate, weights=np.where(opens, filled, 0))
    is_table = inside & ((rows >= 2) | (leading >= 3))[candidate] & anchored
    starts = begin | (anchored & ((is_table & opens) | (~is_table & (above(is_table) | full))))
    segment = np.cumsum(starts) - 1
    ranked = np.cumsum(full)
    row = np.where(padded, at - top, ranked - (ranked - full)[np.flatnonzero(starts)][segment] - 1)
    names = pa.array(["flow", "padded", "anchored"]).take(pa.array(np.where(anchored, 2, np.where(padded, 1, 0))))
    held = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(anchors))
    return {
        "anchors": held.take(pa.array(page)), "cells": cells, "mode": names, "segment_no": pa.array(segment - segment[top], pa.int32()),
        "is_table": pa.array(is_table | padded), "row_no": pa.array(row, pa.int32(), mask=~(is_table | padded)),
    }


def region_cells(table: pa.Table, bounds: np.ndarray, keys: list[str]) -> pa.Table | None:
    """The text of each cell of table lines, its lines joined by newline in the order of (line_no, text).

    Lines come sorted by region, segment_no, row_no, line_no.
    """
    n = table.num_rows
    cells = table.column("cells").combine_chunks()
    counts = pc.fill_null(cells.value_lengths(), 0).to_numpy()
    each = cells.flatten()
    if not len(each):
        return None
    first = bounds[bounds < n]
    page = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    owner = np.repeat(np.arange(n), counts)
    places = [page, *(pc.fill_null(table.column(c), -1).to_numpy() for c in ("segment_no", "row_no"))]
    row = np.cumsum(np.append(False, np.any([p[1:] != p[:-1] for p in places], axis=0)))[owner]
    number, col = table.column("line_no").to_numpy()[owner], each.field("col").to_numpy(zero_copy_only=False)
    texts = each.field("text")
    order = np.lexsort((owner, number, col, row))
    row, col, number = row[order], col[order], number[order]
    opens = np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1]))
    if (~opens[1:] & (number[1:] == number[:-1])).any():
        rank = pc.rank(texts, "ascending", tiebreaker="dense").to_numpy()[order]
        order = order[np.lexsort((rank, number, col, row))]
    heads = np.flatnonzero(opens)
    words = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)), pa.int32()), texts.take(pa.array(order)))
    rows = pa.array(owner[order[heads]])
    return pa.table({
        **{k: table.column(k).combine_chunks().take(rows) for k in [*keys, "segment_no", "row_no"]},
        "col": pa.array(col[heads], pa.int32()), "text": pc.binary_join(words, "\n"),
    })


BINS = 48
LOW, HIGH = 8, 39  # bins within 18 and 82 percent


def _of_pages(reduce: np.ufunc, values: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """A number for each page, of rows sorted by page; NaN for pages without rows."""
    out, first = np.full(pages, np.nan), _firsts(page)
    if len(first):
        out[page[first]] = reduce.reduceat(values, first)
    return out


def _medians(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of each group, unknown values counted as the least; 0 for groups without rows."""
    order = np.lexsort((np.where(np.isnan(values), -np.inf, values), group))
    ranked, n = values[order], np.bincount(group, minlength=groups)
    first = np.cumsum(n) - n
    out, some = np.zeros(groups), n > 0
    upper, lower = ranked[(first + n // 2)[some]], ranked[(first + np.maximum(n // 2 - 1, 0))[some]]
    out[some] = np.where(n[some] % 2 == 1, upper, (lower + upper) / 2)
    return out


def _distance(values: np.ndarray, group: np.ndarray, points: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How far each value is from the nearest point of its group, by one sort; infinite if there is none."""
    every, of, m = np.concatenate([points, values]), np.concatenate([owner, group]), len(points)
    order = np.lexsort((every, of))
    sorted_, of, point, at = every[order], of[order], order < m, np.arange(len(order))
    out = np.full(len(order), np.inf)
    for nearest in (np.maximum.accumulate(np.where(point, at, -1)), np.minimum.accumulate(np.where(point, at, len(at))[::-1])[::-1]):
        there = np.clip(nearest, 0, max(0, len(at) - 1))
        known = (nearest >= 0) & (nearest < len(at)) & (of[there] == of)
        out = np.where(known, np.fmin(out, np.abs(sorted_[there] - sorted_)), out)
    back = np.empty(len(order))
    back[order] = out
    return back[m:]


def _rank(values: np.ndarray, group: np.ndarray, points: np.ndarray, owner: np.ndarray, equal: bool) -> np.ndarray:
    """How many points of its group are below each value, or equal to it if asked for."""
    m, groups = len(points), int(max(group.max(initial=0), owner.max(initial=0))) + 1
    is_value = np.repeat([0, 1], [m, len(values)])
    order = np.lexsort((is_value if equal else 1 - is_value, np.concatenate([points, values]), np.concatenate([owner, group])))
    before = np.empty(len(order), np.int64)
    before[order] = np.cumsum(order < m)
    held = np.bincount(owner, minlength=groups)
    return before[m:] - (np.cumsum(held) - held)[group]


def _widest_gaps(crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and middle of each page's longest run of bins 8 to 39 that are not crowded; the first wins."""
    pages = len(crowded)
    run, best, at = np.zeros(pages, int), np.zeros(pages, int), np.full(pages, -1)
    for i in range(LOW, HIGH + 1):
        run = np.where(crowded[:, i], 0, run + 1)
        better = run > best
        best, at = np.where(better, run, best), np.where(better, i + 1 - run + run // 2, at)
    return best, at


def _short_columns(g: dict, side: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """Pages whose two sides are short lines on common baselines: a table rather than columns.

    Rows come sorted by page, side (0 left, 1 right), y descending, x, glyph_no.
    """
    if not len(page):
        return np.zeros(pages, bool)
    group = page * 2 + side
    first = _firsts(group)
    number = line_numbers(pa.table({"y": g["y"], "size": g["size"]}), first)
    opens = np.ones(len(group), bool)
    opens[1:] = (group[1:] != group[:-1]) | (number[1:] != number[:-1])
    line = np.cumsum(opens) - 1
    order = np.lexsort((g["glyph_no"], -g["y"], g["x"], line))
    g = {name: values[order] for name, values in g.items()}
    _, _, spaced = _spaces(g, line)
    first = _firsts(line)
    # a line keeps its rows in any reading order, so its sums do not depend on that
    length = np.add.reduceat(g["chars"], first) + np.add.reduceat(spaced.astype(int), first)
    y, group = _means(g["y"], first), group[opens]
    page, right = group // 2, group % 2 == 1

    near = _distance(y[right], page[right], y[~right], page[~right]) < 6
    hits = np.bincount(page[right][near], minlength=pages)

    count = np.bincount(group, minlength=2 * pages)
    ranked = length[np.lexsort((length, group))]
    middle = np.zeros(2 * pages, int)
    middle[count > 0] = ranked[(np.cumsum(count) - count + count // 2)[count > 0]]
    left, right = slice(0, None, 2), slice(1, None, 2)
    short = (middle[left] < 28) & (middle[right] < 28) & (count[left] >= 2) & (count[right] >= 2)
    return short & (hits / np.maximum(1, count[right]) >= 0.6)


def column_regions(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of sorted glyphs, the region of each and the ``split_x`` of its page (NaN where it is not split).

    Rows with ``page_width`` state the width of their page and are no glyphs.
    A place that is not known is in no side and fills every bin.
    """
    n = table.num_rows
    first = bounds[bounds < n]
    page = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    width = np.fmax.reduceat(_floats(table, "page_width"), first)
    rows = np.flatnonzero(table.column("shown").is_valid().to_numpy())
    if not len(rows):
        return rows, rows, np.zeros(0)
    known, page = np.unique(page[rows], return_inverse=True)
    width, pages = width[known], len(known)
    x, y, size, gw = (_floats(table, c)[rows] for c in ("x", "y", "size", "gw"))
    end = x + gw
    shown = table.column("shown").combine_chunks().take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(bool)
    low = _of_pages(np.fmin, x[shown], page[shown], pages)
    inner = _of_pages(np.fmax, end[shown], page[shown], pages) - low
    able = (np.bincount(page) >= 6) & (width >= 200) & (inner >= 140)

    v = np.flatnonzero(shown & able[page])
    p = page[v]
    a = np.clip(np.fmax(0, np.floor((x[v] - low[p]) / inner[p] * BINS)), 0, BINS).astype(int)
    z = np.clip(np.fmin(BINS - 1, np.floor((end[v] - low[p]) / inner[p] * BINS)), -1, BINS - 1).astype(int) + 1
    cells = pages * (BINS + 1)
    change = np.bincount(p * (BINS + 1) + a, minlength=cells) - np.bincount(p * (BINS + 1) + np.maximum(a, z), minlength=cells)
    best, at = _widest_gaps(np.cumsum(change.reshape(pages, BINS + 1), axis=1) >= 2)
    split_x = np.where(able & (at >= 0) & (best / BINS * inner >= 24), low + (at + 0.5) / BINS * inner, np.nan)

    cut = split_x[page]
    left, right = shown & (end <= cut + 3), shown & (x >= cut - 3)
    top = np.fmin(_of_pages(np.fmax, y[left], page[left], pages), _of_pages(np.fmax, y[right], page[right], pages))
    body = _medians(np.concatenate([size[left], size[right]]), np.concatenate([page[left], page[right]]), pages)
    body = np.where(body == 0, 11.0, body)
    step, large, long = (top + np.fmax(8.0, body * 1.15))[page], (body * 1.22)[page], (inner * 0.46)[page]
    # what is not known is neither a header nor none
    head = ((x < cut) & (end > cut)) | ((y > step) & ((size >= large) | (gw >= long)))
    plain = ((x >= cut) | (end <= cut)) & ((y <= step) | ((size < large) & (gw < long)))

    def count(which):
        return np.bincount(page[which], minlength=pages)

    fits = (count(left) >= 3) & (count(right) >= 3) & (count(left & plain) >= 2) & (count(right & plain) >= 2)
    at = np.concatenate([np.flatnonzero(left & fits[page]), np.flatnonzero(right & fits[page])])
    side = np.repeat([0, 1], [np.count_nonzero(left & fits[page]), np.count_nonzero(right & fits[page])])
    order = np.lexsort((at, side, page[at]))
    at, side = at[order], side[order]
    taken = pa.array(rows[at])
    g = {"x": x[at], "y": y[at], "size": size[at], "gw": gw[at]}
    g |= {c: table.column(c).combine_chunks().take(taken).to_numpy(zero_copy_only=False) for c in ("glyph_no", "chars")}
    g["closing"] = table.column("closing").combine_chunks().take(taken).to_numpy(zero_copy_only=False).astype(bool)
    g["rtl"] = _floats(table, "back")[rows][at]
    split = fits & ~_short_columns(g, side, page[at], pages)

    parts = [np.flatnonzero(some) for some in (~split[page], split[page] & shown & head, split[page] & left & plain, split[page] & right & plain)]
    region = np.repeat(np.arange(4), [len(some) for some in parts])
    at = np.concatenate(parts)
    order = np.argsort(page[at], kind="stable")  # page after page
    at, region = at[order], region[order]
    return rows[at], region, np.where(region > 0, cut[at], np.nan)


def page_facts(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the ``page_width`` that its page states (NaN if none), and whether there is a row that could state it."""
    n = table.num_rows
    first = bounds[bounds < n]
    lengths = np.diff(np.append(first, n))
    stated = table.column("shown").is_null().to_numpy()
    return np.repeat(np.fmax.reduceat(_floats(table, "page_width"), first), lengths), np.repeat(np.maximum.reduceat(stated, first), lengths)


def pages_apart(table: pa.Table, bounds: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows that do not state a page (``_states``), the first ones of their pages, and for each the width of its page and whether it is stated."""
    n = table.num_rows
    first = bounds[bounds < n]
    lengths = np.diff(np.append(first, n))
    states = pc.fill_null(table.column("_states"), False).to_numpy().astype(bool)
    width = np.repeat(np.fmax.reduceat(_floats(table, "page_width"), first), lengths)
    known = np.repeat(np.maximum.reduceat(states, first), lengths)
    others = np.flatnonzero(~states)
    before = np.append(0, np.cumsum(~states))[first]
    firsts = np.unique(before[before < len(others)])
    return table.combine_chunks().take(pa.array(others)), firsts, width[others], known[others]


def _known(table: pa.Table, name: str) -> np.ndarray:
    """A boolean column as 0 and 1, and -1 where it is null."""
    return pc.fill_null(table.column(name).cast(pa.int8()), -1).to_numpy()


def walk_lines(table: pa.Table, bounds: np.ndarray) -> dict[str, pa.Array]:
    """Region statistics of sorted lines and the paragraph of each.

    Columns ``base_x``, ``leading``, ``heading``, ``para_no``, ``list_seq``, ``opens`` and ``gap`` (to the line above in the paragraph).
    A line is compared with the line that opened the paragraph above it; list items, the
    first line of a region and lines after a wide step open one in any case.
    """
    n = table.num_rows
    first = bounds[bounds < n]
    regions, lengths = len(first), np.diff(np.append(first, n))
    page = np.repeat(np.arange(regions), lengths)
    x, y, height, font = (_floats(table, c) for c in ("x", "y", "height", "font_size"))
    marker = table.column("marker").combine_chunks()
    kind = np.where(marker.is_valid(), pc.fill_null(pc.index_in(pc.struct_field(marker, "kind"), pa.array(["number", "bullet"])), -1), -1)
    starts_at_one = pc.fill_null(pc.equal(pc.struct_field(marker, "start"), 1), False).to_numpy(zero_copy_only=False) & (kind >= 0)

    ranked = font[np.lexsort((font, page))]
    sizes = np.bincount(page[~np.isnan(font)], minlength=regions)
    at = np.maximum(0, np.floor((sizes - 1) * 0.35)).astype(int)
    typical = np.where(sizes > 0, ranked[first + at], np.nan)
    step = np.append(np.nan, y[:-1] - y[1:])
    step[first] = np.nan
    usual = (step > (typical * 0.75)[page]) & (step < (typical * 2.1)[page])
    middle = _medians(step[usual], page[usual], regions)
    leading, typical = np.where(middle != 0, middle, typical * 1.2)[page], typical[page]

    # what is not known is neither a heading nor none
    bold, chars = _known(table, "bold"), _floats(table, "chars")
    large, larger = np.fmax(typical * 1.28, typical + 2.2), typical * 1.16
    yes = (kind < 0) & (chars < 120) & ((font >= large) | ((bold == 1) & (font >= larger)))
    no = (kind >= 0) | (chars >= 120) | ((font < large) & ((bold == 0) | (font < larger)))
    heading = np.where(yes, 1, np.where(no, 0, -1))

    begin = np.zeros(n, bool)
    begin[first] = True
    close = ~begin & (step > 0) & (step <= np.fmax(leading * 1.42, height * 1.65))
    opener = np.where((kind < 0) & close, -1, np.arange(n))
    maybe = np.flatnonzero(opener < 0)
    rtl, alignment = _known(table, "rtl"), pc.fill_null(pc.index_in(table.column("alignment"), pa.array(["left", "center", "right"])), -1).to_numpy()
    style = np.where((heading == 0) & (rtl >= 0), rtl * 3 + alignment, -1)
    facts = (x, kind, style, np.fmax(42.0, font * 3.8), np.fmax(5.0, font * 0.75), np.fmax(28.0, font * 2.8))
    x_, kind_, style_, indent, same, hanging = (f.tolist() for f in facts)
    opened = opener.tolist()
    for i in maybe.tolist():
        o = opened[i - 1]
        shift = x_[i] - x_[o]
        if kind_[o] >= 0:
            joins = -2 <= shift <= indent[i]
        else:
            joins = style_[i] >= 0 and style_[i] == style_[o] and (abs(shift) < same[i] or (i - o == 1 and -hanging[i] <= shift < 0))
        opened[i] = o if joins else i
    opener = np.array(opened, np.int64)
    opens = opener == np.arange(n)

    above = np.append(-1, kind[opener[:-1]])
    restart = (kind >= 0) & (begin | (above != kind) | starts_at_one | (step > np.fmax(leading * 1.8, height * 2.1)))
    number, seq = np.cumsum(opens), np.cumsum(restart)
    top = np.repeat(first, lengths)
    seq = (seq - (seq - restart)[top])[opener]
    return {
        "base_x": pa.array(np.fmin.reduceat(x, first)[page], from_pandas=True), "leading": pa.array(leading, from_pandas=True),
        "heading": pa.array(heading == 1, mask=heading < 0), "para_no": pa.array(number - number[top], pa.int32()),
        "list_seq": pa.array(seq, pa.int32(), mask=kind[opener] < 0), "opens": pa.array(opens),
        "gap": pa.array(np.where(opens, np.nan, step), from_pandas=True),
    }


def _extreme(table: pa.Table, name: str, first: np.ndarray, largest: bool) -> pa.Array:
    """Least or largest known value of each group, NaN above all numbers."""
    values, null = _floats(table, name), table.column(name).is_null().to_numpy()
    found = (np.fmax if largest else np.fmin).reduceat(values, first)
    if largest:
        found = np.where(np.logical_or.reduceat(np.isnan(values) & ~null, first), np.nan, found)
    return pa.array(found, mask=np.logical_and.reduceat(null, first))


def join_lines(table: pa.Table, bounds: np.ndarray, keys: list[str]) -> pa.Table:
    """A row for each paragraph of sorted lines: ``_o`` of its first line, its bounds, its ``_body`` texts joined by newline, its positive gaps."""
    n = table.num_rows
    first = bounds[bounds < n]
    lengths = np.diff(np.append(first, n))

    def listed(column: pa.Array, some: np.ndarray) -> pa.ListArray:
        many = np.add.reduceat(some.astype(np.int64), first)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), column.filter(pa.array(some)))

    body, gap = (table.column(c).combine_chunks() for c in ("_body", "gap"))
    seq = np.maximum.reduceat(pc.fill_null(table.column("list_seq"), -1).to_numpy(), first)
    rows = pa.array(first)
    return pa.table({
        **{k: table.column(k).combine_chunks().take(rows) for k in [*keys, "_o"]}, "line_count": pa.array(lengths, pa.int64()),
        "list_seq": pa.array(seq, pa.int32(), mask=seq < 0), "_left": _extreme(table, "x", first, False), "x_end": _extreme(table, "x_end", first, True),
        "bottom": _extreme(table, "_low", first, False), "text": pc.binary_join(listed(body, body.is_valid().to_numpy(zero_copy_only=False)), "\n"),
        "_gaps": listed(gap, pc.fill_null(pc.greater(gap, 0), False).to_numpy(zero_copy_only=False)),
    })


def _merged(values: np.ndarray, group: np.ndarray, tolerance: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values of each group where a value near the previous merged one moves it to the midpoint."""
    order = np.lexsort((values, group))
    v, group = values[order], group[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (group[1:] != group[:-1]) | (v[1:] - v[:-1] > tolerance)
    # a merged value is no larger than the last one merged, so wider steps are certain ends
    starts = np.flatnonzero(keep)
    ends = np.append(starts[1:], len(v))
    for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        run, last = v[start:end].tolist(), 0
        for i in range(1, len(run)):
            if abs(run[last] - run[i]) <= tolerance:
                run[last] = (run[last] + run[i]) / 2
            else:
                last = i
                keep[start + i] = True
        v[start:end] = run
    return v[keep], group[keep]


def grid_places(table: pa.Table, bounds: np.ndarray, max_crossings: int, mark: str) -> dict[str, np.ndarray]:
    """``rows`` of the glyphs on pages that hold one complete ruled grid, with their ``page``, ``row`` and ``col`` (-1 outside).

    Rows without ``mark`` are the straight rulings of their page, from (x, y) to
    (size, gw), and no glyphs; glyphs are visible unless ``shown`` says no. The lines of page i are ``xs`` (rising) and ``ys`` (falling) from ``x_from[i]`` and ``y_from[i]``.
    """
    n = table.num_rows
    first = bounds[bounds < n]
    pages = len(first)
    page = np.repeat(np.arange(pages), np.diff(np.append(first, n)))
    ruling = table.column(mark).is_null().to_numpy()
    place = [_floats(table, c) for c in ("x", "y", "size", "gw")]
    x1, y1, x2, y2 = (c[ruling] for c in place)
    of = page[ruling]
    level = np.abs(y2 - y1) <= 2.5
    h, v = level, ~level
    xs, x_of = _merged((x1[v] + x2[v]) / 2, of[v])
    ys, y_of = _merged((y1[h] + y2[h]) / 2, of[h])
    n_x, n_y = np.bincount(x_of, minlength=pages), np.bincount(y_of, minlength=pages)
    enough = (np.bincount(of[h], minlength=pages) >= 3) & (np.bincount(of[v], minlength=pages) >= 3)
    enough &= (n_x >= 3) & (n_y >= 3) & (n_x * n_y <= max_crossings)
    left, right = _of_pages(np.fmin, xs, x_of, pages), _of_pages(np.fmax, xs, x_of, pages)
    bottom, top = _of_pages(np.fmin, ys, y_of, pages), _of_pages(np.fmax, ys, y_of, pages)

    def incomplete(values, owner, where, a, b, low, high, which):
        """Pages with a line that no ruling draws from end to end."""
        at = of[which]
        full = (np.fmin(a, b)[which] <= low[at] + 2.5) & (np.fmax(a, b)[which] >= high[at] - 2.5)
        far = _distance(values, owner, where[which][full], at[full]) > 2.5
        return np.bincount(owner[far], minlength=pages) > 0

    valid = enough & ~incomplete(xs, x_of, x1, y1, y2, bottom, top, v) & ~incomplete(ys, y_of, y1, x1, x2, left, right, h)
    rows = np.flatnonzero(~ruling & valid[page])
    page = page[rows]
    x, y, size, gw = (c[rows] for c in place)
    shown = pc.fill_null(table.column("shown"), False).to_numpy()[rows].astype(bool) if "shown" in table.column_names else True
    cx, cy = x + gw / 2, y + size * 0.3
    inside = shown & (cx >= left[page]) & (cx <= right[page]) & (cy >= bottom[page]) & (cy <= top[page])
    at, p = np.flatnonzero(inside), page[inside]
    x_from, y_from = np.cumsum(n_x) - n_x, np.cumsum(n_y) - n_y
    inner = np.ones(len(xs), bool)
    inner[x_from[n_x > 0]] = False
    after, lower = inner.copy(), np.ones(len(ys), bool)
    inner[(x_from + n_x - 1)[n_x > 0]] = False
    lower[(y_from + n_y - 1)[n_y > 0]] = False
    row, col = np.full(len(rows), -1), np.full(len(rows), -1)
    col[at] = _rank(cx[at], p, xs[after], x_of[after], False)
    row[at] = _rank(-cy[at], p, -ys[lower], y_of[lower], False)
    # the first inner line that is more than two points after the glyph's start
    lines, owner = xs[inner], x_of[inner]
    many = np.bincount(owner, minlength=pages)
    next_ = _rank(x[at], p, lines - 2, owner, True)
    there = next_ < many[p]
    line = lines[(np.cumsum(many) - many)[p[there]] + next_[there]]
    crossing = np.bincount(p[there][x[at][there] + gw[at][there] > line + 2], minlength=pages) > 0
    good = (~crossing & (np.bincount(p, minlength=pages) >= 4))[page]
    falling = np.lexsort((-ys, y_of))
    return {
        "rows": rows[good], "page": page[good], "row": row[good], "col": col[good], "xs": xs, "ys": ys[falling],
        "x_from": np.append(x_from, len(xs)), "y_from": np.append(y_from, len(ys)),
    }
