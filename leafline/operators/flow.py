"""Text flow: wrapping a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.sources.docx import map_rows

EM = 0.5  # advance of a character without a metric, per point of size
_TOKEN = re.compile(r" +|\n|[^ \n]+")


def _advance(text: str, size: float, metrics: dict[str, float] | None) -> float:
    if metrics is None:
        return len(text) * size * EM
    total = 0.0
    for c in text:
        total += metrics.get(c, EM)
    return total * size


def _chunks(word: str, size: float, width: float, metrics: dict[str, float] | None) -> Iterator[str]:
    """A word wider than the line cut into pieces that fit, at least one character each."""
    start, total = 0, 0.0
    for i, c in enumerate(word):
        total += EM if metrics is None else metrics.get(c, EM)
        grown = (i + 1 - start) * size * EM if metrics is None else total * size
        if grown > width and i > start:
            yield word[start:i]
            start, total = i, EM if metrics is None else metrics.get(c, EM)
    yield word[start:]


def _wrap(text: str, size: float, width: float, metrics: dict[str, float] | None) -> list[tuple[str, float]]:
    """The lines of one paragraph and their widths."""
    lines, line, used, filled = [], [], 0.0, False
    for t in _TOKEN.findall(text):
        if t == "\n":
            lines.append(("".join(line), used))
            line, used, filled = [], 0.0, False
            continue
        w, blank = _advance(t, size, metrics), t[0] == " "
        if filled and used + w > width:
            lines.append(("".join(line), used))
            line, used, filled = [], 0.0, False
            if blank:
                continue
        if w > width and not blank:
            *whole, t = _chunks(t, size, width, metrics)
            lines += [(c, _advance(c, size, metrics)) for c in whole]
            w = _advance(t, size, metrics)
        line.append(t)
        used, filled = used + w, True
    if filled or not lines:
        lines.append(("".join(line), used))
    return lines


def flow_lines(paras: DataFrame, width: float | Column, metrics: dict[str, float] | None = None) -> DataFrame:
    """Greedy wrap of every paragraph: (doc_id, para_no, line_no, text, width).

    ``paras`` is (doc_id, para_no, text, size); ``width`` may be one of its
    columns. ``metrics`` maps characters to
    their advance per point of size: a font's own table, so its size is that of
    a character set. Each paragraph is one row, so nothing is shuffled.  A null
    text has one row without a line; a null size or width breaks line feeds only.
    """

    def read(doc_id, para_no, text, size, limit):
        if text is None:
            yield doc_id, para_no, None, None, None
            return
        lines = _wrap(text, 0.0 if size is None else size, float("inf") if limit is None else limit, metrics)
        for i, (line, w) in enumerate(lines):
            yield doc_id, para_no, i, line, None if size is None and line else w

    limit = width if isinstance(width, Column) else F.lit(float(width))
    p = paras.select("doc_id", "para_no", "text", F.col("size").cast("double"), limit.cast("double").alias("_limit"))
    keys = ", ".join(f"{c} {paras.schema[c].dataType.simpleString()}" for c in ("doc_id", "para_no"))
    return map_rows(p, read, f"{keys}, line_no int, text string, width double")
