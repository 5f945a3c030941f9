"""Pages from extracted words with boxes: lines, page numbers, columns, reading order.

Input: page_id, text, x0, y0, x1, y1, page_width, page_height, top to bottom. Grouping runs per page, which is small.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame

LINES = "page_id string, line_no int, column_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, error string"
_number = regex.compile(r"(?i)\s*(?:page\s+)?\d+\s*")
#: Thresholds of the layout, as shares of heights and widths, and the confidence of one and of two columns.
LINE_TOLERANCE, GAP, FOOTER, LANE, SECOND_LANE = 0.45, 0.06, 0.10, 0.12, 0.25
CONFIDENCE = {1: 0.92, 2: 0.82}


def page_lines(page: pd.DataFrame) -> pd.DataFrame:
    """Lines of one page in reading order; a page of three or more columns is an error."""
    names = [c.split()[0] for c in LINES.split(", ")]
    pid = page["page_id"].iloc[0]
    words = page.dropna(subset=["text", "x0", "y0", "x1", "y1"]).sort_values(["y0", "x0"])
    if words.empty:
        return pd.DataFrame([], columns=names)
    width, height = float(page["page_width"].iloc[0]), float(page["page_height"].iloc[0])
    rows: list[list] = []
    for w in words.itertuples(index=False):
        mid, tall = (w.y0 + w.y1) / 2, w.y1 - w.y0
        near = min(rows, key=lambda r: abs((r[0].y0 + r[0].y1) / 2 - mid), default=None)
        if near is not None and abs((near[0].y0 + near[0].y1) / 2 - mid) <= max(3.0, LINE_TOLERANCE * tall):
            near.append(w)
        else:
            rows.append([w])
    parts = []
    for r in rows:
        r.sort(key=lambda w: w.x0)
        run = [r[0]]
        for a, b in zip(r, r[1:], strict=False):
            if b.x0 - a.x1 > max(24.0, GAP * width):
                parts.append(run)
                run = []
            run.append(b)
        parts.append(run)
    lines = [(" ".join(w.text for w in p), min(w.x0 for w in p), min(w.y0 for w in p), max(w.x1 for w in p), max(w.y1 for w in p)) for p in parts]
    lines = [x for x in lines if not (x[2] >= (1 - FOOTER) * height and _number.fullmatch(x[0]))]
    lanes: list[list] = []
    for x in sorted(lines, key=lambda x: x[1]):
        if lanes and x[1] - lanes[-1][0][1] <= LANE * width:
            lanes[-1].append(x)
        else:
            lanes.append([x])
    big = [g for g in lanes if len(g) >= SECOND_LANE * max(len(lines), 1)]
    if len(big) >= 3:
        return pd.DataFrame([(pid, None, None, None, None, None, None, None, None, "UnsupportedLayout")], columns=names)
    if len(big) == 2:
        split = big[1][0][1]
        order = [(1 + (x[1] >= split - 1e-9), x) for x in lines]
    else:
        order = [(1, x) for x in lines]
    order.sort(key=lambda t: (t[0], t[1][2], t[1][1]))
    conf = CONFIDENCE[2 if len(big) == 2 else 1]
    return pd.DataFrame([(pid, i, c, *x, conf, None) for i, (c, x) in enumerate(order)], columns=names)


def lines(words: DataFrame) -> DataFrame:
    return words.groupBy("page_id").applyInPandas(page_lines, LINES)
