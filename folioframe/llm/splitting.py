"""Problem 2: cutting oversized items into pieces at natural boundaries.

Balanced targets: the least number of pieces gives equal-length targets; each target is snapped to the
strongest boundary near it (blank line, line break, sentence, word), the nearest of equal strength; when a
limit fails, or only weaker boundaries are in reach, one more piece is tried. Consecutive pieces share exactly
``overlap`` code points.

An item made of blocks may be larger than a task should hold: its blocks are grouped into runs of bounded
length by two-level prefix sums over lengths only, and each run is split by itself, starting with the overlap
from the run before. Runs end with blocks, so the cut between two is a boundary of the first strength, and each run
has at most one piece more than its share of the item.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

RUN_CHARS = 1 << 18
#: Blocks per cell of the first level of the prefix sums.
CELL = 1024
#: Piece counts above the least (and an eighth of it) that are tried for stronger boundaries; limits hold with any.
EXTRA_PIECES = 3
#: Keys of oversized items up to which they are broadcast (about 50 bytes each).
BROADCAST_ITEMS = 500_000

#: Strengths of boundaries.
BLANK_LINE, LINE, SENTENCE, WORD, ANYWHERE = 4, 3, 2, 1, 0
_breaks = regex.compile(r"(?:[^\S\r\n]*(?:\r\n|\r|\n|\u2028|\u2029))+[^\S\r\n]*")
_one_break = regex.compile(r"\r\n|\r|\n|\u2028|\u2029")
_sentence = regex.compile(r"(?:[.!?…]+[\"'”’»)\]]*\s+|[。！？｡।؟]+[”’」』）】\"']*)(?=\S)")
_word = regex.compile(r"\s+(?=\S)|(?<=[\p{Han}\p{Hiragana}\p{Katakana}][，、；：])")


def boundaries(text: str, given: list[int] | None = None) -> dict[int, list[int]]:
    """Positions after which a piece may start, by strength, ascending. ``given``: positions of blank-line strength."""
    best: dict[int, int] = {}
    for pattern, level in ((_word, WORD), (_sentence, SENTENCE)):
        for m in pattern.finditer(text):
            best[m.end()] = level
    for m in _breaks.finditer(text):
        best[m.end()] = BLANK_LINE if len(_one_break.findall(m.group())) > 1 else LINE
    for p in given or ():
        best[p] = BLANK_LINE
    out: dict[int, list[int]] = {BLANK_LINE: [], LINE: [], SENTENCE: [], WORD: []}
    for p in sorted(best):
        if 0 < p < len(text):
            out[best[p]].append(p)
    return out


def _nearest(positions: list[int], target: float, lo: int, hi: int) -> int | None:
    i = bisect_left(positions, lo)
    j = bisect_right(positions, hi)
    if i >= j:
        return None
    k = bisect_left(positions, target, i, j)
    near = [positions[x] for x in (k - 1, k) if i <= x < j]
    return min(near, key=lambda p: (abs(p - target), p))


def _safe(text: str, at: int, lo: int) -> int:
    """Move a cut within a word back so that it doesn't part a line break or a letter and its marks."""
    p = at
    while p > lo and (unicodedata.combining(text[p]) or text[p] in "\u200d\ufe0f" or text[p - 1] == "\u200d" or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p if p > lo else at


def _attempt(text: str, limit: int, overlap: int, n: int, marks: dict[int, list[int]]) -> tuple[list[int], int] | None:
    """Cuts for n pieces and the weakest boundary used, or None where the limits fail."""
    size, step = len(text), limit - overlap
    share = (size - overlap) / n
    cuts, weakest, prev = [], BLANK_LINE, overlap
    for i in range(1, n):
        target = overlap + i * share
        lo = max(prev + 1, size - (n - i) * step)
        hi = min(prev + step, size - (n - i))
        if lo > hi:
            return None
        reach = max(1, int(share / 3))
        a, b = max(lo, int(target) - reach), min(hi, int(target) + reach)
        for level in (BLANK_LINE, LINE, SENTENCE, WORD):
            p = _nearest(marks[level], target, a, b)
            if p is not None:
                break
        else:
            level, p = ANYWHERE, _safe(text, min(max(int(target), lo), hi), lo)
        weakest = min(weakest, level)
        cuts.append(p)
        prev = p
    return cuts, weakest


def split(text: str, limit: int, overlap: int = 0, given: list[int] | None = None) -> list[tuple[int, int]]:
    """Pieces (start, end) of a text, each of at most ``limit`` code points; one piece if the text fits.

    Consecutive pieces share exactly ``overlap`` code points, which must be less than the limit. Empty text: no piece.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("need 0 <= overlap < limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    marks = boundaries(text, given)
    least = -(-(len(text) - overlap) // (limit - overlap))
    best: tuple[int, list[int]] | None = None
    for n in range(least, least + EXTRA_PIECES + 1 + least // 8):
        got = _attempt(text, limit, overlap, n, marks)
        if got is None:
            continue
        cuts, weakest = got
        if best is None or weakest > best[0]:
            best = (weakest, cuts)
        if weakest >= SENTENCE:
            break
    assert best is not None  # with n pieces of any cut, the least n always succeeds
    ends = [*best[1], len(text)]
    return list(zip([0, *(c - overlap for c in best[1])], ends, strict=True))


PIECES = "item_kind string, item_id string, run_index int, piece_index int, start_char bigint, end_char bigint, text string, limit_id string"


def split_rows(df: DataFrame, limits: DataFrame, kind: str, key: str, text: str, limit_id: str = "limit_id") -> DataFrame:
    """Pieces of the texts above their limit: PIECES, one row per piece.

    Rows alike in key, text and limit are split once. Null or unknown limits and null, empty or fitting texts
    give no rows. ``limits`` (limit_id, max_size, overlap_size) is a small table of fixed size; the join is left
    to the optimiser.
    """
    lim = limits.filter("unit = 'chars'").select(F.col("limit_id").alias("_l"), F.col("max_size").cast("int").alias("_m"), F.col("overlap_size").cast("int").alias("_o"))
    rows = df.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t"), F.col(limit_id).alias("_l")).join(lim, "_l")
    rows = rows.filter(F.char_length("_t") > F.col("_m")).dropDuplicates(["_k", "_l"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                (kind, k, 0, i, s, e, t[s:e], name)
                for k, t, name, m, o in b[["_k", "_t", "_l", "_m", "_o"]].itertuples(index=False)
                for i, (s, e) in enumerate(split(t, m, o))
            ]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInPandas(run, PIECES)


def positions(blocks: DataFrame, key: str, order: str, text: str, run_chars: int = RUN_CHARS) -> DataFrame:
    """(key, order, start, size, total, run): where each block lies in its item; a null block has no length."""
    one = blocks.select(key, order, F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("size")).groupBy(key, order).agg(F.first("size").alias("size"))
    one = one.withColumn("_c", F.floor(F.coalesce(F.col(order), F.lit(-1)) / CELL))
    cells = one.groupBy(key, "_c").agg(F.sum("size").alias("_cs"))
    w = Window.partitionBy(key).orderBy("_c")
    cells = cells.withColumn("_before", F.sum("_cs").over(w) - F.col("_cs")).withColumn("total", F.sum("_cs").over(Window.partitionBy(key)))
    inner = Window.partitionBy(key, "_c").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = one.withColumn("_in", F.sum("size").over(inner) - F.col("size")).join(cells, [key, "_c"])
    out = out.withColumn("start", F.col("_before") + F.col("_in"))
    return out.select(key, order, "start", "size", "total", F.floor(F.col("start") / run_chars).cast("int").alias("run"))


def split_blocks(blocks: DataFrame, limits: DataFrame, limit_id: str, kind: str, key: str, order: str, text: str, run_chars: int = RUN_CHARS) -> DataFrame:
    """Pieces (PIECES) of the items that ordered blocks make up, where an item exceeds the limit.

    Every (key, order) counts once, null text as empty; rows with a null key or order come last-to-first as a
    group or block of their own. Positions are those in the concatenated item; start_char orders all pieces,
    piece_index those of a run (items up to ``run_chars`` have only run 0). Columns besides the named ones are not read.
    """
    lim = [r for r in limits.filter(F.col("limit_id") == limit_id).limit(2).collect()]
    if len(lim) != 1:
        raise ValueError(f"limit {limit_id} must have one row")
    m, o = int(lim[0]["max_size"]), int(lim[0]["overlap_size"])
    if run_chars <= 2 * m:
        raise ValueError("runs must be longer than two pieces")
    pos = cut_lineage(positions(blocks, key, order, text, run_chars).filter((F.col("total") > m) & (F.col("size") > 0)))
    w = Window.partitionBy(key, "run")
    pos = pos.withColumn("run_end", F.max(F.col("start") + F.col("size")).over(w))
    tail = (F.col("start") + F.col("size") > F.col("run_end") - o) & (F.col("run_end") < F.col("total"))
    runs = F.when(tail, F.array(F.struct(F.col("run").alias("r"), F.lit(False).alias("tail")), F.struct(F.col("_next").alias("r"), F.lit(True).alias("tail"))))
    runs = F.coalesce(runs, F.array(F.struct(F.col("run").alias("r"), F.lit(False).alias("tail"))))
    # The run after a run is not always the next number: a long block may leave a gap.
    after = pos.select(key, "run", "run_end").distinct().withColumn("_next", F.lead("run").over(Window.partitionBy(key).orderBy("run"))).select(key, "run", "_next")
    pos = pos.join(after, [key, "run"]).select(key, order, "start", F.explode(runs).alias("_r")).select(key, order, "start", F.col("_r.r").alias("run"), F.col("_r.tail").alias("tail"))
    # Only texts of oversized items are moved; their keys are sent to every worker while they are few.
    large = pos.select(key).distinct()
    large = F.broadcast(large) if large.count() <= BROADCAST_ITEMS else large
    texts = blocks.select(key, order, F.col(text).alias("_t")).filter("_t != ''").join(large, key, "left_semi")
    rows = pos.join(texts, [key, order])
    rows = rows.select(F.col(key).cast("string").alias("_k"), F.col("run").cast("int").alias("run"), "start", "tail", "_t")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["start"]).sort_values("start")
        name, number = pdf["_k"].iloc[0], int(pdf["run"].iloc[0])
        own = pdf[~pdf["tail"]]
        prefix = "".join(pdf[pdf["tail"]]["_t"])
        prefix = prefix[len(prefix) - o :] if o else ""
        text_ = prefix + "".join(own["_t"])
        base = int(own["start"].iloc[0]) - len(prefix)
        ends, at = [], len(prefix)
        for t in own["_t"]:
            at += len(t)
            ends.append(at)
        out = [(kind, name, number, i, base + s, base + e, text_[s:e], limit_id) for i, (s, e) in enumerate(split(text_, m, o, ends))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return rows.groupBy("_k", "run").applyInPandas(run, PIECES)


def oversized(pieces: DataFrame) -> DataFrame:
    """(item_kind, item_id) of the items that were split."""
    return pieces.filter("run_index > 0 OR piece_index > 0").select("item_kind", "item_id").distinct()
