"""Revisions: line hunks with exact byte spans, their impact, and offsets mapped through edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import spans

#: Work of one line diff in cells; a larger pair comes out as one hunk.
MAX_CELLS = 1_000_000
#: Impacts from the weakest to the strongest.
IMPACTS = ("NoChange", "TypoOnly", "TextOnly", "Unknown", "SemanticChange")
HUNKS = "source_id string, old_start bigint, old_end bigint, new_start bigint, new_end bigint, old_text string, new_text string, fallback boolean"


def _lines(data: bytes) -> list[bytes]:
    return regex.findall(rb"[^\n]*\n|[^\n]+", data)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes two runs begin with in common."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _cuts(data: np.ndarray) -> np.ndarray:
    """Offsets at which a run of UTF-8 may be cut: starts of characters and its end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def narrowed(old: bytes, new: bytes) -> tuple[int, int]:
    """Lengths of the common head and of the common tail of what remains; neither parts a character of either side."""
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    both = np.intersect1d(_cuts(a), _cuts(b))
    head = int(max(both[both <= _common(a, b)], default=0))
    ends = np.intersect1d(len(a) - _cuts(a), len(b) - _cuts(b))
    shared = min(_common(a[::-1], b[::-1]), len(a) - head, len(b) - head)
    return head, int(max(ends[ends <= shared], default=0))


def _last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each beginning of y, in one row of memory."""
    row = np.zeros(len(y) + 1, np.int32)
    for c in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == c, row[:-1] + 1, 0)))
    return row


def _matches_by_halves(x: np.ndarray, y: np.ndarray, i: int, j: int) -> Iterator[tuple[int, int]]:
    """Matched places of a longest common subsequence with memory for two rows only: x is halved where both halves fit y best."""
    if not len(x) or not len(y):
        return
    if len(x) == 1:
        hit = np.flatnonzero(y == x[0])
        if len(hit):
            yield i, j + int(hit[-1])
        return
    half = len(x) // 2
    fit = _last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]
    at = len(fit) - 1 - int(np.argmax(fit[::-1]))
    yield from _matches_by_halves(x[:half], y[:at], i, j)
    yield from _matches_by_halves(x[half:], y[at:], i + half, j + at)


def _matches_by_table(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """Matched places of a longest common subsequence; of equal ways the one that passes over new lines first."""
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in reversed(range(len(x))):
        own = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(own[::-1])[::-1]
    j = 0
    for i in range(len(x)):
        # Line i is matched with the first equal one up to which no match is lost; it is passed over if there is none.
        reach = j + int(np.searchsorted(-best[i, j:], -best[i, j], side="right")) if best[i, j] else j
        hit = np.flatnonzero(y[j:reach] == x[i])
        if len(hit):
            j += int(hit[0])
            yield i, j
            j += 1
        elif best[i, j]:
            j = max(j, reach - 1)


def hunks(old: bytes, new: bytes, exact: bool = False) -> tuple[list[tuple[int, int, int, int]], bool]:
    """Changed (old start, old end, new start, new end): the gaps between the lines of a longest common subsequence.

    Above MAX_CELLS the whole is one hunk (the second value is true), or with ``exact`` comes from an alignment in linear space.
    """
    if old == new:
        return [], False
    a, b = _lines(old), _lines(new)
    large = (len(a) + 1) * (len(b) + 1) > MAX_CELLS
    codes: dict[bytes, int] = {}
    x, y = (np.array([codes.setdefault(t, len(codes)) for t in side], np.int64) for side in (a, b))
    if large and not exact:
        pairs: list[tuple[int, int]] = []
    else:
        pairs = list(_matches_by_halves(x, y, 0, 0) if large else _matches_by_table(x, y))
    at, bt = (np.concatenate([[0], np.cumsum([len(t) for t in side], dtype=np.int64)]) for side in (a, b))
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        if p > i or q > j:
            s, e, t, u = int(at[i]), int(at[p]), int(bt[j]), int(bt[q])
            head, tail = narrowed(old[s:e], new[t:u])
            out.append((s + head, e - tail, t + head, u - tail))
        i, j = p + 1, q + 1
    return out, large and not exact


def changed_spans(revisions: DataFrame, exact: bool = False) -> DataFrame:
    """HUNKS of revisions (source_id, old, new: texts), ``exact`` as for ``hunks``. Equal pairs never leave the JVM; null counts as empty."""
    rows = revisions.select(F.col("source_id").cast("string").alias("source_id"), F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new")).filter("old != new")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sid, o, w in batch.itertuples(index=False):
                a, b = o.encode(), w.encode()
                found, capped = hunks(a, b, exact)
                out += [(sid, s, e, t, u, a[s:e].decode(), b[t:u].decode(), capped) for s, e, t, u in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HUNKS.split(", ")])

    return rows.mapInPandas(run, HUNKS)


def rank(impact: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in IMPACTS)), impact)


def strongest(impact: Column) -> Column:
    """The strongest of a group's impacts."""
    return F.max_by(impact, rank(impact))


def review_impact(category: Column, impact: Column) -> Column:
    """What a reviewed change of a category and stated impact means for the story."""
    story = impact.isin("ENTITY_CHANGE", "DIALOGUE_CHANGE", "ACTION_CHANGE", "TIMELINE_CHANGE", "STORY_STATE_CHANGE")
    unsure = (impact == "UNKNOWN") | category.isin("AMBIGUOUS", "POSSIBLE_SOURCE_DAMAGE")
    return (
        F.when(category.isin("NAME_INCONSISTENCY", "TERMINOLOGY_INCONSISTENCY") | story, "SemanticChange")
        .when(unsure, "Unknown").when((category == "TYPO") & (impact == "TEXT_ONLY"), "TypoOnly").when(impact.isin("TEXT_ONLY", "PUNCTUATION_ONLY"), "TextOnly").otherwise("Unknown")
    )


def chapter_pairs(before: DataFrame, after: DataFrame, key: str = "chapter_id") -> DataFrame:
    """(key, change): chapters added, removed, or on both sides."""
    a, b = before.select(key).distinct().withColumn("x", F.lit(1)), after.select(key).distinct().withColumn("y", F.lit(1))
    kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def touched_chapters(changes: DataFrame, chapters: DataFrame) -> DataFrame:
    """Changes with the chapters they touch; sources are the join's equality."""
    c = chapters.select(F.col("source_id").alias("c_source"), "chapter_id", F.col("start_byte").alias("c_start"), F.col("end_byte").alias("c_end"))
    return changes.join(c, (F.col("source_id") == F.col("c_source")) & spans.touches(F.col("old_start"), F.col("old_end"), F.col("c_start"), F.col("c_end"))).drop("c_source")


def uncovered(changes: DataFrame, chapters: DataFrame) -> DataFrame:
    """Changes that lie in no chapter."""
    c = chapters.select(F.col("source_id").alias("c_source"), F.col("start_byte").alias("c_start"), F.col("end_byte").alias("c_end"))
    return changes.join(c, (F.col("source_id") == F.col("c_source")) & (F.col("c_start") <= F.col("old_start")) & (F.col("old_end") <= F.col("c_end")), "left_anti")


def running_delta(edits: DataFrame) -> DataFrame:
    """Edits (source_id, old_start, old_end, new_len) with delta: by how many bytes earlier edits move what follows."""
    w = Window.partitionBy("source_id").orderBy("old_start", "old_end").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("delta", F.coalesce(F.sum(F.col("new_len") - (F.col("old_end") - F.col("old_start"))).over(w), F.lit(0)))


def mapped_offsets(points: DataFrame, edits: DataFrame, include_insertion: bool = True) -> DataFrame:
    """Points (source_id, point) with new_point, their place after the edits; null inside replaced bytes.

    An insertion exactly at a point counts as before it only where ``include_insertion``. Edits don't overlap.
    Points and the ends of edits are put in one order, so that a running sum serves all points of a source.
    """
    grown = (F.col("new_len") - (F.col("old_end") - F.col("old_start"))).cast("long")
    empty = F.col("old_start") == F.col("old_end")
    # At one offset: ends of replacements, then insertions that count, then points, then insertions that don't, then starts.
    turn = F.when(~empty, F.lit(0)).otherwise(F.lit(1 if include_insertion else 3))
    ends = edits.select("source_id", F.col("old_end").cast("long").alias("at"), turn.alias("turn"), grown.alias("moved"), F.when(empty, 0).otherwise(-1).alias("open"))
    starts = edits.filter(~empty).select("source_id", F.col("old_start").cast("long").alias("at"), F.lit(4).alias("turn"), F.lit(0).cast("long").alias("moved"), F.lit(1).alias("open"))
    marks = points.select("source_id", F.col("point").cast("long").alias("at")).distinct().select("source_id", "at", F.lit(2).alias("turn"), F.lit(0).cast("long").alias("moved"), F.lit(0).alias("open"))
    w = Window.partitionBy("source_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ends.unionByName(starts).unionByName(marks).withColumn("m", F.sum("moved").over(w)).withColumn("o", F.sum("open").over(w)).filter("turn = 2")
    return rows.select("source_id", F.col("at").alias("point"), F.when(F.col("o") <= 0, F.col("at") + F.col("m")).alias("new_point"))


def splice(body: Column, start: Column, end: Column, replacement: Column) -> Column:
    """Bytes with one span replaced."""
    raw = F.encode(body, "UTF-8")
    return F.concat(F.substring(raw, F.lit(1), start), F.encode(replacement, "UTF-8"), F.substring(raw, end + 1, F.lit(2147483647)))


def dirty_from(touched: DataFrame, sequences: DataFrame) -> DataFrame:
    """(project_id, dirty_from, chapters): the first chapter from which memory must be rebuilt, and the chapters that changed.

    touched: chapter_id; sequences: project_id, chapter_id, sequence.
    """
    rows = touched.select("chapter_id").distinct().join(sequences, "chapter_id")
    return rows.groupBy("project_id").agg(F.min("sequence").alias("dirty_from"), F.array_sort(F.collect_set("chapter_id")).alias("chapters"))
