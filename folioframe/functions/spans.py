"""Half-open UTF-8 byte spans: positions of matches, overlap predicates, prefix sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid_span(source: Column, start: Column, end: Column) -> Column:
    ok = (F.trim(source) != "") & (start >= 0) & (start <= end)
    return F.coalesce(ok, F.lit(False))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def contains(outer_s: Column, outer_e: Column, s: Column, e: Column) -> Column:
    """A span of no length contains nothing."""
    return (outer_e > outer_s) & (outer_s <= s) & (e <= outer_e)


def touches(cs: Column, ce: Column, s: Column, e: Column) -> Column:
    """A change of no length touches spans it borders on; others must overlap."""
    return F.when(cs == ce, (cs >= s) & (cs <= e)).otherwise(overlaps(cs, ce, s, e))


def protects(ps: Column, pe: Column, s: Column, e: Column) -> Column:
    """Whether a protected span stands against an edit; an insertion is held off strictly inside only."""
    return F.when(s == e, (ps < s) & (s < pe)).otherwise(overlaps(ps, pe, s, e))


#: Elements summed up at once, so that running sums over long arrays stay near linear.
CHUNK = 128


def with_starts(items: Column, base: Column, size: Callable[[Column], Column]) -> Column:
    """array<struct<start, item>>: each item with ``base`` and the sizes of those before it, in two levels of sums."""
    return let(items, lambda it: _placed(it, base, size))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(items: Column, base: Column, size: Callable[[Column], Column]) -> Column:
    n = F.size(items)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))
    sums = lambda first, xs, of: F.aggregate(xs, F.array(first.cast("long")), lambda a, x: F.concat(a, F.array((F.element_at(a, -1) + of(x)).cast("long"))))
    total = lambda ch: F.aggregate(ch, F.lit(0).cast("long"), lambda a, x: (a + size(x)).cast("long"))
    starts = lambda cs: sums(base, F.transform(cs, total), lambda x: x)
    pairs = let(chunks, lambda cs: F.filter(F.arrays_zip(cs.alias("c"), starts(cs).alias("s")), lambda z: z["c"].isNotNull()))
    at = F.flatten(F.transform(pairs, lambda z: F.slice(sums(z["s"], z["c"], size), F.lit(1), F.size(z["c"]))))
    return F.when(n > 0, F.transform(F.arrays_zip(items.alias("item"), at.alias("start")), lambda z: F.struct(z["start"].alias("start"), z["item"].alias("item"))))


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, text, whole>>: byte position and text of each match, and of ``group`` within it.

    Spark gives matches without positions; they follow from the pieces between the matches. ``start`` is where the
    whole match starts. Null gives null, no match an empty array.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    items = F.arrays_zip(whole.alias("w"), part.alias("p"), F.split(text, pattern, -1).alias("g"))
    placed = with_starts(items, F.lit(0), lambda x: F.octet_length(x["g"]) + F.coalesce(F.octet_length(x["w"]), F.lit(0)))
    hits = F.filter(placed, lambda z: z["item"]["w"].isNotNull())
    found = F.transform(hits, lambda z: F.struct((z["start"] + F.octet_length(z["item"]["g"])).cast("long").alias("start"), z["item"]["p"].alias("text"), z["item"]["w"].alias("whole")))
    return F.when(text.isNotNull(), F.coalesce(found, F.array().cast("array<struct<start:bigint,text:string,whole:string>>")))


def char_span_to_bytes(text: Column, start: Column, end: Column, base: Column) -> Column:
    """Code point range to absolute byte range."""
    before = F.octet_length(F.substring(text, F.lit(1), start))
    inner = F.octet_length(F.substring(text, start + 1, end - start))
    return F.struct((base + before).cast("long").alias("start_byte"), (base + before + inner).cast("long").alias("end_byte"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The bytes of a span as text, null where the span cuts a character."""
    raw = F.substring(F.encode(text, "UTF-8"), start + 1, end - start)
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))
