"""Proofreading: detectors that turn texts into candidates, protection, names, ordering.

Input ``sources``: chapter_id, source_id, start_byte (of the text in its source), text, source_hash. A candidate
carries the exact bytes it replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import ids, spans, text
from folioframe.session import size_in_bytes

DETECTOR_VERSION = "deterministic-v1"
#: Registries above this size are joined by shuffle instead of being broadcast.
BROADCAST_BYTES = 64 << 20
#: The detectors' pattern, replacement, category, confidence and impact.
PATTERNS: dict[str, tuple[str, str | None, str, float, str]] = {
    "multiple_blanks": (r"[ \t]{2,}", " ", "SPACING", 0.97, "TEXT_ONLY"),
    "blank_before_punctuation": (r"[ \t]+(?=[,.;:!?，。；：！？])", "", "SPACING", 0.96, "PUNCTUATION_ONLY"),
    "missing_blank": (r"(?<=[,;:!?])(?=[\p{L}\p{N}])", " ", "SPACING", 0.78, "PUNCTUATION_ONLY"),
    "repeated_punctuation": (r"([,;:!?，；：！？])\1+", None, "PUNCTUATION", 0.72, "PUNCTUATION_ONLY"),
    "two_dot_ellipsis": (r"(?<!\.)\.{2}(?!\.)", "...", "PUNCTUATION", 0.84, "PUNCTUATION_ONLY"),
}
DUPLICATE_TOKENS = r"(?iu)([\p{L}\p{M}\p{N}_'’-]+)([ \t]+)\1"
#: The order of categories among candidates of one place.
CATEGORIES = ("TYPO", "MISSING_WORD", "EXTRA_WORD", "DUPLICATED_TEXT", "SPACING", "PUNCTUATION", "NAME_INCONSISTENCY", "TERMINOLOGY_INCONSISTENCY", "POSSIBLE_SOURCE_DAMAGE", "AMBIGUOUS")
COLUMNS = ["chapter_id", "source_id", "source_hash", "start_byte", "end_byte", "original", "suggestion", "category", "confidence", "impact", "detector"]


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A side to broadcast if its estimated size allows it; otherwise the optimiser chooses."""
    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def _candidates(sources: DataFrame, found: Column, suggestion: Column, detector: str, category: str, confidence: float, impact: str) -> DataFrame:
    rows = sources.select("chapter_id", "source_id", "source_hash", F.col("start_byte").alias("base"), F.explode(found).alias("m"))
    start = F.col("base") + F.col("m.start")
    return rows.select(
        "chapter_id", "source_id", "source_hash", start.alias("start_byte"), (start + F.octet_length("m.text")).alias("end_byte"), F.col("m.text").alias("original"),
        suggestion.alias("suggestion"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(impact).alias("impact"), F.lit(detector).alias("detector"),
    )


def pattern_detector(sources: DataFrame, name: str) -> DataFrame:
    pattern, replacement, category, confidence, impact = PATTERNS[name]
    suggestion = F.lit(replacement) if replacement is not None else F.substring("m.text", 1, 1)
    return _candidates(sources, spans.match_spans(F.col("text"), pattern), suggestion, name, category, confidence, impact)


def duplicate_tokens(sources: DataFrame) -> DataFrame:
    """A token twice in a row; the blanks and the second copy go."""
    found = F.transform(spans.match_spans(F.col("text"), DUPLICATE_TOKENS, 1), lambda m: F.struct(
        (m["start"] + F.octet_length(m["text"])).alias("start"), F.substring(m["whole"], F.char_length(m["text"]) + 1, F.lit(2147483647)).alias("text")))
    return _candidates(sources, found, F.lit(""), "duplicate_tokens", "DUPLICATED_TEXT", 0.82, "TEXT_ONLY")


def repeated_lines(sources: DataFrame) -> DataFrame:
    """A line equal to the one before, but for white space around; blank lines never repeat."""
    keys = ["chapter_id", "source_id", "source_hash", "base"]
    parts = sources.select("chapter_id", "source_id", "source_hash", F.col("start_byte").alias("base"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    w = Window.partitionBy(*keys).orderBy("n")
    size = F.octet_length("line").cast("long")
    rows = parts.withColumn("trim", text.trimmed(F.col("line"))).withColumn("prev", F.lag("trim").over(w))
    rows = rows.withColumn("at", F.sum(size + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size - 1)
    rows = rows.filter((F.col("trim") != "") & (F.col("trim") == F.col("prev")))
    start = F.col("base") + F.col("at")
    return rows.select(
        "chapter_id", "source_id", "source_hash", start.alias("start_byte"), (start + size).alias("end_byte"), F.col("line").alias("original"), F.lit("").alias("suggestion"),
        F.lit("DUPLICATED_TEXT").alias("category"), F.lit(0.94).alias("confidence"), F.lit("TEXT_ONLY").alias("impact"), F.lit("repeated_lines").alias("detector"),
    )


_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【"}


def unmatched(value: str) -> list[tuple[int, str]]:
    """(position, bracket) of brackets without a partner; a closer of another kind closes nothing."""
    stack: list[tuple[int, str]] = []
    out = []
    for i, c in enumerate(value):
        if c in _PAIRS.values():
            stack.append((i, c))
        elif c in _PAIRS:
            if stack and stack[-1][1] == _PAIRS[c]:
                stack.pop()
            else:
                out.append((i, c))
    return sorted(out + stack)


def unmatched_brackets(sources: DataFrame) -> DataFrame:
    """Brackets without a partner. Only texts with a bracket leave the JVM."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"start": len(t[:i].encode()), "text": c} for i, c in unmatched(t)] if t else [])

    find = F.pandas_udf(run, "array<struct<start:bigint,text:string>>")
    rows = sources.filter(F.col("text").rlike(r"[()\[\]{}（）【】]"))
    return _candidates(rows, find(F.col("text")), F.lit(""), "unmatched_brackets", "PUNCTUATION", 0.91, "PUNCTUATION_ONLY")


def _other_than(value: str) -> Callable[[Column], Column]:
    return lambda m: m["text"] != F.lit(value)


def terminology(sources: DataFrame, rules: list[dict]) -> DataFrame:
    """Known variants of a term, and the term in the wrong case where case matters. ``rules``: canonical, variants, case_sensitive."""
    out = None
    for r in rules:
        found = [(text.literal_pattern(v, not r.get("case_sensitive", False)), None, 0.99, "terminology_variant") for v in r["variants"]]
        if r.get("case_sensitive", False):
            found.append((text.literal_pattern(r["canonical"], True), r["canonical"], 0.98, "terminology_case"))
        for pattern, unlike, confidence, name in found:
            hits = spans.match_spans(F.col("text"), pattern)
            if unlike is not None:
                hits = F.filter(hits, _other_than(unlike))
            part = _candidates(sources, hits, F.lit(r["canonical"]), name, "TERMINOLOGY_INCONSISTENCY", confidence, "TEXT_ONLY")
            out = part if out is None else out.unionByName(part)
    return out


def name_frequency(sources: DataFrame, names: list[str]) -> DataFrame:
    """(name, n): mentions of known names over all sources; names never met stay with 0."""
    spark = sources.sparkSession
    counts = sources.select(*(F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit(text.literal_pattern(n)), F.lit(0)))), F.lit(0)).alias(f"n{i}") for i, n in enumerate(names)))
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    long = counts.select(F.posexplode(F.array(*(F.col(f"n{i}") for i in range(len(names))))).alias("i", "n"))
    return frame.join(long, "i").select("name", F.col("n").cast("long").alias("n"))


def token_frequency(sources: DataFrame) -> DataFrame:
    """(token, n): word tokens as spelled, over all sources; combined on the map side."""
    return sources.select(F.explode(text.word_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def name_variants(sources: DataFrame, names: list[str], minimum: int = 2) -> DataFrame:
    """Tokens met once that are one edit from a known single-word name met at least ``minimum`` times.

    Rare tokens are found first, so that the comparison with the few names sees those only.
    """
    single = [n for n in names if n.strip() and " " not in n.strip()]
    known = name_frequency(sources, single).filter(F.col("n") >= minimum).select("name")
    tokens = sources.select("chapter_id", "source_id", "source_hash", F.col("start_byte").alias("base"), F.explode(spans.match_spans(F.col("text"), text.WORD_TOKEN)).alias("m"))
    rare = token_frequency(sources).filter("n = 1").select("token")
    tokens = tokens.withColumn("token", F.col("m.text")).join(rare, "token", "left_semi")
    upper = F.col("token").rlike(r"^\p{Lu}")
    cjk = F.col("token").rlike(f"[{text.NAME_CJK}]") & F.col("name").rlike(f"[{text.NAME_CJK}]")
    near = F.levenshtein(F.lower("token"), F.lower("name"), 1)
    hit = (F.col("token") != F.col("name")) & (upper | cjk) & (near >= 0) & (near <= 1)
    rows = tokens.join(maybe_broadcast(known), hit)
    start = F.col("base") + F.col("m.start")
    return rows.select(
        "chapter_id", "source_id", "source_hash", start.alias("start_byte"), (start + F.octet_length("token")).alias("end_byte"), F.col("token").alias("original"), F.col("name").alias("suggestion"),
        F.lit("NAME_INCONSISTENCY").alias("category"), F.lit(0.74).alias("confidence"), F.lit("ENTITY_CHANGE").alias("impact"), F.lit("name_variant").alias("detector"),
    )


def protected_spans(sources: DataFrame, terms: list[str]) -> DataFrame:
    """(source_id, p_start, p_end): where protected terms and their variants stand."""
    out = None
    for t in terms:
        m = sources.select("source_id", F.col("start_byte").alias("base"), F.explode(spans.match_spans(F.col("text"), text.literal_pattern(t))).alias("m"))
        part = m.select("source_id", (F.col("base") + F.col("m.start")).alias("p_start"), (F.col("base") + F.col("m.start") + F.octet_length("m.text")).alias("p_end"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def without_protected(candidates: DataFrame, protected: DataFrame) -> DataFrame:
    """Candidates that no protected span stands against; sources are the join's equality, spans its range."""
    p = protected.withColumnRenamed("source_id", "p_source")
    cond = (F.col("source_id") == F.col("p_source")) & spans.protects(F.col("p_start"), F.col("p_end"), F.col("start_byte"), F.col("end_byte"))
    return candidates.join(p, cond, "left_anti")


def with_ids(candidates: DataFrame) -> DataFrame:
    """Candidates with their content-derived id, repeated ones once."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_hash", "chapter_id", "source_id", "start_byte", "end_byte", "category", "suggestion")]
    key = F.concat_ws(":", *parts, F.lit(DETECTOR_VERSION))
    return candidates.withColumn("candidate_id", ids.stable_id("candidate", key)).dropDuplicates(["candidate_id"])


def in_order(candidates: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category"))
    return candidates.orderBy("source_id", "start_byte", "end_byte", order, "candidate_id")


def analyze(sources: DataFrame, rules: list[dict] | None = None, names: list[str] | None = None, protected: list[str] | None = None, minimum: int = 2) -> DataFrame:
    """All detectors over all sources: candidates with ids, protected places left out."""
    parts = [duplicate_tokens(sources), repeated_lines(sources), *(pattern_detector(sources, n) for n in PATTERNS), unmatched_brackets(sources)]
    if rules:
        parts.append(terminology(sources, rules))
    if names:
        parts.append(name_variants(sources, names, minimum))
    out = parts[0].select(COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(COLUMNS))
    if protected:
        out = without_protected(out, protected_spans(sources, protected))
    return with_ids(out)
