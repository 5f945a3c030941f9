"""Scalar text functions as Column expressions; all run inside the JVM but for NFC of non-ASCII text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The ideograph ranges of the word counter, of the token estimator and matchers, and of the name detector.
IDEOGRAPHS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2EBEF}"
CJK = IDEOGRAPHS + r"\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
NAME_CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
SPACE = r"[\s\p{Z}\x{85}]"
#: Heading patterns.
HEADING_EN = r"(?i)^(?:(?:chapter|book|part)\s+(?:[0-9]+|[ivxlcdm]+|[a-z]+)|prologue|epilogue)(?:\s*[:.\-\x{2014}]\s*.+)?$"
HEADING_ZH = (
    r"^(?:\x{7b2c}[\x{96f6}\x{3007}\x{4e00}\x{4e8c}\x{4e09}\x{56db}\x{4e94}\x{516d}\x{4e03}\x{516b}\x{4e5d}\x{5341}\x{767e}\x{5343}\x{4e07}\x{4e24}0-9]+"
    r"[\x{7ae0}\x{8282}\x{56de}\x{5377}\x{90e8}](?:(?:\s*[:\x{ff1a}.\-\x{2014}]\s*|\s+).+)?|\x{5e8f}\x{7ae0}|\x{6954}\x{5b50}|\x{5c3e}\x{58f0})$"
)
SCENE_BREAK = r"^\s*(?:\*\s*\*\s*\*|-\s*-\s*-|#\s*#\s*#)\s*$"
PAGE_NUMBER = r"(?i)^\s*(?:Page\s+)?\d+\s*$"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:['’][\p{L}\p{N}][\p{L}\p{N}\p{M}]*)*"
WORD_TOKEN = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}_'’-]*"
#: A line terminator of imported sources.
LINE_END = r"\r\n|\r|\n"


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """NFC; ASCII text never leaves the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfc(c)).otherwise(c)


@F.pandas_udf(ArrayType(StringType()))
def _nfc_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda xs: None if xs is None else [x if x is None else unicodedata.normalize("NFC", x) for x in xs])


def nfc_each(c: Column) -> Column:
    """NFC of every string of an array, a null one as it is; where all are ASCII nothing leaves the JVM."""
    return F.when(F.exists(c, lambda x: x.rlike(r"[^\x00-\x7F]")), _nfc_each(c)).otherwise(c)


def unify_lines(c: Column) -> Column:
    """Without a leading byte-order mark, all line ends as line feeds."""
    return F.regexp_replace(F.regexp_replace(c, r"^\x{FEFF}", ""), r"\r\n?", "\n")


def normalize(c: Column) -> Column:
    return nfc(unify_lines(c))


def trimmed(c: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def simplified(c: Column) -> Column:
    """Trimmed, every run of white space one blank."""
    return trimmed(F.regexp_replace(c, f"{SPACE}+", " "))


def block_line(c: Column) -> Column:
    return trimmed(normalize(c))


def is_blank(c: Column) -> Column:
    return trimmed(c) == ""


def is_scene_break(c: Column) -> Column:
    return c.rlike(SCENE_BREAK)


def heading(c: Column) -> Column:
    """The normalised heading a line is, or null."""
    line = trimmed(unify_lines(c))
    return F.when((line != "") & (line.rlike(HEADING_EN) | line.rlike(HEADING_ZH)), line)


def join_wrapped(lines: Column) -> Column:
    """An array of lines as one text: trimmed, empty ones left out, joined by blanks."""
    return F.array_join(F.filter(F.transform(lines, trimmed), lambda x: x != ""), " ")


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def count_words(c: Column) -> Column:
    """Words: runs of letters and digits, inner apostrophes included, and single ideographs. Null counts 0."""
    runs = F.size(F.regexp_extract_all(F.regexp_replace(c, f"[{IDEOGRAPHS}]", " "), F.lit(WORD), F.lit(0)))
    return F.when(c.isNull(), 0).otherwise(runs + F.size(F.regexp_extract_all(c, F.lit(f"[{IDEOGRAPHS}]"), F.lit(0))))


def estimate_tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of each run of word characters rounded up, one for each CJK character and other mark."""
    rest = F.regexp_replace(c, f"[{CJK}]", " ")
    runs = F.aggregate(
        F.regexp_extract_all(rest, F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)), F.lit(0), lambda a, x: (a + F.ceil(F.char_length(x) / 4)).cast("int")
    )
    marks = F.char_length(F.regexp_replace(rest, rf"[\p{{L}}\p{{N}}_'\s\p{{Z}}\x{{85}}]", ""))
    cjk = F.char_length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return F.when(c.isNull(), 0).otherwise(runs + marks + cjk)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_TOKEN), F.lit(0))


def contains_cjk(c: Column, ranges: str = CJK) -> Column:
    return c.rlike(f"[{ranges}]")


def literal_pattern(term: str, ignore_case: bool = False) -> str:
    """A term as a pattern; at word boundaries only, unless it holds CJK characters."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    cjk = bool(re.search("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002ebef\u3040-\u30ff\uac00-\ud7af]", term))
    inner = quoted if cjk else rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{M}}\p{{N}}_])"
    return ("(?iu)" if ignore_case else "") + inner


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, by which thresholds of the matchers are stated."""
    return F.char_length(c) + F.char_length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def contains_meaningful_term(query: Column, term: Column) -> Column:
    """Whether a query mentions a term, both in NFC: as a whole if long enough or CJK, or by one of its longer words."""
    return mentions(F.lower(query), F.lower(term))


def mentions(q: Column, t: Column) -> Column:
    """As ``contains_meaningful_term`` of texts in lower case."""
    whole = ((utf16_length(t) >= 3) | contains_cjk(t)) & F.contains(q, t)
    part = F.exists(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & ((utf16_length(w) >= 4) | contains_cjk(w)) & F.contains(q, w))
    return F.coalesce((trimmed(t) != "") & (whole | part), F.lit(False))


def mention_terms(t: Column) -> Column:
    """The strings of which a text must contain one to mention t: t's longer words, which t as a whole holds too, else t itself."""
    words = F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & ((utf16_length(w) >= 4) | contains_cjk(w)))
    whole = F.when((trimmed(t) != "") & ((utf16_length(t) >= 3) | contains_cjk(t)), F.array(t))
    return F.coalesce(F.when(F.size(words) > 0, words), whole, F.array().cast("array<string>"))
