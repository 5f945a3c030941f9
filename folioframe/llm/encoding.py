"""Problem 1: text that was decoded with a wrong encoding.

Round-trip repair: the text, or a part of it, is encoded again under a candidate legacy encoding and strictly
decoded as the encoding that may have been meant; the result is kept when a garbling cost drops, and the step
is repeated for nested layers. The cost of a text is its length in bits under the character frequencies of the
whole corpus, plus a charge for letters of two alphabets in one word; characters that the corpus doesn't hold or
that no text holds on purpose (C1 controls, U+FFFD, private use) cost the most. Texts in which every run of
non-ASCII characters is ordinary for its script are passed over. Numeric character references may be the outermost
layer: they are decoded where that lets the round trips save more; other references stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 40.0
MIXED = 12.0
ASCII_BITS = 5.0
LEAST_DROP = 8.0
#: Mean bits of a run of Han or kana up to which it is ordinary.
ORDINARY_BITS = 12.5
LEAST_SHARE = 0.12
LAYERS = 4

#: Fixed: (read as, meant) pairs of legacy encodings that are confused in practice; UTF-8 is tried for every first.
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8_r", "cp1250", "cp1254")
DOUBLE = ("cp932", "gbk", "cp950", "euc_kr", "euc_jp")
PAIRS = {
    "cp1252": ("gbk", "cp932", "euc_jp", "cp950", "euc_kr", "cp1251", "koi8_r", "cp866"),
    "mac_roman": ("cp1252", "cp1251", "gbk", "cp932"),
    "cp437": ("cp1252", "cp1251", "cp866", "gbk", "cp932"),
    "cp850": ("cp1252", "cp1251", "cp866"),
    "cp1251": ("koi8_r", "cp866", "cp1252"),
    "cp866": ("cp1251", "koi8_r"),
    "koi8_r": ("cp1251", "cp866"),
    "cp1250": ("cp1252",),
    "cp1254": (),
    "cp932": ("euc_jp", "gbk", "cp950", "utf-8"),
    "gbk": ("cp950", "cp932", "euc_jp", "euc_kr", "utf-8"),
    "cp950": ("gbk", "cp932", "euc_jp", "euc_kr", "utf-8"),
    "euc_kr": ("gbk", "euc_jp", "utf-8"),
    "euc_jp": ("cp932", "gbk", "utf-8"),
}

_non_ascii = re.compile(r"[^\x00-\x7f]")
_mixed = regex.compile(
    r"\p{Cyrillic}(?=[^\P{L}\p{Cyrillic}])|[^\P{L}\p{Cyrillic}](?=\p{Cyrillic})|\p{Greek}(?=[^\P{L}\p{Greek}])|[^\P{L}\p{Greek}](?=\p{Greek})"
    r"|\p{L}(?=[─-▟])|[─-▟](?=\p{L})|\p{Ll}(?=[À-ÖØ-Þ])|\p{L}(?=[“”„»«]\p{Ll})"
)
_hopeless = regex.compile(r"[\x80-\x84\x86-\x9f�-]")
_chunk = regex.compile(r"[^.!?。！？\n�]*[.!?。！？\n�]+\s*|[^.!?。！？\n�]+")


_runs = regex.compile(r"[^\x00-\x7f]{2,}")
_marks = "[“”„‘’«»‹›—–…¡¿、。，！？；：「」『』（）《》]"
_latin = "[ß-öø-ÿœšžğışłąęćńśźżčřěůőű]"
_plain_run = regex.compile(
    rf"{_marks}+|[—–…«»“”‘’ \u00a0\u00ad°±½¼¾§№€£¥©®™·•¡¿]+|{_marks}*{_latin}{{1,2}}{_marks}?|{_marks}*(?:[À-ÖØ-Þ]{_latin}?|[А-ЯЁІЇЄҐ]?[а-яёіїєґ]+{_marks}*|[А-ЯЁ]+{_marks}*)"
    rf"|{_marks}*(?:\p{{Thai}}+|\p{{Devanagari}}+|[\p{{Arabic}}ـ]+|\p{{Hebrew}}+|\p{{Hangul}}+|\p{{Greek}}+){_marks}*"
)
_cjk_run = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〇\u3000-〿！-～“”‘’—…·«»]+")
_clause = regex.compile(r"[。！？，、；：「」“”]+")
_edges = regex.compile(r"([\s。！？，、；：「」“”‘’（）]*)(.*?)([\s。！？，、；：「」“”‘’（）�]*)", regex.S)
_half_width = regex.compile(r"[｡-ﾟ\p{Bopomofo}]")
#: A numeric character reference, for Python and the JVM.
REFERENCE = r"&#(?:[0-9]{2,9}|[xX][0-9a-fA-F]{2,8});"
_reference = regex.compile(REFERENCE)
_reference_run = regex.compile(rf"(?:{REFERENCE}|[^\x00-\x7f])+")

@lru_cache(maxsize=32)
def _to_byte(codec: str) -> dict[str, int]:
    """Characters of a single-byte encoding; undefined bytes stand for the C1 control of their number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=32)
def _utf8_pattern(codec: str) -> regex.Pattern:
    """Character sequences whose bytes under the codec are UTF-8 sequences of two to four bytes."""
    by = {}
    for ch, b in _to_byte(codec).items():
        by.setdefault(b, []).append(ch)
    of = lambda a, z: "[" + "".join(regex.escape(c) for b in range(a, z + 1) for c in by.get(b, ())) + "]"
    cont = of(0x80, 0xBF)
    return regex.compile(f"(?:{of(0xC2, 0xDF)}{cont}|{of(0xE0, 0xEF)}{cont}{{2}}|{of(0xF0, 0xF4)}{cont}{{3}})+")


#: Characters that a corpus is taken to hold before it is counted, so that a small one doesn't decide alone.
PRIOR_TOTAL = 200_000


@lru_cache(maxsize=1)
def _prior() -> dict[str, int]:
    out = dict.fromkeys("ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšž", 100) | dict.fromkeys("абвгдежзийклмнопрстуфхцчшщъыьэюяё", 300) | dict.fromkeys("“”„‘’«»–—…", 200)
    out |= dict.fromkeys("ÀÁÂÄÅÆÇÈÉÊËÍÎÓÔÖØÚÜАБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", 20)
    out |= {chr(c): 100 for c in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB))} | dict.fromkeys("、。，！？；：「」", 300)
    for b in range(0xB0, 0xD8):  # the first level of GB 2312
        out |= dict.fromkeys(bytes(x for c in range(0xA1, 0xFF if b < 0xD7 else 0xFA) for x in (b, c)).decode("gb2312"), 30)
    return out


class Costs:
    """Bits of each non-ASCII character, from counts over the corpus and a small prior of ordinary letters and marks."""

    def __init__(self, counts: dict[str, int], total: int):
        total += PRIOR_TOTAL
        counts = dict(counts)
        for c, n in _prior().items():
            counts[c] = counts.get(c, 0) + n
        self.bits = {c: min(MOST, max(ASCII_BITS, -math.log2((n + 0.5) / max(total, 1)))) for c, n in counts.items()}
        for c in [c for c in self.bits if _hopeless.match(c)]:
            del self.bits[c]

    def least(self, text: str) -> float:
        """The cost of a text without the charge for mixed alphabets."""
        rare = _non_ascii.findall(text)
        get = self.bits.get
        return ASCII_BITS * (len(text) - len(rare)) + sum([get(c, MOST) for c in rare])

    def __call__(self, text: str) -> float:
        return self.least(text) + (0 if text.isascii() else MIXED * len(_mixed.findall(text)))

    def odd_runs(self, text: str) -> int:
        """Runs of non-ASCII characters that are not ordinary for one script."""
        odd = 0
        for run in _runs.findall(text):
            if _plain_run.fullmatch(run):
                continue
            if _cjk_run.fullmatch(run) and not _half_width.search(run):
                odd += any(sum(self.bits.get(c, MOST) for c in x) > ORDINARY_BITS * len(x) for x in _clause.split(run) if len(x) > 1)
                continue
            odd += 1
        return odd


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec not in SINGLE:
            return None
    table, out = _to_byte(codec), bytearray()
    for ch in text:
        if ch < "\x80":
            out.append(ord(ch))
        elif ch in table:
            out.append(table[ch])
        else:
            return None
    return bytes(out)


def _utf8_step(text: str, codec: str) -> str:
    table = _to_byte(codec)

    def back(m: regex.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _utf8_pattern(codec).sub(back, text)


def _pair_step(part: str, cost: Costs) -> tuple[str, str] | None:
    """The best strict round trip of one part: (result, name), or None."""
    seen = _non_ascii.findall(part)
    if len(seen) < 2 or not cost.odd_runs(part):
        return None
    # Only what is not ASCII tells the candidates apart, so a part is weighed without its ASCII share.
    lost = _hopeless.findall(part)
    ascii_share = ASCII_BITS * (len(part) - len(seen))
    base = best = math.inf  # weighed with the first decoding that is valid
    name, out = None, part
    letters = set(seen)
    for read, meant in PAIRS.items():
        raw = _encode(part, read) if read not in SINGLE or letters <= _to_byte(read).keys() else None
        if raw is None:
            continue
        for codec in meant:
            try:
                new = raw.decode(codec)
            except UnicodeDecodeError:
                continue
            if new == part:
                continue
            if base == math.inf:
                base = best = cost(part) - ascii_share
            if cost.least(new) - ascii_share >= best or len(_hopeless.findall(new)) > len(lost):
                continue
            c = cost(new) - ascii_share
            if c < best and base - c >= max(LEAST_DROP, LEAST_SHARE * base):
                best, name, out = c, f"{read}>{codec}", new
    return (out, name) if name else None


def _referred(m: regex.Match) -> str:
    """The character of a reference; one to ASCII, a surrogate or no character stays."""
    ref = m.group()[2:-1]
    n = int(ref[1:], 16) if ref[0] in "xX" else int(ref)
    return chr(n) if 0x80 <= n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m.group()


def _open_references(text: str, least: int) -> str:
    """The text with the references decoded that stand in runs of at least so many non-ASCII characters."""

    def run(m: regex.Match) -> str:
        new = _reference.sub(_referred, m.group())
        return new if max(map(len, regex.findall(r"[^\x00-\x7f]+", new)), default=0) >= least else m.group()

    return _reference_run.sub(run, text)


def repair(text: str, cost: Costs) -> tuple[str, list[str]]:
    """(the text as far as it can be restored, the round trips that led to it). A clean text comes back as it is."""
    fixed, steps = _round_trips(text, cost)
    if _reference.search(text):
        saved = cost(text) - cost(fixed)
        for least in (2, 1):  # characters of a UTF-8 sequence never stand alone, those of other encodings may
            opened = _open_references(text, least)
            if opened == text:
                continue
            new, more = _round_trips(opened, cost)
            if (c := cost(opened) - cost(new)) >= saved + LEAST_DROP:
                fixed, steps, saved = new, ["references", *more], c
    return fixed, steps


def _round_trips(text: str, cost: Costs) -> tuple[str, list[str]]:
    steps: list[str] = []
    for _ in range(LAYERS):
        odd = cost.odd_runs(text)
        if not odd:
            break
        before, best = math.inf, None  # weighed with the first step that changes the text
        for codec in SINGLE:  # each valid sequence may be a garbled one
            new = _utf8_step(text, codec)
            if new != text and not (_hopeless.search(new) and not _hopeless.search(text)):
                before = cost(text) if before == math.inf else before
                c = cost(new)
                if before - c >= LEAST_DROP and (best is None or c < best[0]) and cost.odd_runs(new) <= odd:
                    best = (c, new, f"{codec}>utf-8")
        parts, names = [], []
        chunks = _chunk.findall(text)
        for part in chunks:
            # Clean marks or a lost character may stand at the ends of a part.
            before_, core, after_ = _edges.fullmatch(part).groups()
            got = _pair_step(part, cost)
            if not got and core != part and (got := _pair_step(core, cost)):
                got = (before_ + got[0] + after_, got[1])
            parts.append(got[0] if got else part)
            if got:
                names.append(got[1])
        whole = _pair_step(text, cost) if len(chunks) > 1 else None  # one chunk is the whole
        if before == math.inf and (names or whole):
            before = cost(text)
        for new, name in (("".join(parts), ",".join(dict.fromkeys(names))) if names else ("", ""), whole or ("", "")):
            if name and (c := cost(new)) < (best[0] if best else before) and cost.odd_runs(new) <= odd:
                best = (c, new, name)
        if best is None:
            break
        text = best[1]
        steps.append(best[2])
    if steps and "cp1252>utf-8" in steps[0]:
        text = _lost_space.sub(lambda m: "à" + m.group(1), text)
    return text, steps


#: A capital Ã where no capital letter is before it: the first byte of à, whose second, a no-break space, became a space.
_lost_space = regex.compile(r"(?<![\p{Lu}])Ã( )")


def hopeless(text: str) -> bool:
    """Whether characters are left, as such or as references, that only a wrong decoding leaves."""
    return bool(_hopeless.search(_reference.sub(_referred, text)))


def character_counts(df: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """Counts of the non-ASCII characters of all rows, and all characters; at most one entry per Unicode character."""
    chars = df.select(F.explode(F.split(F.regexp_replace(text, r"[\x00-\x7f]", ""), "")).alias("c")).filter("c != ''")
    counts = {r["c"]: r["n"] for r in chars.groupBy("c").agg(F.count("*").alias("n")).collect()}
    total = df.agg(F.sum(F.char_length(text))).first()[0] or 0
    return counts, int(total)


def repair_column(df: DataFrame, keys: list[str], text: str, cost: Costs | None = None) -> DataFrame:
    """(keys, repaired, steps, recovered) of the rows whose text holds garbled sequences; others give no row.

    Null and empty texts, and ASCII texts without numeric character references, are never garbled. ``recovered`` is false where characters remain that a wrong
    decoding leaves. Repeated rows give repeated results. Columns besides keys and text are not read.
    """
    rows = df.select(*keys, F.col(text).alias("_t")).filter(F.col("_t").rlike(rf"[^\x00-\x7f]|{REFERENCE}"))
    cost = cost or Costs(*character_counts(df, text))
    shared = df.sparkSession.sparkContext.broadcast(cost)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cost = shared.value
        for b in batches:
            done = [repair(t, cost) for t in b["_t"]]
            left = [hopeless(t) for t, _ in done]
            keep = [bool(s) or h for (_, s), h in zip(done, left, strict=True)]
            out = b[keys].copy()
            out["repaired"] = [t for t, _ in done]
            out["steps"] = [s for _, s in done]
            out["recovered"] = [not h for h in left]
            yield out[keep]

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{kinds}, repaired string, steps array<string>, recovered boolean")


def true_codepage(record: bytes | None, cost: Costs) -> int | None:
    """The code page a text record is written in: 65001, 1252, another number's stand-in 0, or None for ASCII or nothing."""
    if not record or not _non_ascii.search(record.decode("latin-1")):
        return None
    try:
        record.decode("utf-8")
        return 65001
    except UnicodeDecodeError as e:
        cut_off = e.end == len(record) and e.start >= len(record) - 3 and e.reason == "unexpected end of data"
        if cut_off and _non_ascii.search(record[: e.start].decode("latin-1")):
            return 65001
    text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in record)
    _, steps = _round_trips(text, cost)
    return 0 if steps and not steps[0].endswith("utf-8") else 1252


def wrong_headers(headers: DataFrame, cost: Costs, key: str = "book_id", encoding: str = "encoding", record: str = "text_record") -> DataFrame:
    """(key, encoding, written): headers whose non-null encoding is not the one of their record. ASCII and null records are no case."""
    shared = headers.sparkSession.sparkContext.broadcast(cost)
    rows = headers.select(F.col(key).alias("_k"), F.col(encoding).cast("int").alias("_e"), F.col(record).alias("_b")).filter("_e IS NOT NULL AND _b IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            written = [true_codepage(bytes(x), shared.value) for x in b["_b"]]
            out = pd.DataFrame({key: b["_k"], encoding: b["_e"], "written": pd.array(written, "Int32")})
            yield out[out["written"].notna() & (out["written"] != out[encoding])]

    return rows.mapInPandas(run, f"`{key}` {headers.schema[key].dataType.simpleString()}, `{encoding}` int, written int")
