"""Problem 6: noise in text from scanned pages.

Skip-gram vectors of all frequent words are learned over all blocks; the vector of any word, however rare, is the
mean of those around its occurrences, frequent ones counting less. A rare word is linked to the nearest of the
frequent words from which a few plausible glyph edits lead to it (m read as rn, e as c, s as 5), if that one is
near enough; no other link is made. It is corrected where the words around the place agree. Scripts without words
are judged by the characters next to a doubtful one. Then page furniture is removed, words broken by the layout are
joined, and lines are reflowed into paragraphs. A line is furniture if its shape is that of a running header or a
page number and it recurs: a header's title over the blocks of its book (or it is the book's title, where titles are
given), the form of a page number over the corpus.

Everything counted stays distributed. Words are linked by joins, and what a block needs to know is asked for by a
join, so that nothing is sent to all workers but the vectors of words above VECTOR_SHARE of all words (at most
1 / VECTOR_SHARE) and filters of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

#: A correction must be so many times as frequent as what it replaces, and be met so often.
RATIO, LEAST_COUNT = 25, 8
DIMS, WINDOW = 16, 3
#: Words of at least this share of all words have vectors; words above OFTEN are thinned out for learning and weighed down in means.
VECTOR_SHARE, OFTEN = 1e-6, 1e-4
#: Least cosine of a rare word and the frequent one it is linked to, and of a place and the word put there.
LEAST_COSINE, LEAST_CONTEXT = 0.5, 0.0
MAX_EDITS = 2
#: Blocks of a book that a running header stands in, and blocks of the corpus that a form of page numbers stands in.
LEAST_HEADERS, LEAST_FORMS = 2, 3
#: Bits of the filters by which blocks are chosen before the exact join.
FILTER_BITS = 1 << 26

#: What is read, and what may have been printed.
CERTAIN = {"ſ": "s", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Letters that scanners part; all of a word are put together at once.
PARTED = {"rn": "m", "cl": "d", "ii": "u", "vv": "w", "c1": "d"}
READ_AS = {
    "0": "o ó ö ô о", "1": "l i t ı", "|": "l i", "5": "s", "9": "g q", "6": "é b ó б", "8": "B", "3": "з", "4": "ч", "2": "z",
    "rn": "m", "m": "rn", "cl": "d", "c1": "d", "d": "cl", "ii": "u ü п", "vv": "w", "w": "vv", "nn": "m", "ni": "m ш", "in": "m", "li": "h u", "ri": "n", "c": "e o", "e": "c o", "b": "h",
    "h": "b", "l": "t i", "t": "l", "i": "l", "j": "i", "u": "n и", "n": "u п л", "o": "e", "a": "o", "f": "t", "r": "г", "p": "р", "y": "у",
    "ьi": "ы", "ы": "ьi", "bi": "ы", "ii1": "ш", "c1i": "di", "tl": "tt", "lt": "tt", "n1": "m", "iii": "m", "q": "g", "g": "q",
    "в": "б", "б": "в", "п": "н", "н": "п и", "и": "н", "ш": "щ", "щ": "ш", "с": "е", "е": "с", "3": "з", "0": "о o ó ö ô",
    "â": "á à", "á": "à", "è": "é", "é": "è ê", "ò": "ó", "í": "i", "ì": "í",
}
READ_AS_LETTER = {"0": "o", "1": "l", "5": "s", "6": "é", "9": "g", "|": "l"}
#: Characters of scripts without spaces that are read for one another.
ALIKE = "大太犬丈 人入八 的旳 了丁 一ー二 未末 己已巳 日曰目 土士 干千于 王玉主 木本 天夫 问间 没投 看着 地他 往住 夜液 白自 鸟乌 石右 古吉 几儿九 刀力 た だ はばぱ へべぺ ロ口 ニ二 カ力 ソン シツ るろ ぬめ わね れね さき けは"

_token = r"[\p{L}\p{M}0-9|]*[\p{L}\p{M}][\p{L}\p{M}0-9|]*"
_word = regex.compile(_token)
_wide = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_lines = regex.compile(r"\r\n|[\n\r\u2028\u2029]")
_roman = r"[ivxlcdmIVXLCDM]{1,8}"
_page_words = r"(?i:page|p\.|pg\.|seite|s\.|página|pág\.|pagina|pag\.|blz\.|стр\.|с\.)"
_number_line = regex.compile(
    rf"\s*(?:(?:{_page_words}\s*)?\d{{1,4}}(?:\s*(?:(?i:of|von|de|sur|di|van|из)|/)\s*\d{{1,4}})?|[-–—~=*•·\[(|]+\s*(?:{_page_words}\s*)?(?:\d{{1,4}}|{_roman})\s*[-–—~=*•·\])|]+"
    rf"|{_page_words}\s*{_roman}|第\s*[0-9０-９]+\s*[页頁]|[0-9０-９]+\s*(?:ページ|页|頁))\s*"
)
_header_line = regex.compile(
    rf"\s*\d{{1,4}}(?:\s{{2,}}|\s*[·•|]\s*)\p{{L}}[^.!?。！？]{{0,80}}|\s*[\p{{L}}«“\"'‘¿¡][^.!?。！？\n]{{0,80}}(?:\s{{2,}}|\s*[·•|]\s*)(?:\d{{1,4}}|{_roman})\s*|\s*\p{{L}}(?:\s+[\p{{L}}’']){{3,}}\s*|\s*{_wide.pattern}(?:\s+{_wide.pattern}){{2,}}\s*"
)
_spaced = regex.compile(r"(?<![\p{L}\p{M}\p{N}’'.])(?:[\p{L}](?:[ \u00a0]|[ \u00a0]?[’'][ \u00a0]?)){3,}\p{L}(?![\p{L}\p{M}’'])")
_spaced_wide = regex.compile(rf"(?<!{_wide.pattern}){_wide.pattern}(?: {_wide.pattern}){{2,}}(?!{_wide.pattern})")
_broken = regex.compile(r"([\p{L}\p{M}’']+)(?:([-\u2010¬\u2043])\s*[\r\n\u2028\u2029]+\s*|(\u00ad)\s*|(-)[ \u00a0]+)(\p{Ll}[\p{L}\p{M}]*)")
#: Beside such characters a word's letters were decoded wrongly rather than misread.
_undecoded = regex.compile(r"[\x80-\x9f�¤¦¨©¬¯°±²³´µ¶·¸¹º¼½¾÷×ˆ˜†‡‰Œ\u2500-\u25ff\u2200-\u22ff€™]")
NO_WORD = "[0-9|ſﬀﬁﬂﬃﬄﬅﬆ]"
_no_word = regex.compile(NO_WORD)
_odd_glyph = regex.compile(r"[ſﬀﬁﬂﬃﬄﬅﬆ]|\p{L}[01569|]\p{Ll}")


@dataclass
class Known:
    """What a block has to know of the corpus."""

    counts: dict[str, int] = field(default_factory=dict)  # of words and hyphenated words
    links: dict[str, tuple[str, np.ndarray]] = field(default_factory=dict)  # of rare words, with the vector of the frequent one
    contexts: dict[str, str] = field(default_factory=dict)  # of doubtful triples: the character that belongs in the middle
    furniture: frozenset[str] = frozenset()  # keys of lines that recur

    def count(self, word: str) -> int:
        return self.counts.get(word.lower(), 0)


@dataclass
class Vectors:
    """Skip-gram vectors of frequent words, and their weights in means."""

    words: dict[str, int]
    matrix: np.ndarray  # the last row is zero, for words without a vector
    weights: np.ndarray
    middle: np.ndarray

    def around(self, words: list[str], i: int) -> np.ndarray | None:
        """The vector of the place i: the mean of those of the words around it; None where they have none."""
        ids = [self.words[w] for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW] if w in self.words]
        return self.weights[ids] @ (self.matrix[ids] - self.middle) if ids else None


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9))


def variants(word: str) -> set[str]:
    """Words from which at most MAX_EDITS glyph edits lead to ``word``; digits and ligatures within it don't count as edits."""
    base = word
    for read, printed in CERTAIN.items():
        base = base.replace(read, printed)
    starts = {base}
    for digit in "0156|98342":
        if digit in base:
            for printed in READ_AS[digit].split():
                starts |= {s.replace(digit, printed) for s in list(starts)}
    if any(c in "0123456789|" for c in base):
        starts = {s for s in starts if not any(c in "0123456789|" for c in s)} | starts
    for read, printed in PARTED.items():
        if read in base:
            starts |= {s.replace(read, printed) for s in list(starts)}
    seen, layer = set(starts), starts
    for _ in range(MAX_EDITS if len(word) >= 5 else 1):
        nxt = set()
        for w in layer:
            for i in range(len(w)):
                for size in (1, 2, 3):
                    for printed in READ_AS.get(w[i : i + size], "").split() if i + size <= len(w) else ():
                        nxt.add(w[:i] + printed + w[i + size :])
        layer = nxt - seen
        seen |= layer
    return seen - {word}


#: Letters by the strokes that scanners tell apart. Every pair of READ_AS and PARTED has one outline.
STROKES = {c: k for k, letters in {"i": "mnuühblijítrfıìíшщпинглыь1|", "o": "ceoaöóôèéêòâáàеco0о" + "с", "v": "v", "g": "gq", "p": "pр", "y": "yу", "б": "вб"}.items() for c in letters} | {"d": "oi", "w": "v"}


def outline(word: str) -> str:
    """The strokes of a word, repeated ones once: words that glyph edits lead to one another have one outline."""
    out = ""
    for c in word:
        for stroke in STROKES.get(c, c):
            if not out.endswith(stroke):
                out += stroke
    return out


@lru_cache(maxsize=1 << 14)
def outlines(word: str) -> frozenset[str]:
    """Outlines of what a misread word may have been."""
    starts = {word}
    for read, printed in CERTAIN.items():
        starts = {x.replace(read, printed) for x in starts}
    for digit in "569834" + "2":
        if digit in word:
            starts |= {x.replace(digit, p) for p in READ_AS[digit].split() for x in starts}
    return frozenset(outline(x) for x in starts)


_alike = {c: [x for x in group if x != c] for group in ALIKE.split() if len(group) > 1 for c in group} | {"た": ["だ"], "だ": ["た"]}


def doubtful_contexts(text: str) -> Iterator[str]:
    """Character triples around characters that are read for one another."""
    padded = f" {text} "
    for i in range(1, len(padded) - 1):
        if padded[i] in _alike:
            yield padded[i - 1 : i + 2]


_edge_number = regex.compile(rf"^\s*\d{{1,4}}(?:\s{{2,}}|\s*[·•|]\s*)|(?:\s{{2,}}|\s*[·•|]\s*)(?:\d{{1,4}}|{_roman})\s*$")
_no_letter = regex.compile(r"[\W\d_]+")
#: Letters of a title by which headers of a book are told apart; letterspaced ones are often cut off.
TITLE_LETTERS = 8


def title_key(line: str) -> str:
    return _no_letter.sub("", _edge_number.sub("", line).casefold())[:TITLE_LETTERS]


def furniture_key(line: str) -> str:
    """'#' and the form of a line that may be a page number, '=' and the title of one that may be a running header, '' for others."""
    if len(line) > 160 or not line.strip():
        return ""
    if _number_line.fullmatch(line):
        return "#" + regex.sub(_roman + r"(?!\p{L})" if not regex.search(r"\d", line) else r"\d+", "0", regex.sub(r"\s+", " ", line.strip()))
    return "=" + title_key(line) if _header_line.fullmatch(line) else ""


def _cased(word: str, like: str) -> str:
    if len(like) > 1 and like.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _plain_glyphs(word: str) -> str:
    for read, printed in CERTAIN.items():
        word = word.replace(read, printed)
    return regex.sub(r"(?<=\p{L})[01569|](?=\p{Ll})", lambda m: READ_AS_LETTER[m.group()], word)


def correct_words(text: str, known: Known, vectors: Vectors | None = None) -> tuple[str, int]:
    """The text with misread words and characters corrected, and how many there were."""
    found = 0
    tokens = list(_word.finditer(text))
    lows = [m.group().lower() for m in tokens]
    out, at = [], 0
    for i, m in enumerate(tokens):
        w = m.group()
        if len(w) < 3 or _wide.search(w) or _undecoded.match(text[m.start() - 1 : m.start()]) or _undecoded.match(text[m.end() : m.end() + 1]):
            continue
        new = ""
        if link := known.links.get(lows[i]):
            place = vectors.around(lows, i) if vectors else None
            if place is None or cosine(place, link[1]) >= LEAST_CONTEXT or _no_word.search(lows[i]):
                new = _cased(link[0], w)
        if not new and len(w) >= 5 and _odd_glyph.search(w):  # no frequent word, but no word is written so
            new = _plain_glyphs(w)
        if new:
            out += [text[at : m.start()], new]
            at = m.end()
            found += 1
    text = "".join(out) + text[at:]
    if _wide.search(text):
        chars = list(text)
        padded = f" {text} "
        for i in range(len(chars)):
            best = known.contexts.get(padded[i : i + 3])
            if best and (_wide.match(padded[i]) or _wide.match(padded[i + 2])):
                chars[i] = best
                found += 1
        text = "".join(chars)
        fixed = _wide_stop.sub("。", text)
        found += fixed != text
        text = fixed
    return text, found


_wide_stop = regex.compile(rf"(?<={_wide.pattern})o(?=$|\s|{_wide.pattern}|[“「])")


def _halves(m: regex.Match) -> tuple[str, str, str, str]:
    """What is before a broken word, its halves, and both joined by a hyphen."""
    left, right = m.group(1), m.group(5)
    last = regex.split("[’']", left)[-1] or left
    return left[: len(left) - len(last)], last, right, f"{last}-{right}"


def join_broken(text: str, known: Known) -> tuple[str, int]:
    """The text with words joined that line or page ends broke, and how many there were."""
    found = 0

    def join(m: regex.Match) -> str:
        nonlocal found
        if m.group(1)[-1:].isupper() and not m.group(1).isupper() or m.group(3) and "\x7f" < m.group(1)[-1] < "Ā" and "\x7f" < m.group(5)[0] < "Ā":
            return m.group()  # of a wrongly decoded character, not a hyphen
        before, left, right, compound = _halves(m)
        whole = left + right
        if m.group(2) in ("-", None) and not m.group(3) and known.count(compound) > max(known.count(whole), 1):
            return before + compound
        if m.group(4):  # a hyphen and a space within a line may be meant
            is_word = known.count(whole) > 1 or (whole.lower() in known.links and known.count(right) < 2)
            if not is_word or (known.count(left) > known.count(whole) and known.count(right) > known.count(whole)):
                return m.group()
        found += 1
        return before + whole

    return _broken.sub(join, text), found


def join_spaced(text: str) -> tuple[str, int]:
    out, a = _spaced.subn(lambda m: regex.sub(r"[ \u00a0]", "", m.group()), text)
    out, b = _spaced_wide.subn(lambda m: m.group().replace(" ", ""), out)
    return out, a + b


def reflow(lines: list[str]) -> str:
    """Lines joined into paragraphs; an empty line parts paragraphs, scripts without spaces are joined without one."""
    out = ""
    for line in lines:
        line = line.strip()
        if not line:
            out = out.rstrip() + "\n\n" if out.strip() else ""
        elif not out or out.endswith("\n"):
            out += line
        else:
            wide = _wide.match(out[-1]) or out[-1] in "。，、！？；：」』）”"
            out += ("" if wide and (_wide.match(line[0]) or line[0] in "。，、！？；：「『（“”」』") else " ") + line
    return out.strip()


def repair_page(text: str, known: Known, vectors: Vectors | None = None, book: str = "") -> tuple[str, list[str]]:
    """(continuous text, kinds of noise found: furniture, broken, spaced, misread)."""
    lines = _lines.split(text)
    keys = [furniture_key(x) for x in lines]
    page = ["\0" if k and scoped(k, book) in known.furniture else x for x, k in zip(lines, keys, strict=True)]
    text, spaced = join_spaced("\n".join(page))
    text, broken = join_broken(text, known)
    text, misread = correct_words(text, known, vectors)
    kept = [x for x in text.split("\n") if x != "\0"]
    furniture = "\0" in page
    if furniture:  # words that furniture parted
        text, more = join_broken("\n".join(kept), known)
        if more:
            broken += more
            text, again = correct_words(text, known, vectors)
            misread += again
        kept = text.split("\n")
    kinds = [k for k, n in (("furniture", furniture), ("spaced", spaced), ("broken", broken), ("misread", misread)) if n]
    return reflow(kept), kinds


def scoped(key: str, book: str) -> str:
    """The key of a line in the whole corpus: titles count per book."""
    return f"{book}\t{key}" if key[:1] == "=" else key


_hyphen_line = regex.compile(r"(\p{L})[-\u2010¬\u00ad]\s*[\r\n]+\s*(\p{Ll})")
_compound = regex.compile(r"[\p{L}\p{M}’']+-[\p{L}\p{M}]+")
_piece = regex.compile(r"[\p{L}\p{M}0-9|]+")
_not_piece = {c: " " for c in range(128) if not (chr(c).isalnum() or chr(c) == "|")}
_not_piece = "".join(_not_piece.get(c, chr(c)) for c in range(128))
#: Plain patterns that every broken or spaced word matches; far cheaper than the exact ones.
_may_be_spaced = re.compile(r"\b\w[ \u00a0’']+\w[ \u00a0’']+\w[ \u00a0’']+\w\b")
_may_be_broken = re.compile(r"[-\u2010¬\u2043][\s\u00a0]|\u00ad")


def words_of(text: str) -> list[str]:
    """The lower-case words of a text as it reads once broken words are joined; scripts without spaces have none."""
    if "\n" in text or "\r" in text:
        text = _hyphen_line.sub(r"\1\2", text)
    text = text.lower()
    if text.isascii():
        return text.translate(_not_piece).split()
    return [w for w in _piece.findall(text) if not _wide.search(w)] if _wide.search(text) else _piece.findall(text)


def _flat(text: str) -> str:
    return "".join(_lines.split(text))


def _held(words: Iterable[str], bits: np.ndarray) -> set[str]:
    """Those of the words that may be in a filter."""
    words = list(words)
    at = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % FILTER_BITS
    hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return {w for w, h in zip(words, hit, strict=True) if h}


def filter_of(keys: DataFrame, column: str) -> np.ndarray:
    """A filter of FILTER_BITS that holds all values of a column: the bits are set per partition and united in a tree."""
    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.uint32)
        for b in batches:
            at = np.fromiter((zlib.crc32(w.encode()) for w in b["k"]), np.uint32, len(b)) % FILTER_BITS
            seen = np.unique(np.concatenate([seen, at]))
        words, where = seen >> 5, seen & 31
        yield pd.DataFrame({"at": words.astype(np.int64), "mask": (np.uint32(1) << where).astype(np.int64)}, columns=["at", "mask"])

    rows = keys.select(F.col(column).alias("k")).mapInPandas(bits, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    got = rows.toPandas()  # at most FILTER_BITS / 32 rows
    out[got["at"].to_numpy()] = got["mask"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _bookish(df: DataFrame, text: str, book: str | None) -> DataFrame:
    return df.select(F.col(text).alias("t"), (F.coalesce(F.col(book).cast("string"), F.lit("")) if book else F.lit("")).alias("b")).filter("t IS NOT NULL AND t != ''")


def count_corpus(df: DataFrame, text: str, book: str | None = None) -> DataFrame:
    """(kind, key, n) over all rows: w words, y hyphenated words, c triples around doubtful characters, f lines that may be furniture.

    A broken word within a line counts 0, so that it is known to be looked for.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n: Counter = Counter()
            words: Counter = Counter()
            for t, b in rows.itertuples(index=False):
                words.update(words_of(t))
                if "-" in t:
                    n.update(("y", w) for w in _compound.findall(t.lower()))
                    for m in _broken.finditer(t) if _may_be_broken.search(t) else ():
                        if m.group(4):
                            _, left, right, _ = _halves(m)
                            n[("w", (left + right).lower())] += 0
                if not t.isascii() and _wide.search(t):
                    n.update(("c", x) for x in doubtful_contexts(_flat(t)))
                n.update({("f", scoped(k, b)) for x in _lines.split(t) if (k := furniture_key(x))})
            for w, k in words.items():
                n[("w", w)] += k
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "key", "n"])

    return _bookish(df, text, book).mapInPandas(count, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def learn_vectors(df: DataFrame, text: str, counts: DataFrame, dims: int = DIMS) -> Vectors | None:
    """Skip-gram vectors of the words above VECTOR_SHARE, learned over all rows; None where no word is frequent."""
    from pyspark.ml.feature import Word2Vec

    words = counts.filter("kind = 'w' AND n > 0")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.filter(F.col("n") >= max(LEAST_COUNT, VECTOR_SHARE * total)).select("key", "n").toPandas()  # at most 1 / VECTOR_SHARE
    if not len(frequent):
        return None
    often = max(OFTEN, 1 / len(frequent))  # no word is often that is no more frequent than others
    weight = np.minimum(1, np.sqrt(often * total / frequent["n"].to_numpy()))
    keep = dict(zip(frequent["key"], (weight * 2**32).astype(np.int64), strict=True))
    shared = df.sparkSession.sparkContext.broadcast(keep)

    def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = shared.value
        for rows in batches:
            out = []
            for t in rows["t"]:
                known = [(w, k) for w in words_of(t) if (k := keep.get(w))]
                chance = np.random.default_rng(zlib.crc32(t.encode())).integers(0, 2**32, len(known))  # the same when a task is run again
                out.append([w for (w, k), x in zip(known, chance, strict=True) if x <= k])
            yield pd.DataFrame({"words": [x for x in out if len(x) > 1]})

    spoken = cut_lineage(_bookish(df, text, None).select("t").mapInPandas(thinned, "words array<string>"))  # read twice
    parallel = df.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(vectorSize=dims, windowSize=WINDOW, minCount=1, maxIter=1, numPartitions=parallel, seed=7, inputCol="words", outputCol="v", maxSentenceLength=200).fit(spoken)
    got = {r["word"]: r["vector"].toArray() for r in model.getVectors().toLocalIterator()}
    names = [w for w in frequent["key"] if w in got]
    matrix = np.array([*(got[w] for w in names), np.zeros(dims)], np.float32)
    by = dict(zip(frequent["key"], weight, strict=True))
    weights = np.array([*(by[w] for w in names), 0], np.float32)
    return Vectors({w: i for i, w in enumerate(names)}, matrix, weights, matrix[:-1].mean(axis=0) if names else matrix[0])


def glyph_pairs(counts: DataFrame) -> DataFrame:
    """(rare, frequent): words and the frequent enough words that plausible glyph edits lead from to them."""
    words = counts.filter("kind = 'w' AND length(key) >= 3").select("key", "n").withColumn("need", F.when(F.col("n") > 1, RATIO * F.col("n")).otherwise(F.lit(LEAST_COUNT)))
    top = words.agg(F.max("n")).first()[0] or 0

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(w, n, need, o, False) for w, n, need in rows.itertuples(index=False) if need <= top for o in outlines(w)]
            out += [(w, n, need, outline(w), True) for w, n, need in rows.itertuples(index=False) if n >= LEAST_COUNT]
            yield pd.DataFrame(out, columns=["key", "n", "need", "outline", "frequent"])

    drawn = words.mapInPandas(sketch, "key string, n long, need long, outline string, frequent boolean")
    rare = drawn.filter("NOT frequent").select("outline", F.col("key").alias("rare"), "need")
    common = drawn.filter("frequent").select("outline", F.col("key").alias("frequent"), "n")
    met = rare.join(common, "outline").filter("n >= need AND rare != frequent AND abs(length(rare) - length(frequent)) <= 6").select("rare", "frequent").distinct()

    def plausible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cached = lru_cache(maxsize=4096)(variants)
        for rows in batches:
            yield rows[[f in cached(r) for r, f in rows[["rare", "frequent"]].itertuples(index=False)]]

    return met.mapInPandas(plausible, "rare string, frequent string")


def mean_vectors(df: DataFrame, text: str, wanted: DataFrame, vectors: Vectors) -> DataFrame:
    """(key, v array<double>): of each wanted word, the sum of the vectors of all its places."""
    sc = df.sparkSession.sparkContext
    bits, shared = sc.broadcast(filter_of(wanted, "key")), sc.broadcast(vectors)
    dims = vectors.matrix.shape[1]

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        weighted = (v.matrix - v.middle) * v.weights[:, None]
        none = len(v.matrix) - 1
        for rows in batches:
            texts = [words_of(t) for t in rows["t"]]
            held = _held({w for t in texts for w in t}, bits.value)
            number = {w: i for i, w in enumerate(sorted(held))}
            flat, own = [], []
            for t in texts:
                flat += [v.words.get(w, none) for w in t] + [none] * WINDOW
                own += [number.get(w, -1) for w in t] + [-1] * WINDOW
            if not number or not flat:
                continue
            ids, own_ = np.array([none] * WINDOW + flat), np.array(own)
            near = np.zeros((len(own_), dims), np.float32)
            for d in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
                near += weighted[ids[WINDOW + d : WINDOW + d + len(own_)]] if d < 0 else weighted[np.append(ids, [none] * WINDOW)[WINDOW + d : WINDOW + d + len(own_)]]
            at = own_ >= 0
            total = np.zeros((len(number), dims))
            for k in range(dims):
                total[:, k] = np.bincount(own_[at], near[at, k], len(number))
            yield pd.DataFrame({"key": list(number), **{f"v{k}": total[:, k] for k in range(dims)}})

    cols = [f"v{k}" for k in range(dims)]
    got = _bookish(df, text, None).select("t").mapInPandas(places, "key string, " + ", ".join(f"{c} double" for c in cols))
    got = got.groupBy("key").agg(*(F.sum(c).alias(c) for c in cols))
    return got.join(wanted, "key", "left_semi").select("key", F.array(*cols).alias("v"))


def word_links(df: DataFrame, text: str, counts: DataFrame, vectors: Vectors | None) -> DataFrame:
    """(key, link, v): the frequent word that each rare one is linked to, with its vector: the nearest of those glyph edits lead from."""
    empty = df.sparkSession.createDataFrame([], "key string, link string, v array<double>")
    if vectors is None:
        return empty
    pairs = cut_lineage(glyph_pairs(counts))
    wanted = pairs.select(F.explode(F.array("rare", "frequent")).alias("key")).distinct()
    means = cut_lineage(mean_vectors(df, text, wanted, vectors))
    a, b = means.select(F.col("key").alias("rare"), F.col("v").alias("p")), means.select(F.col("key").alias("frequent"), F.col("v").alias("q"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    near = pairs.join(a, "rare").join(b, "frequent").withColumn("cos", dot("p", "q") / (F.sqrt(dot("p", "p") * dot("q", "q")) + 1e-9))
    best = near.groupBy("rare").agg(F.max_by(F.struct("frequent", "q", "cos"), F.struct("cos", "frequent")).alias("x"))
    # A word with a digit or ligature in it is none, so it is linked to the nearest however far that is.
    return best.filter((F.col("x.cos") >= LEAST_COSINE) | F.col("rare").rlike(NO_WORD)).select(F.col("rare").alias("key"), F.col("x.frequent").alias("link"), F.col("x.q").alias("v"))


def context_links(counts: DataFrame) -> DataFrame:
    """(key, link): rare triples around a doubtful character, and the character that is frequent there."""
    triples = counts.filter("kind = 'c'").select("key", "n")
    groups = {c: g for g in sorted({"".join(sorted({c, *x})) for c, x in _alike.items()}) for c in g}
    group = F.create_map(*(F.lit(x) for c, g in groups.items() for x in (c, g)))
    triples = triples.withColumn("m", F.substring("key", 2, 1)).withColumn("hole", F.concat(F.substring("key", 1, 1), F.lit("\t"), F.substring("key", 3, 1), group[F.col("m")]))
    a = triples.select("hole", "key", "m", F.when(F.col("n") > 1, RATIO * F.col("n")).otherwise(F.lit(LEAST_COUNT)).alias("need"))
    b = triples.filter(F.col("n") >= LEAST_COUNT).select("hole", F.col("m").alias("link"), F.col("n").alias("k"))
    return a.join(b, "hole").filter("k >= need AND m != link").groupBy("key").agg(F.max_by("link", F.struct("k", "link")).alias("link"))


def repair_pages(df: DataFrame, keys: list[str], text: str, book: str | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(keys, repaired, kinds) of the rows whose text holds scan noise; clean, null and empty texts give no row.

    ``book`` names the column by which running headers recur (the whole table is one book without it), ``titles``
    (book, title) the titles of books. A text of nothing but page numbers and running headers comes out empty.
    Repeated rows give repeated results. Columns besides keys, text and book are not read.
    """
    sc = df.sparkSession.sparkContext
    counts = cut_lineage(count_corpus(df, text, book))
    vectors = learn_vectors(df, text, counts)
    words = cut_lineage(word_links(df, text, counts, vectors))
    wide = cut_lineage(context_links(counts))
    forms = counts.filter("kind = 'f'").filter(F.when(F.col("key").startswith("#"), F.col("n") >= LEAST_FORMS).otherwise(F.col("n") >= LEAST_HEADERS)).select("key")
    if titles is not None:
        named = titles.select(*titles.columns[:2]).toDF("b", "title").filter("b IS NOT NULL AND title IS NOT NULL").distinct()

        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield pd.DataFrame({"key": [scoped("=" + title_key(t), b) for b, t in rows.astype(str).itertuples(index=False) if title_key(t)]}, columns=["key"])

        forms = forms.unionByName(named.mapInPandas(keyed, "key string")).distinct()
    told = (
        words.select(F.concat(F.lit("l"), "key").alias("ask"), F.lit(0).cast("long").alias("n"), "link", "v")
        .unionByName(wide.select(F.concat(F.lit("c"), "key").alias("ask"), F.lit(0).cast("long").alias("n"), "link", F.lit(None).cast("array<double>").alias("v")))
        .unionByName(forms.select(F.concat(F.lit("f"), "key").alias("ask"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("array<double>").alias("v")))
        .unionByName(counts.filter("kind IN ('w', 'y') AND n > 1").select(F.concat(F.lit("w"), "key").alias("ask"), "n", F.lit(None).cast("string").alias("link"), F.lit(None).cast("array<double>").alias("v")))
    )
    word_bits, wide_bits, shared = sc.broadcast(filter_of(words, "key")), sc.broadcast(filter_of(wide, "key")), sc.broadcast(vectors)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            split = [words_of(t) for t in rows["_t"]]
            every = {w for t in split for w in t}
            held = _held(every, word_bits.value)
            odd = {w for w in every if len(w) >= 5 and _odd_glyph.search(w)}
            asked = []
            for t, ws, b in zip(rows["_t"], split, rows["_b"], strict=True):
                out = {"l" + w for w in held.intersection(ws)}
                if not odd.isdisjoint(ws):
                    out.add("")
                if "\n" in t or "\r" in t or len(t) <= 160:
                    out |= {"f" + scoped(k, b) for x in _lines.split(t) if (k := furniture_key(x))}
                if _may_be_broken.search(t):
                    for m in _broken.finditer(t):
                        _, left, right, compound = _halves(m)
                        out |= {"w" + x.lower() for x in (left, right, left + right, compound)} | {"l" + (left + right).lower()}
                if _may_be_spaced.search(t):
                    out.add("")
                if not t.isascii() and _wide.search(t):
                    flat = f" {t} "
                    out |= {"c" + x for x in _held({flat[i : i + 3] for i in range(len(t)) if flat[i + 1] in _alike}, wide_bits.value)}
                    if _wide_stop.search(t) or _spaced_wide.search(t):
                        out.add("")
                asked.append(sorted(out))
            rows = rows.assign(asked=asked)
            yield rows[[bool(x) for x in asked]]

    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(text).alias("_t"), (F.coalesce(F.col(book).cast("string"), F.lit("")) if book else F.lit("")).alias("_b")).filter("_t IS NOT NULL AND _t != ''")
    kinds = ", ".join(f"{o} {df.schema[k].dataType.simpleString()}" for k, o in zip(keys, own, strict=True))
    asked = cut_lineage(rows.mapInPandas(ask, f"{kinds}, _t string, _b string, asked array<string>").withColumn("_id", F.monotonically_increasing_id()))
    one = asked.select("_id", F.explode("asked").alias("ask")).filter("ask != ''")
    answers = one.join(told, "ask").groupBy("_id").agg(F.collect_list(F.struct("ask", "n", "link", "v")).alias("answers"))
    full = asked.drop("asked").join(answers, "_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = []
            for t, b, got in rows[["_t", "_b", "answers"]].itertuples(index=False):
                known, lines = Known(), set()
                for a in got if got is not None else ():
                    kind, key = a["ask"][0], a["ask"][1:]
                    if kind == "w":
                        known.counts[key] = max(a["n"], known.counts.get(key, 0))
                    elif kind == "l":
                        known.links[key] = (a["link"], np.asarray(a["v"]))
                    elif kind == "c":
                        known.contexts[key] = a["link"]
                    else:
                        lines.add(key)
                known.furniture = frozenset(lines)
                done.append(repair_page(t, known, shared.value, b))
            out = rows[own].copy()
            out["repaired"] = [t for t, _ in done]
            out["kinds"] = [k for _, k in done]
            yield out[[bool(k) for _, k in done]]

    repaired = full.mapInPandas(run, f"{kinds}, repaired string, kinds array<string>")
    return repaired.select(*(F.col(o).alias(k) for o, k in zip(own, keys, strict=True)), "repaired", "kinds")
