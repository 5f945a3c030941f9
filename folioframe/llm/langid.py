"""Problem 7: language of texts, of their single-language stretches, and of books.

Nearest-centroid classification: a text's letter n-grams (one to three letters, with word ends) give a
normalised TF-IDF vector, which is compared by cosine with several clustered centroids per language. A text that
is too far from all centroids, or about as near to two languages, is rejected (language 'und').

The centroids are fitted on a bounded sample of labelled rows: at most ``per_language`` texts of each label.
Everything else runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

DIMS = 1 << 16
CLUSTERS = 4
#: Bound of the training sample: texts per label, and units taken of each.
PER_LANGUAGE, UNITS = 400, 4
#: Labels with fewer texts in the sample aren't learned.
LEAST_TEXTS = 5
LEAST_COSINE, LEAST_MARGIN = 0.12, 0.03
#: Letters (a Han or kana counts three) from which a piece can stand for itself.
LEAST_LETTERS = 12

_latin_run = regex.compile(r"\p{Latin}+")
_end = regex.compile(r"[.!?…؟।]+[\"'”’“»›」』）)\]]*(?=\s|$|[\p{Han}\p{Hiragana}\p{Katakana}])|[。！？｡]+[”’」』）\"']*")
_final = regex.compile(r"[.!?…。！？｡؟।]+[\"'”’“»›」』）)\]]*\s*$")

#: Two-letter code, three-letter codes, English name of languages (ISO 639).
LANGUAGES = """
af afr Afrikaans; ar ara Arabic; be bel Belarusian; bg bul Bulgarian; bn ben Bengali; ca cat Catalan; cs ces cze Czech; cy cym wel Welsh;
da dan Danish; de deu ger German; el ell gre Greek; en eng English; eo epo Esperanto; es spa Spanish; et est Estonian; eu eus baq Basque;
fa fas per Persian; fi fin Finnish; fr fra fre French; ga gle Irish; gl glg Galician; he heb Hebrew; hi hin Hindi; hr hrv Croatian;
hu hun Hungarian; hy hye arm Armenian; id ind Indonesian; is isl ice Icelandic; it ita Italian; ja jpn Japanese; ka kat geo Georgian;
kk kaz Kazakh; ko kor Korean; la lat Latin; lt lit Lithuanian; lv lav Latvian; mk mkd mac Macedonian; mn mon Mongolian; ms msa may Malay;
nb nob Bokmål; nl nld dut Dutch; nn nno Nynorsk; no nor Norwegian; pl pol Polish; pt por Portuguese; ro ron rum Romanian; ru rus Russian;
sk slk slo Slovak; sl slv Slovenian; sq sqi alb Albanian; sr srp Serbian; sv swe Swedish; sw swa Swahili; ta tam Tamil; te tel Telugu;
th tha Thai; tl tgl Tagalog; tr tur Turkish; uk ukr Ukrainian; ur urd Urdu; vi vie Vietnamese; zh zho chi Chinese
"""


def label_codes() -> dict[str, str]:
    out = {}
    for line in LANGUAGES.replace("\n", " ").split(";"):
        code, *others = line.split()
        out |= {x.lower(): code for x in (code, *others)}
    return out | {"cmn": "zh", "yue": "zh", "mandarin": "zh"}


def normal_label(label: Column) -> Column:
    """The two-letter code that a label names as a code, tag or English name; null where it names none."""
    codes = F.create_map(*(F.lit(x) for pair in label_codes().items() for x in pair))
    word = F.lower(F.regexp_replace(F.trim(label), r"[-_ (].*$", ""))
    return F.try_element_at(codes, word)


_tables: list[np.ndarray] = []


def _character_tables() -> list[np.ndarray]:
    """Per code point: its lower-case letter or a space, whether it is a letter, Latin, or wide (counts three)."""
    if not _tables:
        points = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x30000)]
        everything = "".join(points)
        marks = lambda p: np.isin(np.arange(len(points)), [m.start() for m in regex.finditer(p, everything)])
        letter, mark = marks(r"\p{L}"), marks(r"\p{M}")
        low = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in points], np.uint32)
        low[~(letter | mark)] = 32
        _tables.extend([low, letter, marks(r"\p{Latin}"), marks(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")])
    return _tables


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 0x30000, codes, 32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram occurrence, ordered by row."""
    low = _character_tables()[0]
    codes = _codes("\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0")
    edge = codes == 0
    row = np.cumsum(edge) - 1
    a = low[codes]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32) | edge[1:]
    keep[:-1] &= ~((a[:-1] == 32) & ~edge[:-1] & edge[1:])  # no space before an edge
    a, edge, row = a[keep].astype(np.uint64), edge[keep], row[keep]
    two = a[:-1] * np.uint64(0x9E3779B1) + a[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0x27D4EB2F) + a[2:] * np.uint64(0x165667B1)
    h = np.zeros((len(a), 3), np.uint64)
    h[:, 0] = a * np.uint64(0xC2B2AE3D)
    h[:-1, 1] = two * np.uint64(31)
    h[:-2, 2] = three * np.uint64(131)
    use = np.zeros((len(a), 3), bool)
    use[:, 0] = a != 32
    use[:-1, 1] = ~(edge[:-1] & edge[1:])
    use[:-2, 2] = ~edge[1:-1]
    feat = (((h ^ (h >> np.uint64(15))) * np.uint64(0x2545F491)) >> np.uint64(13)) % np.uint64(DIMS)
    return np.repeat(row, 3)[use.ravel()], feat.ravel()[use.ravel()].astype(np.int64)


def vectors(texts: list[str], idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, feature, weight), one entry per occurrence, of about unit length."""
    row, feat = grams(texts)
    w = np.ones(len(feat), np.float32) if idf is None else idf[feat]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(texts)))
    return row, feat, (w / np.maximum(norm[row], 1e-12)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # (features, centroids), float32
    idf: np.ndarray

    def cosines(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(names, cosine of each text with the nearest centroid of each language)."""
        names = sorted(set(self.languages))
        of = np.array([names.index(x) for x in self.languages])
        best = np.zeros((len(texts), len(names)), np.float32)
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            row, feat, w = vectors(part, self.idf)
            sims = np.zeros((len(part), self.centroids.shape[1]), np.float32)
            if len(row):
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                sims[row[starts]] = np.add.reduceat(self.centroids[feat] * w[:, None], starts, axis=0)
            for k in range(len(names)):
                best[a : a + len(part), k] = sims[:, of == k].max(axis=1)
        return names, best

    def classify(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language or 'und', confidence, margin) of each text."""
        names, best = self.cosines(texts)
        order = np.argsort(best, axis=1)
        out = []
        for i in range(len(texts)):
            k = order[i, -1]
            top = float(best[i, k])
            margin = top - (float(best[i, order[i, -2]]) if len(names) > 1 else 0.0)
            ok = top >= LEAST_COSINE and margin >= LEAST_MARGIN
            out.append((names[k] if ok else "und", float(margin / (top + 1e-9)) if ok else 0.0, margin))
        return out


def fit(samples: dict[str, list[str]], clusters: int = CLUSTERS, rounds: int = 8) -> Model:
    """Centroids of labelled texts by spherical k-means within each language; wrongly labelled texts are dropped after a first fit."""
    names = sorted(samples)
    texts = [t for n in names for t in samples[n]]
    labels = np.array([i for i, n in enumerate(names) for _ in samples[n]])
    row, feat = grams(texts)
    df = np.bincount(np.unique(row * DIMS + feat) % DIMS, minlength=DIMS)  # texts that hold the feature
    idf = np.log((1 + len(texts)) / (1 + df)).astype(np.float32) + 0.1

    def centroids(k: int, keep: np.ndarray) -> Model:
        row, feat, w = vectors(texts, idf)
        languages, cols = [], []
        for lang in range(len(names)):
            own = np.flatnonzero((labels == lang) & keep)
            if not len(own):
                continue
            pos = np.full(len(texts), -1)
            pos[own] = np.arange(len(own))
            inside = pos[row] >= 0
            r, f, v = pos[row[inside]], feat[inside], w[inside]
            group = np.arange(len(own)) % min(k, len(own))
            for _ in range(rounds):
                m = np.zeros((DIMS, group.max() + 1), np.float32)
                np.add.at(m, (f, group[r]), v)
                m /= np.maximum(np.linalg.norm(m, axis=0), 1e-12)
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                new = group.copy()
                new[r[starts]] = np.add.reduceat(m[f] * v[:, None], starts, axis=0).argmax(axis=1)
                if (new == group).all():
                    break
                _, group = np.unique(new, return_inverse=True)
            cols.append(m)
            languages += [names[lang]] * m.shape[1]
        return Model(languages, np.concatenate(cols, axis=1), idf)

    everything = np.ones(len(texts), bool)
    first = centroids(1, everything)
    got, best = first.cosines(texts)
    keep = np.array([got[k] for k in best.argmax(axis=1)]) == np.array(names)[labels]
    return centroids(clusters, keep)


class Counts:
    """Letters of texts and of their parts; a Han, kana or Hangul counts three."""

    def __init__(self, texts: list[str]):
        _, letter, latin, wide = _character_tables()
        codes = _codes("".join(texts))
        self.starts = np.cumsum([0, *(len(t) for t in texts)]).tolist()

        def sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x) + 1, np.int32)
            np.cumsum(x, out=out[1:])
            return out

        self.wide = sums(wide[codes])
        self.letters = sums(letter[codes]) + 2 * self.wide
        self.latin = sums(latin[codes])

    def of(self, i: int, a: int, b: int) -> int:
        at = self.starts[i]
        return int(self.letters[at + b] - self.letters[at + a])


def pieces(text: str, counts: Counts | None = None, i: int = 0) -> list[tuple[int, int]]:
    """Sentence-like pieces covering a text; line breaks don't end one. Short pieces join the next, or the one before."""
    counts = counts or Counts([text])
    out: list[tuple[int, int]] = []
    start = 0
    for m in _end.finditer(text):
        if counts.of(i, start, m.end()) >= LEAST_LETTERS:
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        if out and counts.of(i, start, len(text)) < LEAST_LETTERS:
            out[-1] = (out[-1][0], len(text))
        elif text[start:].strip():
            out.append((start, len(text)))
    return out


def stretches(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float, bool, int]]]:
    """Per text, its single-language stretches (start, end, language, confidence, holds a whole sentence, letters)."""
    counts = Counts(texts)
    spans = [pieces(t, counts, i) for i, t in enumerate(texts)]
    flat = [_main_script(t[a:b], counts, i, a, b) for i, (t, p) in enumerate(zip(texts, spans, strict=True)) for a, b in p]
    got = iter(model.classify(flat))
    out = []
    for i, (t, p) in enumerate(zip(texts, spans, strict=True)):
        rows: list[tuple[int, int, str, float, bool, int]] = []
        judged = [(a, b, counts.of(i, a, b), *next(got)) for a, b in p]
        weight: dict[str, float] = {}
        for _, _, n, lang, conf, _ in judged:
            if lang != "und":
                weight[lang] = weight.get(lang, 0) + n * conf
        main = max(sorted(weight), key=weight.__getitem__) if weight else "und"
        for a, b, n, lang, conf, margin in judged:
            whole = n >= 2 * LEAST_LETTERS - 6 and bool(_final.search(t[max(a, b - 16) : b]))
            if lang == "und" or (lang != main and not (whole and margin >= 2 * LEAST_MARGIN)):
                lang, conf, whole = main, 0.0, False
            if rows and rows[-1][2] == lang:
                s, _, _, k, w, m = rows[-1]
                share = n / max(n + m, 1)
                rows[-1] = (s, b, lang, k * (1 - share) + conf * share, w or whole, m + n)
            else:
                rows.append((a, b, lang, conf, whole, n))
        out.append(rows)
    return out


def _main_script(part: str, counts: Counts, i: int, a: int, b: int) -> str:
    """A piece without the letters of a script that is not its main one: names keep their own letters in foreign sentences."""
    at = counts.starts[i]
    latin, wide = int(counts.latin[at + b] - counts.latin[at + a]), int(counts.wide[at + b] - counts.wide[at + a])
    other = counts.of(i, a, b) - 3 * wide - latin
    if latin and (wide and 3 * wide >= latin or other > 0 and other >= 0.4 * latin):
        return _latin_run.sub(" ", part)
    return part


def training_sample(df: DataFrame, text: str, label: str, key: str, per_language: int = PER_LANGUAGE) -> dict[str, list[str]]:
    """At most ``per_language`` texts of each normalised label, drawn by a hash of the key; UNITS pieces of each text."""
    rows = df.select(F.col(text).alias("t"), normal_label(F.col(label)).alias("l"), F.xxhash64(key).alias("h")).filter("l IS NOT NULL AND char_length(t) >= 40")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # at most one row per known language
    share = F.create_map(*(F.lit(x) for n, c in counts.items() for x in (n, min(1.0, 1.5 * per_language / c)))) if counts else None
    if share is None:
        return {}
    picked = rows.filter(F.pmod("h", F.lit(1_000_003)) < F.lit(1_000_003) * share[F.col("l")]).orderBy("h").limit(2 * per_language * len(counts))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                spans = pieces(t)
                out.append([t[x:y] for x, y in spans[:: max(1, len(spans) // UNITS)][:UNITS]])
            yield pd.DataFrame({"l": b["l"], "h": b["h"], "units": out})

    out: dict[str, list[str]] = {}
    texts: dict[str, int] = {}
    # The driver gets UNITS pieces of each text, not the texts.
    for r in picked.mapInPandas(cut, "l string, h long, units array<string>").orderBy("h").toLocalIterator():
        if texts.get(r["l"], 0) < per_language:
            texts[r["l"]] = texts.get(r["l"], 0) + 1
            out.setdefault(r["l"], []).extend(r["units"])
    return {k: v for k, v in out.items() if texts[k] >= min(LEAST_TEXTS, per_language)}


STRETCH = "start_char int, end_char int, lang string, confidence double, whole boolean, n_letters int"


def language_stretches(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """(keys, stretches): per distinct key the single-language stretches of its text, as an array of STRETCH.

    Null, empty and letterless texts have no stretch. Repeated rows count once. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*keys, F.col(text).alias("_t")).filter(F.col("_t").rlike(r"\p{L}"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                texts = part["_t"].tolist()
                got = stretches(texts, shared.value)
                out = part[keys].copy()
                out["stretches"] = [
                    [{"start_char": s, "end_char": e, "lang": lang, "confidence": c, "whole": w, "n_letters": n} for s, e, lang, c, w, n in rows_]
                    for rows_ in got
                ]
                yield out

    got = rows.mapInPandas(run, f"{kinds}, stretches array<struct<{STRETCH.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>")
    return got.dropDuplicates(keys)


def mixed(stretched: DataFrame) -> DataFrame:
    """Rows whose text holds whole sentences in more than one language."""
    return stretched.filter(F.size(F.array_distinct(F.transform(F.filter("stretches", lambda x: x["whole"] & (x["lang"] != "und")), lambda x: x["lang"]))) > 1)


def book_languages(books: DataFrame, stretched: DataFrame, key: str = "book_id", label: str = "lang_label") -> DataFrame:
    """(key, label, label_code, lang, confidence, wrong): language of most of each book's text against its label.

    Books without text have lang null and are wrong only where their label names no language.
    """
    by = stretched.select(key, F.explode("stretches").alias("s")).groupBy(key, "s.lang").agg(F.sum("s.n_letters").alias("n"), F.sum(F.col("s.n_letters") * F.col("s.confidence")).alias("c"))
    by = by.filter("lang != 'und'").groupBy(key).agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), (F.max("n") / F.sum("n")).alias("share"), F.max_by(F.col("c") / F.col("n"), F.struct("n", "lang")).alias("c"))
    one = books.groupBy(key).agg(F.first(label).alias(label))
    out = one.withColumn("label_code", normal_label(F.col(label))).join(by, key, "left")
    wrong = F.col("label_code").isNull() | F.coalesce(F.col("label_code") != F.col("lang"), F.lit(False))
    return out.select(key, label, "label_code", "lang", (F.col("share") * F.sqrt("c")).alias("confidence"), wrong.alias("wrong"))


def labelled_model(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    samples = training_sample(labelled, text, label, key, per_language)
    if not samples:
        samples = {"und": [" "]}
    return fit(samples)


def found(books: DataFrame, blocks: DataFrame, model: Model) -> DataFrame:
    """(item_kind, item_id, block_index): books with a missing or wrong label, blocks of mixed language."""
    stretched = cut_lineage(language_stretches(blocks, ["book_id", "chapter_id", "block_index"], "text", model))
    wrong = book_languages(books, stretched).filter("wrong").select(F.lit("book").alias("item_kind"), F.col("book_id").alias("item_id"), F.lit(-1).alias("block_index"))
    return wrong.unionByName(mixed(stretched).select(F.lit("block").alias("item_kind"), F.col("chapter_id").alias("item_id"), "block_index").distinct())
