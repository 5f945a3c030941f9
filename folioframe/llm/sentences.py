"""Problem 4: sentence boundaries across languages and scripts.

Cascading segmentation rule tables: at every place where a sentence may end, ordered pairs of patterns (what is
before, what is after) are tried, those of the text's language first, then those of its script, then those for
all; the first match decides for a break or against one, and nothing else does but a line break. The tables of a
language are made of fixed values: its abbreviations, ordinals and verbs of reporting clauses.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that a name, number or noun follows, so that their stop ends no sentence.
LEADING = {
    "en": "Mr Mrs Ms Messrs Dr Prof Capt Lt Col Gen Sgt Cpl Maj Cmdr Adm Rev Hon Fr St Mt Ft Pres Gov Sen Rep Supt Insp No Nos Vol Vols Ch Chs Fig Figs Eq Sec Art Ed Eds cf e.g i.e eg ie viz approx ca vs v p pp ch vol fig no sec art ed trans Co Bros et Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "Hr Hrn Fr Frl Dr Prof Dipl Ing Nr Nrn Bd Bde Kap Abb Abs Art Aufl S s vgl ca bzw sog Fa d z u o i v ggf evtl inkl exkl geb gest bes Mag Str St Tab Verf Z",
    "fr": "M MM Mme Mmes Mlle Dr Pr Me Mgr St Ste chap Chap p pp env fig Fig cf Cf av ap art vol Vol éd ex c.-à-d n no coll t h min trad",
    "es": "Sr Sra Srta Sres Dr Dra Dres D Da Prof Profa Lic Ing Gral Cap cap pág págs Pág fig Fig núm Núm aprox vol Vol art ej p pp Ud Uds Vd Vds Sto Sta St S n",
    "pt": "Sr Sra Srta Dr Dra Prof Profa Eng pág págs Pág cap Cap fig Fig núm aprox vol Vol art n p pp cf D Sto Sta V ex",
    "it": "Sig sig Sigg Sig.ra sig.ra Dott dott Dott.ssa dott.ssa Prof prof Ing ing Avv avv On on pag Pag pagg cap Cap fig Fig n nn vol Vol art ca es cfr Cfr p pp S St Geom Rag ecc.ma",
    "nl": "Dhr dhr Mevr mevr Mw mw Dr dr Prof prof Ir ir Drs drs Ing ing Mr mr nr Nr blz Blz ca bijv bv resp enz.t hfdst Hfdst fig Fig art vgl p pp St d m o a z t",
    "ru": "г гг гл Гл стр Стр с С см См ср рис Рис т тт п пп им ул д корп кв проф Проф акад доц св о отец тов гр млн млрд тыс руб коп напр табл илл ок обл р",
}
#: Abbreviations that no language has as an ordinary word; they hold whatever the language.
SHARED = frozenset("Mr Mrs Ms Messrs Dr Prof Capt Lt Col Gen Sgt Rev Hon Mme MM Sra Srta Dra Hr Fa sig dott i.e e.g cf cfr approx aprox vs vgl bzw env pág págs núm Nr Bd pp ca ок см рис гл".split())
#: Abbreviations that may also be the last word of a sentence.
FINAL = {
    "en": "a.m p.m etc Jr Sr Ltd Inc Corp Esq al Ph.D M.D B.A M.A U.S U.K Ave Rd Blvd sq ft in oz lb",
    "de": "usw etc u.a u.ä o.ä s.o s.u z.B d.h a.D n.Chr v.Chr Mio Mrd Std Min",
    "fr": "etc J.-C",
    "es": "etc a.m p.m a.C d.C",
    "pt": "etc a.C d.C Ltda",
    "it": "ecc etc a.C d.C",
    "nl": "enz etc e.d e.a o.a m.a.w",
    "ru": "д п др пр э н.э руб коп",
}
#: Words before which a number with a stop is an ordinal.
ORDINAL = {
    "de": "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jh Kapitel Band Stock Klasse Winter Sommer Frühling Herbst Tag Mal Platz",
}
#: Verbs of reporting clauses that follow or precede speech.
SPEECH = {
    "en": "said says asked asks whispered called cried shouted replied answered muttered murmured hissed added told remarked exclaimed yelled demanded insisted continued explained observed began repeated sighed growled laughed snapped warned agreed declared announced wondered inquired responded",
    "de": "sagte sagt fragte fragt rief ruft flüsterte antwortete erwiderte murmelte schrie meinte entgegnete zischte brummte erklärte wiederholte bat befahl",
    "fr": "dit demanda demande répondit murmura cria s'écria s’écria chuchota ajouta répliqua reprit fit déclara expliqua lança souffla répéta",
    "es": "dijo dice preguntó respondió contestó susurró gritó murmuró exclamó añadió replicó repitió explicó",
    "pt": "disse diz perguntou respondeu sussurrou gritou murmurou exclamou acrescentou replicou repetiu explicou",
    "it": "disse dice chiese domandò rispose sussurrò gridò mormorò esclamò aggiunse replicò ripeté urlò",
    "nl": "zei zegt vroeg riep fluisterde antwoordde mompelde schreeuwde voegde herhaalde",
    "ru": "сказал сказала спросил спросила ответил ответила крикнул крикнула прошептал прошептала шепнул шепнула воскликнул воскликнула пробормотал пробормотала добавил добавила",
}
#: Frequent short words by which a language is told from others of its script.
COMMON = {
    "en": "the and of was in to that it with for his her had not he she at from were by they is",
    "de": "der die das und den von zu mit sich ist im dem nicht ein eine auf war des an aus hatte las ging noch",
    "fr": "le la les et des du un une dans est pas que qui au sur ne se l d en de",
    "es": "el la los las y del un una en que no con su al por se más de lo era",
    "pt": "o a os as e do da um uma em que não com seu ao por se mais de no na à",
    "it": "il la lo gli e di un una in che non con suo al per si più del della nel le i",
    "nl": "de het een en van in dat niet met zijn op was te zij hij voor aan bij las",
}

ARTICLES = "the a an he she they i we it der die das er sie ein eine le la les il elle un une el los ella él o os ele ela lo gli de het een hij zij"
_MONTH_SHORT = frozenset("Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split())
#: Abbreviations that are words too: a number or name has to follow.
_WORDS_TOO = frozenset("in no No art ed".split())

_closing = r"\"'”’»›」』）)\]》"
#: A place where a sentence may end: final marks with their closing marks (French ones after a space). Where „ opens quotations, “ closes them.
_mark = r"(?:[.!?…。！？｡।॥؟۔]+(?:[^\S\r\n]+[!?](?![\p{L}\p{N}]))*|(?<=[\p{L}\p{N}])[ \u00a0\u202f][!?]+)"
_candidate = regex.compile(rf"{_mark}(?:[{_closing}]|[ \u00a0\u202f]+[»›])*")
_candidate_low = regex.compile(rf"{_mark}(?:[{_closing}]|[ \u00a0\u202f]+[»›]|(?<=[.!?…])“)*")
#: In Thai also a space.
_candidate_thai = regex.compile(rf"{_candidate.pattern}|(?<=\p{{Thai}})(?=[^\S\r\n]+\p{{Thai}})")
_line = regex.compile(r"[\r\n\u2028\u2029\x0b\x0c\x85]+")

#: Characters before and after a place that patterns reach at most.
HEAD, TAIL = 128, 512

Rule = tuple[bool, str, str]
#: The start of a word with the stops, hyphens and apostrophes in it.
_start = r"(?<![\p{L}\p{M}\p{N}])(?<![\p{L}\p{N}][.\-’'])"
_inner = r"(?:[\p{L}\p{M}\p{N}\-’'][\p{L}\p{M}\p{N}.\-’']{0,20}\.)"
_initials = r"(?:^|[^\p{L}\p{N}])(?:\p{Lu}\.[^\S\r\n]?){0,8}\p{Lu}"
_goes_on = r"\p{Ll}|\p{N}\S*\s*\p{Ll}|[,;:，；：)\]]|[—–-]\s*\p{Ll}|\.\.\."


def _any(words: object) -> str:
    return "(?:" + "|".join(regex.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"  # type: ignore[call-overload]


def _of(table: dict[str, str], language: str) -> set[str]:
    """The words of a language, of all where none is known."""
    return {w for k in ([language] if language else table) for w in table.get(k, "").split()}


def _clause(language: str) -> str:
    """A reporting clause after closed speech: its verb comes first, or after a name or pronoun; none that leads to the speech that follows."""
    verb, lead = _of(SPEECH, language), _of(LEADING, language)
    word = r"\p{L}[\p{L}\p{M}’'-]*+"
    said = rf"{_any(verb)}(?![\p{{L}}\p{{M}}’'-])(?!:)"
    verbless = rf"(?!{_any(verb)}(?![\p{{L}}\p{{M}}’'-]))"
    step = rf"{verbless}(?:{word}(?![.,;:!?…\n])|(?:{_any(lead)}|\p{{L}})\.)[\s—–-]*+"
    first = rf"(?={verbless}(?:\p{{Lu}}|(?i:{_any(ARTICLES.split())})(?![\p{{L}}\p{{M}}’'-])))"
    return rf"[\s—–-]*+(?:{said}|{first}(?:{step}){{1,4}}{said})"


def language_table(language: str) -> list[Rule]:
    """Ordered pairs (break?, before, after) of a language that has abbreviations and reporting clauses of its own."""
    lead, final = _of(LEADING, language), _of(FINAL, language)
    short = {w for w in final if len(w) < 3}
    sure = lead - _WORDS_TOO - _MONTH_SHORT
    sure |= {w[0].upper() + w[1:] for w in lead if len(w) > 1} - _WORDS_TOO - _MONTH_SHORT
    numbered = {w for t in LEADING.values() for w in t.split()}
    rules: list[Rule] = [
        (False, rf"{_start}{_any(SHARED)}\.", r""),
        (False, rf"{_start}{_any(numbered)}\.", r"\s+\p{N}"),
        (False, r"^\s*(?:\p{Lu}\.){0,8}\p{Lu}\.", r""),  # initials at the start of a line
    ]
    if short:
        rules.append((False, rf"{_start}{_any(short)}\.", r"\s+\p{Lu}\."))
    rules += [
        (True, rf"{_start}{_inner}?{_any(final)}\.", rf"\s+(?!{_goes_on})\S"),
        (False, rf"{_start}{_inner}?{_any(final)}\.", r""),
        (False, rf"{_start}{_inner}?{_any(sure)}\.", r""),
    ]
    if lead & _WORDS_TOO:
        rules.append((False, rf"{_start}{_inner}?{_any(lead & _WORDS_TOO)}\.", r"\s+[\p{N}\p{Lu}]"))
    if lead & _MONTH_SHORT:
        rules.append((False, rf"{_start}{_any(lead & _MONTH_SHORT)}\.", r"\s+\p{N}"))
    if language == "de":
        rules += [
            (False, rf"(?<!\b(?:S|Nr|Bd|Kap|Abb|Nrn)\.\s?){_start}\d{{1,2}}\.", rf"\s+{_any(_of(ORDINAL, language))}(?!\p{{L}})"),
            (False, r"\b(?:am|im|vom|zum|beim|der|die|das|dem|den|des|ein|eine|einem|einen|jeder|jeden)\s+\d{1,2}\.", r"\s+\p{L}"),
        ]
    not_i = r"(?<!(?:^|\s)I)" if language == "en" else ""  # the pronoun
    rules.append((False, rf"{_initials}{not_i}\.", r"\s+\p{Lu}"))
    rules.append((False, r"[\"'”’»›」』]", _clause(language)))
    return rules


_shared_rules: list[Rule] = [(False, rf"{_start}{_any(SHARED)}\.", r""), (False, r"^\s*(?:\p{Lu}\.){0,8}\p{Lu}\.", r""), (False, rf"{_initials}\.", r"\s+\p{Lu}")]
#: The tables of languages, of scripts and for all. Languages not named here are made by ``language_table``.
LANGUAGE_RULES: dict[str, list[Rule]] = {
    "zh": [*_shared_rules, (False, r"[”’」』]", r"[^，。！？“”「」\n]{0,14}?(?:说道|问道|答道|喊道|叫道|低声说|轻声说|回答道?|说|问|道|喊|答|叫)(?:[。，！？]|$)")],
    "ja": [*_shared_rules, (False, r"[”’」』]", r"と")],
    "th": [*_shared_rules, (False, rf"{_start}(?:พ\.ศ|ค\.ศ|ดร|นพ|ม\.ร\.ว|น)\.", r"")],
    "hi": [*_shared_rules, (False, rf"{_start}(?:डॉ|प्रो|श्री|सं|पृ)\.", r"")],
    "ar": [*_shared_rules, (False, rf"{_start}(?:د|أ|م|ص|ج)\.", r"\s+\S")],
    **{lang: language_table(lang) for lang in ("", "en", "de", "fr", "es", "pt", "it", "nl", "ru")},
}
SCRIPT_OF = {"zh": "han", "ja": "kana", "th": "thai", "hi": "devanagari", "ar": "arabic"}
SCRIPT_RULES: dict[str, list[Rule]] = {
    "han": [(False, r"…", r"(?![”’」』])"), (False, r"[.!?]", r"\S"), (True, r"[。！？｡!?]\S{0,60}", r"")],
    "kana": [(False, r"…", r""), (False, r"[.!?]", r"\S"), (True, r"[。！？｡!?]\S{0,60}", r"")],
    "thai": [(True, r"[!?。]['\"”’]*", r""), (True, r"\.", r"\s+\S"), (True, r"\p{Thai}", r"[^\S\r\n]+\p{Thai}")],
    "devanagari": [(True, r"[।॥!?]['\"”’]*", r""), (True, r"\.", r"\s+\S")],
    "arabic": [(True, r"[؟!۔]['\"”’»]*", r""), (True, r"\.['\"”’»]*", r"\s+\S")],
}
DEFAULT_RULES: list[Rule] = [
    (False, r"(?<![.!?…])\.[)\]）]", r"(?!\s+[\p{Lu}“\"«„—¿¡‘(])"),
    (True, r"[。！？｡]\S{0,60}", r""),
    (False, r"", r"\S"),  # marks within a word or number
    (False, r"", r"\s*[,;:，；：)\]]"),
    (False, r"", r"\s*[—–-]\s*\p{Ll}"),  # a reporting clause after a dash
    (False, r"", r"\s*\.\.\."),
    (False, r"", r"\s*\p{Ll}"),
    (True, r"", r""),
]


@lru_cache(maxsize=64)
def cascade(language: str) -> list[tuple[bool, regex.Pattern | None, regex.Pattern | None]]:
    """All rules for a language in order. ``before`` is matched backwards from the place, so its length decides its cost."""
    rules = [*LANGUAGE_RULES.get(language, LANGUAGE_RULES[""]), *SCRIPT_RULES.get(SCRIPT_OF.get(language, ""), ()), *DEFAULT_RULES]
    return [(yes, regex.compile(rf"(?r)(?:{before})\Z") if before else None, regex.compile(after) if after else None) for yes, before, after in rules]


_letters = regex.compile(r"(?<![\p{L}.])\p{L}+(?![\p{L}.])")


@lru_cache(maxsize=1)
def _common() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, words in COMMON.items():
        for w in words.split():
            out.setdefault(w, []).append(lang)
    return out


_by_script = [(lang, regex.compile(p)) for lang, p in (("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("th", r"\p{Thai}"), ("ru", r"\p{Cyrillic}"), ("hi", r"\p{Devanagari}"), ("ar", r"\p{Arabic}"))]


def word_scores(text: str) -> dict[str, float]:
    """How many frequent words of each language a text holds; those of several languages count in shares."""
    score: dict[str, float] = {}
    common = _common()
    for w in _letters.findall(text.lower()):
        for lang in (of := common.get(w, ())):
            score[lang] = score.get(lang, 0) + 1 / len(of)
    return score


def guess(text: str, around: dict[str, float] | None = None) -> str:
    """The language whose frequent words a text holds most, or that of its script, or '' where nothing tells.

    The scores of what is around a text, which may be in other languages, count a quarter.
    """
    if not text.isascii():
        for lang, script in _by_script:
            if script.search(text):
                return lang
    score = word_scores(text)
    for lang, n in (around or {}).items():
        score[lang] = score.get(lang, 0) + n / 4
    return max(sorted(score), key=score.__getitem__) if score else ""


def _breaks(line: str, language: str) -> list[int]:
    """Ends of sentences within one line: the first rule that matches a place decides."""
    out, rules, size = [], cascade(language), len(line)
    places = _candidate_thai if language == "th" else _candidate_low if "„" in line else _candidate
    for m in places.finditer(line):
        at = m.end()
        if at >= size:
            continue
        # Patterns see as much as they can reach; what is cut off before is no start of a line.
        head = line[at - HEAD : at] if at > HEAD else line[:at]
        if at > HEAD:
            head = "\0" + head
        tail = line[at : at + TAIL]
        for yes, before, after in rules:
            if (before is None or before.match(head)) and (after is None or after.match(tail)):
                if yes:
                    out.append(at)
                break
    return out


def sentences(text: str | None, language: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in order, without white space at their ends. Null and blank: none."""
    if not text:
        return []
    out = []
    at = 0
    # The one line of a text is all that is around it.
    around = word_scores(text) if not language and _line.search(text) else {}
    for m in [*_line.finditer(text), None]:
        end = m.start() if m else len(text)
        line = text[at:end]
        if line.strip():
            lang = language or guess(line, around)
            cuts = [0, *_breaks(line, lang), len(line)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = line[a:b]
                s = part.strip()
                if s:
                    lead = len(part) - len(part.lstrip())
                    out.append((at + a + lead, at + a + lead + len(s)))
        at = m.end() if m else end
    return _merge_marks(text, out)


def _merge_marks(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Marks alone belong to the sentence before them on their line."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and not regex.search(r"[\p{L}\p{N}]", text[s:e]) and not _line.search(text[out[-1][1] : s]):
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char, sentence): one row per sentence; null, empty and blank texts give none.

    Rows alike in key are split once. Other columns are not read. Positions are 0-based code points, half-open.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t IS NOT NULL AND _t != ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, s, e, t[s:e]) for k, t in b.itertuples(index=False) for s, e in sentences(t)]
            yield pd.DataFrame(out, columns=["_k", "start_char", "end_char", "sentence"])

    out = rows.mapInPandas(run, f"_k {rows.schema['_k'].dataType.simpleString()}, start_char int, end_char int, sentence string")
    return out.withColumnRenamed("_k", key).dropDuplicates([key, "start_char", "end_char"])
