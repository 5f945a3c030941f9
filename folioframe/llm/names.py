"""Problem 5: variant spellings of names.

Suffix blocking: every token of a name (case, marks and scripts folded, nicknames expanded) is indexed under its
suffixes above a minimum length, and under those of its mirror image. A suffix that too many names of a project
share is refined with what the other tokens of a name must have in common where two names match: their initials
under a whole token, the tokens themselves under a part of one. Refined blocks are compared whole, large ones in
salted shares; nothing is left out. Two tokens are spellings of one by their longest-common-subsequence ratio,
with a threshold by length, and a lower one where the rest of the name is the same.

Full names that match form entities (connected components). A part of a name, such as a surname with a title,
initials, a nickname or an acronym, joins an entity only if it fits no other entity of its project.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import cut_lineage, cut_plan

LEAST_SUFFIX = 3
#: Least ratio of two tokens, by the length of the shorter one (the last holds for all longer ones).
LEAST_RATIO = {4: 0.85, 5: 0.8}
#: The same where the rest of two names is equal.
CORROBORATED_RATIO = {3: 0.66, 4: 0.75, 5: 0.8}
#: Names sharing a suffix in a project from which the suffix is refined.
COMMON_SUFFIX = 200
#: Rows of a block that one share of it holds.
SHARE_ROWS = 2000
#: Edges that one step of the local contraction holds.
LOCAL_EDGES = 500_000

#: Titles and forms of address.
TITLES = frozenset("mr mrs ms miss mx dr prof professor capt captain lt lieutenant col colonel gen general sgt sergeant maj major cpl corporal rev reverend hon sir lady lord dame madame mme mlle m monsieur herr frau fr hr don dona sr sra srta dott sig st saint father mother brother sister uncle aunt king queen prince princess count countess baron baroness duke duchess господин госпожа г-н г-жа".split())
#: Words for speakers that are no names.
ROLES = frozenset("narrator voice voices crowd unknown everyone everybody all both nobody someone somebody anonymous stranger guard guards man woman boy girl child children soldier servant people chorus speaker he she they i you we it none null n/a na tbd other others author editor reader 旁白 众人 路人 守卫 未知 他 她 我 你 ナレーター рассказчик голос толпа неизвестный он она".split())
#: Kinds of organisations, each with its abbreviations.
ORG_TYPES = {
    "institute": "inst institut instituto", "society": "soc", "company": "co comp cie", "association": "assoc assn ass", "brotherhood": "bros bro broth brothers", "sisterhood": "sis", "guild": "gld",
    "union": "un", "league": "lg", "corporation": "corp", "limited": "ltd", "incorporated": "inc", "foundation": "fdn found", "university": "univ uni", "department": "dept", "committee": "comm cttee",
    "council": "cncl", "academy": "acad", "federation": "fed", "group": "grp", "order": "ord", "house": "hse", "club": "", "office": "off", "bank": "bk", "press": "",
}
_org_type = {abbr: kind for kind, abbrs in ORG_TYPES.items() for abbr in (kind, *abbrs.split())}
#: Common short forms of given names.
NICKNAMES = """
alexander: alex sasha xander sandy al; augustin: gus augie august; bartholomew: bart barty bartie; benedikt: ben benno benny; benjamin: ben benny; casimir: caz cas kaz casi miro;
charles: charlie chuck; daniel: dan danny; désirée: desi dee; edward: ed eddie ted ned; elisabeth: liz lisa beth betty lizzie elise lisbeth eliza elsie elsa ilse; frederick: fred freddie freddy fritz rick;
henrietta: etta hetty hettie henny hattie harriet; henry: harry hal hank; isadora: isa dora issy izzy; james: jim jimmy jamie; john: jack johnny; josephine: jo josie fina; joseph: joe joey; katharina: kat kate kathy katja kathi katie kitty tina kasia trina;
leopold: leo poldi; magdalena: lena magda maddie; margarethe: greta meg maggie grete gretel margo peggy; mary: molly polly; michael: mike mick; nathaniel: nate nat nathan; nicholas: nick; patricia: pat patty; philippa: pip pippa phil;
richard: rich rick dick; robert: rob bob bobby robin robbie bert; rosalind: roz rosie rose ros linda lindy; samuel: sam; susannah: sue susie suzie zanna susan sanna anna; theodore: theo ted teddy; thomas: tom tommy; tobias: toby tobi; victoria: vicky tori;
wilhelmina: mina willa minna wilma billie; william: will bill billy liam willy; zoë: zo; rené: ren;
дмитрий: дима митя; сергей: серёжа сережа; николай: коля; юрий: юра; александр: саша шура; алексей: алёша леша; михаил: миша; владимир: вова володя; иван: ваня; пётр: петя; анна: аня; мария: маша; екатерина: катя; ольга: оля; татьяна: таня; наталья: наташа
"""
#: Latin letters for Cyrillic ones.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya i i e g".split(" "), strict=True))
#: The characters with which the Latin initials begin in the pinyin order of the first level of GB 2312.
PINYIN_STARTS = "啊a芭b擦c搭d蛾e发f噶g哈h击j喀k垃l妈m拿n哦o啪p期q然r撒s塌t挖w昔x压y匝z"
HONORIFICS = ("姑娘", "先生", "小姐", "老师", "大人", "夫人", "公子", "少爷", "师傅", "同学", "さん", "様", "君", "先輩")

_quoted = regex.compile(r"[“\"«‘'(（]\s*([\p{L}.\- ]+?)\s*[”\"»’')）]")
_han = regex.compile(r"\p{Han}")
_tokens = regex.compile(r"[\p{L}\p{M}]+(?:[’'-][\p{L}\p{M}]+)*\.?|&")
_acronym = regex.compile(r"(?:\p{Lu}\.?){2,6}")
_syllable = regex.compile(r"(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:iang|iong|uang|ang|eng|ing|ong|uai|uan|iao|ian|ai|ei|ao|ou|an|en|in|un|ia|ie|iu|ua|uo|ui|ue|üe|a|o|e|i|u|ü|er)")


def fold(text: str) -> str:
    """Lower case without marks, Cyrillic in Latin letters."""
    out = "".join(CYRILLIC.get(c, c) for c in unicodedata.normalize("NFC", text.lower()))
    return "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c))


def spell(text: str) -> str:
    """A folded word of a person's name, with one spelling of the i sounds that transcriptions write in many ways."""
    out = regex.sub(r"(?<=.)(?:iy|ij|yi|yj|ii|y)(?![aou])", "i", fold(text))
    return regex.sub(r"(?<=[oe])(?:ff|w)$", "v", out) if len(out) > 5 else out


def _nick_table(text: str) -> dict[str, frozenset[str]]:
    table: dict[str, set[str]] = {}
    for part in text.replace("\n", " ").split(";"):
        full, _, nicks = part.partition(":")
        for n in nicks.split():
            table.setdefault(spell(n), set()).add(spell(full.strip()))
    return {k: frozenset(v) for k, v in table.items()}


_nicks = _nick_table(NICKNAMES)


@lru_cache(maxsize=4096)
def pinyin_initial(ch: str) -> str:
    """The initial letter of a character of GB 2312's first level, '' for others."""
    try:
        code = ch.encode("gb2312")
    except UnicodeEncodeError:
        return ""
    if not b"\xb0" <= code[:1] < b"\xd8":
        return ""
    best = ""
    for first, letter in zip(PINYIN_STARTS[::2], PINYIN_STARTS[1::2], strict=True):
        if first.encode("gb2312") <= code:
            best = letter
    return best


@lru_cache(maxsize=1 << 16)
def _form(ch: str) -> str:
    """'t' for a character only of Big5, 's' for one only of GB 2312, '' otherwise."""
    def has(codec: str) -> bool:
        try:
            ch.encode(codec)
        except UnicodeEncodeError:
            return False
        return True

    big, gb = has("big5"), has("gb2312")
    return "t" if big and not gb else "s" if gb and not big else ""


@dataclass(frozen=True)
class Name:
    kind: str  # person, org, han, acronym, '' for none
    tokens: tuple[str, ...]  # folded, in order
    full: bool  # names one entity by itself
    dotted: frozenset[str] = frozenset()  # tokens that stand for longer ones
    nick: str = ""
    org_kind: str = ""


@lru_cache(maxsize=1 << 17)
def parse(raw: str) -> Name:
    """What a spelling consists of; kind '' where it names no person or organisation."""
    text = unicodedata.normalize("NFKC", raw).strip()
    text = regex.sub(r"\s+", " ", text)
    if not regex.search(r"\p{L}", text) or text.lower() in ROLES or regex.match(r"(?:the|a|an|some|der|die|das|le|la|el) \p{Ll}", text):
        return Name("", (), False)
    if _han.search(text):
        core = text.replace(" ", "").replace("·", "")
        for h in HONORIFICS:
            if core.endswith(h) and len(core) > len(h):
                return Name("han", (core[: -len(h)],), False)
        if core in ROLES:
            return Name("", (), False)
        if len(core) == 2 and core[0] in "老小阿大":
            return Name("han", (core[1],), False, nick=core[0])
        return Name("han", (core,), len(core) >= 2)
    nick = ""
    if m := _quoted.search(text):
        if regex.search(r"\p{L}", text[: m.start()] + text[m.end() :]):
            nick = spell(m.group(1).strip(" ."))
            text = text[: m.start()] + " " + text[m.end() :]
    bare = text.replace(" ", "")
    if _acronym.fullmatch(bare) and bare.isupper() and len(bare.replace(".", "")) >= 3 and (len(text.split()) == 1 or "." in text):
        return Name("acronym", (fold(bare.replace(".", "")),), False)
    found = _tokens.findall(text)
    words = [(fold(t.rstrip(".")), t.endswith("."), t) for t in found if t != "&"]
    kinds = [_org_type[w] for w, dot, _ in words if w in _org_type and (dot or len(w) > 3)]
    kinds += [_org_type[w] for w, _, _ in words if w in ("co", "ltd", "inc") and not kinds]
    if kinds:
        tokens = tuple(_org_type.get(w, w) for w, _, _ in words if w not in ("the", "of", "and", "for", "von", "de", "der"))
        return Name("org", tokens, len(tokens) >= 2, frozenset(_org_type.get(w, w) for w, dot, _ in words if dot and w not in _org_type), org_kind=kinds[0])
    small = ("the", "of", "and")
    plain = [(spell(t.rstrip(".")), dot, t) for w, dot, t in words if w not in TITLES and w not in small] or [(spell(t.rstrip(".")), d, t) for w, d, t in words if w not in small]
    tokens: list[str] = []
    dotted: set[str] = set()
    for w, dot, t in plain:
        if len(t) == 2 and t.isupper() and len(plain) > 1 and not dot and not all(x.isupper() for _, _, x in plain):
            tokens += [w[0], w[1]]  # initials written together
        else:
            tokens.append(w)
            if dot or len(w) == 1:
                dotted.add(w)
    whole = [t for t in tokens if len(t) > 1 and t not in dotted]
    return Name("person", tuple(tokens), len(whole) >= 2, frozenset(dotted), nick)


@lru_cache(maxsize=1 << 16)
def _places(token: str) -> dict[str, int]:
    """For each letter of a token, the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(token):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over the sum of the lengths."""
    if a == b:
        return 1.0
    # A bit of the row is 0 where the length grows, so that a letter of b takes one step for all of a.
    every = row = (1 << len(a)) - 1
    places = _places(a)
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & every
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=1 << 18)
def near(a: str, b: str, corroborated: bool = False) -> bool:
    """Whether two tokens are spellings of one: by their longest-common-subsequence ratio."""
    if a == b:
        return True
    table = CORROBORATED_RATIO if corroborated else LEAST_RATIO
    short, long = sorted((len(a), len(b)))
    least = table.get(min(short, max(table)))
    # No subsequence is longer than the shorter token.
    return least is not None and 2 * short >= least * (short + long) and lcs_ratio(a, b) >= least


def formal(token: str) -> frozenset[str]:
    return _nicks.get(token, frozenset())


@lru_cache(maxsize=256)
def _nicks_near(size: int) -> list[tuple[str, float, frozenset[str]]]:
    """Short forms whose length a token of this size can be near to, each with its least ratio."""
    least = lambda n: CORROBORATED_RATIO[min(n, size, max(CORROBORATED_RATIO))]
    return [(n, least(len(n)), full) for n, full in _nicks.items() if len(n) >= 3 and 2 * min(len(n), size) >= least(len(n)) * (len(n) + size)]


@lru_cache(maxsize=1 << 16)
def spelled_out(token: str) -> frozenset[str]:
    """Given names that a token may stand for: itself, what it is short for, and that of a short form with a typing error."""
    out = {token} | formal(token)
    if len(token) >= 3:
        out |= {f for n, least, full in _nicks_near(len(token)) if lcs_ratio(n, token) >= least for f in full}
    return frozenset(out)


def _given(a: str, b: str, a_short: bool, b_short: bool, exact_rest: bool) -> bool:
    """Whether two given names may be the same: equal, nickname, initial, abbreviated, or with a typing error."""
    if a == b or b in formal(a) or a in formal(b) or formal(a) & formal(b):
        return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0] or exact_rest and any(x[0] == (a if len(a) == 1 else b) for x in formal(b if len(a) == 1 else a))
    if (a_short and any(x.startswith(a) for x in {b, *formal(b)})) or (b_short and any(x.startswith(b) for x in {a, *formal(a)})):
        return True
    if near(a, b):
        return True
    if exact_rest:
        if near(a, b, True):
            return True
        x, y = spelled_out(a), spelled_out(b)
        return b in x or a in y or bool(b_short and any(f.startswith(b) for f in x)) or bool(a_short and any(f.startswith(a) for f in y))
    return False


def _surname(n: Name) -> str:
    """The token of a name without a whole given name that is its surname, '' if there is none."""
    whole = [t for t in n.tokens if len(t) > 1 and t not in n.dotted]
    return whole[-1] if whole else ""


def _parts(x: Name, y: Name) -> str:
    """Two parts: 'same' if alike, 'part_a' or 'part_b' if that one is a surname that the other one has with a shortened given name."""
    if sorted(x.tokens) == sorted(y.tokens):
        return "same"
    p, q = _surname(x), _surname(y)
    if not p or not q or not (p == q or near(p, q)):
        return ""
    g, h = [t for t in x.tokens if t != p], [t for t in y.tokens if t != q]
    if g and h:
        return "same" if _given(g[0], h[0], g[0] in x.dotted, h[0] in y.dotted, p == q) else ""
    return "part_a" if h else "part_b" if g else "same"


def _persons(x: Name, y: Name) -> str:
    """'same' for two full names of one person, 'part' where one is a part that fits the other, '' otherwise."""
    a, b = (x, y) if x.full or not y.full else (y, x)
    if not a.full:
        return _parts(x, y)
    whole = [t for t in a.tokens if len(t) > 1 and t not in a.dotted]
    # In the other order a surname stands where a given name is expected, so typing errors are held to be others' names.
    return _person(a, whole[0], whole[-1], b, True) or _person(a, whole[-1], whole[0], b, False)


def _person(a: Name, first: str, last: str, b: Name, loose: bool) -> str:
    middles = [t for t in a.tokens if t not in (first, last)]
    short = lambda t: t in b.dotted
    firsts = {first, *((a.nick,) if a.nick else ())}
    if b.full:
        for g, s in ((b.tokens[0], b.tokens[-1]), (b.tokens[-1], b.tokens[0])):
            if len(s) == 1 or s in b.dotted and len(g) == 1:
                continue
            rest = [t for t in b.tokens if t not in (g, s)]
            if rest and middles and rest[0][0] != middles[0][0]:
                continue
            gs = {g, *((b.nick,) if b.nick else ())}
            for p in firsts:
                for q in gs:
                    if s == last and _given(p, q, p in a.dotted, short(q), loose):
                        return "same"
                    if near(s, last) and (p == q or q in formal(p) or p in formal(q)):
                        return "same"
        return ""
    if len(b.tokens) == 1:
        t = b.tokens[0]
        if t == last or near(t, last):
            return "part"
        return "part" if any(t == p or p in formal(t) or not formal(t) and near(t, p) for p in firsts) else ""
    g, s = b.tokens[0], b.tokens[-1]
    for p, q in ((g, s), (s, g)):  # given name, surname in either order, of which one is shortened
        if (q == last or near(q, last) or len(q) == 1 and q == last[0] or q in b.dotted and last.startswith(q)) and any(
            _given(f, p, False, p in b.dotted, loose and len(q) > 1) for f in firsts
        ):
            return "part" if len(p) == 1 or len(q) == 1 or p in b.dotted or q in b.dotted else "same"
    return ""


def _orgs(x: Name, y: Name) -> str:
    def eq(t: str, u: str) -> bool:
        if t in x.dotted and u.startswith(t) or u in y.dotted and t.startswith(u):
            return True
        return near(t, u)

    small, large = (x, y) if len(x.tokens) <= len(y.tokens) else (y, x)
    left = list(large.tokens)
    typos = 0
    for t in small.tokens:
        hit = next((u for u in left if (eq(t, u) if small is x else eq(u, t))), None)
        if hit is None:
            return ""
        typos += hit != t and not (t in x.dotted | y.dotted or hit in x.dotted | y.dotted)
        left.remove(hit)
    if typos > (1 if len(small.tokens) < 3 else 2):
        return ""
    if not left:
        return "same"
    return "part" if len(small.tokens) >= 2 and left == [large.org_kind] else ""


def _initials(tokens: tuple[str, ...]) -> str:
    return "".join(t[0] for t in tokens)


def _pinyin(latin: Name, han: str) -> bool:
    """Whether a Latin name may spell a Han one: as many syllables with the same initials, surname first or last."""
    if len(latin.tokens) != 2 or any(len(t) == 1 for t in latin.tokens):
        return False
    parts = [pinyin_letters(t) for t in latin.tokens]
    if not all(parts):
        return False
    for order in (parts, parts[::-1]):
        letters = [c for p in order for c in p]
        if len(letters) == len(han) and len(order[0]) == 1:
            known = [pinyin_initial(h) for h in han]
            if all(not k or k == c for k, c in zip(known, letters, strict=True)) and any(known):
                return True
    return False


def _hans(a: str, b: str, forms: dict[str, str]) -> bool:
    """Equal but for traditional and simplified forms of characters."""
    return len(a) == len(b) and all(p == q or forms.get(p) == q or forms.get(q) == p for p, q in zip(a, b, strict=True))


def form_pairs(a: str, b: str, forms: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(traditional, simplified) characters that two full names of one length may show to belong together, given those known."""
    x, y, known = parse(a), parse(b), forms or {}
    if x.kind != "han" or y.kind != "han" or not (x.full and y.full) or len(x.tokens[0]) != len(y.tokens[0]):
        return []
    for p, q in ((x.tokens[0], y.tokens[0]), (y.tokens[0], x.tokens[0])):
        pairs = [(c, d) for c, d in zip(p, q, strict=True) if c != d and known.get(c) != d]
        if pairs and all(_form(c) == "t" and _form(d) != "t" for c, d in pairs):
            return pairs
    return []


def relate(a: str, b: str, forms: dict[str, str] | None = None) -> str:
    """'same': two full spellings of one entity, or two equal parts; 'part': one is a part that fits the other; '' neither."""
    x, y, forms = parse(a), parse(b), forms or {}
    if not x.kind or not y.kind:
        return ""
    kinds = {x.kind, y.kind}
    if kinds == {"han"}:
        p, q = x.tokens[0], y.tokens[0]
        if x.full and y.full and len(p) == len(q):
            return "same" if _hans(p, q, forms) else ""
        if not x.full and not y.full:
            return "same" if x == y else ""
        short, name = (x, q) if len(p) < len(q) or not x.full else (y, p)
        s = short.tokens[0]
        if short.nick == "老":
            return "part" if _hans(s, name[: len(s)], forms) else ""
        if len(s) >= len(name):
            return "part" if not short.full and _hans(s, name, forms) else ""
        return "part" if _hans(s, name[len(name) - len(s) :], forms) else ""
    if "han" in kinds:
        latin, han = (x, y) if y.kind == "han" else (y, x)
        return "part" if latin.kind == "person" and han.full and _pinyin(latin, han.tokens[0]) else ""
    if kinds == {"acronym"}:
        return "same" if x.tokens == y.tokens else ""
    if "acronym" in kinds:
        short, org = (x, y) if x.kind == "acronym" else (y, x)
        if org.kind != "org":
            return ""
        tokens = [t for t in org.tokens if t != org.org_kind]
        return "part" if short.tokens[0] in (_initials(org.tokens), _initials((*tokens, org.org_kind)), _initials((org.org_kind, *tokens)), _initials((*tokens[::-1], org.org_kind))) else ""
    if "org" in kinds:
        return _orgs(x, y) if kinds == {"org"} or len((y if x.kind == "org" else x).tokens) >= 2 else ""
    return _persons(x, y)


def form_keys(raw: str, forms: dict[str, str]) -> list[tuple[bool, str]]:
    """(traditional?, key) under which full Han names of one person in two forms meet: the name with characters masked.

    A name with traditional characters has those masked whose form is not known; another one has every mask that leaves a character.
    """
    n = parse(raw)
    t = "".join(forms.get(c, c) for c in n.tokens[0]) if n.kind == "han" and n.full else ""
    if not 2 <= len(t) <= 5:
        return []
    own = [_form(c) == "t" for c in t]
    if any(own):
        return [] if all(own) else [(True, "".join("_" if x else c for x, c in zip(own, t, strict=True)))]
    return [(False, "".join("_" if m >> i & 1 else c for i, c in enumerate(t))) for m in range(1, 2 ** len(t) - 1)]


def pinyin_letters(t: str) -> list[str]:
    """The initials of the syllables of a token that is nothing but pinyin syllables, or none."""
    got, at = [], 0
    while at < len(t):
        m = _syllable.match(t, at)
        if not m or m.end() == at:
            return []
        got.append(t[at])
        at = m.end()
    return got


def keys(raw: str, forms: dict[str, str] | None = None) -> list[tuple[str, bool, list[str]]]:
    """(suffix, asks, refinements) under which a spelling is indexed.

    Of two names in a block one at least asks for the other. Where a block is refined, names meet that have a
    refinement in common; one without any meets the whole block. A refinement with ~ is asked for by names only
    that are not full.
    """
    n = parse(raw)
    if n.kind == "han":
        t = "".join((forms or {}).get(c, c) for c in n.tokens[0])
        if not n.full:
            return [("=" + t, True, [])]
        # Full names match as wholes; under their beginnings and ends they wait for parts.
        out = [("=" + t, True, [])] + [("=" + x, False, []) for x in sorted({t[i:] for i in range(1, len(t))} | {t[:i] for i in range(1, len(t))})]
        initials = "".join(pinyin_initial(c) or "?" for c in n.tokens[0])
        return out + ([("@" + initials, False, [])] if initials.strip("?") else [])
    if n.kind == "acronym":
        return [(f"*{n.tokens[0]}*", True, [])]
    tokens = {*n.tokens, *((n.nick,) if n.nick else ())}
    stands = {t: spelled_out(t) if n.kind == "person" else frozenset({t}) for t in tokens}
    found: dict[str, set[str]] = {}
    bare: set[str] = set()
    for t in tokens:
        others = {x for u in tokens if u != t for x in stands[u]}
        initials = {x[0] for x in others}
        # Under a part of a token two full names have another token in common.
        part = {f"={x}" for x in others} | {f"~{x}" for x in initials} if n.full and n.kind == "person" else {f"~{x}" for x in initials} if n.kind == "person" else initials
        for form in stands[t]:
            own = {(s[i:], i > 0 or s != form) for s in (form, form[::-1]) for i in range(len(s) - max(2, min(LEAST_SUFFIX, len(s))) + 1)}
            if 4 <= len(form) <= 6:  # a letter in the middle of these leaves no long suffix
                own |= {(f"{form[0]}~{form[-2:]}", True), (f"{form[:2]}~{form[-1]}", True)}
            for suffix, partial in own:
                found.setdefault(suffix, set()).update(part if partial else part | initials)
                if not others:
                    bare.add(suffix)
    out = [(s, True, [] if s in bare else sorted(more)) for s, more in sorted(found.items())]
    if n.kind == "org":
        rest = tuple(t for t in n.tokens if t != n.org_kind)
        out += [(f"*{x}*", False, []) for x in sorted({_initials(n.tokens), _initials((*rest, n.org_kind)), _initials((n.org_kind, *rest)), _initials((*rest[::-1], n.org_kind))})]
    parts = [pinyin_letters(t) for t in n.tokens if len(t) > 1] if n.kind == "person" and len(n.tokens) == 2 else []
    if len(parts) == 2 and all(parts):
        spelled = {"".join(c for p in order for c in p) for order in (parts, parts[::-1]) if len(order[0]) == 1}
        # Any of a Han name's characters may have no known initial.
        out += [("@" + x, True, []) for x in sorted({"".join("?" if m >> i & 1 else c for i, c in enumerate(x)) for x in spelled if len(x) <= 5 for m in range(2 ** len(x) - 1)})]
    return out


_KEYED = "project_id string, name string, suffix string, asks boolean, more array<string>"
_RELATED = "project_id string, name_a string, name_b string, how string, a_full boolean, b_full boolean"


def distinct_names(tables: list[tuple[DataFrame, str]], project: str = "project_id") -> DataFrame:
    """(project_id, name): every spelling of a project once, exactly as stored; null, blank and null-project rows left out."""
    out = None
    for df, column in tables:
        part = df.select(F.col(project).cast("string").alias("project_id"), F.col(column).alias("name")).filter("project_id IS NOT NULL AND trim(name) != ''").distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def spread(names: DataFrame) -> DataFrame:
    """The names over as many tasks as there are cores at least: indexing is dear where their table is small."""
    return names.repartition(max(names.rdd.getNumPartitions(), names.sparkSession.sparkContext.defaultParallelism))


def block_pairs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct pairs of rows (project_id, name, block, asks) of a block of which one asks; ``sizes``: (block, n).

    A block is compared in shares of SHARE_ROWS names that wait, each share with all names that ask.
    """
    shares = sizes.select("block", F.ceil(F.col("n") / SHARE_ROWS).cast("int").alias("k"))
    rows = rows.join(shares, "block")
    b = rows.select("project_id", "block", F.col("name").alias("y"), F.pmod(F.xxhash64("name"), "k").cast("int").alias("share"))
    a = rows.filter("asks").select("project_id", "block", F.col("name").alias("x"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("share"))
    met = a.join(b, ["project_id", "block", "share"]).filter("x != y")
    return met.select("project_id", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b")).distinct()


def candidate_pairs(names: DataFrame, forms: dict[str, str] | None = None) -> DataFrame:
    """Distinct (project_id, name_a, name_b), name_a < name_b, that share an indexed suffix."""
    shared = names.sparkSession.sparkContext.broadcast(forms or {})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, n, s, a, m) for p, n in b[["project_id", "name"]].itertuples(index=False) if parse(n).kind for s, a, m in keys(n, shared.value)]
            yield pd.DataFrame(out, columns=["project_id", "name", "suffix", "asks", "more"])

    # Blocks are moved as hashes; a pair that only shares a hash is compared in vain, nothing else.
    keyed = spread(names).mapInPandas(index, _KEYED).select("project_id", "name", "asks", "more", F.xxhash64("project_id", "suffix").alias("block"))
    keyed = cut_lineage(keyed)
    met = F.count("*").alias("n"), F.max("asks").alias("asked")
    sizes = cut_lineage(keyed.groupBy("block").agg(*met).filter("n > 1 AND asked").select("block", "n"))
    small, common = sizes.filter(F.col("n") <= COMMON_SUFFIX), sizes.filter(F.col("n") > COMMON_SUFFIX)
    plain = block_pairs(keyed.select("project_id", "name", "block", "asks"), small)
    if common.isEmpty():
        return plain
    held = cut_lineage(keyed.join(common.select("block"), "block"))
    # Names without refinements ask the whole block, the others those that have a refinement in common.
    whole = block_pairs(held.select("project_id", "name", "block", (F.col("asks") & (F.size("more") == 0)).alias("asks")), common)
    full_only = F.col("cls").startswith("~") & F.array_contains(F.transform("more", lambda x: x.startswith("=")), True)
    fine = held.filter("size(more) > 0").select("project_id", "name", "asks", "block", "more", F.explode("more").alias("cls"))
    fine = fine.select("project_id", "name", (F.col("asks") & ~full_only).alias("asks"), F.xxhash64("block", "cls").alias("block"))
    refined = block_pairs(fine, fine.groupBy("block").agg(*met).filter("n > 1 AND asked").select("block", "n"))
    return plain.unionByName(whole).unionByName(refined).distinct()


def character_forms(names: DataFrame) -> dict[str, str]:
    """The simplified form of each traditional character, learned from full names of the same projects.

    Forms once known show those of the characters beside them, so it is repeated until none is added. There is at
    most one entry per character.
    """
    han = cut_lineage(names.filter(F.col("name").rlike(r"\p{IsHan}")))
    known: dict[str, str] = {}
    while not han.isEmpty():
        forms = dict(known)

        def index(batches: Iterator[pd.DataFrame], forms: dict[str, str] = forms) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(p, n, t, k) for p, n in b[["project_id", "name"]].itertuples(index=False) for t, k in form_keys(n, forms)]
                yield pd.DataFrame(out, columns=["project_id", "name", "traditional", "key"])

        def evidence(batches: Iterator[pd.DataFrame], forms: dict[str, str] = forms) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [x for p, q in b[["name_a", "name_b"]].itertuples(index=False) for x in form_pairs(p, q, forms)]
                yield pd.DataFrame(out, columns=["t", "s"])

        keyed = spread(han).mapInPandas(index, "project_id string, name string, traditional boolean, key string")
        a = keyed.filter("traditional").select("project_id", "key", F.col("name").alias("name_a"))
        b = keyed.filter("NOT traditional").select("project_id", "key", F.col("name").alias("name_b"))
        pairs = a.join(b, ["project_id", "key"]).select("project_id", "name_a", "name_b").distinct()
        counts = pairs.mapInPandas(evidence, "t string, s string").groupBy("t", "s").agg(F.count("*").alias("n"))
        best = counts.groupBy("t").agg(F.max_by("s", F.struct("n", "s")).alias("s"))
        new = {r["t"]: r["s"] for r in best.collect() if r["t"] not in known}
        if not new:
            break
        known |= new
    return known


def related_pairs(names: DataFrame) -> DataFrame:
    """Pairs of names that belong together, with how: 'same' or 'part'."""
    known = character_forms(names)
    pairs = candidate_pairs(names, known)
    forms = names.sparkSession.sparkContext.broadcast(known)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, x, y in b[["project_id", "name_a", "name_b"]].itertuples(index=False):
                if how := relate(x, y, forms.value):
                    out.append((p, x, y, how, parse(x).full, parse(y).full))
            yield pd.DataFrame(out, columns=["project_id", "name_a", "name_b", "how", "a_full", "b_full"])

    return pairs.mapInPandas(compare, _RELATED)


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (project_id, u, v) as stars: each node with the least one that the edges at hand connect it with."""

    def stars(edges: list[tuple[str, str, str]]) -> pd.DataFrame:
        up: dict[tuple[str, str], tuple[str, str]] = {}

        def root(x: tuple[str, str]) -> tuple[str, str]:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for p, u, v in edges:
            a, b = sorted((root((p, u)), root((p, v))))
            up[b] = a
        return pd.DataFrame([(*x, root(x)[1]) for x in list(up) if root(x) != x], columns=["project_id", "u", "v"])

    held: list[tuple[str, str, str]] = []
    for b in batches:
        held += b[["project_id", "u", "v"]].itertuples(index=False, name=None)
        if len(held) >= LOCAL_EDGES:
            yield stars(held)
            held = []
    yield stars(held)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v only, which is no u itself."""
    ends = edges.select("project_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("hub")), F.struct(F.col("v").alias("node"), F.lit(None).cast("string").alias("hub")))).alias("e"))
    seen = ends.groupBy("project_id", "e.node").agg(F.min("e.hub").alias("a"), F.max("e.hub").alias("z"), F.max(F.col("e.hub").isNull()).alias("is_hub"))
    return seen.filter("a != z OR a IS NOT NULL AND is_hub").isEmpty()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, name, entity): the least name that each name is connected with.

    Edges are contracted to stars within partitions, then by rounds of large and small stars until nothing
    changes, which takes a number of rounds logarithmic in the length of the longest chain.
    """
    kind = "project_id string, u string, v string"
    e = edges.select("project_id", F.col("name_a").alias("u"), F.col("name_b").alias("v")).filter("u != v").distinct()
    # A project's edges are contracted together, those of a large one in several shares.
    many = e.groupBy("project_id").agg(F.ceil(F.count("*") / LOCAL_EDGES).cast("int").alias("k"))
    e = e.join(many, "project_id").repartition("project_id", F.pmod(F.xxhash64("u"), "k")).select("project_id", "u", "v")
    e = cut_lineage(e.mapInPandas(_contract, kind))
    while not _are_stars(e):
        e = e.distinct()
        both = e.unionByName(e.select("project_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("project_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, ["project_id", "u"]).select("project_id", F.col("v").alias("u"), F.col("m").alias("v"))
        hub = large.groupBy("project_id", "u").agg(F.min("v").alias("m"))
        small = large.join(hub, ["project_id", "u"])
        small = small.filter("v != m").select("project_id", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hub.select("project_id", "u", F.col("m").alias("v")))
        e = cut_plan(small.distinct())
    return nodes.join(e.select("project_id", F.col("u").alias("name"), F.col("v").alias("entity")), ["project_id", "name"], "left").select("project_id", "name", F.coalesce("entity", "name").alias("entity"))


def link(names: DataFrame) -> DataFrame:
    """(project_id, name, entity): spellings of a project that mean the same have the same entity.

    Roles, pronouns and names without letters stay alone, as does a part of a name that fits several entities.
    """
    related = cut_lineage(related_pairs(names))
    full_edges = related.filter("how = 'same' AND a_full AND b_full")
    entities = components(names, full_edges)
    part = related.filter("how = 'part' AND a_full != b_full OR how = 'part' AND a_full AND b_full OR how = 'same' AND a_full != b_full")
    short = F.when(F.col("a_full") & ~F.col("b_full"), F.col("name_b")).when(~F.col("a_full") & F.col("b_full"), F.col("name_a"))
    # Where both could stand alone (a name without its kind of organisation, a name in Latin letters), the part is the one with fewer links.
    degree = part.filter("a_full AND b_full").select("project_id", F.explode(F.array("name_a", "name_b")).alias("name")).groupBy("project_id", "name").agg(F.count("*").alias("n"))
    da, db = degree.select("project_id", F.col("name").alias("name_a"), F.col("n").alias("na")), degree.select("project_id", F.col("name").alias("name_b"), F.col("n").alias("nb"))
    part = part.join(da, ["project_id", "name_a"], "left").join(db, ["project_id", "name_b"], "left")
    short = F.coalesce(short, F.when(F.col("na") >= F.col("nb"), F.col("name_a")).otherwise(F.col("name_b")))
    both = F.col("a_full") & F.col("b_full")
    part = cut_lineage(part.select("project_id", short.alias("name"), F.when(short == F.col("name_a"), F.col("name_b")).otherwise(F.col("name_a")).alias("whole"), both.alias("both")))

    def fits_of(rows: DataFrame, known: DataFrame) -> DataFrame:
        return rows.join(known.withColumnRenamed("name", "whole"), ["project_id", "whole"]).groupBy("project_id", "name").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"))

    # Parts that could stand alone are placed first, so that they don't count as entities of their own for the others.
    first = cut_lineage(fits_of(part.filter("both"), entities))
    merged = components(names, full_edges.select("project_id", "name_a", "name_b").unionByName(first.filter("n = 1").select("project_id", F.col("name").alias("name_a"), F.col("entity").alias("name_b"))))
    to = first.unionByName(fits_of(part.filter("NOT both"), merged))
    placed = to.filter("n = 1").select("project_id", "name", F.col("entity").alias("whole"))
    lost = to.filter("n > 1").select("project_id", "name")
    alike = related.filter("how = 'same' AND NOT a_full AND NOT b_full").select("project_id", "name_a", "name_b")
    bare = related.filter("how IN ('part_a', 'part_b')").select("project_id", F.expr("if(how = 'part_a', name_a, name_b)").alias("name"), F.expr("if(how = 'part_a', name_b, name_a)").alias("whole"))
    for side in ("name_a", "name_b"):
        alike = alike.join(lost.withColumnRenamed("name", side), ["project_id", side], "left_anti")
    # A surname that fits no full name may still fit one shortened name, or several that are alike.
    bare = bare.join(to.select("project_id", "name"), ["project_id", "name"], "left_anti")
    second = components(names, alike)
    fits = bare.join(second.withColumnRenamed("name", "whole"), ["project_id", "whole"]).groupBy("project_id", "name").agg(F.count_distinct("entity").alias("n"), F.min("whole").alias("whole")).filter("n = 1")
    placed = placed.unionByName(fits.select("project_id", "name", "whole"))
    edges = full_edges.select("project_id", "name_a", "name_b").unionByName(placed.select("project_id", F.col("name").alias("name_a"), F.col("whole").alias("name_b"))).unionByName(alike)
    return components(names, edges)


def same_entity_pairs(linked: DataFrame) -> DataFrame:
    """(project_id, name_a, name_b): two spellings of an entity, name_a < name_b. An entity has a few spellings, each once."""
    linked = cut_lineage(linked)
    many = linked.groupBy("project_id", "entity").agg(F.count("*").alias("n")).filter("n > 1").select("project_id", "entity")
    rows = linked.join(many, ["project_id", "entity"])
    a, b = rows.withColumnRenamed("name", "name_a"), rows.withColumnRenamed("name", "name_b")
    return a.join(b, ["project_id", "entity"]).filter("name_a < name_b").select("project_id", "name_a", "name_b")
