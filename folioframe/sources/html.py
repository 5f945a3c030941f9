"""Block scanning of XHTML and tolerant HTML: headings, paragraphs, list items, quotes, preformatted text, breaks."""

from __future__ import annotations

import html.entities
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that are blocks, that are skipped with what they hold, and that stand for a blank.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dt dd".split())
SKIPPED = frozenset("script style svg head".split())
BLANKS = frozenset({"br", "img"})
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_entity = regex.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z]+);")


def decode_entities(text: str) -> str:
    """Known named and all numeric entities; surrogates, numbers out of range and unknown names stay as they are."""

    def one(m: regex.Match) -> str:
        name = m.group(1)
        if name[0] != "#":
            return ENTITIES.get(name, m.group())
        number = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return m.group() if number > 0x10FFFF or 0xD800 <= number < 0xE000 or number == 0 else chr(number)

    return _entity.sub(one, text)


def simplified(text: str) -> str:
    return " ".join(text.split())


def fragment_text(fragment: str) -> str:
    """Text of a piece of markup: tags gone, line breaks and images as blanks, entities decoded, white space simplified."""
    out = regex.sub(r"(?i)<br\b[^>]*>", " ", fragment)
    out = regex.sub(r"(?is)<img\b[^>]*?\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>", lambda m: f" {m.group(1) or m.group(2) or ''} ", out)
    return simplified(decode_entities(regex.sub(r"(?s)<!--.*?-->|<[^>]*>", "", out)))


class _Scanner(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.blocks: list[tuple[str, str, int, int]] = []
        self.anchors: list[tuple[str, int]] = []
        self.open: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.skip = 0
        self.starts = [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.bytes = None if source.isascii() else [0]
        if self.bytes is not None:
            for c in source:
                self.bytes.append(self.bytes[-1] + len(c.encode()))

    def _at(self) -> int:
        line, column = self.getpos()
        at = self.starts[line - 1] + column
        return at if self.bytes is None else self.bytes[min(at, len(self.bytes) - 1)]

    def _close(self) -> None:
        if self.open:
            tag, start = self.open.pop()
            text = simplified(decode_entities("".join(self.parts)))
            if text:
                self.blocks.append(("heading" if tag[0] == "h" and tag[1:].isdigit() else "paragraph", text, start, self._at()))
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k, v in attrs:
            if k == "id" and v:
                self.anchors.append((v, self._at()))
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "hr" and not self.skip:
            self._close()
            self.blocks.append(("scene_break", "", self._at(), self._at()))
        elif tag in BLOCKS and not self.skip:
            self._close()
            self.open.append((tag, self._at()))
        elif tag in BLANKS and self.open:
            self.parts.append(" " + (dict(attrs).get("alt") or "") + " ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.open and tag == self.open[-1][0] or tag in ("body", "html"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open and not self.skip:
            self.parts.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def scan(source: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[str, int]]]:
    """(blocks, anchors): (type, text, start byte, end byte) of blocks, (id, byte) of anchors. An unclosed block ends with the source."""
    s = _Scanner(source)
    s.feed(source)
    s.close()
    s._close()
    return s.blocks, s.anchors


def xhtml_problem(data: bytes) -> str | None:
    """Why strict XHTML is refused: not UTF-8, a document type declaration, or not well formed."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "InvalidUtf8"
    if regex.search(r"(?i)<!DOCTYPE|<!ENTITY", text):
        return "DocumentType"
    try:
        ElementTree.fromstring(regex.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9a-fA-F]+);)(\w+);", lambda m: f"&#{html.entities.name2codepoint.get(m.group(1), 63)};", text))
    except ElementTree.ParseError:
        return "NotWellFormed"
    return None


BLOCK_SCHEMA = "source_id string, block_index int, block_type string, text string, start_byte bigint, end_byte bigint"


def html_blocks(pages: DataFrame, key: str, body: str) -> DataFrame:
    """BLOCK_SCHEMA rows of tolerant HTML; null and empty pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, *x) for k, t in b.itertuples(index=False) for i, x in enumerate(scan(t)[0])]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    return pages.select(F.col(key).cast("string").alias("k"), F.col(body).alias("t")).filter("t != ''").mapInPandas(run, BLOCK_SCHEMA)
