"""MOBI books: record table, headers, PalmDOC text, blocks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from folioframe.sources import html
from folioframe.sources.epub import BadBook

MAX_SOURCE = MAX_TEXT = 512 << 20
BLOCKS = "source_id string, title string, authors array<string>, language string, chapter_index int, block_index int, block_type string, text string, start_byte bigint, end_byte bigint, error string"
#: Code pages of the header.
ENCODINGS = {1252: "cp1252", 65001: "utf-8"}


def records(data: bytes) -> list[bytes]:
    """The records of a PalmDB file, whose offsets must strictly increase."""
    if len(data) < 78 or len(data) > MAX_SOURCE or data[60:68] != b"BOOKMOBI":
        raise BadBook("NotABook")
    (n,) = struct.unpack_from(">H", data, 76)
    if n == 0 or len(data) < 78 + 8 * n:
        raise BadBook("InvalidRecords")
    at = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(n)] + [len(data)]
    if at[0] < 78 + 8 * n or any(a >= b for a, b in zip(at, at[1:], strict=False)):
        raise BadBook("InvalidRecords")
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def header(first: bytes) -> dict:
    """Compression, text records, encoding, trailers and EXTH values of the first record."""
    if len(first) < 16:
        raise BadBook("InvalidHeader")
    compression, _, length, count, _, encryption, _ = struct.unpack_from(">HHIHHHH", first, 0)
    if encryption:
        raise BadBook("Encrypted")
    if compression not in (1, 2):
        raise BadBook("UnsupportedCompression")
    if first[16:20] != b"MOBI" or len(first) < 0x84:
        raise BadBook("InvalidHeader")
    size, _, codepage = struct.unpack_from(">III", first, 20)
    if codepage not in ENCODINGS:
        raise BadBook("UnsupportedEncoding")
    flags = struct.unpack_from(">I", first, 0x80)[0]
    trailers = struct.unpack_from(">H", first, 0xF2)[0] if size >= 0xE4 and len(first) >= 0xF4 else 0
    exth: dict[int, list[bytes]] = {}
    at = 16 + size
    if flags & 0x40 and first[at : at + 4] == b"EXTH":
        (n,) = struct.unpack_from(">I", first, at + 8)
        at += 12
        for _ in range(n):
            if at + 8 > len(first):
                raise BadBook("InvalidHeader")
            kind, size_ = struct.unpack_from(">II", first, at)
            if size_ < 8 or at + size_ > len(first):
                raise BadBook("InvalidHeader")
            exth.setdefault(kind, []).append(first[at + 8 : at + size_])
            at += size_
    return {"compression": compression, "length": length, "count": count, "encoding": ENCODINGS[codepage], "trailers": trailers, "exth": exth}


def strip_trailers(record: bytes, flags: int) -> bytes:
    """A text record without its trailing entries, whose sizes are backward variable-length numbers."""
    for bit in range(15, 0, -1):
        if flags & (1 << bit):
            size = shift = 0
            for b in reversed(record[-4:]):
                size |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            if not 0 < size <= len(record):
                raise BadBook("InvalidTrailer")
            record = record[:-size]
    if flags & 1 and record:
        record = record[: len(record) - (record[-1] & 3) - 1]
    return record


def palmdoc(data: bytes, limit: int = MAX_TEXT) -> bytes:
    """PalmDOC LZ77: literals, short runs, back references into the last 2047 bytes, blank and letter."""
    out = bytearray()
    i = 0
    while i < len(data):
        b = data[i]
        i += 1
        if 1 <= b <= 8:
            if i + b > len(data):
                raise BadBook("InvalidCompression")
            out += data[i : i + b]
            i += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((32, b ^ 0x80))
        else:
            if i >= len(data):
                raise BadBook("InvalidCompression")
            pair = (b << 8 | data[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise BadBook("InvalidCompression")
            for _ in range(n):
                out.append(out[-back])
        if len(out) > limit:
            raise BadBook("TooLarge")
    return bytes(out)


def parse(data: bytes, locator: str) -> dict:
    recs = records(data)
    head = header(recs[0])
    if head["count"] >= len(recs):
        raise BadBook("InvalidRecords")
    raw = b"".join(palmdoc(t) if head["compression"] == 2 else t for t in (strip_trailers(r, head["trailers"]) for r in recs[1 : 1 + head["count"]]))
    try:
        text = raw.decode(head["encoding"])
    except UnicodeDecodeError as e:
        raise BadBook("InvalidText") from e
    value = lambda kind: [html.simplified(v.decode(head["encoding"], "replace")) for v in head["exth"].get(kind, [])]
    base = locator.rpartition("/")[2].rpartition(".")[0] or locator.rpartition("/")[2]
    return {"title": (value(503) + value(99) + [base or "Untitled"])[0], "authors": value(100), "language": (value(524) + ["und"])[0], "blocks": html.scan(text)[0]}


def blocks(books: DataFrame) -> DataFrame:
    """BLOCKS rows of books (source_id, content); headings start chapters. A book that can't be imported gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, content in b[["source_id", "content"]].itertuples(index=False):
                try:
                    book = parse(bytes(content or b""), sid)
                except BadBook as e:
                    out.append((sid, *[None] * 9, str(e)))
                    continue
                chapter, index = -1, 0
                for kind, text, s, e in book["blocks"]:
                    if kind == "heading" or chapter < 0:
                        chapter, index = chapter + 1, 0
                    out.append((sid, book["title"], book["authors"], book["language"], chapter, index, kind, text, s, e, None))
                    index += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return books.mapInPandas(run, BLOCKS)
