"""EPUB books: package, reading order, navigation and blocks of an archive, read with the standard library."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from folioframe.sources import html

MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 10_000, 64 << 20, 512 << 20
BLOCKS = "source_id string, title string, authors array<string>, language string, chapter_index int, chapter_title string, block_index int, block_type string, text string, start_byte bigint, end_byte bigint, entry string, error string"


class BadBook(ValueError):
    """A book that can't be imported; the message is its code."""


def is_safe(path: str) -> bool:
    return bool(path) and not path.startswith(("/", "\\")) and "\\" not in path and ":" not in path and ".." not in path.split("/") and "\0" not in path


def resolved(base: str, href: str) -> str:
    """The archive path that a reference in ``base`` means, without its fragment."""
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0])))
    if not is_safe(path):
        raise BadBook("UnsafePath")
    return path


def open_archive(data: bytes) -> zipfile.ZipFile:
    """The archive if it is one of an EPUB within the caps: an uncompressed mimetype first, safe paths, no repeated ones."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise BadBook("NotAnArchive") from e
    infos = z.infolist()
    if not infos or infos[0].filename != "mimetype" or infos[0].compress_type != zipfile.ZIP_STORED or z.read("mimetype") != b"application/epub+zip":
        raise BadBook("InvalidMimetype")
    if len(infos) > MAX_ENTRIES or any(i.file_size > MAX_ENTRY for i in infos) or sum(i.file_size for i in infos) > MAX_TOTAL:
        raise BadBook("TooLarge")
    names = [i.filename for i in infos]
    if any(not is_safe(n.rstrip("/")) for n in names) or len(set(names)) < len(names):
        raise BadBook("UnsafePath")
    if "META-INF/encryption.xml" in names:
        raise BadBook("Encrypted")
    return z


def _xml(z: zipfile.ZipFile, path: str) -> ElementTree.Element:
    try:
        data = z.read(path)
    except KeyError as e:
        raise BadBook("MissingEntry") from e
    if b"<!DOCTYPE" in data[:4096] and not path.endswith(".ncx"):
        raise BadBook("DocumentType")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise BadBook("NotWellFormed") from e


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _name(e) == name]


def navigation(z: zipfile.ZipFile, path: str) -> list[tuple[str, str, str]]:
    """(entry, fragment, title) of a navigation document or an NCX, in order."""
    root = _xml(z, path)
    out = []
    if _name(root) == "ncx":
        for p in _all(root, "navPoint"):
            label = " ".join("".join(t.itertext()) for t in _all(p, "navLabel")[:1])
            src = next((c.get("src", "") for c in p if _name(c) == "content"), "")
            if src:
                out.append((resolved(path, src), src.partition("#")[2], html.simplified(label)))
        return out
    navs = [n for n in _all(root, "nav") if "toc" in next((v for k, v in n.attrib.items() if k.endswith("type")), "").split()] or _all(root, "nav")
    for a in _all(navs[0], "a") if navs else []:
        if href := a.get("href"):
            out.append((resolved(path, href), href.partition("#")[2], html.simplified("".join(a.itertext()))))
    return out


def parse(data: bytes, locator: str) -> dict:
    """Title, authors, language and chapters [(title, [(type, text, start, end, entry)])] of a book."""
    z = open_archive(data)
    package = next((r.get("full-path") for r in _all(_xml(z, "META-INF/container.xml"), "rootfile")), None)
    if not package or not is_safe(package):
        raise BadBook("MissingPackage")
    root = _xml(z, package)
    text = lambda name: [html.simplified("".join(e.itertext())) for e in _all(root, name) if "".join(e.itertext()).strip()]
    items = {i.get("id"): i for i in _all(root, "item")}
    spine = [resolved(package, items[r.get("idref")].get("href")) for r in _all(root, "itemref") if r.get("idref") in items]
    if not spine:
        raise BadBook("EmptySpine")
    nav = next((i for i in items.values() if "nav" in (i.get("properties") or "").split()), None)
    toc = next((s.get("toc") for s in _all(root, "spine")), None)
    places: list[tuple[str, str, str]] = []
    if nav is not None:
        places = navigation(z, resolved(package, nav.get("href")))
    elif toc in items:
        places = navigation(z, resolved(package, items[toc].get("href")))
    title = (text("title") or [posixpath.splitext(posixpath.basename(locator))[0] or "Untitled"])[0]
    chapters: list[tuple[str, list]] = []
    for entry in spine:
        try:
            raw = z.read(entry)
        except KeyError as e:
            raise BadBook("MissingEntry") from e
        if problem := html.xhtml_problem(raw):
            raise BadBook(problem)
        blocks, anchors = html.scan(raw.decode("utf-8"))
        at = dict(reversed(anchors))
        # A chapter starts at the first block that ends behind its anchor.
        starts = sorted({next((i for i, b in enumerate(blocks) if b[3] > at.get(f, 0)), 0): t for e, f, t in places if e == entry}.items())
        if not places and blocks:
            starts = [(0, next((b[1] for b in blocks if b[0] == "heading"), title))]
        for i, b in enumerate(blocks):
            if starts and i == starts[0][0]:
                chapters.append((starts.pop(0)[1], []))
            if not chapters:
                chapters.append((title, []))
            chapters[-1][1].append((*b, entry))
    if not any(c[1] for c in chapters):
        raise BadBook("EmptyInput")
    return {"title": title, "authors": text("creator"), "language": (text("language") or ["und"])[0], "chapters": [c for c in chapters if c[1]]}


def blocks(books: DataFrame) -> DataFrame:
    """BLOCKS rows of books (source_id, content); a book that can't be imported gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, content in b[["source_id", "content"]].itertuples(index=False):
                try:
                    book = parse(bytes(content or b""), sid)
                except BadBook as e:
                    out.append((sid, *[None] * 11, str(e)))
                    continue
                for ci, (ct, bs) in enumerate(book["chapters"]):
                    out += [(sid, book["title"], book["authors"], book["language"], ci, ct, bi, *x, None) for bi, x in enumerate(bs)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return books.mapInPandas(run, BLOCKS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, content); the caps on what archives hold are checked, and reported as errors, when they are parsed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).selectExpr("path AS source_id", "content")
