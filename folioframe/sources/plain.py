"""Plain text import: bytes or texts to chapters and blocks with exact byte spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import ids, spans, text


def read_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(source_id, content) of plain text files; the path is the locator. There is no cap."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return df.select(F.col("path").alias("source_id"), "content")


def decode(sources: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(texts, errors): strictly decoded texts without byte-order mark (their spans start at ``base``), and sources that aren't valid UTF-8 or hold nothing."""
    raw = F.col(content)
    bom = F.substring(raw, 1, 3) == F.lit(b"\xef\xbb\xbf")
    rows = sources.withColumn("_ok", F.is_valid_utf8(raw.cast("string"))).withColumn("base", F.when(bom, 3).otherwise(0).cast("long"))
    body = F.decode(F.substring(raw, F.col("base").cast("int") + 1, F.lit(2147483647)), "UTF-8")
    texts = rows.filter("_ok").select("source_id", "base", body.alias("text")).filter(~text.is_blank(F.col("text")))
    bad = rows.filter(~F.coalesce("_ok", F.lit(False))).select("source_id", F.lit("InvalidUtf8").alias("code"))
    empty = rows.filter("_ok").select("source_id", body.alias("text")).filter(text.is_blank(F.col("text"))).select("source_id", F.lit("EmptyInput").alias("code"))
    return texts, bad.unionByName(empty)


def lines(texts: DataFrame, key: str = "source_id", body: str = "text", base: Column | None = None) -> DataFrame:
    """(key, line_no, line, start_byte, end_byte): lines without their terminators; a terminator at the end starts no line."""
    t = F.col(body)
    ends = F.regexp_extract_all(t, F.lit(text.LINE_END), F.lit(0))
    parts = F.split(t, text.LINE_END, -1)
    size = lambda x: F.octet_length(x["p"]) + F.coalesce(F.octet_length(x["e"]), F.lit(0))
    placed = spans.with_starts(F.arrays_zip(parts.alias("p"), ends.alias("e")), base if base is not None else F.lit(0), size)
    kept = F.filter(placed, lambda z: z["item"]["e"].isNotNull() | (z["item"]["p"] != ""))
    rows = texts.filter(t.isNotNull()).select(key, F.posexplode(kept).alias("line_no", "_l"))
    line = F.col("_l.item.p")
    return rows.select(key, "line_no", line.alias("line"), F.col("_l.start").alias("start_byte"), (F.col("_l.start") + F.octet_length(line)).cast("long").alias("end_byte"))


def blocks(lined: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, chapter_index, block_index, block_type, text, start_byte, end_byte) from lines.

    A heading starts a chapter; what comes before the first heading is a chapter of its own. Blank lines, headings
    and scene breaks end paragraphs. One shuffle by key serves all windows.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    kind = F.when(text.heading(line).isNotNull(), "heading").when(text.is_blank(line), "blank").when(text.is_scene_break(line), "scene_break").otherwise("paragraph")
    rows = lined.withColumn("kind", kind)
    rows = rows.withColumn("island", F.sum(F.when((F.col("kind") != "paragraph") | (F.lag("kind", 1, "").over(w) != "paragraph"), 1).otherwise(0)).over(upto))
    rows = rows.withColumn("headings", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(upto))
    rows = rows.filter("kind != 'blank'").groupBy(key, "headings", "island", "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("ls"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")
    )
    lead = F.min("headings").over(Window.partitionBy(key))
    body = F.when(F.col("kind") == "paragraph", text.join_wrapped(F.col("ls"))).otherwise(text.trimmed(F.element_at("ls", 1)))
    rows = rows.withColumn("chapter_index", (F.col("headings") - lead).cast("int")).withColumn("text", body)
    number = F.row_number().over(Window.partitionBy(key, "chapter_index").orderBy("start_byte")) - 1
    return rows.select(key, "chapter_index", number.alias("block_index"), F.col("kind").alias("block_type"), "text", "start_byte", "end_byte")


def chapters(block_rows: DataFrame, titles: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, book_id, chapter_id, chapter_index, title): a chapter's first heading, or the book's title, names it."""
    first = block_rows.groupBy(key, "chapter_index").agg(F.min_by("text", "block_index").alias("t"), F.min_by("block_type", "block_index").alias("k"))
    out = first.join(titles.select(key, F.col("title").alias("book_title")), key, "left").withColumn("book_id", ids.stable_id("book", F.col(key)))
    chapter_key = F.concat("book_id", F.lit(":chapter:"), F.col("chapter_index").cast("string"))
    title = F.when(F.col("k") == "heading", F.col("t")).otherwise(title_or(F.col("book_title"), F.col(key)))
    return out.select(key, "book_id", ids.stable_id("chapter", chapter_key).alias("chapter_id"), "chapter_index", title.alias("title"))


def title_or(title: Column, locator: Column) -> Column:
    """A title, else the file's base name, else 'Untitled'."""
    base = F.regexp_replace(F.element_at(F.split(locator, "/"), -1), r"(?<=.)\.[^.]*$", "")
    named = lambda c: F.when(text.trimmed(c) != "", text.trimmed(c))
    return F.coalesce(named(title), named(base), F.lit("Untitled"))


def span_text(df: DataFrame, body: str, start: str = "start_byte", end: str = "end_byte") -> Column:
    return spans.byte_slice(F.col(body), F.col(start), F.col(end))
