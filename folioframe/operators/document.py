"""Documents as rows of books, chapters and blocks: validation, constraints, metrics, content hash."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import ids, spans, text


def latest(df: DataFrame, keys: list[str], by: str = "ingested_at", first: bool = True) -> DataFrame:
    """One row per key: of redelivered rows the first (or last) that arrived."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*others)
    pick = F.min_by(row, by) if first else F.max_by(row, by)
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others))


def _error(df: DataFrame, bad: Column, code: str, path: Column) -> DataFrame:
    return df.filter(bad).select(F.lit(code).alias("code"), path.alias("path"))


def validate(books: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """(code, path): everything wrong with documents; no rows mean valid ones. Inputs have one row per key."""
    book_path = F.concat(F.lit("books/"), F.coalesce("book_id", F.lit("null")))
    chapter_path = F.concat(F.lit("chapters/"), F.coalesce("chapter_id", F.lit("null")))
    block_path = F.concat(F.lit("blocks/"), F.coalesce("chapter_id", F.lit("null")), F.lit("/"), F.coalesce(F.col("block_index").cast("string"), F.lit("null")))
    blank = lambda c: text.trimmed(F.coalesce(c, F.lit(""))) == ""
    order = Window.partitionBy("book_id").orderBy("chapter_index", "chapter_id")
    numbered = chapters.withColumn("_n", F.row_number().over(order) - 1)
    same = Window.partitionBy("chapter_id")
    spanned = blocks.withColumn("_ok", spans.is_valid_span(F.col("source_id"), F.col("start_byte"), F.col("end_byte")))
    before = Window.partitionBy("source_id").orderBy("start_byte", "end_byte", "block_index").rowsBetween(Window.unboundedPreceding, -1)
    overlap = spanned.filter("_ok").withColumn("_prev", F.max("end_byte").over(before)).filter(F.col("_prev") > F.col("start_byte"))
    conf = F.col("extraction_confidence")
    out = [
        _error(books, ~ids.is_stable_id("book", F.col("book_id")), "InvalidBookId", book_path),
        _error(books, blank(F.col("title")) | blank(F.col("source_format")) | blank(F.col("source_locator")), "MissingMetadata", book_path),
        _error(books, ~ids.is_sha256(F.col("source_hash")), "InvalidSourceHash", book_path),
        _error(books.join(chapters.select("book_id").distinct(), "book_id", "left_anti"), F.lit(True), "MissingChapters", book_path),
        _error(chapters, ~ids.is_stable_id("chapter", F.col("chapter_id")), "InvalidChapterId", chapter_path),
        _error(chapters.withColumn("_c", F.count("*").over(same)), F.col("_c") > 1, "DuplicateChapterId", chapter_path),
        _error(numbered, ~F.col("_n").eqNullSafe(F.col("chapter_index")), "InvalidChapterOrder", chapter_path),
        _error(spanned, ~F.col("_ok"), "InvalidSourceSpan", block_path),
        _error(overlap, F.lit(True), "OverlappingSourceSpan", block_path),
        _error(blocks, (F.col("block_type") != "scene_break") & (F.coalesce("text", F.lit("")) == ""), "EmptyBlockText", block_path),
        _error(blocks, conf.isNotNull() & (F.isnan(conf) | (conf < 0) | (conf > 1)), "InvalidExtractionConfidence", block_path),
    ]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def constraint_violations(df: DataFrame, table: str, unique: list[list[str]] = (), foreign: list[tuple[str, DataFrame, str]] = (), checks: dict[str, Column] | None = None) -> DataFrame:
    """(table, rule, n): rows against uniqueness, foreign keys and checks. A check that is null isn't violated."""
    lit = lambda d, rule: d.agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "n")
    parts = [lit(df.groupBy(*k).count().filter("count > 1"), f"unique({', '.join(k)})") for k in unique]
    parts += [lit(df.filter(F.col(c).isNotNull()).join(ref.select(F.col(rc).alias(c)).distinct(), c, "left_anti"), f"foreign({c})") for c, ref, rc in foreign]
    if checks:
        row = df.agg(*(F.count_if(~cond).alias(name) for name, cond in checks.items()))
        pairs = F.explode(F.array(*(F.struct(F.lit(f"check({n})").alias("rule"), F.col(n).alias("n")) for n in checks)))
        parts.append(row.select(pairs.alias("x")).select(F.lit(table).alias("table_name"), "x.rule", "x.n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def block_measures(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each block as what the metrics need of it, without its text: words of a paragraph, whether the span is valid."""
    words = F.when(F.col("block_type") == "paragraph", text.count_words(F.col("text"))).otherwise(0)
    ok = spans.is_valid_span(F.col("source_id"), F.col("start_byte"), F.col("end_byte"))
    return blocks.select("book_id", "chapter_id", *keep, words.cast("long").alias("words"), ok.alias("valid"))


def chapter_metrics(blocks: DataFrame) -> DataFrame:
    """Per chapter: blocks, words of paragraphs, valid spans. Blocks may be given as their measures."""
    rows = blocks if "words" in blocks.columns else block_measures(blocks)
    return rows.groupBy("book_id", "chapter_id").agg(F.count("*").alias("n_blocks"), F.sum("words").alias("n_words"), F.count_if(F.col("valid")).alias("n_valid_spans"))


def document_metrics(blocks: DataFrame) -> DataFrame:
    """Per book: chapters with blocks, blocks, words. Rolled up from the chapters, so that a large book is combined early."""
    return chapter_metrics(blocks).groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum("n_blocks").alias("n_blocks"), F.sum("n_words").alias("n_words"), F.sum("n_valid_spans").alias("n_valid_spans"))


def nested(books: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents as nested rows: a book with its ordered chapters, each with its ordered blocks."""
    b = blocks.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "block_type", "text", "source_id", "start_byte", "end_byte", "extraction_confidence"))).alias("blocks"))
    c = chapters.join(b, "chapter_id", "left").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "chapter_id", "title", "blocks"))).alias("chapters"))
    return books.join(c, "book_id", "left")


def real_text(c: Column) -> Column:
    """A confidence of 0 to 1 with 17 significant digits of its exact binary value, trailing zeros left out; others as they print."""
    out = F.when(c == 0, F.lit("0")).when(c == 1, F.lit("1"))
    for k, bits in ((1, 60), (2, 60), (3, 66), (4, 66)):  # 10^-k <= c: c * 2^bits is a whole number
        whole = (c * F.lit(2.0**bits)).cast("bigint").cast("decimal(19,0)")
        scaled = whole * F.lit(Decimal(2)).cast("decimal(1,0)") * F.lit(Decimal(10 ** (16 + k))).cast(f"decimal({17 + k},0)")
        # Rounded to the nearest: half a unit is added before the whole division.
        digits = F.call_function("div", scaled + F.lit(Decimal(2**bits)).cast("decimal(20,0)"), F.lit(Decimal(2 ** (bits + 1))).cast("decimal(21,0)"))
        text_ = F.rtrim(F.concat(F.lit("0."), F.lpad(digits.cast("string"), 16 + k, "0")), F.lit("0"))
        out = out.when((c >= 10.0**-k) & (c < 1), text_)
    return out.otherwise(c.cast("string"))


def content_hash(docs: DataFrame) -> DataFrame:
    """(book_id, content_hash): SHA-256 over the framed fields of nested documents in order, lists preceded by their counts.

    Null texts count as empty, a null confidence is left out.
    """
    f = ids.framed
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    count = lambda c: F.greatest(F.size(c), F.lit(0)).cast("string")

    def block(b: Column) -> Column:
        conf = F.when(b["extraction_confidence"].isNotNull(), f("block.extraction_confidence", real_text(b["extraction_confidence"]))).otherwise("")
        return F.concat(f("block.type", s(b["block_type"])), f("block.text", s(b["text"])), f("block.source_id", s(b["source_id"])), f("block.start_byte", s(b["start_byte"])), f("block.end_byte", s(b["end_byte"])), conf)

    def chapter(c: Column) -> Column:
        body = F.array_join(F.transform(F.coalesce(c["blocks"], F.array()), block), "")
        return F.concat(f("chapter.id", s(c["chapter_id"])), f("chapter.index", s(c["chapter_index"])), f("chapter.title", s(c["title"])), f("chapter.blocks.count", count(c["blocks"])), body)

    authors = F.concat(f("metadata.authors.count", count("authors")), F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: f("metadata.author", s(a))), ""))
    rest = (("metadata.language", "lang_label"), ("metadata.source_format", "source_format"), ("metadata.source_locator", "source_locator"), ("metadata.source_hash", "source_hash"))
    head = F.concat(f("document.id", s(F.col("book_id"))), f("metadata.title", s(F.col("title"))), authors, *(f(n, s(F.col(c))) for n, c in rest))
    body = F.concat(f("chapters.count", count("chapters")), F.array_join(F.transform(F.coalesce("chapters", F.array()), chapter), ""))
    return docs.select("book_id", F.sha2(F.concat(head, body), 256).alias("content_hash"))
