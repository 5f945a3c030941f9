"""Queries over books, chapters, blocks, segments and documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import ids, spans, text
from folioframe.operators import diff, document, evaluate, extract, proofread
from folioframe.plans.sqltext import CJK, IDEO, MATCHES, TRIM, one_block, words_sql
from folioframe.session import table
from folioframe.sources import html, plain

NAMES = ["Isterford", "Halberg", "Capitán", "Fährmann"]
TERMS = [{"canonical": "sextant", "variants": ["compass", "chart"], "case_sensitive": False}, {"canonical": "Lantern", "variants": ["lamp"], "case_sensitive": True}]
VARIANT_TEXT = "Istrford and Halbergs met the Fährmannn."
PROTECTED = ["* * *", "paces", "well-known gate"]


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return document.latest(table(spark, sf, "blocks"), ["chapter_id", "block_index"])


def _books(spark: SparkSession, sf: str) -> DataFrame:
    return document.latest(table(spark, sf, "books"), ["book_id"])


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a source of its own."""
    key = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").filter("text IS NOT NULL").select(key.alias("chapter_id"), key.alias("source_id"), F.sha2("text", 256).alias("source_hash"), F.lit(0).cast("long").alias("start_byte"), "text")


def _measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of every block once: texts are reduced before redelivered rows are folded, so that none is shuffled."""
    keys = ("block_index", "ingested_at")
    return document.latest(document.block_measures(table(spark, sf, "blocks"), keys), ["chapter_id", "block_index"])


def document_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return document.document_metrics(_measures(spark, sf))


def chapter_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return document.chapter_metrics(_measures(spark, sf))


def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.count_words(t).alias("words"), text.estimate_tokens(t).alias("tokens"), F.coalesce(text.contains_cjk(t), F.lit(False)).alias("has_cjk"))


def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(text.normalize(t), 256).alias("normal_hash"), F.char_length(text.trimmed(t)).alias("trimmed_chars"), F.char_length(text.simplified(t)).alias("simple_chars"))


def line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    lined = plain.lines(table(spark, sf, "documents"), "doc_id")
    c = F.col("line")
    kind = F.when(text.heading(c).isNotNull(), "heading").when(text.is_blank(c), "blank").when(text.is_scene_break(c), "scene_break").when(text.is_page_number(c), "page_number").otherwise("text")
    return lined.select("doc_id", "line_no", "start_byte", "end_byte", kind.alias("kind"))


def imported_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = plain.blocks(plain.lines(table(spark, sf, "documents"), "doc_id"), "doc_id")
    return rows.select("doc_id", "chapter_index", "block_index", "block_type", F.sha2("text", 256).alias("text_hash"), "start_byte", "end_byte")


def imported_chapters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"))
    return plain.chapters(plain.blocks(plain.lines(docs, "doc_id"), "doc_id"), docs, "doc_id")


def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat("project_id", F.lit(":"), "source_locator")
    return _books(spark, sf).select("book_id", *(ids.stable_id(p, key).alias(f"{p}_id2") for p in ("book", "chapter", "snapshot")), ids.is_stable_id("book", F.col("book_id")).alias("valid_id"), ids.is_sha256(F.col("source_hash")).alias("valid_hash"))


def document_problems(spark: SparkSession, sf: str) -> DataFrame:
    return document.validate(_books(spark, sf), table(spark, sf, "chapters"), _blocks(spark, sf))


def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    blocks, chapters, books, runs = _blocks(spark, sf), table(spark, sf, "chapters"), _books(spark, sf), table(spark, sf, "llm_runs")
    a = document.constraint_violations(blocks, "blocks", [["chapter_id", "block_index"]], [("chapter_id", chapters, "chapter_id")], {"span": F.col("end_byte") >= F.col("start_byte"), "type": F.col("block_type").isin("paragraph", "heading", "scene_break", "unknown")})
    b = document.constraint_violations(chapters, "chapters", [["book_id", "chapter_index"]], [("book_id", books, "book_id")], {"index": F.col("chapter_index") >= 0})
    c = document.constraint_violations(runs, "llm_runs", [["run_id"], ["request_id"]], [], {"status": F.col("status").isin("queued", "running", "succeeded", "failed", "cancelled")})
    return a.unionByName(b).unionByName(c)


def document_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return document.content_hash(document.nested(_books(spark, sf), table(spark, sf, "chapters"), _blocks(spark, sf)))


#: What is done to the documents so that a detector finds something: blanks after commas left out, marks doubled.
_FAULTS = {"missing_blank": (", ", ","), "repeated_punctuation": ("!", "!!")}


def _detector(name: str):  # noqa: ANN202
    def query(spark: SparkSession, sf: str) -> DataFrame:
        sources = _sources(spark, sf)
        if name in _FAULTS:
            sources = sources.withColumn("text", F.replace("text", *(F.lit(x) for x in _FAULTS[name])))
        rows = getattr(proofread, name)(sources) if name not in proofread.PATTERNS else proofread.pattern_detector(sources, name)
        return rows.select("source_id", "start_byte", "end_byte", "original", "suggestion", "category", "confidence", "impact")

    return query


def terminology_variants(spark: SparkSession, sf: str) -> DataFrame:
    return proofread.terminology(_sources(spark, sf), TERMS).select("source_id", "start_byte", "end_byte", "original", "suggestion", "detector")


def name_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return proofread.name_frequency(_sources(spark, sf), NAMES)


def token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return proofread.token_frequency(_sources(spark, sf))


def name_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, and one more text in which known names are misspelled."""
    more = spark.createDataFrame([("x", "x", "", 0, VARIANT_TEXT)], "chapter_id string, source_id string, source_hash string, start_byte long, text string")
    return proofread.name_variants(_sources(spark, sf).unionByName(more), NAMES).select("source_id", "start_byte", "end_byte", "original", "suggestion")


def protected_suppression(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(spark, sf)
    rows = proofread.pattern_detector(s, "multiple_blanks").unionByName(proofread.pattern_detector(s, "blank_before_punctuation")).unionByName(proofread.pattern_detector(s, "missing_blank"))
    return proofread.without_protected(rows, proofread.protected_spans(s, PROTECTED)).select("source_id", "start_byte", "end_byte", "original", "detector")


def proofreading(spark: SparkSession, sf: str) -> DataFrame:
    return proofread.in_order(proofread.analyze(_sources(spark, sf), TERMS, NAMES, PROTECTED))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return document.latest(table(spark, sf, "segments"), ["segment_id"])


def segment_problems(spark: SparkSession, sf: str) -> DataFrame:
    rows = _segments(spark, sf)
    # The capture of a chapter is cut at the head and prolonged at the tail, so that every rule has something to find.
    captures = rows.groupBy("chapter_id").agg((F.min("start_byte") + F.pmod(F.xxhash64(F.lit(0)) * 0 + F.min("segment_id"), F.lit(3))).alias("c_start"), (F.max("end_byte") + F.pmod(F.max("segment_id"), F.lit(2))).alias("c_end"))
    return evaluate.segment_problems(rows, captures)


def reconstructed_chapters(spark: SparkSession, sf: str) -> DataFrame:
    rows = _segments(spark, sf).groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("t"))
    return rows.select("chapter_id", F.sha2("t", 256).alias("hash"), F.octet_length("t").alias("bytes"))


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "golden_cases").select("case_id", F.posexplode("segments").alias("segment_index", "s")).select("case_id", "segment_index", "s.text", "s.segment_type", "s.speaker")
    return evaluate.byte_offsets(rows, "case_id", "segment_index", "text")


def golden_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _golden(spark, sf).select("case_id", "segment_index", "segment_type", "start_byte", "end_byte")


def _observed(golden: DataFrame) -> DataFrame:
    """A prediction: every third segment loses its last two bytes, every fourth its speaker, every fifth its type."""
    i = F.col("segment_index")
    return golden.withColumn("end_byte", F.when(i % 3 == 0, F.greatest(F.col("end_byte") - 2, F.col("start_byte"))).otherwise(F.col("end_byte"))).withColumn("speaker", F.when(i % 4 == 0, F.lit(None)).otherwise(F.col("speaker"))).withColumn("segment_type", F.when(i % 5 == 0, "narration").otherwise(F.col("segment_type")))


def extraction_scores(spark: SparkSession, sf: str) -> DataFrame:
    g = _golden(spark, sf)
    o = _observed(g)
    whole = g.groupBy("case_id").agg(F.min("start_byte").alias("e_start"), F.max("end_byte").alias("e_end"))
    return evaluate.coverage(whole, o).join(evaluate.boundary_f1(whole, g, o), "case_id").join(evaluate.speaker_scores(g, o), "case_id")


def weighted_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    g = _golden(spark, sf)
    return evaluate.weighted_accuracy(g, _observed(g))


def json_schema_problems(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "enum": list(range(50))}}}
    return extract.validate_json(table(spark, sf, "events"), "props", schema).select("event_id", F.size("problems").alias("n_problems"))


def revision_hunks(spark: SparkSession, sf: str) -> DataFrame:
    changed = F.regexp_replace(F.regexp_replace("text", r"(?m)^The ", "A "), r"\.\n", ".\n\n")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("old"), changed.alias("new"))
    return diff.changed_spans(rows)


def mapped_block_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Where line starts lie once every first word after a colon is taken out."""
    s = _sources(spark, sf)
    edits = s.select("source_id", F.explode(spans.match_spans(F.col("text"), r": \p{L}+")).alias("m")).select("source_id", F.col("m.start").alias("old_start"), (F.col("m.start") + F.octet_length("m.text")).alias("old_end"), F.lit(1).alias("new_len"))
    points = plain.lines(table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("source_id"), F.col("start_byte").alias("point"))
    return diff.mapped_offsets(points, edits)


def edit_deltas(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(spark, sf)
    edits = s.select("source_id", F.explode(spans.match_spans(F.col("text"), r": \p{L}+")).alias("m")).select("source_id", F.col("m.start").alias("old_start"), (F.col("m.start") + F.octet_length("m.text")).alias("old_end"), F.lit(1).alias("new_len"))
    return diff.running_delta(edits)


def touched_chapters(spark: SparkSession, sf: str) -> DataFrame:
    seg = _segments(spark, sf).select("segment_id", "source_id", F.col("start_byte").alias("old_start"), F.col("end_byte").alias("old_end"))
    seg = seg.unionByName(seg.withColumn("old_end", F.col("old_start")))
    chapters = _segments(spark, sf).groupBy("source_id", "chapter_id").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))
    return diff.touched_chapters(seg, chapters).select("segment_id", "old_start", "old_end", "chapter_id")


def review_impacts(spark: SparkSession, sf: str) -> DataFrame:
    rows = proofread.analyze(_sources(spark, sf), TERMS, None, None).withColumn("change", diff.review_impact(F.col("category"), F.col("impact")))
    return rows.groupBy("source_id").agg(diff.strongest(F.col("change")).alias("impact"), F.count("*").alias("n"))


def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    page = F.concat(F.lit("<!DOCTYPE html><html><head><title>x</title></head><body><h1>"), "doc_kind", F.lit("</h1><p>"), F.regexp_replace(esc, r"\n+", "</p><hr/><p>"), F.lit("</p></body></html>"))
    return html.html_blocks(table(spark, sf, "documents").withColumn("page", page), "doc_id", "page")


QUERIES = {
    "document_metrics": document_metrics, "chapter_metrics": chapter_metrics, "text_measures": text_measures, "normalized_texts": normalized_texts, "line_kinds": line_kinds,
    "imported_blocks": imported_blocks, "imported_chapters": imported_chapters, "stable_ids": stable_ids, "document_problems": document_problems, "constraint_violations": constraint_violations, "document_hashes": document_hashes,
    **{f"detect_{n}": _detector(n) for n in (*proofread.PATTERNS, "duplicate_tokens", "repeated_lines", "unmatched_brackets")},
    "terminology_variants": terminology_variants, "name_frequency": name_frequency, "token_frequency": token_frequency, "name_variants": name_variants, "protected_suppression": protected_suppression, "proofreading": proofreading,
    "segment_problems": segment_problems, "reconstructed_chapters": reconstructed_chapters, "golden_offsets": golden_offsets, "extraction_scores": extraction_scores, "weighted_accuracy": weighted_accuracy,
    "json_schema_problems": json_schema_problems, "revision_hunks": revision_hunks, "mapped_line_starts": mapped_block_starts, "edit_deltas": edit_deltas, "touched_chapters": touched_chapters, "review_impacts": review_impacts, "html_blocks": html_blocks,
}

_BOOK = "bk AS (SELECT DISTINCT ON (book_id) * FROM books ORDER BY book_id, ingested_at)"
_SEG = "sg AS (SELECT DISTINCT ON (segment_id) * FROM segments ORDER BY segment_id, ingested_at)"
_SRC = "s AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, text AS t FROM documents WHERE text IS NOT NULL)"
_VALID = "coalesce(trim(source_id) <> '' AND start_byte >= 0 AND start_byte <= end_byte, false)"
_HEAD_EN, _HEAD_ZH = text.HEADING_EN, text.HEADING_ZH
_LINES = """parts AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS i,
    regexp_extract_all(text, '\\r\\n|\\r|\\n') AS ends FROM documents WHERE text IS NOT NULL),
  pos AS (SELECT doc_id, i - 1 AS line_no, line, len(ends) + 1 AS n, i,
    coalesce(sum(strlen(line) + strlen(coalesce(ends[i], ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte FROM parts),
  l AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, CAST(start_byte AS BIGINT) AS start_byte, CAST(start_byte + strlen(line) AS BIGINT) AS end_byte FROM pos WHERE NOT (i = n AND line = ''))"""


def _kind(extra: str = "") -> str:
    return f"CASE WHEN regexp_matches({TRIM('line')}, '{_HEAD_EN}') OR regexp_matches({TRIM('line')}, '{_HEAD_ZH}') THEN 'heading' WHEN {TRIM('line')} = '' THEN 'blank' WHEN regexp_matches(line, '^\\s*(?:\\*\\s*\\*\\s*\\*|-\\s*-\\s*-|#\\s*#\\s*#)\\s*$') THEN 'scene_break' {extra} END"


_BLOCK_CTES = f"""{_LINES},
  k AS (SELECT *, {_kind("ELSE 'paragraph'")} AS kind FROM l),
  f AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER w AS headings, CASE WHEN kind <> 'paragraph' OR lag(kind, 1, '') OVER (PARTITION BY doc_id ORDER BY line_no) <> 'paragraph' THEN 1 ELSE 0 END AS flag FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
  g AS (SELECT *, sum(flag) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM f),
  b AS (SELECT doc_id, headings, island, kind, string_agg({TRIM('line')}, ' ' ORDER BY line_no) AS text, min(start_byte) AS start_byte, max(end_byte) AS end_byte FROM g WHERE kind <> 'blank' GROUP BY ALL),
  c AS (SELECT *, CAST(headings - min(headings) OVER (PARTITION BY doc_id) AS INTEGER) AS chapter_index FROM b)"""


def _detect(pattern: str, original: str, start: str, suggestion: str, category: str, confidence: float, impact: str, where: str = "true", fault: str = "") -> str:
    """SQL of a detector; m is a match with its byte position p."""
    src = _SRC.replace("text AS t", "replace(text, '{}', '{}') AS t".format(*_FAULTS[fault])) if fault else _SRC
    return f"""WITH {src}, {MATCHES(pattern)} SELECT source_id, CAST({start} AS BIGINT) AS start_byte, CAST({start} + strlen({original}) AS BIGINT) AS end_byte, {original} AS original, {suggestion} AS suggestion,
      '{category}' AS category, CAST({confidence} AS DOUBLE) AS confidence, '{impact}' AS impact FROM mm WHERE {where}"""


_OBS = """g0 AS (SELECT case_id, generate_subscripts(segments, 1) - 1 AS i, unnest(segments) AS s FROM golden_cases),
  g AS (SELECT case_id, i, s.segment_type AS ty, s.speaker AS sp, CAST(sum(strlen(s.text)) OVER (PARTITION BY case_id ORDER BY i) - strlen(s.text) AS BIGINT) AS a, CAST(sum(strlen(s.text)) OVER (PARTITION BY case_id ORDER BY i) AS BIGINT) AS z FROM g0),
  o AS (SELECT case_id, i, CASE WHEN i % 5 = 0 THEN 'narration' ELSE ty END AS ty, CASE WHEN i % 4 = 0 THEN NULL ELSE sp END AS sp, a, CASE WHEN i % 3 = 0 THEN greatest(z - 2, a) ELSE z END AS z FROM g),
  w AS (SELECT case_id, min(a) AS a, max(z) AS z FROM g GROUP BY 1)"""

def _field(name: str, value: str) -> str:
    return f"'{name}' || chr(0) || strlen({value}) || ':' || {value} || chr(10)"


def _or(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


SQL = {
    "document_hashes": f"""WITH {_BOOK}, {one_block()},
        bs AS (SELECT chapter_id, count(*) AS n, string_agg({' || '.join(_field(n, _or(c)) for n, c in (('block.type', 'block_type'), ('block.text', 'text'), ('block.source_id', 'source_id'), ('block.start_byte', 'start_byte'), ('block.end_byte', 'end_byte')))}
          || CASE WHEN extraction_confidence IS NOT NULL THEN {_field('block.extraction_confidence', "format('{:.17g}', extraction_confidence)")} ELSE '' END, '' ORDER BY block_index) AS s FROM b GROUP BY 1),
        cs AS (SELECT book_id, count(*) AS n, string_agg({_field('chapter.id', 'c.chapter_id')} || {_field('chapter.index', _or('chapter_index'))} || {_field('chapter.title', _or('title'))} || {_field('chapter.blocks.count', 'CAST(coalesce(bs.n, 0) AS VARCHAR)')} || coalesce(s, ''), '' ORDER BY chapter_index, c.chapter_id) AS s
          FROM chapters c LEFT JOIN bs ON bs.chapter_id = c.chapter_id GROUP BY 1)
        SELECT book_id, sha256({_field('document.id', 'book_id')} || {_field('metadata.title', _or('title'))} || {_field('metadata.authors.count', 'CAST(coalesce(len(authors), 0) AS VARCHAR)')} || coalesce(array_to_string(list_transform(authors, lambda x: {_field('metadata.author', 'x')}), ''), '')
          || {' || '.join(_field(n, _or(c)) for n, c in (('metadata.language', 'lang_label'), ('metadata.source_format', 'source_format'), ('metadata.source_locator', 'source_locator'), ('metadata.source_hash', 'source_hash')))}
          || {_field('chapters.count', 'CAST(coalesce(cs.n, 0) AS VARCHAR)')} || coalesce(s, '')) AS content_hash FROM bk LEFT JOIN cs USING (book_id)""",
    "name_frequency": f"WITH {_SRC}, w AS (SELECT unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS token FROM s) SELECT name, count(token) AS n FROM (VALUES {', '.join(f"('{n}')" for n in NAMES)}) AS k(name) LEFT JOIN w ON token = name GROUP BY 1",
    "name_variants": f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, text AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'x', '{VARIANT_TEXT}'), {MATCHES("[\\p{L}\\p{M}][\\p{L}\\p{M}\\p{N}_''’-]*")},
        once AS (SELECT m FROM mm GROUP BY m HAVING count(*) = 1), w AS (SELECT unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS token FROM s),
        known AS (SELECT name FROM (VALUES {', '.join(f"('{n}')" for n in NAMES)}) AS k(name) JOIN w ON token = name GROUP BY 1 HAVING count(*) >= 2)
        SELECT source_id, CAST(p AS BIGINT) AS start_byte, CAST(p + strlen(m) AS BIGINT) AS end_byte, m AS original, name AS suggestion FROM mm JOIN once USING (m) JOIN known ON m <> name AND levenshtein(lower(m), lower(name)) <= 1 WHERE regexp_matches(m, '^\\p{{Lu}}')""",
    "terminology_variants": f"""WITH {_SRC}, {MATCHES("[\\p{L}\\p{M}\\p{N}_]+")} SELECT source_id, CAST(p AS BIGINT) AS start_byte, CAST(p + strlen(m) AS BIGINT) AS end_byte, m AS original, CASE WHEN lower(m) IN ('compass', 'chart') THEN 'sextant' ELSE 'Lantern' END AS suggestion,
        CASE WHEN lower(m) = 'lantern' THEN 'terminology_case' ELSE 'terminology_variant' END AS detector FROM mm WHERE lower(m) IN ('compass', 'chart') OR m = 'lamp' OR lower(m) = 'lantern' AND m <> 'Lantern'""",
    "document_metrics": f"""WITH {one_block()}, c AS (SELECT book_id, chapter_id, count(*) AS nb, sum(CASE WHEN block_type = 'paragraph' THEN {words_sql('text')} ELSE 0 END) AS nw, count(*) FILTER ({_VALID}) AS nv FROM b GROUP BY 1, 2)
        SELECT book_id, count(*) AS n_chapters, CAST(sum(nb) AS BIGINT) AS n_blocks, CAST(sum(nw) AS BIGINT) AS n_words, CAST(sum(nv) AS BIGINT) AS n_valid_spans FROM c GROUP BY 1""",
    "chapter_metrics": f"WITH {one_block()} SELECT book_id, chapter_id, count(*) AS n_blocks, CAST(sum(CASE WHEN block_type = 'paragraph' THEN {words_sql('text')} ELSE 0 END) AS BIGINT) AS n_words, count(*) FILTER ({_VALID}) AS n_valid_spans FROM b GROUP BY 1, 2",
    "text_measures": f"""SELECT doc_id, CAST({words_sql('text')} AS INTEGER) AS words, CAST(coalesce(list_sum(list_transform(regexp_extract_all(regexp_replace(text, '[{CJK}]', ' ', 'g'), '[\\p{{L}}\\p{{N}}_'']+'), lambda x: (length(x) + 3) // 4)), 0)
          + length(regexp_replace(regexp_replace(text, '[{CJK}]', ' ', 'g'), '[\\p{{L}}\\p{{N}}_''\\s\\p{{Z}}\\x{{85}}\\x{{0B}}]', '', 'g')) + length(regexp_replace(text, '[^{CJK}]', '', 'g')) AS INTEGER) AS tokens, regexp_matches(text, '[{CJK}]') AS has_cjk
        FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 0, 0, false FROM documents WHERE text IS NULL""",
    "normalized_texts": f"""SELECT doc_id, sha256(nfc_normalize(regexp_replace(regexp_replace(text, '^\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g'))) AS normal_hash, CAST(length({TRIM('text')}) AS INTEGER) AS trimmed_chars,
        CAST(length({TRIM("regexp_replace(text, '[\\s\\p{Z}\\x{85}\\x{0B}]+', ' ', 'g')")}) AS INTEGER) AS simple_chars FROM documents WHERE text IS NOT NULL""",
    "line_kinds": f"WITH {_LINES} SELECT doc_id, line_no, start_byte, end_byte, {_kind(chr(10) + 'WHEN regexp_matches(line, ' + repr('(?i)^' + chr(92) + 's*(?:Page' + chr(92) + 's+)?' + chr(92) + 'd+' + chr(92) + 's*$').replace(chr(92) * 2, chr(92)) + ') THEN ' + repr('page_number') + ' ELSE ' + repr('text'))} AS kind FROM l",
    "imported_blocks": f"WITH {_BLOCK_CTES} SELECT doc_id, chapter_index, CAST(row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY start_byte) - 1 AS INTEGER) AS block_index, kind AS block_type, sha256(text) AS text_hash, start_byte, end_byte FROM c",
    "imported_chapters": f"""WITH {_BLOCK_CTES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY start_byte) AS rn FROM c),
        x AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'book_' || substr(sha256('book' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 32) AS book_id, chapter_index, CASE WHEN kind = 'heading' THEN text ELSE 'Doc ' || CAST(doc_id AS VARCHAR) END AS title FROM r WHERE rn = 1)
        SELECT doc_id, book_id, 'chapter_' || substr(sha256('chapter' || chr(0) || book_id || ':chapter:' || CAST(chapter_index AS VARCHAR)), 1, 32) AS chapter_id, chapter_index, title FROM x""",
    "stable_ids": f"WITH {_BOOK} SELECT book_id, " + ", ".join(f"'{p}_' || substr(sha256('{p}' || chr(0) || project_id || ':' || source_locator), 1, 32) AS {p}_id2" for p in ("book", "chapter", "snapshot")) + ", coalesce(regexp_matches(book_id, '^book_[0-9a-f]{32}$'), false) AS valid_id, coalesce(regexp_matches(source_hash, '^[0-9a-fA-F]{64}$'), false) AS valid_hash FROM bk",
    "document_problems": f"""WITH {_BOOK}, {one_block()}, bp AS (SELECT *, 'blocks/' || coalesce(chapter_id, 'null') || '/' || coalesce(CAST(block_index AS VARCHAR), 'null') AS path FROM b),
        ch AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, chapter_id) - 1 AS n, count(*) OVER (PARTITION BY chapter_id) AS c, 'chapters/' || chapter_id AS path FROM chapters),
        ov AS (SELECT path, start_byte, max(end_byte) OVER (PARTITION BY source_id ORDER BY start_byte, end_byte, block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bp WHERE {_VALID})
        SELECT 'InvalidBookId' AS code, 'books/' || book_id AS path FROM bk WHERE NOT regexp_matches(book_id, '^book_[0-9a-f]{{32}}$')
        UNION ALL SELECT 'MissingMetadata', 'books/' || book_id FROM bk WHERE {TRIM("coalesce(title, '')")} = '' OR {TRIM("coalesce(source_format, '')")} = '' OR {TRIM("coalesce(source_locator, '')")} = ''
        UNION ALL SELECT 'InvalidSourceHash', 'books/' || book_id FROM bk WHERE NOT coalesce(regexp_matches(source_hash, '^[0-9a-fA-F]{{64}}$'), false)
        UNION ALL SELECT 'MissingChapters', 'books/' || book_id FROM bk WHERE book_id NOT IN (SELECT book_id FROM chapters)
        UNION ALL SELECT 'InvalidChapterId', path FROM ch WHERE NOT regexp_matches(chapter_id, '^chapter_[0-9a-f]{{32}}$')
        UNION ALL SELECT 'DuplicateChapterId', path FROM ch WHERE c > 1
        UNION ALL SELECT 'InvalidChapterOrder', path FROM ch WHERE n IS DISTINCT FROM chapter_index
        UNION ALL SELECT 'InvalidSourceSpan', path FROM bp WHERE NOT {_VALID}
        UNION ALL SELECT 'OverlappingSourceSpan', path FROM ov WHERE prev > start_byte
        UNION ALL SELECT 'EmptyBlockText', path FROM bp WHERE block_type <> 'scene_break' AND coalesce(text, '') = ''
        UNION ALL SELECT 'InvalidExtractionConfidence', path FROM bp WHERE extraction_confidence IS NOT NULL AND (isnan(extraction_confidence) OR extraction_confidence < 0 OR extraction_confidence > 1)""",
    "constraint_violations": f"""WITH {_BOOK}, {one_block()}
        SELECT 'blocks' AS table_name, 'unique(chapter_id, block_index)' AS rule, (SELECT count(*) FROM (SELECT 1 FROM b GROUP BY chapter_id, block_index HAVING count(*) > 1)) AS n
        UNION ALL SELECT 'blocks', 'foreign(chapter_id)', (SELECT count(*) FROM b WHERE chapter_id NOT IN (SELECT chapter_id FROM chapters))
        UNION ALL SELECT 'blocks', 'check(span)', (SELECT count(*) FROM b WHERE NOT end_byte >= start_byte)
        UNION ALL SELECT 'blocks', 'check(type)', (SELECT count(*) FROM b WHERE block_type NOT IN ('paragraph', 'heading', 'scene_break', 'unknown'))
        UNION ALL SELECT 'chapters', 'unique(book_id, chapter_index)', (SELECT count(*) FROM (SELECT 1 FROM chapters GROUP BY book_id, chapter_index HAVING count(*) > 1))
        UNION ALL SELECT 'chapters', 'foreign(book_id)', (SELECT count(*) FROM chapters WHERE book_id NOT IN (SELECT book_id FROM bk))
        UNION ALL SELECT 'chapters', 'check(index)', (SELECT count(*) FROM chapters WHERE NOT chapter_index >= 0)
        UNION ALL SELECT 'llm_runs', 'unique(run_id)', (SELECT count(*) FROM (SELECT 1 FROM llm_runs GROUP BY run_id HAVING count(*) > 1))
        UNION ALL SELECT 'llm_runs', 'unique(request_id)', (SELECT count(*) FROM (SELECT 1 FROM llm_runs GROUP BY request_id HAVING count(*) > 1))
        UNION ALL SELECT 'llm_runs', 'check(status)', (SELECT count(*) FROM llm_runs WHERE status NOT IN ('queued', 'running', 'succeeded', 'failed', 'cancelled'))""",
    "detect_multiple_blanks": _detect("[ \\t]{2,}", "m", "p", "' '", "SPACING", 0.97, "TEXT_ONLY"),
    "detect_blank_before_punctuation": _detect("[ \\t]+[,.;:!?，。；：！？]", "left(m, length(m) - 1)", "p", "''", "SPACING", 0.96, "PUNCTUATION_ONLY"),
    "detect_missing_blank": _detect("[,;:!?][\\p{L}\\p{N}]", "''", "(p + 1)", "' '", "SPACING", 0.78, "PUNCTUATION_ONLY", fault="missing_blank"),
    "detect_repeated_punctuation": _detect(",,+|;;+|::+|!!+|\\?\\?+|，，+|；；+|：：+|！！+|？？+", "m", "p", "left(m, 1)", "PUNCTUATION", 0.72, "PUNCTUATION_ONLY", fault="repeated_punctuation"),
    "detect_two_dot_ellipsis": _detect("\\.+", "m", "p", "'...'", "PUNCTUATION", 0.84, "PUNCTUATION_ONLY", "length(m) = 2"),
    "detect_repeated_lines": f"""WITH {_SRC}, p0 AS (SELECT source_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM s),
        p1 AS (SELECT *, {TRIM('line')} AS tr, lag({TRIM('line')}) OVER (PARTITION BY source_id ORDER BY i) AS prev, sum(strlen(line) + 1) OVER (PARTITION BY source_id ORDER BY i) - strlen(line) - 1 AS a FROM p0)
        SELECT source_id, CAST(a AS BIGINT) AS start_byte, CAST(a + strlen(line) AS BIGINT) AS end_byte, line AS original, '' AS suggestion, 'DUPLICATED_TEXT' AS category, CAST(0.94 AS DOUBLE) AS confidence, 'TEXT_ONLY' AS impact FROM p1 WHERE tr <> '' AND tr = prev""",
    "token_frequency": f"WITH {_SRC} SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}][\\p{{L}}\\p{{M}}\\p{{N}}_''’-]*')) AS token FROM s) GROUP BY 1",
    "reconstructed_chapters": f"WITH {_SEG} SELECT chapter_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY segment_index)) AS hash, CAST(strlen(string_agg(coalesce(text, ''), '' ORDER BY segment_index)) AS INTEGER) AS bytes FROM sg GROUP BY 1",
    "segment_problems": f"""WITH {_SEG}, cp AS (SELECT chapter_id, min(start_byte) + min(segment_id) % 3 AS c_start, max(end_byte) + max(segment_id) % 2 AS c_end FROM sg GROUP BY 1),
        r AS (SELECT sg.*, c_start, c_end, coalesce(start_byte >= c_start AND end_byte <= c_end AND end_byte > start_byte, false) AS ok FROM sg JOIN cp USING (chapter_id)),
        q AS (SELECT *, greatest(coalesce(max(CASE WHEN ok THEN end_byte END) OVER (PARTITION BY chapter_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c_start), c_start) AS seen FROM r)
        SELECT chapter_id, segment_index, 'InvalidSegmentSpan' AS code FROM q WHERE NOT ok UNION ALL SELECT chapter_id, segment_index, 'CoverageGap' FROM q WHERE ok AND start_byte > seen
        UNION ALL SELECT chapter_id, segment_index, 'CoverageOverlap' FROM q WHERE ok AND start_byte < seen
        UNION ALL SELECT chapter_id, segment_index, 'InvalidConfidence' FROM q WHERE ok AND (confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1)
        UNION ALL SELECT chapter_id, segment_index, 'InvalidSpeaker' FROM q WHERE ok AND speaker IS NOT NULL AND (speaker = '' OR speaker <> trim(speaker))
        UNION ALL SELECT chapter_id, segment_index, 'NarrationSpeaker' FROM q WHERE ok AND segment_type = 'narration' AND speaker IS NOT NULL
        UNION ALL SELECT chapter_id, NULL, 'CoverageGapAtEnd' FROM r GROUP BY chapter_id HAVING coalesce(max(CASE WHEN ok THEN end_byte END), -1) < any_value(c_end)""",
    "golden_offsets": f"WITH {_OBS} SELECT case_id, CAST(i AS INTEGER) AS segment_index, ty AS segment_type, a AS start_byte, z AS end_byte FROM g",
    "extraction_scores": f"""WITH {_OBS}, cl AS (SELECT o.case_id, greatest(o.a, w.a) AS s, least(o.z, w.z) AS e FROM o JOIN w USING (case_id)),
        cv AS (SELECT case_id, s, e, max(e) OVER (PARTITION BY case_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM cl WHERE e > s),
        cov AS (SELECT case_id, sum(greatest(0, e - greatest(s, coalesce(pe, s)))) AS n FROM cv GROUP BY 1),
        gb AS (SELECT DISTINCT case_id, x FROM (SELECT case_id, unnest([a, z]) AS x FROM g) JOIN w USING (case_id) WHERE x > w.a AND x < w.z),
        ob AS (SELECT DISTINCT case_id, x FROM (SELECT case_id, unnest([a, z]) AS x FROM o) JOIN w USING (case_id) WHERE x > w.a AND x < w.z),
        bf AS (SELECT case_id, count(gx) AS n, count(ox) AS m, count(*) FILTER (gx IS NOT NULL AND ox IS NOT NULL) AS k FROM (SELECT case_id, gb.x AS gx, ob.x AS ox FROM (SELECT case_id, x FROM gb) gb FULL JOIN (SELECT case_id, x FROM ob) ob USING (case_id, x)) GROUP BY 1),
        od AS (SELECT case_id, a, z, arg_min(coalesce(sp, chr(1)), i) AS sp FROM o WHERE ty = 'dialogue' GROUP BY 1, 2, 3),
        sc AS (SELECT g.case_id, count(*) FILTER (g.ty = 'dialogue') AS n, count(*) FILTER (g.ty = 'dialogue' AND od.sp = coalesce(g.sp, chr(1))) AS k, count(*) FILTER (g.ty = 'dialogue' AND g.sp IS NULL) AS un, count(*) FILTER (g.ty = 'dialogue' AND g.sp IS NULL AND od.sp = chr(1)) AS uk
          FROM g LEFT JOIN od ON g.case_id = od.case_id AND g.a = od.a AND g.z = od.z GROUP BY 1)
        SELECT w.case_id, CASE WHEN w.z = w.a THEN 1.0 ELSE coalesce(cov.n, 0) / (w.z - w.a) END AS coverage, coalesce(2.0 * bf.k / (bf.n + bf.m), 1.0) AS boundary_f1,
          CASE WHEN sc.n = 0 THEN 1.0 ELSE sc.k / sc.n END AS speaker_accuracy, CASE WHEN un = 0 THEN 1.0 ELSE uk / un END AS unknown_speaker_accuracy
        FROM w LEFT JOIN cov USING (case_id) LEFT JOIN bf USING (case_id) JOIN sc USING (case_id)""",
    "weighted_accuracy": f"""WITH {_OBS}, j AS (SELECT g.case_id, least(g.z, o.z) - greatest(g.a, o.a) AS n, g.ty AS gt, o.ty AS ot, g.sp AS gs, o.sp AS os FROM g JOIN o ON g.case_id = o.case_id AND g.a < o.z AND o.a < g.z)
        SELECT case_id, sum(CASE WHEN gt = ot THEN n ELSE 0 END) / sum(n) AS dialogue_accuracy, CASE WHEN sum(CASE WHEN gt = 'dialogue' THEN n ELSE 0 END) = 0 THEN 1.0
          ELSE sum(CASE WHEN gt = 'dialogue' AND gt = ot AND gs IS NOT DISTINCT FROM os THEN n ELSE 0 END) / sum(CASE WHEN gt = 'dialogue' THEN n ELSE 0 END) END AS speaker_accuracy FROM j GROUP BY 1""",
    "json_schema_problems": """SELECT event_id, CAST(CASE WHEN NOT coalesce(json_valid(props), false) THEN 1 WHEN json_type(props) <> 'OBJECT' THEN 1 ELSE
          (CASE WHEN json_type(props, '$.k') IS NULL THEN 1 WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 1 WHEN CAST(json_extract(props, '$.k') AS BIGINT) NOT BETWEEN 0 AND 49 THEN 1 ELSE 0 END)
          + len(list_filter(json_keys(props), lambda x: x <> 'k')) END AS INTEGER) AS n_problems FROM events""",
    "edit_deltas": f"""WITH {_SRC}, {MATCHES(': ' + chr(92) + 'p{L}+')}, e AS (SELECT source_id, CAST(p AS BIGINT) AS old_start, CAST(p + strlen(m) AS BIGINT) AS old_end, 1 AS new_len FROM mm)
        SELECT *, CAST(coalesce(sum(new_len - (old_end - old_start)) OVER (PARTITION BY source_id ORDER BY old_start, old_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS delta FROM e""",
    "mapped_line_starts": f"""WITH {_SRC}, {MATCHES(': ' + chr(92) + 'p{L}+')}, e AS (SELECT source_id, CAST(p AS BIGINT) AS s, CAST(p + strlen(m) AS BIGINT) AS e FROM mm), {_LINES},
        pt AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS source_id, start_byte AS point FROM l)
        SELECT pt.source_id, point, CASE WHEN NOT max(coalesce(s < point AND point < e.e, false)) THEN CAST(point + coalesce(sum(CASE WHEN e.e <= point THEN 1 - (e.e - s) ELSE 0 END), 0) AS BIGINT) END AS new_point
        FROM pt LEFT JOIN e ON pt.source_id = e.source_id AND s <= point GROUP BY 1, 2""",
    "touched_chapters": f"""WITH {_SEG}, c0 AS (SELECT segment_id, source_id, start_byte AS old_start, end_byte AS old_end FROM sg), c AS (SELECT * FROM c0 UNION ALL SELECT segment_id, source_id, old_start, old_start FROM c0),
        h AS (SELECT source_id, chapter_id, min(start_byte) AS a, max(end_byte) AS z FROM sg GROUP BY 1, 2)
        SELECT segment_id, old_start, old_end, chapter_id FROM c JOIN h ON c.source_id = h.source_id AND CASE WHEN old_start = old_end THEN old_start >= a AND old_start <= z ELSE old_start < z AND a < old_end END""",
}
