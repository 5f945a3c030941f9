"""Queries pN_ of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import encoding, langid, names, packing, percentiles, scan, sentences, splitting, tokens, truncation
from folioframe.session import cut_lineage, table


def _block_costs(spark: SparkSession, sf: str) -> encoding.Costs:
    return encoding.Costs(*encoding.character_counts(table(spark, sf, "blocks"), "text"))


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    out = encoding.repair_column(table(spark, sf, "blocks"), ["chapter_id", "block_index"], "text")
    return out.dropDuplicates(["chapter_id", "block_index"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    cost = _block_costs(spark, sf)
    blocks = encoding.repair_column(table(spark, sf, "blocks"), ["chapter_id", "block_index"], "text", cost)
    headers = encoding.wrong_headers(table(spark, sf, "mobi_headers"), cost)
    found = blocks.select(F.lit("block").alias("item_kind"), F.col("chapter_id").alias("item_id"), "block_index")
    found = found.unionByName(headers.select(F.lit("header").alias("item_kind"), F.col("book_id").alias("item_id"), F.lit(-1).alias("block_index")))
    return found.distinct()


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    limits = table(spark, sf, "size_limits")
    contexts = splitting.split_rows(table(spark, sf, "context_inputs"), limits, "context", "context_id", "current_chapter")
    chapters = splitting.split_blocks(table(spark, sf, "blocks"), limits, "chapter_blocks", "chapter", "chapter_id", "block_index", "text")
    return contexts.unionByName(chapters)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(p2_pieces(spark, sf))


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.percentiles_of_runs(table(spark, sf, "llm_runs"))


def _day_summaries(spark: SparkSession, sf: str) -> DataFrame:
    counts = percentiles.value_counts(percentiles.run_metrics(table(spark, sf, "llm_runs")), ["model", "day"], ["latency_ms", "total_tokens"])
    return percentiles.summarise_days(counts, ["model", "metric"])


def p3_day_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _day_summaries(spark, sf)


def p3_months(spark: SparkSession, sf: str) -> DataFrame:
    monthly = _day_summaries(spark, sf).withColumn("month", F.date_format("day", "yyyy-MM"))
    return percentiles.combine(monthly, ["model", "metric", "month"])


def p4_sentences(spark: SparkSession, sf: str) -> DataFrame:
    segments = sentences.split_sentences(table(spark, sf, "segments").withColumn("k", F.col("segment_id").cast("string")), "k", "text")
    golden = sentences.split_sentences(table(spark, sf, "golden_cases"), "case_id", "source_text")
    named = lambda df, name, key: df.select(F.lit(name).alias("item_table"), F.col(key).alias("item_id"), "start_char", "end_char", "sentence")
    return named(segments, "segments", "k").unionByName(named(golden, "golden_cases", "case_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_sentences(spark, sf).drop("sentence")


def p5_linked(spark: SparkSession, sf: str) -> DataFrame:
    spelled = names.distinct_names([(table(spark, sf, "analysis_characters"), "character_name"), (table(spark, sf, "segments"), "speaker")])
    return names.link(cut_lineage(spelled))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.same_entity_pairs(p5_linked(spark, sf))


def p6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "books").select("book_id", "title")
    out = scan.repair_pages(table(spark, sf, "blocks"), ["chapter_id", "block_index"], "text", "book_id", titles)
    return out.dropDuplicates(["chapter_id", "block_index"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_repaired(spark, sf).select("chapter_id", "block_index")


def p7_stretches(spark: SparkSession, sf: str) -> DataFrame:
    model = langid.labelled_model(table(spark, sf, "documents"))
    rows = langid.language_stretches(table(spark, sf, "blocks"), ["chapter_id", "block_index"], "text", model)
    return rows.select("chapter_id", "block_index", F.explode("stretches").alias("s")).select("chapter_id", "block_index", "s.start_char", "s.end_char", "s.lang", "s.confidence")


def p7_books(spark: SparkSession, sf: str) -> DataFrame:
    model = langid.labelled_model(table(spark, sf, "documents"))
    rows = langid.language_stretches(table(spark, sf, "blocks"), ["book_id", "chapter_id", "block_index"], "text", model)
    return langid.book_languages(table(spark, sf, "books"), rows)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    model = langid.labelled_model(table(spark, sf, "documents"))
    return langid.found(table(spark, sf, "books"), table(spark, sf, "blocks"), model)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


def p8_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """As p8_ids, with leaves small enough that ordinary texts are spread over rows and joined again."""
    return tokens.encode_corpus(table(spark, sf, "documents"), spread_chars=2048, leaf_chars=512)


def p9_pack(spark: SparkSession, sf: str) -> DataFrame:
    limits = table(spark, sf, "size_limits").filter("unit = 'tokens'")
    return packing.pack_texts(table(spark, sf, "documents"), limits)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.find_truncated(table(spark, sf, "documents")).filter("truncated").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(truncation.find_truncated(table(spark, sf, "documents")))


def p2_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Check of p2_pieces: the longest piece of each item, and a hash of its pieces put together without their overlaps."""
    limits = table(spark, sf, "size_limits").select("limit_id", F.col("overlap_size").alias("o"))
    rows = p2_pieces(spark, sf).join(limits, "limit_id")
    own = F.when(F.col("start_char") == 0, F.col("text")).otherwise(F.expr("substring(text, o + 1)"))
    rows = rows.select("item_kind", "item_id", F.char_length("text").alias("n"), F.struct("start_char", own.alias("t")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "")
    return rows.groupBy("item_kind", "item_id").agg(F.sha2(text, 256).alias("hash"), F.max("n").alias("longest")).join(_item_limits(spark, sf), ["item_kind", "item_id"]).select("item_kind", "item_id", "hash", (F.col("longest") <= F.col("m")).alias("fits"))


def _item_limits(spark: SparkSession, sf: str) -> DataFrame:
    limits = table(spark, sf, "size_limits").select("limit_id", F.col("max_size").alias("m"))
    contexts = table(spark, sf, "context_inputs").select(F.lit("context").alias("item_kind"), F.col("context_id").alias("item_id"), "limit_id").distinct()
    chapters = table(spark, sf, "blocks").select(F.lit("chapter").alias("item_kind"), F.col("chapter_id").alias("item_id"), F.lit("chapter_blocks").alias("limit_id")).distinct()
    return contexts.unionByName(chapters).join(limits, "limit_id").drop("limit_id")


def p3_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Check of p3_months: whether each percentile is within its bound of the exact one."""
    counts = percentiles.value_counts(percentiles.run_metrics(table(spark, sf, "llm_runs")), ["model", "day"], ["latency_ms", "total_tokens"])
    months = counts.groupBy("model", F.date_format("day", "yyyy-MM").alias("month"), "metric", "value").agg(F.sum("n").alias("n"))
    group = F.to_json(F.struct("model", "month")).alias("g")  # leaves out nulls, so that they meet
    exact = percentiles.select_ranks(months, ["model", "metric", "month"]).select(group, "metric", "p", F.col("value").alias("exact"))
    rows = p3_months(spark, sf).withColumn("g", group).join(exact, ["g", "metric", "p"])
    return rows.select("model", "metric", "month", "p", (F.abs(F.col("value") - F.col("exact")) <= F.col("relative_error") * F.abs("exact") + 1e-9).alias("within"))


def p4_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Check of p4_sentences: a hash of each item's sentences put together without white space."""
    rows = p4_sentences(spark, sf).groupBy("item_table", "item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_char", "sentence"))), lambda x: x["sentence"]), "").alias("t"))
    return rows.select("item_table", "item_id", F.sha2(F.regexp_replace("t", r"[\s\p{Z}\x{85}\x{0B}]+", ""), 256).alias("hash"))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Check of p8_ids: a hash of the text that the ids decode to."""
    return tokens.decode_corpus(p8_ids(spark, sf)).select("doc_id", F.sha2("text", 256).alias("hash"))


def p9_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Check of p9_pack: per limit the texts placed, containers above the capacity, texts split that would fit, and texts whose parts don't add up."""
    rows = cut_lineage(p9_pack(spark, sf))
    limits = table(spark, sf, "size_limits").select("limit_id", F.col("max_size").alias("m"))
    full = rows.groupBy("limit_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(limits, "limit_id").groupBy("limit_id").agg(F.count_if(F.col("n") > F.col("m")).alias("n_over"))
    texts = rows.groupBy("limit_id", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max("part_index").alias("parts")).join(limits, "limit_id")
    split = texts.groupBy("limit_id").agg(F.count_if((F.col("parts") > 0) & (F.col("n") <= F.col("m"))).alias("n_split"), F.count("*").alias("n_texts"), F.count_if(F.col("k") != F.col("parts") + 1).alias("n_odd"))
    return split.join(full, "limit_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_repaired": p1_repaired,
        "p2_found": p2_found, "p2_pieces": p2_pieces,
        "p3_percentiles": p3_percentiles, "p3_day_summaries": p3_day_summaries, "p3_months": p3_months,
        "p4_found": p4_found, "p4_sentences": p4_sentences,
        "p5_found": p5_found, "p5_linked": p5_linked,
        "p6_found": p6_found, "p6_repaired": p6_repaired,
        "p7_found": p7_found, "p7_stretches": p7_stretches, "p7_books": p7_books,
        "p8_ids": p8_ids, "p8_leaves": p8_leaves, "p9_pack": p9_pack,
        "p10_found": p10_found, "p10_rates": p10_rates,
        "p2_rebuilt": p2_rebuilt, "p3_bounded": p3_bounded, "p4_covered": p4_covered, "p8_decoded": p8_decoded, "p9_checked": p9_checked,
    }


_ONE_RUN = "SELECT DISTINCT run_id, model, CAST(started_at AS DATE) AS day, latency_ms, total_tokens FROM llm_runs"
_LONG = (
    f"WITH r AS ({_ONE_RUN}), v AS (SELECT model, day, 'latency_ms' AS metric, CAST(latency_ms AS DOUBLE) AS value FROM r WHERE latency_ms IS NOT NULL "
    "UNION ALL SELECT model, day, 'total_tokens', CAST(total_tokens AS DOUBLE) FROM r WHERE total_tokens IS NOT NULL)"
)


def oracle_sql() -> dict[str, str]:
    ps = "(VALUES (0.25), (0.5), (0.75), (0.9), (0.95), (0.99)) AS t(p)"
    squeezed = lambda c: f"sha256(regexp_replace({c}, '[\\s\\p{{Z}}\\x{{85}}\\x{{0B}}]+', '', 'g'))"
    return {
        "p2_rebuilt": """
            SELECT DISTINCT 'context' AS item_kind, context_id AS item_id, sha256(current_chapter) AS hash, true AS fits FROM context_inputs JOIN size_limits USING (limit_id) WHERE unit = 'chars' AND length(current_chapter) > max_size
            UNION ALL SELECT 'chapter', chapter_id, sha256(string_agg(t, '' ORDER BY block_index)), true FROM (SELECT chapter_id, block_index, coalesce(any_value(text), '') AS t FROM blocks GROUP BY 1, 2)
            GROUP BY chapter_id HAVING sum(length(t)) > (SELECT max_size FROM size_limits WHERE limit_id = 'chapter_blocks')""",
        "p4_covered": f"""
            SELECT 'segments' AS item_table, CAST(segment_id AS VARCHAR) AS item_id, {squeezed('any_value(text)')} AS hash FROM segments WHERE regexp_replace(text, '[\\s\\p{{Z}}\\x{{85}}\\x{{0B}}]+', '', 'g') <> '' GROUP BY segment_id
            UNION ALL SELECT 'golden_cases', case_id, {squeezed('source_text')} FROM golden_cases WHERE regexp_replace(source_text, '[\\s\\p{{Z}}\\x{{85}}\\x{{0B}}]+', '', 'g') <> ''""",
        "p3_bounded": f"{_LONG}, m AS (SELECT DISTINCT model, metric, strftime(day, '%Y-%m') AS month FROM v) SELECT model, metric, month, CAST(p AS DOUBLE) AS p, true AS within FROM m, {ps}",
        "p8_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
        "p9_checked": "SELECT limit_id, 0 AS n_split, (SELECT count(DISTINCT doc_id) FROM documents) AS n_texts, 0 AS n_odd, 0 AS n_over FROM size_limits WHERE unit = 'tokens'",
        "p2_found": """
            SELECT DISTINCT 'context' AS item_kind, context_id AS item_id FROM context_inputs JOIN size_limits USING (limit_id)
            WHERE unit = 'chars' AND length(current_chapter) > max_size
            UNION ALL
            SELECT 'chapter', chapter_id FROM (
              SELECT chapter_id, block_index, coalesce(length(any_value(text)), 0) AS size FROM blocks GROUP BY 1, 2) b
            GROUP BY chapter_id HAVING sum(size) > (SELECT max_size FROM size_limits WHERE limit_id = 'chapter_blocks')""",
        "p3_percentiles": f"""{_LONG},
            g AS (SELECT 'all' AS scope, model, CAST(NULL AS DATE) AS day, metric, value FROM v UNION ALL SELECT 'day', model, day, metric, value FROM v),
            k AS (SELECT *, row_number() OVER (PARTITION BY scope, model, day, metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY scope, model, day, metric) AS n_values FROM g)
            SELECT scope, model, day, metric, CAST(p AS DOUBLE) AS p, value, n_values, CAST(0 AS DOUBLE) AS rank_error
            FROM k, {ps} WHERE rn = greatest(1, CAST(ceil(round(CAST(p AS DOUBLE) * n_values, 9)) AS BIGINT))""",
        "p3_day_summaries": f"""{_LONG}
            SELECT model, metric, day, CAST(sign(value) AS INTEGER) AS sign,
              CAST(CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(CASE WHEN value = 0 THEN 1 ELSE value END)) / ln(1.01 / 0.99)) END AS BIGINT) AS cell,
              count(*) AS n, CAST(0.01 AS DOUBLE) AS accuracy
            FROM v GROUP BY ALL""",
    }
