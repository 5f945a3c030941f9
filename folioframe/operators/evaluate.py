"""Scores of extractions and runs against golden labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics that count cost, which have no mean unless every case has them.
COSTS = ("total_tokens", "latency_ms")


def byte_offsets(segments: DataFrame, case: str, index: str, body: str) -> DataFrame:
    """Segments with start_byte and end_byte by the bytes before them in their case."""
    size = F.octet_length(body).cast("long")
    upto = F.sum(size).over(Window.partitionBy(case).orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("start_byte", upto - size).withColumn("end_byte", upto)


def segment_problems(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """(chapter_id, segment_index, code): gaps, overlaps and wrong fields of segments that must tile their chapter.

    segments: chapter_id, segment_index, segment_type, speaker, confidence, start_byte, end_byte; chapters:
    chapter_id, c_start, c_end. A segment outside its chapter counts for nothing else.
    """
    rows = segments.join(chapters, "chapter_id")
    inside = F.coalesce((F.col("start_byte") >= F.col("c_start")) & (F.col("end_byte") <= F.col("c_end")) & (F.col("end_byte") > F.col("start_byte")), F.lit(False))
    w = Window.partitionBy("chapter_id").orderBy("segment_index")
    rows = rows.withColumn("_in", inside)
    seen = F.coalesce(F.max(F.when(F.col("_in"), F.col("end_byte"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("c_start"))
    seen = F.greatest(seen, F.col("c_start"))
    rows = rows.withColumn("_seen", seen)
    conf, speaker = F.col("confidence"), F.col("speaker")
    codes = F.array_compact(F.array(
        F.when(~F.col("_in"), F.lit("InvalidSegmentSpan")), F.when(F.col("_in") & (F.col("start_byte") > F.col("_seen")), F.lit("CoverageGap")),
        F.when(F.col("_in") & (F.col("start_byte") < F.col("_seen")), F.lit("CoverageOverlap")),
        F.when(F.col("_in") & (conf.isNull() | F.isnan(conf) | (conf < 0) | (conf > 1)), F.lit("InvalidConfidence")),
        F.when(F.col("_in") & speaker.isNotNull() & ((speaker == "") | (speaker != F.trim(speaker))), F.lit("InvalidSpeaker")),
        F.when(F.col("_in") & (F.col("segment_type") == "narration") & speaker.isNotNull(), F.lit("NarrationSpeaker")),
    ))
    each = rows.select("chapter_id", "segment_index", F.explode(codes).alias("code"))
    ends = rows.groupBy("chapter_id").agg(F.max(F.when(F.col("_in"), F.col("end_byte"))).alias("last"), F.first("c_end").alias("c_end"))
    tail = ends.filter(F.coalesce("last", F.lit(-1)) < F.col("c_end")).select("chapter_id", F.lit(None).cast("int").alias("segment_index"), F.lit("CoverageGapAtEnd").alias("code"))
    return each.unionByName(tail)


def coverage(expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, coverage): share of each expected span (case, e_start, e_end) that actual spans (case, start_byte, end_byte) cover."""
    rows = expected.join(actual, case).select(case, F.greatest("start_byte", "e_start").alias("s"), F.least("end_byte", "e_end").alias("e")).filter("e > s")
    w = Window.partitionBy(case).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    added = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(w), F.col("s"))))
    covered = rows.withColumn("n", added).groupBy(case).agg(F.sum("n").alias("n"))
    total = F.col("e_end") - F.col("e_start")
    return expected.join(covered, case, "left").select(case, F.when(total == 0, 1.0).otherwise(F.coalesce("n", F.lit(0)) / total).alias("coverage"))


def _boundaries(rows: DataFrame, whole: DataFrame, case: str) -> DataFrame:
    ends = rows.select(case, F.explode(F.array("start_byte", "end_byte")).alias("b")).distinct()
    return ends.join(whole, case).filter("b > e_start AND b < e_end").select(case, "b")


def boundary_f1(whole: DataFrame, expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, boundary_f1) over inner boundaries; 1 where neither side has any."""
    e, a = _boundaries(expected, whole, case), _boundaries(actual, whole, case)
    both = e.withColumn("x", F.lit(1)).join(a.withColumn("y", F.lit(1)), [case, "b"], "full")
    n = both.groupBy(case).agg(F.count("x").alias("n"), F.count("y").alias("m"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("k"))
    return whole.select(case).join(n, case, "left").select(case, F.coalesce(2.0 * F.col("k") / (F.col("n") + F.col("m")), F.lit(1.0)).alias("boundary_f1"))


def speaker_scores(expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, speaker_accuracy, unknown_speaker_accuracy): dialogue is matched on exact spans; 1 where there is nothing to match."""
    a = actual.filter("segment_type = 'dialogue'").groupBy(case, "start_byte", "end_byte").agg(F.min_by("speaker", "segment_index").alias("a_speaker"), F.lit(True).alias("hit"))
    d = F.col("segment_type") == "dialogue"
    rows = expected.join(a, [case, "start_byte", "end_byte"], "left")
    right = F.coalesce(F.col("hit"), F.lit(False)) & F.col("speaker").eqNullSafe(F.col("a_speaker"))
    unknown = d & F.col("speaker").isNull()
    out = rows.groupBy(case).agg(F.count_if(d).alias("n"), F.count_if(d & right).alias("k"), F.count_if(unknown).alias("un"), F.count_if(unknown & right).alias("uk"))
    share = lambda k, n: F.when(F.col(n) == 0, 1.0).otherwise(F.col(k) / F.col(n))
    return out.select(case, share("k", "n").alias("speaker_accuracy"), share("uk", "un").alias("unknown_speaker_accuracy"))


def weighted_accuracy(golden: DataFrame, observed: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, dialogue_accuracy, speaker_accuracy) weighted by the bytes in which segments meet. Ranges join within a case."""
    o = observed.select(case, F.col("start_byte").alias("os"), F.col("end_byte").alias("oe"), F.col("segment_type").alias("ot"), F.col("speaker").alias("osp"))
    rows = golden.join(o, case).filter((F.col("start_byte") < F.col("oe")) & (F.col("os") < F.col("end_byte")))
    n = F.least("end_byte", "oe") - F.greatest("start_byte", "os")
    dialogue = F.col("segment_type") == "dialogue"
    same = F.col("segment_type") == F.col("ot")
    out = rows.groupBy(case).agg(
        F.sum(n).alias("total"), F.sum(F.when(same, n).otherwise(0)).alias("right"), F.sum(F.when(dialogue, n).otherwise(0)).alias("d"),
        F.sum(F.when(dialogue & same & F.col("speaker").eqNullSafe(F.col("osp")), n).otherwise(0)).alias("sp"),
    )
    return out.select(case, (F.col("right") / F.col("total")).alias("dialogue_accuracy"), F.when(F.col("d") == 0, 1.0).otherwise(F.col("sp") / F.col("d")).alias("speaker_accuracy"))


def label_f1(required: Column, allowed: Column, actual: Column) -> Column:
    """F1 of a label array: recall against the required, precision against the allowed; null where nothing is required or found."""
    r, a = F.array_distinct(required), F.array_distinct(actual)
    precision = F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, allowed)) / F.size(a))
    recall = F.when(F.size(r) == 0, 1.0).otherwise(F.size(F.array_intersect(a, r)) / F.size(r))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return F.when((F.size(r) == 0) & (F.size(a) == 0), F.lit(None).cast("double")).otherwise(f1)


def hallucination_rate(claims: list[tuple[Column, Column]]) -> Column:
    """Share of claims that aren't allowed, over several (actual, allowed) arrays; 0 where nothing is claimed."""
    n = sum((F.size(F.array_distinct(a)) for a, _ in claims), F.lit(0))
    bad = sum((F.size(F.array_except(a, ok)) for a, ok in claims), F.lit(0))
    return F.when(n == 0, 0.0).otherwise(bad / n)


def edit_scores(golden: DataFrame, observed: DataFrame, fields: list[str], case: str = "case_id") -> DataFrame:
    """(case, precision, recall) of edits equal in all fields; null where the denominator is empty."""
    g = golden.select(case, *fields).distinct().withColumn("g", F.lit(1))
    o = observed.select(case, *fields).distinct().withColumn("o", F.lit(1))
    n = g.join(o, [case, *fields], "full").groupBy(case).agg(F.count("g").alias("ng"), F.count("o").alias("no"), F.count(F.when(F.col("g").isNotNull() & F.col("o").isNotNull(), 1)).alias("k"))
    return n.select(case, F.when(F.col("no") > 0, F.col("k") / F.col("no")).alias("precision"), F.when(F.col("ng") > 0, F.col("k") / F.col("ng")).alias("recall"))


def aggregate_run(metrics: DataFrame, case: str = "case_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(metric, value, by): mean over the cases that have one; a cost metric is null unless every case has it. Input: case, metric, value, by."""
    out = metrics.groupBy("metric", *by).agg(F.avg("value").alias("mean"), F.count("value").alias("have"), F.count("*").alias("cases"))
    cost = F.col("metric").isin(*COSTS) & (F.col("have") < F.col("cases"))
    return out.select("metric", F.when(~cost, F.col("mean")).alias("value"), *by)


def compare_runs(baseline: DataFrame, candidate: DataFrame, limits: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(case_id, metric, baseline, candidate, issue): metrics that fall below limits, fall by more than the tolerance, cost too much, or are missing.

    limits: metric, minimum, maximum, max_ratio (nulls where there is none); a handful of rows.
    """
    b = baseline.withColumnRenamed("value", "baseline")
    rows = candidate.withColumnRenamed("value", "candidate").join(b, ["case_id", "metric"], "full").join(limits, "metric", "left")
    issue = (
        F.when(F.col("baseline").isNull() != F.col("candidate").isNull(), "MissingMetric")
        .when(F.col("candidate") < F.col("minimum"), "BelowMinimum")
        .when(F.col("candidate") > F.col("maximum"), "AboveMaximum")
        .when(F.col("max_ratio").isNotNull() & (F.col("candidate") > F.col("baseline") * F.col("max_ratio")), "CostRatio")
        .when(F.col("max_ratio").isNull() & F.col("minimum").isNotNull() & (F.col("baseline") - F.col("candidate") > tolerance), "QualityDrop")
        .when(F.col("max_ratio").isNull() & F.col("maximum").isNotNull() & (F.col("candidate") - F.col("baseline") > tolerance), "QualityDrop")
    )
    return rows.withColumn("issue", issue).filter("issue IS NOT NULL").select("case_id", "metric", "baseline", "candidate", "issue")


def golden_problems(cases: DataFrame, case: str = "case_id", source: str = "source_text", segments: str = "segments") -> DataFrame:
    """(case, code): cases whose segments don't add up to their source, are empty, or whose narration has a speaker."""
    joined = F.array_join(F.transform(segments, lambda s: s["text"]), "")
    parts = [
        cases.filter(~joined.eqNullSafe(F.col(source))).select(case, F.lit("SourceMismatch").alias("code")),
        cases.filter((F.coalesce(F.size(segments), F.lit(0)) <= 0) | F.exists(segments, lambda s: F.coalesce(s["text"], F.lit("")) == "")).select(case, F.lit("EmptySegment").alias("code")),
        cases.filter(F.exists(segments, lambda s: (s["segment_type"] == "narration") & s["speaker"].isNotNull())).select(case, F.lit("NarrationSpeaker").alias("code")),
        cases.groupBy(case).count().filter("count > 1").select(case, F.lit("DuplicateCase").alias("code")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nth_occurrence(body: Column, part: Column, n: Column) -> Column:
    """0-based character position of the n-th (from 1) non-overlapping occurrence, null if there are fewer."""
    pieces = F.split(body, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    at = F.char_length(F.array_join(F.slice(pieces, F.lit(1), n), "")) + F.char_length(part) * (n - 1)
    return F.when((part != "") & (n >= 1) & (n < F.size(pieces)), at)


def unpaired(golden: DataFrame, observed: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, code): golden cases without one observation, observations without a case, repeated ones."""
    g, o = golden.groupBy(case).agg(F.count("*").alias("g")), observed.groupBy(case).agg(F.count("*").alias("o"))
    code = F.when(F.col("o").isNull(), "MissingObservation").when(F.col("g").isNull(), "UnknownCase").when((F.col("o") > 1) | (F.col("g") > 1), "Duplicate")
    return g.join(o, case, "full").select(case, code.alias("code")).filter("code IS NOT NULL")
