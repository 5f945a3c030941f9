"""Problem 10: texts that were cut off before they arrived.

Per source, the histograms of lengths in characters and in bytes are tested for spikes: single lengths far more
frequent than those below them (a fixed limit), and a band under the largest length in which unfinished texts
pile up (a limit that cuts at word or character ends). A text at a spike without terminal punctuation is
truncated; marks that a cutter appends are taken off first. Such rows have cut = 'limit'.

Cuts in mid-transfer leave no spike, so a second test stands beside the first, with histograms of its own (cut =
'transfer'). It judges only texts at no spike. The lengths of a source's unfinished texts must be spread there: a
length with more of them around it than the lengths on either side is a pile, and nothing in a pile is taken for a
cut in mid-transfer. The forms of endings (names and numbers masked) are counted over the corpus: on-purpose
endings pile up in few forms, those of cut texts don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

#: Lengths below a spike from which its usual frequency is taken, and the width of the band under the maximum.
BACKGROUND, BAND = 200, 20
LEAST_AT_SPIKE = 5
#: An ending is formulaic from this share of all texts (and at least FORM_LEAST texts).
FORM_SHARE, FORM_LEAST = 0.0002, 3

#: Characters of an ending that a pattern can reach; closing lines are at most so long.
REACH = 256
_BLANKS = " \t\n\r\f\x0b\x00\x85\xa0\u2028\u2029\u200b\u3000\ufeff"
_END = r"[.!?。！？।؟｡…]['\"”’»›」』）)\]*_]*$|[—–-]['\"”’»」』]$"
_MARKER = r"(?:\s*(?:…|\.\.\.|\[(?:…|\.\.\.|(?i:truncated|cut|more))\]|\((?:…|\.\.\.|(?i:truncated|more))\)|(?i:read more|<more>)))+$"
_DEBRIS = r"�$|&#?[A-Za-z0-9]{0,7}$|=[0-9A-F]?$|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|%[0-9A-F]?$|<[^<>\n]{0,30}$"
_BULLET = r"^\s*(?:[•*\-–·‣◦]|\d{1,3}[.)])\s+\S"


def _masked(c: Column) -> Column:
    """The form of an ending: capitalised words and numbers masked."""
    out = F.regexp_replace(c, r"\p{Lu}[\p{L}\p{M}’'-]*", "X")
    return F.regexp_replace(F.regexp_replace(out, r"\d+", "0"), r"\s+", " ")


def features(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """What the tests need of each row, without its text."""
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("t"))
    # All patterns look at an ending, so each is applied to as much of the text's end as it can reach.
    rows = rows.withColumn("s", F.rtrim("t", F.lit(_BLANKS))).filter("s != ''")
    rows = rows.withColumn("end", F.right("s", F.lit(REACH))).withColumn("bare", F.regexp_replace("end", _MARKER, "")).withColumn("last", F.substring_index("s", "\n", -1))
    rows = rows.withColumn("head", F.expr("left(s, char_length(s) - char_length(last) - 1)")).withColumn("before", F.rtrim("head", F.lit(_BLANKS)))
    rows = rows.withColumn("gap", F.right("head", F.lit(REACH)).rlike(r"\n[^\S\n]*$")).withColumn("prev", F.substring_index("before", "\n", -1))
    rows = rows.withColumn("before_ended", F.right("before", F.lit(REACH)).rlike(_END))
    sentence = F.regexp_replace(F.regexp_extract(F.right("last", F.lit(REACH)), r"([^.!?。！？।؟…]*[.…—–”’\"'»」\s]*)$", 1), r"^[\"'”’»」』)\s]+", "")
    closing = F.col("gap") & F.col("before_ended") & (F.char_length("last") <= REACH)
    form = F.when(F.col("end").rlike(r"(?:…|\.\.\.|—)$"), F.concat(F.lit("s:"), _masked(F.trim(sentence)))).when(closing, F.concat(F.lit("l:"), _masked(F.col("last"))))
    return rows.select(
        "key", "source", F.xxhash64("t").alias("h"), F.char_length("t").alias("chars"), F.octet_length("t").alias("bytes"),
        F.col("end").rlike(_END).alias("ended"), (F.col("bare") != F.col("end")).alias("marker"),
        F.col("bare").rlike(_END).alias("bare_ended"), F.col("end").rlike(_DEBRIS).alias("debris"),
        (F.col("last").rlike(_BULLET) & (F.col("prev").rlike(_BULLET) | F.col("before_ended"))).alias("item"), form.alias("form"),
    )


def spikes(feats: DataFrame) -> DataFrame:
    """(source, measure, lo, hi, band): lengths at which texts of a source pile up. Equal texts count once."""
    one = feats.groupBy("source", "h").agg(F.first("chars").alias("chars"), F.first("bytes").alias("bytes"), F.min((F.col("ended") & ~F.col("marker")).cast("int")).alias("ended"))
    both = F.explode(F.array(F.struct(F.lit("chars").alias("m"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("m"), F.col("bytes").alias("n"))))
    hist = one.select("source", "ended", both.alias("x")).groupBy("source", F.col("x.m").alias("measure"), F.col("x.n").alias("n")).agg(F.count("*").alias("c"), F.sum(1 - F.col("ended")).alias("u"))
    w = Window.partitionBy("source", "measure").orderBy("n")
    below = w.rangeBetween(-BACKGROUND, -1)
    far = w.rangeBetween(-BACKGROUND - BAND, -BAND - 1)
    hist = (
        hist.withColumn("d", F.coalesce(F.sum("c").over(below), F.lit(0)) / BACKGROUND)
        .withColumn("top", F.max("n").over(Window.partitionBy("source", "measure")))
        .withColumn("zone", F.sum("u").over(w.rangeBetween(-BAND, 0)))
        .withColumn("zd", F.coalesce(F.sum("u").over(far), F.lit(0)) * (BAND + 1) / BACKGROUND)
    )
    exact = hist.filter(_crowded(F.col("c"), F.col("d")) & (2 * F.col("u") > F.col("c"))).select("source", "measure", F.col("n").alias("lo"), F.col("n").alias("hi"), F.lit(False).alias("band"))
    band = hist.filter((F.col("n") == F.col("top")) & _crowded(F.col("zone"), F.col("zd"))).select("source", "measure", (F.col("n") - BAND).alias("lo"), F.col("n").alias("hi"), F.lit(True).alias("band"))
    return exact.unionByName(band)


def piles(feats: DataFrame) -> DataFrame:
    """(source, measure, n): lengths of a source around which unfinished texts pile up, against both sides. Equal texts count once."""
    one = feats.filter(_unfinished()).groupBy("source", "h").agg(F.first("chars").alias("chars"), F.first("bytes").alias("bytes"))
    both = F.explode(F.array(F.struct(F.lit("chars").alias("m"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("m"), F.col("bytes").alias("n"))))
    hist = one.select("source", both.alias("x")).groupBy("source", F.col("x.m").alias("measure"), F.col("x.n").alias("n")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("source", "measure").orderBy("n")
    near, left, right = w.rangeBetween(-BAND // 2, BAND // 2), w.rangeBetween(-BACKGROUND - BAND, -BAND - 1), w.rangeBetween(BAND + 1, BACKGROUND + BAND)
    side = lambda x: F.coalesce(F.sum("c").over(x), F.lit(0)) * (BAND + 1) / BACKGROUND
    hist = hist.withColumn("zone", F.sum("c").over(near)).withColumn("usual", F.greatest(side(left), side(right)))
    return hist.filter(_crowded(F.col("zone"), F.col("usual"))).select("source", "measure", "n")


def ending_forms(feats: DataFrame) -> DataFrame:
    """(form): forms of endings that recur over the corpus; at most 1 / FORM_SHARE rows, as each holds that share of the texts."""
    counts = feats.filter(F.col("form").rlike(r"^.:\S+\s+\S")).groupBy("form").agg(F.countDistinct("h").alias("n"))
    return counts.filter(F.col("n") >= max(FORM_LEAST, FORM_SHARE * feats.count())).select("form")


def _unfinished() -> Column:
    return ~F.col("ended") | (F.col("marker") & ~F.col("bare_ended")) | F.col("debris")


def _crowded(c: Column, usual: Column) -> Column:
    return (c >= LEAST_AT_SPIKE) & (c > usual + 5 * F.sqrt(usual + 1))


def find_truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, truncated, cut) for every row of df; cut is 'limit', 'transfer' or null.

    Null, empty and blank texts are not truncated. Rows of a null source form a source of their own. Repeated
    rows are judged alike, and equal texts count once in the histograms. An empty table gives an empty table.
    Only the three named columns are read, so clashing names don't matter.
    """
    feats = cut_lineage(features(df, key, text, source))
    # One row per source: its limits. A source has few limits, as each must hold many times the usual share.
    limits = spikes(feats).groupBy("source").agg(F.collect_set(F.struct("measure", "lo", "hi", "band")).alias("limits"))
    # Forms are at most 1 / FORM_SHARE = 5,000 texts of REACH characters, so they are sent to every worker.
    forms = F.broadcast(ending_forms(feats).withColumn("formulaic", F.lit(True)))
    rows = feats.join(limits.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").join(forms, "form", "left")
    size = lambda x: F.when(x["measure"] == "chars", F.col("chars")).otherwise(F.col("bytes"))
    at = lambda band: F.coalesce(F.exists("limits", lambda x: (x["band"] == F.lit(band)) & (size(x) >= x["lo"]) & (size(x) <= x["hi"])), F.lit(False))
    formulaic = F.coalesce(F.col("formulaic"), F.lit(False))
    cut_off = F.col("debris") | (F.col("marker") & ~F.col("bare_ended"))
    limit = _unfinished() & ((at(False) & (~formulaic | cut_off)) | (at(True) & (F.col("debris") | ~formulaic & ~F.col("item"))))
    loose = F.col("debris") | (~F.col("ended") & ~formulaic & ~F.col("item")) | (F.col("marker") & ~F.col("bare_ended") & ~formulaic)
    rows = rows.select("key", "source", "chars", "bytes", limit.alias("limit"), (loose & ~at(False) & ~at(True)).alias("loose")).filter("limit OR loose")
    pile = piles(feats)
    for measure in ("chars", "bytes"):
        here = pile.filter(F.col("measure") == measure).select(F.col("source").alias("_s"), F.col("n").alias(measure), F.lit(True).alias(f"_{measure}"))
        rows = rows.withColumnRenamed("source", "source_").join(here, F.col("source_").eqNullSafe(F.col("_s")) & (rows[measure] == here[measure]), "left").drop(here[measure]).drop("_s").withColumnRenamed("source_", "source")
    cut = F.when(F.col("limit"), F.lit("limit")).when(F.col("loose") & F.col("_chars").isNull() & F.col("_bytes").isNull(), F.lit("transfer"))
    judged = rows.select("key", cut.alias("cut")).filter("cut IS NOT NULL").groupBy("key").agg(F.min("cut").alias("cut"))
    ids = df.select(F.col(key).alias("key"), F.col(source).alias("source"))
    out = ids.join(judged, "key", "left")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), F.col("cut").isNotNull().alias("truncated"), "cut")


def truncation_rates(judged: DataFrame, source: str = "source") -> DataFrame:
    """Per source: texts, truncated texts, their share, and how many were cut at a limit and in mid-transfer."""
    n = F.sum(F.col("truncated").cast("long"))
    kinds = [F.count(F.when(F.col("cut") == c, 1)).alias(f"n_{c}") for c in ("limit", "transfer")]
    return judged.groupBy(source).agg(F.count("*").alias("n_texts"), n.alias("n_truncated"), (n / F.count("*")).alias("share"), *kinds)
