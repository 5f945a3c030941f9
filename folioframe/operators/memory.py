"""Story memory: characters, relationships, timeline and open threads of a project, rebuilt from chapter records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import ids, text


def name_key(c: Column) -> Column:
    """The key under which names are one: trimmed, composed characters, in lower case."""
    return F.lower(text.nfc(text.trimmed(c)))


def name_keys(c: Column) -> Column:
    return F.transform(text.nfc_each(c), lambda x: F.lower(text.trimmed(x)))


def is_blank_key(c: Column) -> Column:
    return text.trimmed(c) == ""


def characters(records: DataFrame) -> DataFrame:
    """Per project and name key: id, first spelling, aliases by key, chapters, first and last sequence.

    records: project_id, chapter_id, sequence, position, name, aliases.
    """
    rows = records.withColumn("key", name_key(F.col("name"))).filter(~is_blank_key(F.col("key")))
    base = rows.groupBy("project_id", "key").agg(
        F.min_by("name", F.struct("sequence", "position", "name")).alias("name"), F.count_distinct("chapter_id").alias("n_chapters"),
        F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
    )
    alias = rows.select("project_id", "key", F.explode("aliases").alias("alias"), "sequence", "position").withColumn("akey", name_key(F.col("alias")))
    alias = alias.groupBy("project_id", "key", "akey").agg(F.min_by("alias", F.struct("sequence", "position", "alias")).alias("alias"))
    alias = alias.groupBy("project_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("akey", "alias"))), lambda x: x["alias"]).alias("aliases"))
    out = base.join(alias, ["project_id", "key"], "left")
    cid = ids.stable_id("character", F.concat("project_id", F.lit(":"), "key"))
    return out.select("project_id", cid.alias("character_id"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "n_chapters", "first_sequence", "last_sequence")


def local_names(records: DataFrame) -> DataFrame:
    """(project_id, chapter_id, key, character_id): names and aliases that mean one character in their chapter."""
    own = name_key(F.col("name"))
    cid = ids.stable_id("character", F.concat("project_id", F.lit(":"), own))
    named = records.select("project_id", "chapter_id", cid.alias("character_id"), F.explode(F.concat(F.array(own), name_keys(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("key"))
    one = named.filter(~is_blank_key(F.col("key"))).groupBy("project_id", "chapter_id", "key").agg(F.count_distinct("character_id").alias("n"), F.min("character_id").alias("character_id"))
    return one.filter("n = 1").drop("n")


def resolve_participants(events: DataFrame, names: DataFrame) -> DataFrame:
    """Event participants with the character their name means in the chapter, or null where it means none or several."""
    rows = events.withColumn("key", name_key(F.col("participant")))
    return rows.join(names, ["project_id", "chapter_id", "key"], "left").drop("key")


def relationships(resolved: DataFrame) -> DataFrame:
    """Per pair of characters that share events: the number of events, first and last sequence."""
    one = resolved.filter("character_id IS NOT NULL").select("project_id", "event_id", "sequence", "character_id").distinct()
    a, b = one.withColumnRenamed("character_id", "first_id"), one.select("project_id", "event_id", F.col("character_id").alias("second_id"))
    pairs = a.join(b, ["project_id", "event_id"]).filter("first_id < second_id")
    out = pairs.groupBy("project_id", "first_id", "second_id").agg(F.count("*").alias("n_events"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))
    return out.withColumn("relationship_id", ids.stable_id("relationship", F.concat("first_id", F.lit(":"), "second_id")))


def timeline(events: DataFrame) -> DataFrame:
    """(project_id, position, event_id): events in the order of chapters and of their index."""
    w = Window.partitionBy("project_id").orderBy("sequence", "event_index", "event_id")
    return events.select("project_id", "event_id", "sequence", "event_index").distinct().select("project_id", "event_id", (F.row_number().over(w) - 1).alias("position"))


def open_threads(records: DataFrame) -> DataFrame:
    """Per project and thread text: id, text, mentions, first and last sequence, whether only inferred. records: project_id, chapter_id, sequence, thread, inferred."""
    rows = records.withColumn("key", name_key(F.col("thread"))).filter(~is_blank_key(F.col("key")))
    out = rows.groupBy("project_id", "key").agg(
        F.min_by("thread", F.struct("sequence", "thread")).alias("thread"), F.count_distinct("chapter_id").alias("n_mentions"), F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"), F.bool_and("inferred").alias("inferred_only"),
    )
    return out.select("project_id", ids.stable_id("thread", F.concat("project_id", F.lit(":"), "key")).alias("thread_id"), "thread", "n_mentions", "first_sequence", "last_sequence", "inferred_only")


def record_problems(records: DataFrame) -> DataFrame:
    """(project_id, chapter_id, code): gaps in the sequence, repeated chapters, blank or repeated names, bad confidence, ungrounded claims."""
    chapters = records.select("project_id", "chapter_id", "sequence").distinct()
    w = Window.partitionBy("project_id").orderBy("sequence", "chapter_id")
    parts = [
        chapters.withColumn("n", F.row_number().over(w) - 1).filter("n != sequence").select("project_id", "chapter_id", F.lit("InvalidSequence").alias("code")),
        chapters.groupBy("project_id", "chapter_id").count().filter("count > 1").select("project_id", "chapter_id", F.lit("DuplicateChapter").alias("code")),
        records.filter((F.col("name").isNull()) | (text.trimmed(F.col("name")) != F.col("name")) | (F.col("name") == "")).select("project_id", "chapter_id", F.lit("InvalidName").alias("code")),
        records.groupBy("project_id", "chapter_id", name_key(F.col("name")).alias("k")).count().filter("count > 1").filter(~is_blank_key(F.col("k"))).select("project_id", "chapter_id", F.lit("DuplicateName").alias("code")),
        records.filter("confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1").select("project_id", "chapter_id", F.lit("InvalidConfidence").alias("code")),
        records.filter("NOT inferred AND size(evidence) <= 0").select("project_id", "chapter_id", F.lit("Ungrounded").alias("code")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def state_hash(rows: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """(by, state_hash): an ordered content hash of the rows of each group."""
    part = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in fields))
    one = F.struct(*order, part.alias("_p"))
    return rows.groupBy(*by).agg(ids.ordered_hash(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_p"])).alias("state_hash"))


def as_of(records: DataFrame, sequence: int) -> DataFrame:
    """Records up to a chapter, from which the state as of then is rebuilt."""
    return records.filter(F.col("sequence") <= sequence)


def entity_names(records: DataFrame) -> DataFrame:
    """(chapter_id, names): names and aliases of a chapter, each once, in order."""
    named = records.select("chapter_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).filter("n IS NOT NULL")
    return named.groupBy("chapter_id").agg(F.array_sort(F.collect_set("n")).alias("names"))


def semantic_signatures(records: DataFrame) -> DataFrame:
    """(chapter_id, signature): a hash of what a chapter says of its characters, whatever the order and the evidence's place."""
    claim = F.concat_ws("\x1f", name_key(F.col("name")), F.array_join(F.array_sort(F.array_distinct(name_keys(F.coalesce("aliases", F.array().cast("array<string>"))))), "\x1e"), F.coalesce(F.col("inferred").cast("string"), F.lit("")))
    return records.groupBy("chapter_id").agg(ids.ordered_hash(F.array_sort(F.collect_set(claim))).alias("signature"))


def signature_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(chapter_id, change): chapters whose signature is new, gone or another."""
    b, a = before.withColumnRenamed("signature", "b"), after.withColumnRenamed("signature", "a")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "chapter_id", "full").select("chapter_id", change.alias("change")).filter("change IS NOT NULL")
