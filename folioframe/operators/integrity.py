"""Narrative integrity: rules over events on a logical story clock.

events: event_id, character_id, kind (speech, death, revival, knowledge, location, reference), tick, ord, used_name,
information_id, location_id, grounded, confidence. Every rule is a window, an equi join or a range join within a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.memory import name_key
from folioframe.operators.proofread import maybe_broadcast

#: Ticks of the clock within which names are counted together.
STRETCH = 1440


def _moment(tick: str, order: str) -> Column:
    return F.struct(F.col(tick).alias("t"), F.col(order).alias("o"))


def _found(df: DataFrame, rule: str, severity: str) -> DataFrame:
    return df.select("event_id", "character_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("confidence"))


def _either(df: DataFrame, *cases: tuple[Column, str, str]) -> DataFrame:
    """Findings of rows that make one at most: the first case (condition, rule, severity) that holds."""
    rules = severities = F
    for holds, rule, severity in cases:
        rules, severities = rules.when(holds, rule), severities.when(holds, severity)
    return df.select("event_id", "character_id", rules.alias("rule"), severities.alias("severity"), "confidence").filter("rule IS NOT NULL")


def _by_moment() -> Window:
    return Window.partitionBy("character_id").orderBy("tick", "ord", "event_id")


def known(events: DataFrame, characters: DataFrame) -> DataFrame:
    """Events of registered characters; the others are reported and skipped by all other rules."""
    return events.join(characters.select("character_id"), "character_id", "left_semi")


def existence(events: DataFrame, characters: DataFrame) -> DataFrame:
    """Events of characters that aren't registered, and events before their character exists."""
    rows = events.join(characters.select("character_id", _moment("from_tick", "from_ord").alias("_from")), "character_id", "left")
    unresolved = F.col("_from").isNull()
    return _either(rows, (unresolved, "UNRESOLVED_CHARACTER", "notice"), (_moment("tick", "ord") < F.col("_from"), "APPEARANCE_BEFORE_EXISTENCE", "warning"))


def speech_after_death(events: DataFrame) -> DataFrame:
    """Speech whose last life event before it is a death; only a revival backed by evidence clears one."""
    change = F.when(F.col("kind") != "speech", F.struct("kind", "event_id", "confidence"))
    lives = events.filter("kind IN ('speech', 'death') OR (kind = 'revival' AND grounded)")
    rows = lives.withColumn("last", F.last(change, ignorenulls=True).over(_by_moment().rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.filter("kind = 'speech' AND last.kind = 'death'").withColumn("confidence", F.least("confidence", "last.confidence"))
    return _found(rows, "SPEECH_AFTER_DEATH", "warning")


def locations(events: DataFrame, registry: DataFrame, travel: DataFrame) -> DataFrame:
    """Unknown locations, transitions without a known bound, and transitions faster than their bound. An unknown location breaks the chain."""
    here = events.filter("kind = 'location'").join(maybe_broadcast(registry.select("location_id", F.lit(True).alias("_known"))), "location_id", "left")
    w = _by_moment()
    here = here.withColumn("_known", F.coalesce("_known", F.lit(False))).withColumn("prev", F.lag(F.struct("location_id", "tick", "_known", "confidence")).over(w))
    moved = F.col("_known") & F.col("prev._known") & (F.col("prev.location_id") != F.col("location_id"))
    here = here.withColumn("from_id", F.when(moved, F.col("prev.location_id"))).withColumn("confidence", F.when(moved, F.least("confidence", "prev.confidence")).otherwise(F.col("confidence")))
    routes = travel.groupBy(F.col("from_id"), F.col("to_id").alias("location_id")).agg(F.min("minimum_ticks").alias("minimum_ticks"))
    here = here.join(maybe_broadcast(routes), ["from_id", "location_id"], "left")
    moved, bound = F.col("from_id").isNotNull(), F.col("minimum_ticks")
    return _either(here, (~F.col("_known"), "UNRESOLVED_LOCATION", "notice"), (moved & bound.isNull(), "UNKNOWN_TRAVEL_CONSTRAINT", "notice"), (moved & (F.col("tick") - F.col("prev.tick") < bound), "IMPOSSIBLE_LOCATION_TRANSITION", "warning"))


def knowledge(events: DataFrame, information: DataFrame, revelations: DataFrame) -> DataFrame:
    """Knowledge of unknown information, without a stated access, or before it."""
    rows = events.filter("kind = 'knowledge'").join(maybe_broadcast(information.select("information_id", F.lit(True).alias("_known"))), "information_id", "left")
    # By the character alone, by which the events already lie.
    told = revelations.groupBy("character_id").agg(F.collect_list(F.struct("information_id", _moment("from_tick", "from_ord").alias("m"))).alias("told"))
    access = F.array_min(F.transform(F.filter("told", lambda x: x["information_id"] == F.col("information_id")), lambda x: x["m"]))
    rows = rows.join(told, "character_id", "left").withColumn("access", access)
    return _either(rows, (F.col("_known").isNull(), "UNRESOLVED_INFORMATION", "notice"), (F.col("access").isNull(), "UNKNOWN_KNOWLEDGE_ACCESS", "notice"), (_moment("tick", "ord") < F.col("access"), "KNOWLEDGE_BEFORE_REVELATION", "warning"))


def _stretch(tick: str) -> Column:
    return F.floor(F.col(tick) / STRETCH).alias("_s")


def _owners_at(rows: DataFrame, seen: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, tick, ord and others) with the number of existing owners of the name at their moment. seen: by and _s of all rows.

    A running sum over the beginnings and ends of what each owner's times add up to, within stretches of the clock that
    start from the sum before them, so that neither pairs of rows and owners arise nor a frequent name is one task.
    """
    t = names.withColumn("a", F.when(F.col("canonical"), F.col("owner_from")).otherwise(F.greatest("a", "owner_from"))).filter("b IS NULL OR a < b")
    w = Window.partitionBy(*by, "owner").orderBy("a")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_new", ~F.coalesce(F.max(F.col("b").isNull()).over(before) | (F.col("a") <= F.max("b").over(before)), F.lit(False)))
    t = t.withColumn("_n", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.groupBy(*by, "owner", "_n").agg(F.min("a").alias("a"), F.when(~F.max(F.col("b").isNull()), F.max("b")).alias("b"))
    bounds = t.select(*by, F.explode(F.array(F.struct(F.col("a").alias("m"), F.lit(1).alias("d")), F.struct(F.col("b").alias("m"), F.lit(-1).alias("d")))).alias("x")).select(*by, "x.*").filter("m IS NOT NULL")
    bounds = bounds.groupBy(*by, F.col("m.t").alias("tick"), F.col("m.o").alias("ord")).agg(F.sum("d").alias("d"))
    sums = bounds.select(*by, _stretch("tick"), "d").unionByName(seen.select(*by, "_s", F.lit(0).cast("long").alias("d"))).groupBy(*by, "_s").agg(F.sum("d").alias("d"))
    start = F.sum("d").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    points = sums.select(*by, "_s", F.coalesce(start, F.lit(0)).alias("d"), F.lit(0).alias("_o")).unionByName(bounds.select(*by, _stretch("tick"), "d", "tick", "ord", F.lit(1).alias("_o")), allowMissingColumns=True)
    every = rows.withColumn("_s", _stretch("tick")).withColumn("_o", F.lit(2)).unionByName(points, allowMissingColumns=True)
    # Null, the moment of a start, comes first; a bound comes before the rows of its moment.
    w = Window.partitionBy("_s", *by).orderBy("tick", "ord", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("owners", F.sum("d").over(w)).filter("_o = 2").drop("_s", "_o", "d")


def name_use(events: DataFrame, characters: DataFrame, variants: DataFrame) -> DataFrame:
    """Names that aren't valid at their moment, and names that then denote another character too.

    variants: character_id, name, from_tick, from_ord, until_tick, until_ord (null: open); the end is exclusive.
    Where all three have a project_id, names are those of their project.
    """
    scope = ["project_id"] if all("project_id" in d.columns for d in (events, characters, variants)) else []
    used = events.filter("used_name IS NOT NULL")
    canon = characters.select(*scope, "character_id", name_key(F.col("name")).alias("key"), "from_tick", "from_ord", F.lit(None).cast("long").alias("until_tick"), F.lit(None).cast("long").alias("until_ord"), F.lit(True).alias("canonical"))
    var = variants.select(*scope, "character_id", name_key(F.col("name")).alias("key"), "from_tick", "from_ord", "until_tick", "until_ord", F.lit(False).alias("canonical"))
    exists = characters.groupBy(F.col("character_id").alias("owner")).agg(F.min(_moment("from_tick", "from_ord")).alias("owner_from"))
    names = canon.unionByName(var).withColumnRenamed("character_id", "owner").join(exists, "owner")
    names = names.select("key", *scope, "owner", "owner_from", "canonical", _moment("from_tick", "from_ord").alias("a"), F.when(F.col("until_tick").isNotNull(), _moment("until_tick", "until_ord")).alias("b"))
    m = _moment("tick", "ord")
    # Joined by the character alone, by which the events already lie, and before keys are made, as Python forgets how they lie.
    mine = names.groupBy(F.col("owner").alias("character_id")).agg(F.first("owner_from").alias("owner_from"), F.collect_set(F.struct("key", *scope, "canonical", "a", "b")).alias("names"))
    same = lambda x: (x["key"] == F.col("key")) & (x["project_id"] == F.col("project_id")) if scope else x["key"] == F.col("key")
    valid = F.exists("names", lambda x: same(x) & (x["canonical"] | ((m >= x["a"]) & (x["b"].isNull() | (m < x["b"])))))
    rows = used.join(mine, "character_id", "left").withColumn("key", name_key(F.col("used_name"))).withColumn("own", F.coalesce(valid, F.lit(False)))
    rows = rows.select("event_id", "character_id", "confidence", "key", *scope, "tick", "ord", F.when(F.col("own") & (m >= F.col("owner_from")), 2).otherwise(F.col("own").cast("int")).alias("own"))
    seen = used.select("used_name", *scope, _stretch("tick")).distinct().withColumn("key", name_key(F.col("used_name")))
    rows = _owners_at(rows, seen, names, ["key", *scope])
    # Of an event, by bits: a name that is its character's own (1), a name that another character has (2).
    use = F.when(F.col("own") > 0, 1).otherwise(0).bitwiseOR(F.when(F.col("owners") > F.when(F.col("own") == 2, 1).otherwise(0), 2).otherwise(0))
    rows = rows.select("event_id", "character_id", "confidence", use.alias("use")).withColumn("use", F.bit_or("use").over(Window.partitionBy("event_id")))
    return _either(rows, (F.col("use").bitwiseAND(1) == 0, "INVALID_NAME_VARIANT", "warning"), (F.col("use") == 3, "AMBIGUOUS_NAME_VARIANT", "notice"))


def check(events: DataFrame, characters: DataFrame, variants: DataFrame, registry: DataFrame, travel: DataFrame, information: DataFrame, revelations: DataFrame) -> DataFrame:
    """All findings: event_id, character_id, rule, severity, confidence."""
    mine = known(events, characters)
    parts = [existence(events, characters), name_use(mine, characters, variants), speech_after_death(mine), knowledge(mine, information, revelations), locations(mine, registry, travel)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explain(findings: DataFrame, explanations: DataFrame, rules: tuple[str, ...] = ()) -> DataFrame:
    """Findings with the reason that explains them; null where a finding stays open.

    rules: all that explanations are of, where that is known; findings of other rules then stay open without being moved.
    """
    e = explanations.groupBy("event_id", "rule").agg(F.min("reason").alias("reason"))
    if not rules:
        return findings.join(e, ["event_id", "rule"], "left")
    may = F.col("rule").isin(*rules)
    explained = findings.filter(may).join(e, ["event_id", "rule"], "left")
    return explained.unionByName(findings.filter(~may | F.col("rule").isNull()).withColumn("reason", F.lit(None).cast(e.schema["reason"].dataType)))
