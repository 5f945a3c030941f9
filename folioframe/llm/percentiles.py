"""Problem 3: percentiles per group over very large numeric columns.

Distributed multi-select: each partition proposes the median of its values in every undecided range, the
weighted median of the proposals is the range's pivot, values are counted below, at and above it, and ranges
that hold no wanted rank are discarded. Ranges with few distinct values left are decided by one running count.
The result is exact (rank error 0). For combining days, ``summarise_days`` gives additive counts on a
logarithmic grid, from which ``combine`` takes the percentiles of any period with a relative error bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import cut_lineage, cut_plan

PROBABILITIES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: A range with at most so many distinct values is decided by a running count instead of more rounds.
SMALL_RANGE = 128
#: States of up to so many ranges are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_RANGES = 100_000
MAX_ROUNDS = 200


def value_counts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Long form (keys, metric, value double, n): how often each non-null, non-NaN value occurs per group."""
    pairs = F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values))
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.metric", "_p.value")
    return long.filter("value IS NOT NULL AND NOT isnan(value)").groupBy(*keys, "metric", "value").agg(F.count("*").alias("n"))


def select_ranks(counts: DataFrame, keys: list[str], probabilities: tuple[float, ...] = PROBABILITIES, small: int = SMALL_RANGE) -> DataFrame:
    """Exact percentiles (nearest rank: the ceil(p*n)-th smallest) of value counts (keys, value, n).

    Returns keys, p, value, n_values, rank_error (0). Null key values are a group of their own; an empty input
    gives no rows. Ties are counted, not expanded. The counts are read once per pass, never collected.
    """
    inf = float("inf")
    exact = F.to_json(F.struct(*(F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(f"k{i}") for i, k in enumerate(keys))))
    data = counts.select(*keys, exact.alias("_g"), "value", "n")
    data = cut_lineage(data)
    ps = F.array(*(F.lit(float(p)) for p in probabilities))
    groups = data.groupBy("_g", *keys).agg(F.sum("n").alias("n_values"), F.count("*").alias("d"))
    groups = cut_lineage(groups)
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.round(p * F.col("n_values"), 9))).cast("long")
    wanted = F.transform(ps, lambda p: F.struct(p.alias("p"), rank(p).alias("k")))
    state = groups.select("_g", F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"), wanted.alias("want"), "d")
    live, found, rounds, total = data.select("_g", "value", "n"), [], 0, None

    def small_enough(s: DataFrame, n: int) -> DataFrame:
        return F.broadcast(s) if n <= BROADCAST_RANGES else s

    def inside(d: DataFrame, s: DataFrame, n: int) -> DataFrame:
        s = small_enough(s.withColumnRenamed("_g", "_h"), n)
        return d.join(s, (F.col("_g") == F.col("_h")) & (F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi"))).drop("_h")

    while True:
        state = cut_plan(state)
        n_state = state.count()
        done = state.filter(F.col("d") <= small)
        n_done = done.count()
        if n_done:
            w = Window.partitionBy("_g", "lo").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            cum = inside(live, done.select("_g", "lo", "hi", "want"), n_done).withColumn("upto", F.sum("n").over(w))
            hit = cum.withColumn("want", F.filter("want", lambda x: (x["k"] <= F.col("upto")) & (x["k"] > F.col("upto") - F.col("n"))))
            found.append(hit.select("_g", F.explode("want").alias("_w"), "value").select("_g", "_w.p", "value"))
        if n_done == n_state:
            break
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError("multi-select did not end")
        state = state.filter(F.col("d") > small)
        n_state -= n_done
        here = inside(live, state.select("_g", "lo", "hi"), n_state)
        proposals = here.groupBy("_g", "lo", F.spark_partition_id().alias("pid")).agg(
            F.percentile("value", F.lit(0.5), F.col("n")).alias("m"), F.sum("n").alias("w")
        )
        pivots = proposals.groupBy("_g", "lo").agg(F.sort_array(F.collect_list(F.struct("m", "w"))).alias("ms"), F.sum("w").alias("total"))
        step = F.aggregate(
            "ms", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("m")),
            lambda a, x: F.struct((a["seen"] + x["w"]).alias("seen"), F.coalesce(a["m"], F.when((a["seen"] + x["w"]) * 2 >= F.col("total"), x["m"])).alias("m")),
        )
        pivots = cut_lineage(pivots.select("_g", "lo", step["m"].alias("pivot")).join(state, ["_g", "lo"]))
        seen = inside(live, pivots.select("_g", "lo", "hi", "pivot"), n_state)
        sides = seen.groupBy("_g", "lo").agg(
            F.coalesce(F.sum(F.when(F.col("value") < F.col("pivot"), F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("value") == F.col("pivot"), F.col("n"))), F.lit(0)).alias("at"),
            F.count(F.when(F.col("value") < F.col("pivot"), 1)).alias("d_below"),
            F.count(F.when(F.col("value") > F.col("pivot"), 1)).alias("d_above"),
        )
        split = cut_lineage(pivots.join(sides, ["_g", "lo"]))
        upto = F.col("below") + F.col("at")
        mid = F.filter("want", lambda x: (x["k"] > F.col("below")) & (x["k"] <= upto))
        found.append(split.select("_g", F.explode(mid).alias("_w"), F.col("pivot").alias("value")).select("_g", "_w.p", "value"))
        low = F.struct("lo", F.col("pivot").alias("hi"), F.filter("want", lambda x: x["k"] <= F.col("below")).alias("want"), F.col("d_below").alias("d"))
        above = F.transform(F.filter("want", lambda x: x["k"] > upto), lambda x: F.struct(x["p"].alias("p"), (x["k"] - upto).alias("k")))
        high = F.struct(F.col("pivot").alias("lo"), "hi", above.alias("want"), F.col("d_above").alias("d"))
        # Exploded, not united, so that the number of partitions stays.
        state = split.select("_g", F.explode(F.array(low, high)).alias("_s")).select("_g", "_s.*").filter("size(want) > 0")
        left = split.agg(F.sum(F.col("d_below") + F.col("d_above"))).first()[0] or 0
        if total is None or left * 2 < total:  # rows of discarded ranges are not read again
            state = cut_plan(state)
            live, total = cut_plan(inside(live, state.select("_g", "lo", "hi"), 2 * n_state).select("_g", "value", "n")), left
    if not found:
        found.append(groups.select("_g", F.lit(0.0).alias("p"), F.lit(0.0).alias("value")).limit(0))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    groups_ = groups.select("_g", *keys, "n_values")
    return out.join(groups_, "_g").select(*keys, "p", "value", "n_values", F.lit(0.0).alias("rank_error"))


def bucket(value: Column, accuracy: float) -> Column:
    """Index on a logarithmic grid whose cells differ by at most ``accuracy`` relative to their middle; 0 and signs have cells of their own."""
    g = math.log((1 + accuracy) / (1 - accuracy))
    size = F.ceil(F.log(F.abs(value)) / g).cast("long")
    return F.struct(F.signum(value).cast("int").alias("sign"), F.when(value != 0, size).otherwise(F.lit(0)).alias("cell"))


def summarise_days(counts: DataFrame, keys: list[str], day: str = "day", accuracy: float = 0.01) -> DataFrame:
    """Additive day summaries (keys, day, sign, cell, n, accuracy): summaries of any rows are combined by adding n."""
    b = counts.select(*keys, day, bucket(F.col("value"), accuracy).alias("_b"), "n")
    return b.groupBy(*keys, day, "_b").agg(F.sum("n").alias("n")).select(*keys, day, "_b.sign", "_b.cell", "n", F.lit(accuracy).alias("accuracy"))


def combine(summaries: DataFrame, keys: list[str], probabilities: tuple[float, ...] = PROBABILITIES, accuracy: float = 0.01) -> DataFrame:
    """Percentiles per keys from summaries: p, value, n_values, relative_error (the bound). Keys may be coarser than the summaries'."""
    g = (1 + accuracy) / (1 - accuracy)
    cells = summaries.groupBy(*keys, "sign", "cell").agg(F.sum("n").alias("n"))
    order = F.col("sign") * 1_000_000 + F.col("sign") * F.col("cell")
    w = Window.partitionBy(*keys).orderBy(order)
    cells = cells.withColumn("upto", F.sum("n").over(w)).withColumn("n_values", F.sum("n").over(Window.partitionBy(*keys)))
    ps = F.array(*(F.lit(float(p)) for p in probabilities))
    hit = F.filter(ps, lambda p: (F.greatest(F.lit(1), F.ceil(F.round(p * F.col("n_values"), 9))) <= F.col("upto")) & (F.greatest(F.lit(1), F.ceil(F.round(p * F.col("n_values"), 9))) > F.col("upto") - F.col("n")))
    middle = F.col("sign") * F.pow(F.lit(g), F.col("cell")) * F.lit(2 / (1 + g))
    return cells.select(*keys, F.explode(hit).alias("p"), F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(middle).alias("value"), "n_values", F.lit(accuracy).alias("relative_error"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Model, day, latency_ms and total_tokens of every run once (redelivered rows are alike)."""
    rows = runs.select("run_id", "model", F.to_date("started_at").alias("day"), "latency_ms", "total_tokens")
    return rows.filter("latency_ms IS NOT NULL OR total_tokens IS NOT NULL").dropDuplicates(["run_id"]).drop("run_id")


def percentiles_of_runs(runs: DataFrame, probabilities: tuple[float, ...] = PROBABILITIES, small: int = SMALL_RANGE) -> DataFrame:
    """Exact percentiles of latency_ms and total_tokens: per model (scope 'all', day null) and per model and day (scope 'day')."""
    counts = cut_lineage(value_counts(run_metrics(runs), ["model", "day"], ["latency_ms", "total_tokens"]))
    days = counts.select(F.lit("day").alias("scope"), "model", "day", "metric", "value", "n")
    whole = counts.groupBy("model", "metric", "value").agg(F.sum("n").alias("n")).select(F.lit("all").alias("scope"), "model", F.lit(None).cast("date").alias("day"), "metric", "value", "n")
    return select_ranks(whole.unionByName(days), ["scope", "model", "day", "metric"], probabilities, small)
