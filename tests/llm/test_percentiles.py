import math
import random

from folioframe.llm import percentiles as P


def data(spark, n=3000):
    random.seed(5)
    rows = [(random.choice(["a", "b", None]), f"2025-01-0{random.randint(1, 3)}", random.choice([random.lognormvariate(3, 2), 7.0, 0.0, -3.5])) for _ in range(n)] + [("c", "2025-01-01", 1.0), ("d", "2025-01-01", None)]
    return rows, spark.createDataFrame(rows, "model string, day string, v double").repartition(5)


def nearest(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(round(p * len(values), 9))) - 1]


def test_multi_select_is_exact(spark):
    rows, df = data(spark)
    counts = P.value_counts(df, ["model"], ["v"])
    for small in (3, 100_000):
        got = P.select_ranks(counts, ["model", "metric"], (0.01, 0.5, 0.5, 0.99, 1.0), small).collect()
        assert {r["model"] for r in got} == {"a", "b", None, "c"}
        for r in got:
            assert r["value"] == nearest([v for m, _, v in rows if m == r["model"] and v is not None], r["p"]) and r["rank_error"] == 0


def test_days_combine_within_the_bound(spark):
    rows, df = data(spark)
    counts = P.value_counts(df, ["model", "day"], ["v"])
    days = P.summarise_days(counts, ["model", "metric"], "day", 0.01)
    for r in P.combine(days, ["model", "metric"], (0.25, 0.5, 0.9, 0.99), 0.01).collect():
        want = nearest([v for m, _, v in rows if m == r["model"] and v is not None], r["p"])
        assert abs(r["value"] - want) <= 0.0100001 * abs(want)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([("a", "d", None)], "model string, day string, v double")
    assert P.select_ranks(P.value_counts(df, ["model"], ["v"]), ["model", "metric"]).count() == 0


def test_runs_count_once(spark):
    df = spark.sql("SELECT * FROM VALUES ('r1','m',TIMESTAMP'2025-01-01 10:00:00',5L,NULL,1),('r1','m',TIMESTAMP'2025-01-01 10:00:00',5L,NULL,2),('r2','m',TIMESTAMP'2025-01-01 11:00:00',9L,3,3) AS t(run_id, model, started_at, latency_ms, total_tokens, value)")
    got = P.percentiles_of_runs(df, (0.5,)).collect()
    assert {(r["scope"], r["metric"], r["value"], r["n_values"]) for r in got} == {("all", "latency_ms", 5.0, 2), ("day", "latency_ms", 5.0, 2), ("all", "total_tokens", 3.0, 1), ("day", "total_tokens", 3.0, 1)}
