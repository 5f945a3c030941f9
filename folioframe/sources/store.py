"""Parquet tables: write by staging, upserts, conditional updates, cascading deletes, JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Existing rows, replaced or joined by incoming ones; of repeated incoming keys the last by ``order``."""
    if order:
        others = [c for c in incoming.columns if c not in keys]
        incoming = incoming.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others))
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those incoming ones whose key is new."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def update_where(existing: DataFrame, changes: DataFrame, keys: list[str], expect: str, column: str) -> DataFrame:
    """Optimistic update: ``column`` takes the change's value where ``expect`` still has the change's expected value."""
    c = changes.select(*keys, F.col("expected").alias("_x"), F.col("value").alias("_v"))
    return existing.join(c, keys, "left").withColumn(column, F.when(F.col("_x").isNotNull() & (F.col(expect) == F.col("_x")), F.col("_v")).otherwise(F.col(column))).drop("_x", "_v")


def delete_cascade(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parent and child rows without the deleted keys."""
    return parent.join(gone.select(key), key, "left_anti"), child.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def next_version(df: DataFrame, by: list[str], column: str = "version") -> DataFrame:
    return df.groupBy(*by).agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_version"))


def write_all(spark: SparkSession, tables: dict[str, DataFrame], path: str, version: str) -> None:
    """Write tables together: all into the folder of a version, then the pointer to it. Readers see all or nothing of it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/_current")


def read_all(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    version = spark.read.schema("version string").json(f"{path}/_current").first()["version"]
    return {n: spark.read.parquet(f"{path}/{version}/{n}") for n in names}


def schema_problems(df: DataFrame, expected: str) -> list[str]:
    """Columns that are missing or of another type than in a DDL string."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = []
    for part in expected.split(","):
        name, kind = part.split()
        if name not in have:
            out.append(f"missing {name}")
        elif have[name] != kind:
            out.append(f"{name} is {have[name]}, not {kind}")
    return out


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, json, hash): rows as JSON with keys in alphabetical order, and its SHA-256."""
    cols = sorted(c for c in df.columns)
    j = F.to_json(F.struct(*cols))
    return df.select(key, j.alias("json")).withColumn("hash", F.sha2("json", 256))


def from_json_rows(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, rows whose hash doesn't fit or whose JSON is broken)."""
    parsed: Column = F.from_json("json", schema, {"mode": "PERMISSIVE"})
    checked = rows.withColumn("_v", parsed).withColumn("_ok", (F.sha2("json", 256) == F.col("hash")) & F.col("_v").isNotNull())
    return checked.filter("_ok").select("_v.*"), checked.filter("NOT coalesce(_ok, false)").drop("_v", "_ok")
