"""Model output to rows: JSON schemas, segments, chapter analyses, semantic proofreading."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import spans

KEYWORDS = frozenset({"$schema", "title", "description", "type", "enum", "required", "properties", "additionalProperties", "items"})
TYPES = frozenset({"object", "array", "string", "number", "integer", "boolean", "null"})


def schema_problems(schema: object, path: str = "$") -> list[str]:
    """What is wrong with a schema of the supported subset."""
    if not isinstance(schema, dict):
        return [f"{path}: a schema must be an object"]
    out = [f"{path}.{k}: unsupported keyword" for k in sorted(set(schema) - KEYWORDS)]
    types = schema.get("type", [])
    for t in types if isinstance(types, list) else [types]:
        if t not in TYPES:
            out.append(f"{path}.type: unknown type")
    if "enum" in schema and not (isinstance(schema["enum"], list) and schema["enum"]):
        out.append(f"{path}.enum: must be a non-empty array")
    req = schema.get("required", [])
    if not isinstance(req, list) or any(not isinstance(r, str) for r in req) or len(set(map(str, req))) < len(req):
        out.append(f"{path}.required: must be distinct names")
    if not isinstance(schema.get("additionalProperties", True), bool):
        out.append(f"{path}.additionalProperties: must be true or false")
    props = schema.get("properties", {})
    if not isinstance(props, dict):
        out.append(f"{path}.properties: must be an object")
        props = {}
    for k, v in sorted(props.items()):
        out += schema_problems(v, f"{path}.properties.{k}")
    if "items" in schema:
        out += schema_problems(schema["items"], f"{path}.items")
    return out


def _is(value: object, kind: str) -> bool:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None,
        "number": number, "integer": number and math.isfinite(value) and value == int(value) if number else False,
    }[kind]


def instance_problems(value: object, schema: dict, path: str = "$") -> list[str]:
    """What is wrong with a value under a valid schema; a wrong type ends the descent."""
    types = schema.get("type")
    if types is not None and not any(_is(value, t) for t in (types if isinstance(types, list) else [types])):
        return [f"{path}: wrong type"]
    out = []
    if "enum" in schema and not any(type(value) is type(e) and value == e for e in schema["enum"]):
        out.append(f"{path}: not an allowed value")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{path}.{k}: unexpected" for k in sorted(set(value) - set(props))]
        for k in sorted(set(value) & set(props)):
            out += instance_problems(value[k], props[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += instance_problems(v, schema["items"], f"{path}[{i}]")
    return out


def validate_json(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """df with ``problems``: an array of what is wrong with each JSON text; null text has the problem of not being JSON."""
    if bad := schema_problems(schema):
        raise ValueError("; ".join(bad))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                try:
                    out.append(instance_problems(json.loads(t), schema))
                except (TypeError, ValueError):
                    out.append(["$: not JSON"])
            yield pd.Series(out)

    return df.withColumn("problems", F.pandas_udf(run, "array<string>")(F.col(column)))


SEGMENTS = "struct<segments:array<struct<type:string,speaker:string,source_start:bigint,source_end:bigint,confidence:double>>>"
ANALYSIS = (
    "struct<characters:array<struct<name:string,aliases:array<struct<name:string>>,inferred:boolean,confidence:double,evidence:array<struct<source_start:bigint,source_end:bigint>>>>,"
    "locations:array<struct<name:string,inferred:boolean,confidence:double,evidence:array<struct<source_start:bigint,source_end:bigint>>>>,"
    "events:array<struct<description:string,participants:array<string>,location:string,inferred:boolean,confidence:double,evidence:array<struct<source_start:bigint,source_end:bigint>>>>,"
    "open_threads:array<struct<text:string,inferred:boolean,confidence:double,evidence:array<struct<source_start:bigint,source_end:bigint>>>>>"
)


def segments_from_json(responses: DataFrame, column: str = "output") -> DataFrame:
    """(chapter_id, segment_index, segment_type, speaker, start_byte, end_byte, confidence) of segmentation outputs."""
    rows = responses.select("chapter_id", F.posexplode(F.from_json(column, SEGMENTS)["segments"]).alias("segment_index", "s"))
    return rows.select("chapter_id", "segment_index", F.col("s.type").alias("segment_type"), "s.speaker", F.col("s.source_start").alias("start_byte"), F.col("s.source_end").alias("end_byte"), "s.confidence")


def analysis_claims(responses: DataFrame, column: str = "output") -> DataFrame:
    """(chapter_id, kind, claim_index, name, inferred, confidence, evidence): every claim of chapter analyses as a row."""
    a = F.from_json(column, ANALYSIS)
    rows = responses.select("chapter_id", a.alias("a"))
    parts = []
    for kind, field, name in (("character", "characters", "name"), ("location", "locations", "name"), ("event", "events", "description"), ("thread", "open_threads", "text")):
        one = rows.select("chapter_id", F.posexplode(F.col(f"a.{field}")).alias("claim_index", "c"))
        parts.append(one.select("chapter_id", F.lit(kind).alias("kind"), "claim_index", F.col(f"c.{name}").alias("name"), "c.inferred", "c.confidence", "c.evidence"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence_texts(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with the text of each piece of evidence, taken from the source's bytes and never from the model; null where a span is wrong.

    claims: key columns and evidence; sources: chapter_id, start_byte, text.
    """
    rows = claims.withColumn("_e", F.explode_outer("evidence")).join(sources.select("chapter_id", F.col("start_byte").alias("_base"), F.col("text").alias("_text")), "chapter_id", "left")
    s, e = F.col("_e.source_start") - F.col("_base"), F.col("_e.source_end") - F.col("_base")
    ok = (s >= 0) & (e > s) & (e <= F.octet_length("_text"))
    return rows.withColumn("evidence_text", F.when(ok, spans.byte_slice(F.col("_text"), s.cast("int"), e.cast("int")))).drop("_e", "_base", "_text")


def grounded(claims: DataFrame) -> DataFrame:
    """Claims that are inferences or have evidence."""
    return claims.filter(F.col("inferred") | (F.size("evidence") > 0))


def semantic_candidates(found: DataFrame, sources: DataFrame, protected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, errors) from model findings (chapter_id, source_start, source_end, suggestion, category, impact, confidence).

    The original is cut from the source. Bad spans, no-ops, repeats and protected places are errors here, not left out silently.
    """
    rows = found.join(sources.select("chapter_id", "source_id", F.col("start_byte").alias("base"), F.col("text").alias("_text")), "chapter_id", "left")
    s, e = F.col("source_start") - F.col("base"), F.col("source_end") - F.col("base")
    inside = F.coalesce((s >= 0) & (e > s) & (e <= F.octet_length("_text")), F.lit(False))
    rows = rows.withColumn("original", F.when(inside, spans.byte_slice(F.col("_text"), s.cast("int"), e.cast("int")))).drop("_text", "base")
    keys = ["chapter_id", "source_start", "source_end", "category", "suggestion"]
    code = F.when(F.col("original").isNull(), "InvalidSpan").when(F.col("original") == F.col("suggestion"), "NoChange").when(F.count("*").over(_over(keys)) > 1, "Duplicate")
    rows = rows.withColumn("code", code)
    if protected is not None:
        p = protected.select(F.col("source_id").alias("p_source"), "p_start", "p_end")
        hit = (F.col("source_id") == F.col("p_source")) & spans.protects(F.col("p_start"), F.col("p_end"), F.col("source_start"), F.col("source_end"))
        held = rows.join(p, hit, "left_semi").withColumn("code", F.coalesce("code", F.lit("Protected")))
        rows = held.unionByName(rows.join(p, hit, "left_anti"))
    return rows.filter("code IS NULL").drop("code"), rows.filter("code IS NOT NULL")


def _over(keys: list[str]):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*keys)
