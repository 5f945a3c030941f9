"""Stable identifiers and content hashes."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of identifiers.
PREFIXES = ("project", "book", "chapter", "llmrun", "prompt", "schema", "snapshot", "character", "event", "relationship", "thread", "story", "candidate")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_id(prefix: str, key: Column) -> Column:
    """prefix, '_' and the first 32 hex digits of the SHA-256 of prefix, NUL and key."""
    if prefix not in PREFIXES:
        raise ValueError(f"unknown prefix {prefix}")
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(F.lit(prefix + "\0"), key), 256), 1, 32))


def is_stable_id(prefix: str, c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{prefix}_[0-9a-f]{{32}}$"), F.lit(False))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def ordered_hash(parts: Column) -> Column:
    """SHA-256 over an ordered array of strings, each preceded by its length, so that parts can't run together."""
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)), "\n"), 256)


def framed(name: str, value: Column) -> Column:
    """A field of the document hash: name, NUL, byte length, ':', value, line feed."""
    return F.concat(F.lit(name + "\0"), F.octet_length(value).cast("string"), F.lit(":"), value, F.lit("\n"))


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys, unescaped UTF-8, and whole numbers without a fraction."""

    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and math.isfinite(v) and v == int(v) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
