"""Pieces of SQL that several queries share."""

from __future__ import annotations

IDEO = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2EBEF}"
CJK = IDEO + r"\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
_SPACE = r"[\s\p{Z}\x{85}\x{0B}]"
_WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:[''’][\p{L}\p{N}][\p{L}\p{N}\p{M}]*)*"


def TRIM(c: str) -> str:  # noqa: N802
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def words_sql(c: str) -> str:
    return f"coalesce(len(regexp_extract_all(regexp_replace({c}, '[{IDEO}]', ' ', 'g'), '{_WORD}')) + len(regexp_extract_all({c}, '[{IDEO}]')), 0)"


def one_block() -> str:
    return "b AS (SELECT DISTINCT ON (chapter_id, block_index) * FROM blocks ORDER BY chapter_id, block_index, ingested_at)"


def MATCHES(pattern: str) -> str:  # noqa: N802
    """CTE mm(source_id, m, p): the matches of a pattern in s(source_id, t) with their byte positions."""
    return f"""m0 AS (SELECT source_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM s),
      m1 AS (SELECT source_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM m0 WHERE len(ms) > 0),
      mm AS (SELECT source_id, m, sum(strlen(g) + strlen(m)) OVER (PARTITION BY source_id ORDER BY i) - strlen(m) AS p FROM m1)"""
