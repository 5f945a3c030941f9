"""Context for prompts: ranked memory, admitted as far as a token budget goes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text

#: Priorities of relevant and other memory by kind.
BANDS = {"character": (500_000, 100_000), "event": (400_000, 200_000), "thread": (300_000, 50_000)}
KINDS = ("character", "event", "thread")
_ORDER = sorted(((v, k, not i) for k, kind in enumerate(KINDS) for i, v in enumerate(BANDS[kind])), reverse=True)
#: Contexts that share a copy of their project's memory; rows and prompts of a batch; lines that are looked through at once.
SHARE, ROWS, PROMPTS, SKIP = 256, 20_000, 100, 1024

_cjk = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002ebef぀-ヿ가-힯"
_parts = regex.compile(rf"([{_cjk}])|([\p{{L}}\p{{N}}_']+)|(\s)|(.)", regex.S)


def estimate(value: str) -> int:
    """The token estimate of functions.text for one string."""
    n = run = 0
    for m in _parts.finditer(value):
        if m.group(2):
            run = len(m.group(2))
            n += -(-run // 4)
        elif not m.group(3):
            n += 1
    return n


def items(characters: DataFrame, threads: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(project_id, kind, stable_id, text, recency, terms, character_ids): what a project remembers; kind is an index of KINDS.

    events: project_id, event_id, sequence, description, participants (names in order), character_ids, location. An
    item is relevant to a query that contains one of its terms, an event also where one of its characters is relevant.
    """
    low = lambda c: F.lower(text.nfc(F.col(c)))
    recency = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.lit(9999))).cast("int")
    none = F.array().cast("array<string>")

    def of(df: DataFrame, kind: str, key: str, line: Column, at: str, terms: Column, ids: Column = none) -> DataFrame:
        return df.select("project_id", F.lit(KINDS.index(kind)).alias("kind"), F.col(key).alias("stable_id"), line.alias("text"), recency(at).alias("recency"), terms.alias("terms"), ids.alias("character_ids"))

    characters = characters.withColumn("name_key", low("name")).withColumn("alias_keys", F.transform(text.nfc_each(F.col("aliases")), F.lower))
    named = F.concat(text.mention_terms(F.col("name_key")), F.flatten(F.transform(F.coalesce("alias_keys", none), text.mention_terms)))
    alias = F.when(F.size("aliases") > 0, F.concat(F.lit(" | aliases: "), F.array_join("aliases", ", "))).otherwise("")
    seen = F.concat(F.lit(" | seen in "), F.col("n_chapters").cast("string"), F.lit(" chapter(s), last in chapter "), (F.col("last_sequence") + 1).cast("string"))
    out = of(characters, "character", "character_id", F.concat("name", alias, seen), "last_sequence", named)
    open_ = F.concat(F.lit("Open since chapter "), (F.col("first_sequence") + 1).cast("string"), F.lit(": "), "thread", F.when(F.col("inferred_only"), " | inferred").otherwise(""))
    out = out.unionByName(of(threads.withColumn("thread_key", low("thread")), "thread", "thread_id", open_, "last_sequence", text.mention_terms(F.col("thread_key"))))
    if events is None:
        return out
    happened = events.withColumn("description_key", low("description")).withColumn("location_key", low("location"))
    who = F.when(F.size("participants") > 0, F.concat(F.lit(" | participants: "), F.array_join("participants", ", "))).otherwise("")
    where = F.when(F.col("location").isNotNull(), F.concat(F.lit(" | location: "), "location")).otherwise("")
    line = F.concat(F.lit("Chapter "), (F.col("sequence") + 1).cast("string"), F.lit(": "), "description", who, where)
    told = F.concat(text.mention_terms(F.col("description_key")), text.mention_terms(F.col("location_key")))
    return out.unionByName(of(happened, "event", "event_id", line, "sequence", told, F.coalesce("character_ids", none)))


class Memory:
    """What a project remembers, in the order of kind, recency and id, with an index of its terms."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(parts) if parts else pa.table({"kind": pa.array([], pa.int32()), "recency": pa.array([], pa.int32()), **{c: pa.array([], pa.string()) for c in ("stable_id", "text")}, **{c: pa.array([], pa.list_(pa.string())) for c in ("terms", "character_ids")}})
        one = lambda c: pa.concat_arrays(t[c].chunks) if t[c].num_chunks else pa.array([], t[c].type)
        self.stable_id, self.text = one("stable_id"), one("text")
        self.kind, self.recency = t["kind"].to_numpy(), t["recency"].to_numpy()
        self.ends = np.searchsorted(self.kind, range(len(KINDS) + 1))
        row, values = self._pairs(one("terms"))
        coded = values.dictionary_encode()
        self.terms, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        by = np.argsort(code, kind="stable")
        self.rows, self.starts = row[by], np.searchsorted(code[by], range(len(self.terms) + 1))
        self.heads: dict[str, list[int]] = {}
        for k, term in enumerate(self.terms):
            self.heads.setdefault(term[:4], []).append(k)
        self.head_lengths = {len(h) for h in self.heads}
        people = {x: i for i, x in enumerate(self.stable_id[: self.ends[1]].to_pylist())}
        row, values = self._pairs(one("character_ids"))
        there = np.array([people.get(x, -1) for x in values.to_pylist()], dtype=np.int64)
        self.takes_part, self.person = row[there >= 0], there[there >= 0]

    @staticmethod
    def _pairs(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten()

    def _found(self, query: str) -> list[int]:
        """Terms that a query contains: only those whose beginning is among the query's n-grams are looked for."""
        if 8 * len(self.terms) < len(query):
            return [k for k, t in enumerate(self.terms) if t in query]
        grams = {query[i : i + n] for n in self.head_lengths for i in range(len(query) - n + 1)}
        return [k for g in grams & self.heads.keys() for k in self.heads[g] if self.terms[k] in query]

    def ranked(self, query: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of priority, kind and id, and their priorities."""
        relevant = np.zeros(len(self.kind), dtype=bool)
        for k in self._found(query):
            relevant[self.rows[self.starts[k] : self.starts[k + 1]]] = True
        relevant[self.takes_part[relevant[self.person]]] = True
        # Bands are further apart than recency goes, so that each is in order as it stands.
        order, priority = [], []
        for value, kind, is_relevant in _ORDER:
            rows = self.ends[kind] + np.flatnonzero(relevant[self.ends[kind] : self.ends[kind + 1]] == is_relevant)
            order.append(rows)
            priority.append(value + self.recency[rows])
        return np.concatenate(order), np.concatenate(priority)

    @cached_property
    def cost(self) -> np.ndarray:
        """The token estimate of each line."""
        return np.array([estimate(f"- {t}") for t in self.text.to_pylist()], dtype=np.int64)


def _shares(contexts: DataFrame, memory: DataFrame) -> DataFrame:
    """Contexts (context_id, project_id, query and more) and items of their projects in one frame, for ``_met``.

    Contexts of a project meet its items within one task, at most about SHARE of them, so that neither a query nor an
    item is written out for every pair; only items of projects with more contexts are repeated.
    """
    n = contexts.filter("project_id IS NOT NULL").groupBy("project_id").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("_n"))
    n = F.broadcast(n.filter("_n > 1"))  # one row for SHARE contexts at most
    # Contexts without a project have no memory and may be anywhere.
    share = F.pmod(F.xxhash64("context_id"), F.coalesce("_n", F.when(F.col("project_id").isNull(), SHARE), F.lit(1))).cast("int")
    q = contexts.join(n, "project_id", "left").withColumn("_share", share).drop("_n")
    q = q.withColumn("query", F.lower(text.nfc(F.col("query")))).withColumn("_context", F.lit(True))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))
    m = memory.filter("project_id IS NOT NULL").join(n, "project_id", "left").withColumn("_share", copies).drop("_n").withColumn("_context", F.lit(False))
    return m.unionByName(q, allowMissingColumns=True).repartition("project_id", "_share").sortWithinPartitions("project_id", "_share", "_context", "kind", F.desc("recency"), "stable_id")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Memory, pa.RecordBatch]]:
    """Runs of contexts with the memory of their project."""
    at, parts, memory = None, [], None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("project_id", "_share", "_context")), strict=True))
        a = 0
        for key, run in groupby(keys):
            rows = b.slice(a, n := len(list(run)))
            a += n
            if key[:2] != at:
                at, parts, memory = key[:2], [], None
            if not key[2]:
                parts.append(rows.select(["kind", "recency", "stable_id", "text", "terms", "character_ids"]))
                continue
            if memory is None:
                memory, parts = Memory(parts), []
            yield memory, rows


_RANKED = "context_id string, place int, kind string, stable_id string, text string, priority int"


def ranked(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """``items`` of its project for each of the queries (context_id, project_id, query), with their place: priority, kind, id."""
    names = pa.array(KINDS)

    def rows(m: Memory, got: list[tuple[str, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        order = np.concatenate([x[2] for x in got])
        of = pa.array([x[0] for x in got], pa.string()).take(pa.array(np.repeat(np.arange(len(got)), [len(x[2]) for x in got])))
        place = np.concatenate([np.arange(x[1], x[1] + len(x[2])) for x in got]).astype(np.int32)
        priority = np.concatenate([x[3] for x in got]).astype(np.int32)
        at = pa.array(order)
        return pa.RecordBatch.from_arrays([of, pa.array(place), names.take(pa.array(m.kind[order])), m.stable_id.take(at), m.text.take(at), pa.array(priority)], names=[c.split()[0] for c in _RANKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, part in _met(batches):
            got, n = [], 0
            for context_id, query in zip(part.column("context_id").to_pylist(), part.column("query").to_pylist(), strict=True):
                order, priority = m.ranked(query)
                for a in range(0, len(order), ROWS):
                    got.append((context_id, a + 1, order[a : a + ROWS], priority[a : a + ROWS]))
                    n += len(got[-1][2])
                    if n >= ROWS:
                        yield rows(m, got)
                        got, n = [], 0
            if got:
                yield rows(m, got)

    return _shares(queries.select("context_id", "project_id", "query"), memory).mapInArrow(run, _RANKED)


def _listed(values: list[str]) -> str:
    return "\n".join(f"- {v}" for v in values) if values else "(none)"


def render(base: dict, memory: dict[str, list[str]]) -> str:
    """The prompt of a context with the memory admitted so far."""
    sections = [
        ("PROJECT BACKGROUND", base["background"] or "(none)"), ("CANONICAL TERMINOLOGY", _listed(base["terminology"])), ("CHARACTER MEMORY", _listed(memory["character"])),
        ("EVENT MEMORY", _listed(memory["event"])), ("OPEN THREADS", _listed(memory["thread"])), ("RECENT SUMMARY", base["recent_summary"] or "(none)"),
        ("CURRENT CHAPTER", base["current_chapter"] or ""), ("TASK", base["task"] or ""), ("OUTPUT SCHEMA", base.get("schema") or "{}"),
    ]
    return f"SYSTEM:\n{base['system_rules'] or ''}\n\nUSER:\n" + "\n\n".join(f"[{h}]\n{b}" for h, b in sections)


def _admitted(kind: np.ndarray, cost: np.ndarray, left: int) -> list[int]:
    """Positions of the memory that fits, in order: what doesn't fit is skipped, not the end.

    cost: of each line; the first of a kind takes the place of the line that says there is none.
    """
    saved = np.full(len(KINDS), estimate("(none)"))
    out, p = [], 0
    while p < len(kind):
        fits = cost[p : p + SKIP] - saved[kind[p : p + SKIP]] <= left
        if not fits.any():
            p += SKIP
            continue
        p += int(fits.argmax())
        # As long as nothing is skipped, one at a time.
        while p < len(kind) and (c := int(cost[p] - saved[kind[p]])) <= left:
            out.append(p)
            left -= c
            saved[kind[p]] = 0
            p += 1
    return out


def _prompt(r: dict, memory: Callable[[], tuple[np.ndarray, np.ndarray, Callable[[list[int]], list[str]]]]) -> tuple:
    """The row of a context's prompt. memory: kinds and costs of its memory in order of place, and the texts at some positions."""
    base = {k: r[k] for k in _BASE[1:7]} | {"terminology": list(r["terminology"]) if r["terminology"] is not None else []}
    limit = int(r["maximum_tokens"] or 0) - int(r["reserved_completion_tokens"] or 0)
    chosen: dict[str, list[str]] = {k: [] for k in KINDS}
    used = estimate(render(base, chosen))
    if used > limit:
        return r["context_id"], None, used, limit, 0, 0, 0, 0, 0, 0, "MandatoryContentExceedsBudget"
    kind, cost, texts = memory()
    at = _admitted(kind, cost, limit - used)
    for p, t in zip(at, texts(at), strict=True):
        chosen[KINDS[kind[p]]].append(t)
    used += int(cost[at].sum()) - estimate("(none)") * sum(map(bool, chosen.values()))
    every = np.bincount(kind, minlength=len(KINDS))
    return r["context_id"], render(base, chosen), used, limit, *(len(chosen[k]) for k in KINDS), *(int(n) - len(chosen[k]) for n, k in zip(every, KINDS, strict=True)), None


_BASE = ["context_id", "system_rules", "background", "terminology", "recent_summary", "current_chapter", "task", "maximum_tokens", "reserved_completion_tokens"]
_PROMPT = "context_id string, prompt string, estimated_tokens int, token_limit int, n_characters int, n_events int, n_threads int, omitted_characters int, omitted_events int, omitted_threads int, error string"


def build(contexts: DataFrame, ranked: DataFrame) -> DataFrame:
    """One prompt per context: ranked memory is admitted while it fits the limit; what doesn't fit is skipped, not the end.

    Estimates add up over lines, so a candidate costs its own line and is not rendered anew. A context whose fixed
    parts exceed the limit comes out with an error and no prompt. ``prompts`` does without the ranked rows.
    """
    memory = ranked.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "text"))).alias("memory"))
    rows = contexts.select(*_BASE).join(memory, "context_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = r["memory"] or []
                kind, cost = np.array([KINDS.index(x["kind"]) for x in m], dtype=np.int64), np.array([estimate(f"- {x['text']}") for x in m], dtype=np.int64)
                out.append(_prompt(r, lambda m=m, kind=kind, cost=cost: (kind, cost, lambda at: [m[p]["text"] for p in at])))
            yield _rows(out)

    return rows.mapInArrow(run, _PROMPT)


def prompts(contexts: DataFrame, memory: DataFrame) -> DataFrame:
    """As ``build`` with ``ranked``, for contexts with project_id and query and the ``items`` of all projects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, part in _met(batches):

            def remembered(query: str, m: Memory = m) -> tuple:
                order, _ = m.ranked(query)
                return m.kind[order], m.cost[order], lambda at: m.text.take(pa.array(order[at])).to_pylist()

            for a in range(0, part.num_rows, PROMPTS):
                yield _rows([_prompt(r, lambda r=r: remembered(r["query"])) for r in part.slice(a, PROMPTS).to_pylist()])

    return _shares(contexts.select(*_BASE, "project_id", "query"), memory).mapInArrow(run, _PROMPT)


def _rows(prompts: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in _PROMPT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in prompts], pa.string() if kind == "string" else pa.int32()) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])
