"""Dependency graphs: order, dirty closure, rebuild plans, fingerprints, tickets.

Graphs are DataFrames: artifacts (artifact_id, kind, input_hash) and edges (artifact_id, dependency_id). Closures go
level by level; every level is a join on edges, and the visited set is cut from the lineage.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import cut_plan

MAX_LEVELS = 10_000


def topology_problems(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, code): repeated artifacts, unknown dependencies, self-dependencies."""
    dup = artifacts.groupBy("artifact_id").count().filter("count > 1").select("artifact_id", F.lit("Duplicate").alias("code"))
    missing = edges.join(artifacts.select(F.col("artifact_id").alias("dependency_id")), "dependency_id", "left_anti").select("artifact_id", F.lit("MissingDependency").alias("code"))
    own = edges.filter("artifact_id = dependency_id").select("artifact_id", F.lit("Cycle").alias("code"))
    return dup.unionByName(missing).unionByName(own)


def levels(artifacts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((artifact_id, level), artifacts on or behind a cycle): an artifact's level is above those of its dependencies."""
    left = cut_plan(artifacts.select("artifact_id").distinct())
    open_edges = cut_plan(edges.select("artifact_id", "dependency_id").distinct())
    done = None
    for level in range(MAX_LEVELS):
        ready = left.join(open_edges.select("artifact_id").distinct(), "artifact_id", "left_anti").withColumn("level", F.lit(level))
        ready = cut_plan(ready)
        if ready.limit(1).count() == 0:
            break
        done = ready if done is None else done.unionByName(ready)
        left = cut_plan(left.join(ready.select("artifact_id"), "artifact_id", "left_anti"))
        open_edges = cut_plan(open_edges.join(ready.select(F.col("artifact_id").alias("dependency_id")), "dependency_id", "left_anti"))
    empty = left.limit(0).withColumn("level", F.lit(0))
    return (done if done is not None else empty), left


def topological_order(artifacts: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Order of one graph on the driver, ties by name; raises on a cycle. For graphs the size of a build, not of a corpus."""
    needs = {a: 0 for a in artifacts}
    users: dict[str, list[str]] = {a: [] for a in artifacts}
    for a, d in set(edges):
        needs[a] += 1
        users[d].append(a)
    ready = [a for a, n in needs.items() if n == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        a = heapq.heappop(ready)
        out.append(a)
        for u in users[a]:
            needs[u] -= 1
            if needs[u] == 0:
                heapq.heappush(ready, u)
    if len(out) < len(needs):
        raise ValueError("cycle")
    return out


def closure(roots: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """(artifact_id): roots and all that is reached by following edges from ``start`` to ``end``."""
    seen = front = cut_plan(roots.select("artifact_id").distinct())
    links = edges.select(F.col(start).alias("artifact_id"), F.col(end).alias("to")).distinct()
    for _ in range(MAX_LEVELS):
        front = cut_plan(front.join(links, "artifact_id").select(F.col("to").alias("artifact_id")).distinct().join(seen, "artifact_id", "left_anti"))
        if front.limit(1).count() == 0:
            return seen
        seen = cut_plan(seen.unionByName(front))
    raise RuntimeError("closure did not settle")


def dirty_closure(roots: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Artifacts that a change of the roots makes dirty: all their consumers. Sources are never dirty."""
    reached = closure(roots, edges, "dependency_id", "artifact_id")
    return reached.join(artifacts.filter("kind != 'source'").select("artifact_id"), "artifact_id", "left_semi")


def rebuild_plan(targets: DataFrame, dirty: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, level): the dirty artifacts that the targets need, by level."""
    needed = closure(targets, edges, "artifact_id", "dependency_id").join(dirty, "artifact_id", "left_semi")
    order, _ = levels(artifacts, edges)
    return needed.join(order, "artifact_id")


def fingerprints(artifacts: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """(artifact_id, fingerprint): hash of kind, input and the ordered outputs of the dependencies. outputs: artifact_id, output_hash."""
    deps = edges.join(outputs.select(F.col("artifact_id").alias("dependency_id"), "output_hash"), "dependency_id", "left")
    deps = deps.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("dependency_id", F.coalesce("output_hash", F.lit("")).alias("h")))).alias("d"))
    text = F.concat_ws("\n", "artifact_id", "kind", "input_hash", F.array_join(F.transform(F.coalesce("d", F.array().cast("array<struct<dependency_id:string,h:string>>")), lambda x: F.concat(x["dependency_id"], F.lit("="), x["h"])), "\n"))
    return artifacts.join(deps, "artifact_id", "left").select("artifact_id", F.sha2(text, 256).alias("fingerprint"))


def accept_results(results: DataFrame, tickets: DataFrame) -> DataFrame:
    """Results (artifact_id, serial, fingerprint, ...) whose ticket is the current one; late, foreign and stale ones are left out."""
    return results.join(tickets.select("artifact_id", "serial", "fingerprint").distinct(), ["artifact_id", "serial", "fingerprint"], "left_semi")


def keep_compatible(old: DataFrame, new: DataFrame, spec: list[str]) -> DataFrame:
    """New artifacts with the output of the old one where all of ``spec`` is equal."""
    return new.join(old.select("artifact_id", *spec, "output_hash").distinct(), ["artifact_id", *spec], "left")


def rebuild(plan: list[str], builder: Callable[[str], str]) -> tuple[dict[str, str], str | None]:
    """Run a builder over a plan in order: (outputs, the artifact that failed or None). Stops at the first failure."""
    done: dict[str, str] = {}
    for a in plan:
        try:
            done[a] = builder(a)
        except Exception:  # noqa: BLE001
            return done, a
    return done, None


def chapter_artifacts(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts and edges of chapters (project_id, chapter_id, sequence, content_hash): source, analysis, story state, context.

    A chapter's story state needs its analysis and the state of the chapter before; its context needs that state.
    """
    rows = chapters.withColumn("prev", F.lag("chapter_id").over(Window.partitionBy("project_id").orderBy("sequence", "chapter_id")))
    name = lambda kind, c="chapter_id": F.concat(F.lit(kind + ":"), F.col(c))
    arts = rows.select(F.explode(F.array(*(F.struct(name(k).alias("artifact_id"), F.lit(k).alias("kind"), F.when(F.lit(k == "source"), F.col("content_hash")).otherwise("").alias("input_hash")) for k in ("source", "analysis", "story", "context")))).alias("a")).select("a.*")
    pair = lambda a, d: F.struct(a.alias("artifact_id"), d.alias("dependency_id"))
    es = rows.select(F.explode(F.array(pair(name("analysis"), name("source")), pair(name("story"), name("analysis")), pair(name("context"), name("story")), pair(name("story"), name("story", "prev")))).alias("e")).select("e.*")
    return arts, es.filter("dependency_id IS NOT NULL")
