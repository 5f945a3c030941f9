"""Problem 9: filling fixed-capacity containers.

Bounded-space online packing: every partition keeps a fixed number of open containers per limit, places each
item best-fit (the fullest container that still takes it), closes the fullest container when none fits, and
hands on what is open at its end. The leftovers, at most ``open_windows`` per partition and limit, are merged
best-fit-decreasing in a last pass over container sizes only.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.tokens import TOKENIZER, count_tokens
from folioframe.session import cut_lineage

OPEN_WINDOWS = 64
#: Leftover containers merged by one task.
MERGE_GROUP = 50_000

SCHEMA = "limit_id string, container_id bigint, doc_id {key}, part_index int, start_token bigint, n_tokens bigint, is_open boolean"


class Packer:
    """Open containers of one limit in one partition."""

    def __init__(self, capacity: int, windows: int, first_id: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.windows, self.next_id = capacity, windows, first_id
        self.open: list[tuple[int, int]] = []  # (free space, container), ascending
        self.closed: set[int] = set()
        self.empty: int | None = None  # holds the items without a size until the merge

    def for_empty(self) -> int:
        if self.empty is None:
            self.empty, self.next_id = self.next_id, self.next_id + 1
        return self.empty

    def _new(self, size: int) -> int:
        if len(self.open) == self.windows:
            self.closed.add(self.open.pop(0)[1])  # the fullest
        cid, self.next_id = self.next_id, self.next_id + 1
        if size < self.capacity:
            insort(self.open, (self.capacity - size, cid))
        else:
            self.closed.add(cid)
        return cid

    def put(self, size: int) -> int:
        """Place an item of at most the capacity; its container."""
        i = bisect_left(self.open, (size, -1))
        if i == len(self.open):
            return self._new(size)
        free, cid = self.open.pop(i)
        if free > size:
            insort(self.open, (free - size, cid))
        else:
            self.closed.add(cid)
        return cid

    def place(self, size: int) -> list[tuple[int, int, int, int]]:
        """(container, part, start, length) of an item; only one above the capacity is split."""
        out, start = [], 0
        while size - start > self.capacity:
            out.append((self._full(), len(out), start, self.capacity))
            start += self.capacity
        return [*out, (self.put(size - start), len(out), start, size - start)]

    def _full(self) -> int:
        cid, self.next_id = self.next_id, self.next_id + 1
        self.closed.add(cid)
        return cid


def pack_texts(df: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", windows: int = OPEN_WINDOWS, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (limit_id, container_id, key, part_index, start_token, n_tokens): each text of df in containers of every limit.

    ``limits`` has limit_id and max_size, a handful of rows of fixed number (its count is checked). Null and
    empty texts have no tokens and share a container with others (n_tokens 0). Repeated rows are items of their
    own. A text above the capacity fills whole containers, its rest is packed. Empty table: no rows. Columns
    other than the two named are not read.
    """
    caps = {r["limit_id"]: r["max_size"] for r in limits.select("limit_id", "max_size").limit(1001).collect()}
    if len(caps) > 1000:
        raise ValueError("more than 1000 limits")
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    schema = SCHEMA.format(key=rows.schema["_k"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        base = (ctx.partitionId() + 1) << 33 if ctx else 1 << 33
        packers = {n: Packer(c, windows, base) for n, c in caps.items()}
        pending: dict[str, list[tuple]] = {n: [] for n in caps}
        nothing: dict[str, list[tuple]] = {n: [] for n in caps}  # texts without tokens: never kept waiting

        def emit(final: bool) -> Iterator[pa.RecordBatch]:
            for n, p in packers.items():
                done = pending[n] if final else [x for x in pending[n] if x[0] in p.closed]
                pending[n] = [] if final else [x for x in pending[n] if x[0] not in p.closed]
                done += nothing[n]
                nothing[n] = []
                if done:
                    cols = list(zip(*done, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * len(done)), pa.array(cols[0], pa.int64()), pa.array(cols[1], key_type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array([x not in p.closed for x in cols[0]])],
                        ["limit_id", "container_id", "doc_id", "part_index", "start_token", "n_tokens", "is_open"],
                    )
                p.closed.clear()

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for k, n in zip(b[0].to_pylist(), count_tokens(b[1], tokenizer), strict=True):
                for name, p in packers.items():
                    if not n:
                        nothing[name].append((p.for_empty(), k, 0, 0, 0))
                        continue
                    pending[name] += [(c, k, part, start, size) for c, part, start, size in p.place(n)]
            yield from emit(False)
        yield from emit(True)

    placed = cut_lineage(rows.mapInArrow(run, schema))
    left = placed.filter("is_open").groupBy("limit_id", "container_id").agg(F.sum("n_tokens").alias("size"))
    groups = 1 + placed.filter("is_open").select("limit_id", "container_id").distinct().count() // MERGE_GROUP

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "container_id"], ascending=[False, True])
        capacity = caps[pdf["limit_id"].iloc[0]]
        open_: list[tuple[int, int]] = []
        out = []
        for cid, size in zip(pdf["container_id"], pdf["size"], strict=True):
            i = bisect_left(open_, (size, -1))
            if i == len(open_):
                insort(open_, (capacity - size, cid))
                out.append(cid)
            else:
                free, into = open_.pop(i)
                insort(open_, (free - size, into))
                out.append(into)
        return pdf[["limit_id", "container_id"]].assign(merged_id=out)

    merged = (
        left.withColumn("_g", F.abs(F.hash("container_id")) % groups)
        .groupBy("limit_id", "_g")
        .applyInPandas(lambda p: merge(p), "limit_id string, container_id bigint, merged_id bigint")
    )
    out = placed.filter("is_open").join(merged, ["limit_id", "container_id"])
    cols = ["limit_id", "container_id", "doc_id", "part_index", "start_token", "n_tokens"]
    out = out.withColumn("container_id", F.col("merged_id")).select(cols).unionByName(placed.filter("NOT is_open").select(cols))
    return out.withColumnRenamed("doc_id", key)
