"""Problem 8: encoding a corpus with a public byte-level BPE.

Tree concatenation: text without a cut point that is too long to encode at once is halved, the halves are
encoded, and around each join a growing window is encoded again until it agrees with both sides. A sequence
of BPE tokens is the encoding of its bytes exactly when every adjacent pair of its tokens is, so agreement in
the window's first and last token makes the whole sequence exact.

Texts above ``spread_chars`` are cut into leaves that Spark encodes as rows of their own, in parallel, and
joined again per document.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: the pattern that splits text before the merges of the rank files (public, see the tokenizers' README).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = os.environ.get("FOLIO_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Longest piece, in characters, that is encoded without halving.
PIECE_CHARS = 512
#: Texts above this are encoded as several rows.
SPREAD_CHARS = 1 << 20
LEAF_CHARS = 1 << 17

_loaded: dict[str, Encoder] = {}


class Encoder:
    """A rank file with its splitting pattern; one per Python worker."""

    def __init__(self, path: str = TOKENIZER):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("folio", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.bpe._core_bpe.encode_single_piece
        self.bytes_of = self.bpe.decode_bytes
        self.plain = self.bpe._core_bpe.encode_ordinary
        self.split = regex.compile(PATTERN)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty give an empty list."""
        if not text:
            return []
        if not has_long_run(text):
            return self.plain(text)
        out: list[int] = []
        short: list[str] = []
        for m in self.split.finditer(text):
            piece = m.group()
            if len(piece) <= PIECE_CHARS:
                short.append(piece)
                continue
            out += self._pieces(short)
            short = []
            out += self.tree(piece)
        return out + self._pieces(short)

    def _pieces(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += self.piece(p.encode())
        return out

    def tree(self, piece: str) -> list[int]:
        """One unsplittable piece: encode halves, join them."""
        if len(piece) <= PIECE_CHARS:
            return self.piece(piece.encode())
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours of one piece from the encodings of each."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.piece(self.bytes_of(a + b))
            if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
                return left[: max(0, len(left) - k)] + window + right[k:]
            k *= 2

    def join_all(self, leaves: list[list[int]]) -> list[int]:
        """The encoding of one piece from those of its leaves: neighbours are joined in pairs, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def has_long_run(text: str) -> bool:
    """Whether a piece of the split pattern could exceed PIECE_CHARS."""
    if len(text) <= PIECE_CHARS:
        return False
    n = longest = words = 0
    for w in text.split():
        size = len(w)
        n += size
        words += 1
        if size > longest:
            longest = size
    return longest >= PIECE_CHARS or len(text) - n - words >= PIECE_CHARS - 2


def encoder(path: str = TOKENIZER) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def leaves(text: str, size: int = LEAF_CHARS) -> Iterator[tuple[str, bool]]:
    """Cut a text into leaves of about ``size``: (leaf, whether it continues the piece of the leaf before).

    Cuts fall before white space that follows other text, where the pattern always splits. Where there is no
    such place within a leaf, the run is split by the pattern, and a piece longer than a leaf is cut anywhere.
    """
    at, n = 0, len(text)
    space = regex.compile(r"(?<=\S)(?=\s)")
    while n - at > size:
        m = None
        for m in space.finditer(text, at + size // 2, at + size):  # noqa: B007
            pass
        if m:
            yield text[at : m.start()], False
            at = m.start()
            continue
        end = (m := space.search(text, at + size)) and m.start() or n
        for p in regex.finditer(PATTERN, text[at:end]):
            piece = p.group()
            for i in range(0, len(piece), size):
                yield piece[i : i + size], i > 0
        at = end
    if at < n:
        yield text[at:], False


def _list_array(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.empty(offsets[-1], np.int32)
    for x, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True):
        flat[a:b] = x
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", tokenizer: str = TOKENIZER,
    spread_chars: int = SPREAD_CHARS, leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """One row (key, ids) per row of df, exactly what the public tokenizer gives without special tokens.

    Null, empty text: an empty list. Repeated rows stay repeated rows, unless their text is above
    ``spread_chars``: then rows equal in key and text still come out once each. Other columns are not read.
    An empty table gives an empty table. Texts up to ``spread_chars`` need no shuffle.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    kind = rows.schema["_k"].dataType
    ids_type = T.ArrayType(T.IntegerType())
    big = F.coalesce(F.char_length("_t") > spread_chars, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part[0], _list_array([enc.encode(t) for t in part[1].to_pylist()])], ["_k", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, (leaf, glue) in enumerate(leaves(t, leaf_chars)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], b.schema.field(0).type), pa.array([r]), pa.array([i], pa.int32()), pa.array([leaf]), pa.array([glue])], ["_k", "_r", "_i", "_leaf", "_glue"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            leaf, glue, nxt = (b[n].to_pylist() for n in ("_leaf", "_glue", "_next"))
            ids = [enc.tree(t) if g or x else enc.encode(t) for t, g, x in zip(leaf, glue, nxt, strict=True)]
            yield pa.RecordBatch.from_arrays([b["_k"], b["_r"], b["_i"], b["_glue"], _list_array(ids)], ["_k", "_r", "_i", "_glue", "ids"])

    import pandas as pd

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(tokenizer)
        parts = parts.sort_values("_i")
        pieces: list[list[list[int]]] = []  # leaves of one piece of the split pattern each
        for glue, ids in parts[["_glue", "ids"]].itertuples(index=False):
            ids = np.asarray(ids).tolist()
            if glue:
                pieces[-1].append(ids)
            else:
                pieces.append([ids])
        out_ids = [x for piece in pieces for x in enc.join_all(piece)]
        return pd.DataFrame({"_k": [parts["_k"].iloc[0]], "ids": [out_ids]})

    schema = T.StructType([T.StructField("_k", kind), T.StructField("ids", ids_type)])
    done = rows.filter(~big).mapInArrow(short, schema)
    cut_schema = T.StructType([T.StructField("_k", kind), T.StructField("_r", T.LongType()), T.StructField("_i", T.IntegerType()), T.StructField("_leaf", T.StringType()), T.StructField("_glue", T.BooleanType())])
    leaf_schema = T.StructType([*cut_schema.fields[:3], cut_schema["_glue"], T.StructField("ids", ids_type)])
    from pyspark.sql import Window

    spread = rows.filter(big).withColumn("_r", F.monotonically_increasing_id()).mapInArrow(cut, cut_schema)
    spread = spread.withColumn("_next", F.coalesce(F.lead("_glue").over(Window.partitionBy("_r").orderBy("_i")), F.lit(False)))
    spread = spread.repartition("_r", "_i").mapInArrow(encode_leaves, leaf_schema)
    joined = spread.groupBy("_r").applyInPandas(join, schema)
    return done.unionByName(joined).select(F.col("_k").alias(key), F.col("ids").alias(out))


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", out: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, text): the texts that lists of ids stand for; null and empty lists give an empty text."""
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = [enc.bytes_of(x).decode() for x in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(texts, pa.string())], ["_k", "text"])

    schema = T.StructType([T.StructField("_k", rows.schema["_k"].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select(F.col("_k").alias(key), F.col("text").alias(out))


def count_tokens(texts: pa.Array, tokenizer: str = TOKENIZER) -> list[int]:
    """Token counts of a batch of texts; null counts 0."""
    enc = encoder(tokenizer)
    return [len(enc.encode(t)) for t in texts.to_pylist()]
