"""Encoding of texts with a public byte-level BPE by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never end up in one
token, so between such bytes the encoding is certain to be cut: a merge that
crossed the place would have to build a token holding the pair.  The table of
the 65,536 pairs is derived from the vocabulary file.  Texts are cut there, the
fragments are encoded independently (each distinct fragment of a batch once,
then remembered), and the ids are concatenated.

The tokenizer's pre-splitting must see the same pieces in a fragment as in the
whole text.  A cut is therefore only made where the character before is no
white space (a run of blanks is split by what follows it) and the character
after is no apostrophe (contractions are recognised from the apostrophe on).

Defined results: null and empty texts give an empty list; a special token's
name in a text is ordinary text; a text of any length is one row.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 200_000
REMEMBERED_CHARS = 64
BLANKS = np.array(sorted({*range(0x1C, 0x20), *(c for c in range(0x3001) if chr(c).isspace())}), dtype=np.uint32)


class Encoder:
    """One vocabulary with its table of forced boundaries; lives once in each Python worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros(65536, dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
            inside[b[:-1] * 256 + b[1:]] = True
        self.forced = ~inside
        self.known: dict[str, list[int]] = {}

    def cuts(self, text: str) -> list[int]:
        """Places (in characters) where the encoding is certain to be cut."""
        c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        a, b = c[:-1], c[1:]
        last = np.where(a < 0x80, a, 0x80 | (a & 0x3F))
        first = np.where(b < 0x80, b, np.where(b < 0x800, 0xC0 | (b >> 6), np.where(b < 0x10000, 0xE0 | (b >> 12), 0xF0 | (b >> 18))))
        ok = self.forced[last.astype(np.int64) * 256 + first]
        ok &= ~np.isin(a, BLANKS) & (b != 0x27)
        return (np.flatnonzero(ok) + 1).tolist()

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, encode = self.known, self.bpe.encode_ordinary
        if len(known) > REMEMBERED:
            known.clear()
        ids: list[int] = []
        at = 0
        for to in [*self.cuts(text), len(text)]:
            piece = text[at:to]
            at = to
            got = known.get(piece)
            if got is None:
                got = encode(piece)
                if len(piece) <= REMEMBERED_CHARS:
                    known[piece] = got
            ids += got
        return ids


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def spread(df: DataFrame) -> DataFrame:
    """Few large files leave cores idle before a Python step; many splits need no shuffle."""
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= want else df.repartition(want)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key``, ids array<int>: one row per input row."""
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary).encode
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids = [code(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return spread(slim).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key``, the columns ``keep``, n_tokens int; only the counts leave the workers."""
    slim = df.select(F.col(key), *keep, F.col(text).alias("__text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "__text") + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary).encode
        for batch in batches:
            n = pa.array([len(code(t)) for t in batch.column("__text").to_pylist()], pa.int32())
            names = [x for x in batch.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), n], names=[*names, "n_tokens"])

    return spread(slim).mapInArrow(run, out)
