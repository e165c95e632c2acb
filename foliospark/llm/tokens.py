"""Encoding of texts with a public byte-level BPE vocabulary.

Method: a piece of text starts as its bytes. A segment tree over the byte positions holds the rank of the pair that
begins at each live position; its root is the leftmost pair of the lowest rank. A merge joins two live neighbours and
changes three leaves, each in logarithmic time, so that a piece of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import spread

#: Where the vocabulary lies on the driver's machine; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the vocabulary's rule for cutting a text into pieces, which merges never cross.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Encoded pieces that a Python worker remembers; when full it starts anew. It changes the speed only.
REMEMBERED = 100_000

_NONE = 1 << 62
_SHIFT = 32


def byte_letters() -> list[str]:
    """The letter by which a vocabulary file writes each byte: printable bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class SegmentTreeBpe:
    """Encoder of one vocabulary."""

    def __init__(self, vocabulary: str):
        """``vocabulary``: the text of a vocabulary file."""
        model = json.loads(vocabulary)["model"]
        ids = model["vocab"]
        self.byte_ids = [ids[c] for c in byte_letters()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[a], ids[b]] = (rank, ids[a + b])
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        pairs = self.pairs.get
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if found := pairs((ids[i], ids[i + 1])):
                tree[size + i] = found[0] << _SHIFT | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def put(at: int, value: int) -> None:
            k = size + at
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least
                k >>= 1

        while (top := tree[1]) != _NONE:
            i = top & (1 << _SHIFT) - 1
            j = after[i]
            ids[i] = pairs((ids[i], ids[j]))[1]
            ids[j] = -1
            after[i] = k = after[j]
            put(j, _NONE)
            if k >= 0:
                before[k] = i
                found = pairs((ids[i], ids[k]))
                put(i, found[0] << _SHIFT | i if found else _NONE)
            else:
                put(i, _NONE)
            if (h := before[i]) >= 0:
                found = pairs((ids[h], ids[i]))
                put(h, found[0] << _SHIFT | h if found else _NONE)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or missing one."""
        out: list[int] = []
        known = self.known
        for p in self.pieces.findall(text or ""):
            ids = known.get(p)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.piece(p.encode("utf-8", "replace"))
                if len(p) < 200:
                    known[p] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> SegmentTreeBpe:
    """The encoder of a vocabulary file."""
    return _encoder_of(Path(path).read_text(encoding="utf-8"))


@lru_cache(maxsize=4)
def _encoder_of(vocabulary: str) -> SegmentTreeBpe:
    """An encoder, once per Python worker."""
    return SegmentTreeBpe(vocabulary)


@lru_cache(maxsize=8)
def _shared(application: str, path: str) -> Broadcast:
    """A vocabulary file's text, read where the driver is and sent to all workers once an application: a few megabytes."""
    return SparkSession.active().sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def _vocabulary(path: str) -> Broadcast:
    return _shared(SparkSession.active().sparkContext.applicationId, path)


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """ARRAY<INT> of the ids of ``text``, without special tokens. Null, like an empty text, gives an empty array."""
    shared = _vocabulary(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder_of(shared.value)
        for texts in batches:
            yield pd.Series([e.encode(x) for x in texts], dtype=object)

    return ids(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of ids of ``text``; 0 for null and empty texts. Only the number leaves the Python worker."""
    shared = _vocabulary(vocabulary)

    @F.pandas_udf("bigint")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder_of(shared.value)
        for texts in batches:
            yield pd.Series([len(e.encode(x)) for x in texts], dtype="int64")

    return n(text)


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each row of ``documents``; reads doc_id and text only.

    A null, empty or blank text never fails: null and empty give [], blanks are tokens. The strings of special tokens
    are ordinary text. Repeated rows give repeated rows.
    """
    return spread(documents.select("doc_id", "text")).select("doc_id", token_ids(F.col("text"), vocabulary).alias("ids"))
