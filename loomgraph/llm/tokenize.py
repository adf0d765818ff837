"""Encoding a corpus with a public byte-level BPE vocabulary.

Per pre-token, merges are taken from a priority queue of (rank, position) over a
doubly linked list of symbols; entries whose symbols have changed since they
were queued are stale and skipped.  Pre-tokens repeat across a corpus, so each
worker keeps the ids of those it has met, up to a fixed number of entries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_ENTRIES = 200_000

# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file with one ``base64 rank`` pair a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))  # the next symbol, n at the end
    before = list(range(-1, n - 1))  # the previous symbol, -1 at the start
    queue = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            queue.append((rank, i, word[i : i + 2]))
    heapify(queue)
    while queue:
        _, i, made = heappop(queue)
        left = part[i]
        if left is None:
            continue
        j = after[i]
        # stale: one of the two symbols was merged with another one meanwhile
        if j >= n or len(left) >= len(made) or left + part[j] != made:
            continue
        part[i], part[j] = made, None
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            pair = made + part[k]
            rank = ranks.get(pair)
            if rank is not None:
                heappush(queue, (rank, i, pair))
        h = before[i]
        if h >= 0:
            pair = part[h] + made
            rank = ranks.get(pair)
            if rank is not None:
                heappush(queue, (rank, h, pair))
    return tuple(ranks[p] for p in part if p is not None)


class Encoder(dict):
    """Maps a pre-token to its ids, remembering a bounded number of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.ranks, self.entries = ranks, entries
        self.words = regex.compile(pattern).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = merge_word(word.encode("utf-8", "replace"), self.ranks)
        if len(self) >= self.entries:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.words(text)))) if text else []


def decode(ids: list[int], vocabulary: dict[int, bytes]) -> str:
    """Text of token ids: their byte strings, concatenated."""
    return b"".join(vocabulary[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(load_ranks(path))
    return _encoders[path]


def encode_corpus(docs: DataFrame, *, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key, ids``: the token ids of each text, one row per row of ``docs``.

    Null and empty texts give an empty list.  Strings that look like special
    tokens are ordinary text; lone surrogates cannot occur in a Spark string.
    ``vocabulary`` is the path of the vocabulary file, present on every
    executor.  Other columns are dropped; there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        words, get = encoder.words, encoder.__getitem__
        for batch in batches:
            flat, ends = [], [0]
            for value in batch.column(1):
                t = value.as_py()
                ids = np.fromiter(chain.from_iterable(map(get, words(t))), dtype=np.int32) if t else np.zeros(0, np.int32)
                flat.append(ids)
                ends.append(ends[-1] + len(ids))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")
