"""Evaluation texts leaking into training text, by greedy string tiling.

Texts become sequences of words.  Windows of ``min_words`` words get rolling
(Karp-Rabin) hashes; a shared window is a seed that names a (document, item)
pair.  On each pair the longest matches of unmarked words are marked first, run
by run, until none of ``min_words`` is left; the tiles' total length over the
item's length is its coverage, so passages in another order count as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[a-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "longest int, covered int, tiles int, item_words int"


def words_of(text: str | None) -> list[str]:
    """Longest runs of a-z and 0-9 in the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` words, by a polynomial over mixed word ids (mod 2^64)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(15))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        # doubling: windows of 2^j words from two of 2^(j-1)
        out, size, power, done = None, 1, _BASE, 0
        block, width = x, k
        while width:
            if width & 1:
                if out is None:
                    out, done = block[: len(x) - size + 1], size
                else:
                    m = len(x) - done - size + 1
                    out = out[:m] * power + block[done : done + m]
                    done += size
            width >>= 1
            if width:
                m = len(x) - 2 * size + 1
                if m <= 0:
                    return np.zeros(0, dtype=np.uint64)
                block = block[:m] * power + block[size : size + m]
                size, power = 2 * size, power * power
    return out[:n]


def tile(doc: list, item: list, min_words: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, length), longest first."""
    free_d, free_i = [True] * len(doc), [True] * len(item)
    tiles = []
    while True:
        starts: dict[tuple, list[int]] = {}
        for j in range(len(item) - min_words + 1):
            if all(free_i[j : j + min_words]):
                starts.setdefault(tuple(item[j : j + min_words]), []).append(j)
        best, found = min_words - 1, []
        for i in range(len(doc) - min_words + 1):
            if not starts or not free_d[i]:
                continue
            for j in starts.get(tuple(doc[i : i + min_words]), ()):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_i[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= min_words:
                    found.append((i, j, n))
        if not found:
            return tiles
        for i, j, n in found:
            if all(free_d[i : i + n]) and all(free_i[j : j + n]):
                free_d[i : i + n], free_i[j : j + n] = [False] * n, [False] * n
                tiles.append((i, j, n))


class ItemIndex:
    """Seeds of a bounded set of items: sorted window hashes and where they come from."""

    def __init__(self, ids: list, texts: list[str | None], min_words: int) -> None:
        self.ids, self.min_words = ids, min_words
        self.words = [words_of(t) for t in texts]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        hashes, owners = [], []
        for n, ws in enumerate(self.words):
            h = rolling(np.array([self.vocabulary[w] for w in ws], dtype=np.int64), min_words)
            hashes.append(h)
            owners.append(np.full(len(h), n))
        hashes, owners = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owners, np.int64)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]

    def pairs(self, docs: list[list[str]]) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        """(document, item, (longest, covered, tiles, item words)) for documents that share a seed."""
        get = self.vocabulary.get
        k = self.min_words
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        ids = np.fromiter((get(w, 0) for d in docs for w in d), dtype=np.int64, count=int(lengths.sum()))
        at = np.cumsum(lengths) - lengths
        # only windows of words that all occur in items can be shared
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        start = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else np.zeros(0, np.int64)
        if not len(start) or not len(self.hashes):
            return
        h = rolling(ids, k)[start]
        left = np.searchsorted(self.hashes, h, "left")
        right = np.searchsorted(self.hashes, h, "right")
        hit = right > left
        start, left, right = start[hit], left[hit], right[hit]
        doc = np.searchsorted(at, start, "right") - 1
        inside = start + k <= at[doc] + lengths[doc]
        seen = set()
        for d, a, b in zip(doc[inside].tolist(), left[inside].tolist(), right[inside].tolist()):
            seen.update((d, o) for o in self.owners[a:b].tolist())
        for d, n in sorted(seen):
            tiles = tile(docs[d], self.words[n], k)
            if tiles:  # equal hashes of different words give none
                yield d, n, (tiles[0][2], sum(t[2] for t in tiles), len(tiles), len(self.words[n]))


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_key: str,
    doc_text: str,
    item_key: str,
    item_text: str,
    min_words: int = 13,
    min_coverage: float = 0.0,
    index_items: int = 20_000,
) -> DataFrame:
    """``doc_key, item_key, longest, covered, tiles, item_words``: one row per document and item that share a run of ``min_words`` words.

    ``longest`` is the longest run, ``covered`` the item words in all tiles;
    pairs below ``min_coverage`` = covered / item_words are left out.  An item
    of less than ``min_words`` words cannot be found.  Null and empty texts
    match nothing; repeated rows of ``docs`` give their pairs once, and item
    keys that come twice with different texts are tiled per text, the best kept.

    Items are indexed in blocks of at most ``index_items`` rows; each block is
    sent to the executors and compared with all documents, so an item set of any
    size works in bounded memory.
    """
    spark = docs.sparkSession
    pool = items.select(F.col(item_key), F.col(item_text)).filter(F.col(item_text).isNotNull()).distinct()
    blocks = max(1, -(-pool.count() // index_items))
    parts = pool.withColumn("_b", F.pmod(F.xxhash64(item_key, item_text), F.lit(blocks)))
    schema = f"{doc_key} {dict(docs.dtypes)[doc_key]}, {item_key} {dict(items.dtypes)[item_key]}, {RESULT}"
    wanted = docs.select(doc_key, doc_text)
    found = None
    for b in range(blocks):
        rows = parts.filter(F.col("_b") == b).select(item_key, item_text).toArrow()
        index = spark.sparkContext.broadcast(ItemIndex(rows.column(0).to_pylist(), rows.column(1).to_pylist(), min_words))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for batch in batches:
                out = list(held.pairs([words_of(t) for t in batch.column(1).to_pylist()]))
                keys = batch.column(0).take(pa.array([d for d, _, _ in out], pa.int64()))
                ids = pa.array([held.ids[n] for _, n, _ in out], pa.from_numpy_dtype(np.int64) if not out or isinstance(held.ids[out[0][1]], int) else None)
                yield pa.RecordBatch.from_arrays([keys, ids, *[pa.array([r[c] for _, _, r in out], pa.int32()) for c in range(4)]], names=[doc_key, item_key, "longest", "covered", "tiles", "item_words"])

        got = wanted.mapInArrow(run, schema)
        found = got if found is None else found.union(got)
    best = F.max(F.struct("longest", "covered", "tiles", "item_words")).alias("m")
    return found.groupBy(doc_key, item_key).agg(best).select(doc_key, item_key, "m.*").filter(F.col("covered") >= F.col("item_words") * min_coverage)
