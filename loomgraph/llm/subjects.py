"""Subject area of each document, by anchored non-negative matrix factorisation.

The document-term matrix X of the whole corpus is approximated by W H with one
component per subject and one for the language that texts share.  Every term
is in X: its column is its hash modulo a fixed number of columns, so H has one
size for any corpus.  Labelled samples seed H: on them W is zero outside a
sample's own subjects, so each component is anchored to its subject, while the
shared one takes what is no subject's.  Alternating multiplicative updates for
the Kullback-Leibler loss then run over all documents until the loss settles; a
document's row of W is its mixture of subjects.  Only the components x columns
sums of an update travel to the driver, never anything per document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage

_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
EPS = 1e-12


class _Ids(dict):
    """Word to term id (31 bits of CRC32), remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.lower().encode()) & 0x7FFFFFFF if len(word) > 2 else -1
        if len(self) > 100_000:
            self.clear()
        self[word] = found
        return found


def term_counts(text: str | None, ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term ids of a text with their counts; identifiers are split into their words."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.fromiter(map(ids.__getitem__, _PART.findall(text)), dtype=np.int64)
    return np.unique(found[found >= 0], return_counts=True)


def _vectors(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            rows = [term_counts(t, ids) for t in batch.column(len(keep)).to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *[r[i] for r in rows]]).astype(np.int32)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.ListArray.from_arrays(ends, f) for f in flat]], names=[*keep, "terms", "counts"])

    return df.select(*keep, text).mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keep), "terms array<int>, counts array<int>"]))


def _document_frequency(vectors: DataFrame, n_columns: int) -> np.ndarray:
    """Documents of each column, over all documents, pre-aggregated per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False) % n_columns, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(column.astype(np.int32)), pa.array(n.astype(np.int64))], names=["t", "df"])

    found = vectors.select("terms").mapInArrow(run, "t int, df bigint").groupBy("t").agg(F.sum("df").alias("df")).toArrow()  # at most n_columns rows
    out = np.zeros(n_columns)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


@dataclass
class Model:
    """Components: rows of ``h`` are the ``subjects`` (and, while it is fitted, the shared language); the share from which a subject counts; the loss after each round."""

    subjects: list[str]
    h: np.ndarray
    anchors: np.ndarray | None = None
    least_share: float = 0.2
    least_mass: float = 2.0
    least_density: float = 0.04
    losses: tuple[float, ...] = ()

    def columns(self, ids: np.ndarray) -> np.ndarray:
        """Column of each term id."""
        return ids % self.h.shape[1]


def _mixtures(h: np.ndarray, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, n: int, steps: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of W for fixed H, and H's columns of the entries; rows must be sorted.  In the precision of H."""
    k, kind = h.shape[0], h.dtype
    total = np.bincount(rows, counts, n).astype(kind)
    w = np.repeat(total[:, None] / kind.type(k), k, axis=1) if mask is None else (mask * (total / np.maximum(mask.sum(1), 1))[:, None]).astype(kind)
    at, counts = np.ascontiguousarray(h[:, cols].T), counts.astype(kind)
    starts = np.flatnonzero(np.diff(rows, prepend=-1)) if len(rows) else np.zeros(0, np.int64)
    some = rows[starts] if len(rows) else np.zeros(0, np.int64)
    for _ in range(steps):
        ratio = counts / np.maximum(np.einsum("ij,ij->i", at, w[rows]), kind.type(EPS))
        if len(starts):
            w[some] *= np.add.reduceat(at * ratio[:, None], starts, axis=0)
    return w, at


def _shares(w: np.ndarray, at: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Each entry's count parted among the components, and the loss of all entries."""
    parts = w[rows] * at
    held = np.maximum(parts.sum(1), EPS)
    loss = float((counts * np.log(np.maximum(counts, EPS) / held)).sum())
    parts *= (counts / held)[:, None]
    return parts, loss


def _sparse(model: Model, terms: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    rows = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    return rows, model.columns(terms.flatten().to_numpy(zero_copy_only=False)), counts.flatten().to_numpy(zero_copy_only=False).astype(np.float64), len(terms)


def _update(vectors: DataFrame, h: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Sum over all documents of W * (X / WH), by component and column: what an update of H needs; and the loss per word."""
    held = vectors.sparkSession.sparkContext.broadcast(Model([], h.astype(np.float32)))  # components x columns, whatever the corpus
    k = len(h)
    names = ["t", "loss", "words", *[f"v{i}" for i in range(k)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        total, loss, words = np.zeros(m.h.shape), 0.0, 0.0
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                rows, cols, counts, n = _sparse(m, part.column(0), part.column(1))
                w, at = _mixtures(m.h, rows, cols, counts, n, steps)
                parts, lost = _shares(w, at, rows, counts)
                loss, words = loss + lost, words + counts.sum()
                for i in range(k):
                    total[i] += np.bincount(cols, parts[:, i], total.shape[1])
        some = np.flatnonzero(total.any(0))
        first = np.arange(len(some)) == 0
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(first * loss), pa.array(first * words), *[pa.array(total[i, some]) for i in range(k)]], names=names)

    sums = vectors.select("terms", "counts").mapInArrow(run, ", ".join(f"{n} {'int' if n == 't' else 'double'}" for n in names)).groupBy("t").agg(*[F.sum(n).alias(n) for n in names[1:]]).toArrow()  # at most n_columns rows
    held.destroy()
    out = np.zeros(h.shape)
    for i in range(k):
        out[i, sums.column(0).to_numpy()] = sums.column(3 + i).to_numpy()
    loss, words = (float(np.sum(sums.column(i).to_numpy())) for i in (1, 2))
    return out, loss / max(words, 1.0)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(1, keepdims=True), EPS)


def fit(vectors: DataFrame, samples: list[tuple[str, list[str]]], subjects: list[tuple[str, str]], *, n_columns: int = 1 << 18, weight: float = 5.0, steps: int = 4, settled: float = 0.002, anchor: float = 0.4, firm: int = 3) -> Model:
    """Factor the corpus, seeded by labelled samples and the subjects' descriptions.

    Every term is one of ``n_columns`` columns.  One component without a label
    stands for the language of no subject.  Anchors hold the others in place
    while all documents are fitted: terms that at least ``firm`` samples have,
    and of which the samples alone give one subject the share ``anchor``, never
    are the shared language, and samples weigh ``weight`` times as much as the
    corpus.  Rounds end when the loss of both falls by less than ``settled`` of
    itself.
    """
    names, ids = sorted(s for s, _ in subjects), _Ids()
    memory = [(t, set(u)) for t, u in samples] + [(f"{s} {text}", {s}) for s, text in subjects]
    seeds = [term_counts(t, ids) for t, _ in memory]
    rows = np.repeat(np.arange(len(seeds)), [len(s[0]) for s in seeds])
    cols = np.concatenate([np.zeros(0, np.int64), *[s[0] for s in seeds]]) % n_columns
    counts = np.concatenate([np.zeros(0), *[s[1] for s in seeds]])
    own, shared = len(names), 1
    mask = np.array([[*(float(n in u) for n in names), *[1.0] * shared] for _, u in memory])

    def labelled_sums(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
        w, at = _mixtures(h, rows, cols, counts, len(seeds), n, mask)
        parts, lost = _shares(w, at, rows, counts)
        return parts, np.stack([np.bincount(cols, parts[:, c], n_columns) for c in range(own + shared)]), lost / max(counts.sum(), 1.0)

    frequency = _document_frequency(vectors, n_columns)
    frequency[np.unique(cols)] += 1
    language = _normal(frequency[None, :])
    h = np.vstack([np.full((own, n_columns), 1 / n_columns), language])
    for turn in range(60):
        parts, labelled, _ = labelled_sums(h, 3)
        h = _normal(np.vstack([labelled[:own], labelled[own:] + 0.5 * labelled.sum() / shared * language]))
        if turn == 30:  # the seeds have settled: what is surely a subject's stays out of the shared component for good
            sure = (labelled[:own] / np.maximum(labelled.sum(0), EPS) >= anchor).any(0) & (np.bincount(cols, minlength=n_columns) >= firm)
            language[:, sure] = h[own:, sure] = 0.0

    losses: list[float] = []
    while True:
        corpus, loss = _update(vectors, h, steps)
        parts, labelled, lost = labelled_sums(h, 6)
        scale = weight * corpus.sum() / max(labelled.sum(), EPS) or 1.0
        mass = corpus + scale * labelled
        h = _normal(mass)
        losses.append((loss + weight * lost) / (1 + weight))
        if len(losses) > 1 and losses[-2] - losses[-1] < settled * abs(losses[-2]) or not corpus.any():
            break

    of = mass[:own] / np.maximum(mass.sum(0), EPS)
    model = Model(names, _normal(np.where(of >= anchor, h[:own], 0.0)), (of >= anchor).any(0), losses=tuple(losses))
    cut = _held_out_cut(memory[: len(samples)], own, rows, cols, counts, parts * scale, mass, anchor)
    if cut is not None:
        model.least_share = cut
    return model


def _held_out_cut(samples: list[tuple[str, set[str]]], own: int, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, parts: np.ndarray, mass: np.ndarray, anchor: float) -> float | None:
    """The share that parts the second subject of samples with two from the strays in samples with one.

    Each sample is judged by components without what it gave them itself
    (``parts``, by entry and component), so no text is held against its own
    trace.  None without samples of both kinds.
    """
    seconds: dict[int, list[float]] = {1: [], 2: []}
    total = np.where(mass[:own] / np.maximum(mass.sum(0), EPS) >= anchor, mass[:own], 0.0).sum(1, keepdims=True)
    ends = np.searchsorted(rows, np.arange(len(samples) + 1))
    for i, (_, labels) in enumerate(samples):
        if own < 2 or len(labels) not in seconds:
            continue
        at = slice(ends[i], ends[i + 1])
        rest = np.maximum(mass[:, cols[at]] - parts[at].T, 0.0)
        sure = rest[:own] / np.maximum(rest.sum(0), EPS) >= anchor
        use = sure.any(0)
        h = (np.where(sure, rest[:own], 0.0) / np.maximum(total, EPS))[:, use]
        w = _mixtures(h, np.zeros(use.sum(), np.int64), np.arange(use.sum()), counts[at][use], 1, 15)[0][0]
        seconds[len(labels)].append(float(np.sort(w / max(w.sum(), EPS))[-2]))
    one, two = (np.array(seconds[n]) for n in (1, 2))
    if not len(one) or not len(two):
        return None
    cuts = np.linspace(0.05, 0.45, 81)
    wrong = np.array([(one >= c).mean() + (two < c).mean() for c in cuts])
    best = cuts[wrong == wrong.min()]
    return float((best[0] + best[-1]) / 2)


def _score(model: Model, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Subject masses over the anchor terms."""
    use = model.anchors[cols]
    return _mixtures(model.h, rows[use], cols[use], counts[use], n, 15)[0]


def assign(vectors: DataFrame, key: str, model: Model) -> DataFrame:
    """``key, subject, share`` of the at most two subjects of each document."""
    held = vectors.sparkSession.sparkContext.broadcast(model)
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = pa.array(m.subjects, pa.string())
        for batch in batches:
            rows, cols, counts, n = _sparse(m, batch.column(1), batch.column(2))
            w = _score(m, rows, cols, counts, n)
            ends = batch.column(2).offsets.to_numpy()
            every = np.bincount(np.repeat(np.arange(n), np.diff(ends)), batch.column(2).flatten().to_numpy(zero_copy_only=False), n)
            mass = w.sum(1)
            share = w / np.maximum(mass, EPS)[:, None]
            rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
            about = (mass >= m.least_mass) & (mass >= m.least_density * every)
            d, s = np.nonzero((share >= m.least_share) & (rank < 2) & about[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), names.take(pa.array(s)), pa.array(share[d, s])], names=[key, "subject", "share"])

    return vectors.select(key, "terms", "counts").mapInArrow(run, f"{key} {kind}, subject string, share double")


def document_subjects(docs: DataFrame, samples: DataFrame, subjects: DataFrame, *, key: str, text: str, max_samples: int = 20_000, **options) -> DataFrame:
    """``key, subject, share``: the one or two subjects of each document.

    ``samples`` (``text, subjects``) and ``subjects`` (``subject, description``)
    seed the factors; of more than ``max_samples`` samples those with the least
    text hashes are used.  Documents without a subject give no row, as do null
    and empty texts; repeated documents give repeated rows.  Samples with a null
    text or without subjects are ignored; without any sample the descriptions
    alone are the seeds.
    """
    vectors = stage(_vectors(docs, [key], text), "subject-terms")
    seeds = samples.filter("text is not null and size(subjects) > 0").select("text", "subjects").orderBy(F.xxhash64("text"), "text").limit(max_samples).collect()
    named = subjects.filter("subject is not null").select("subject", F.coalesce("description", F.lit(""))).distinct().orderBy("subject").collect()  # a row per subject
    if not named:
        return docs.sparkSession.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, subject string, share double")
    model = fit(vectors, [(r[0], list(r[1])) for r in seeds], [tuple(r) for r in named], **options)
    return assign(vectors, key, model)


def composition(found: DataFrame) -> DataFrame:
    """``subject, n_docs, weight``: documents per subject, and their summed shares."""
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("share").alias("weight"))
