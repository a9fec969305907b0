"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is binned; cyclic boosting goes round the features and
adds, at a small rate, a shallow tree of the loss's gradient to the feature's
lookup table. Then the pairs whose joint bins explain most of what is left get
tables of their own. A score is the logistic function of a sum of table entries,
for a whole batch by array look-ups.

The model is fitted on at most PER_CLASS labelled rows of each class (and
MAX_CHARS characters), a documented bound; every text is scored as a whole.

Defined cases: null and empty texts are scored from their all-zero features;
without labels of both classes every score is the share of ones (0.5 without
any); rows that repeat are scored alike; a null doc_id is not held out; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrays import U, Words, as_bytes, batches, mix
from weftgraph.llm.labelled import held_out, training_rows

PER_CLASS, MAX_CHARS = 8000, 32_000_000
BINS, ROUNDS, RATE, PAIRS, COARSE = 48, 120, 0.15, 8, 12

FEATURES = ("words", "word_length", "symbols", "capitals", "bangs", "bars", "same_next", "distinct", "digits", "line_breaks", "stops", "distinct_grams", "wide_bytes", "capital_words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SETS = [_table(b"#*$%&<>"), _table(bytes(range(65, 91))), _table(b"!"), _table(b"|"), _table(b"0123456789"), _table(b"\n"), _table(b".,;:"), _table(bytes(range(128, 256)))]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    w = Words(texts)
    n, size = w.n, np.fromiter(map(len, texts), np.int64, w.n)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(w.counts, 1)

    def count(member: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(member[w.data])) if len(w.data) else np.zeros(1, int)
        return sums[w.begin + size] - sums[w.begin]

    symbols, capitals, bangs, bars, digits, breaks, stops, wide = (count(s) * per_byte for s in _SETS)
    by_doc = lambda hit: np.bincount(w.doc[hit], minlength=n)
    next_same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])) if len(w.hash) > 1 else np.zeros(0, int)
    distinct = np.unique(mix(w.hash ^ mix(w.doc.astype(U), 3)), return_index=True)[1]
    at, gram = w.grams(4)
    grams = np.bincount(w.doc[at], minlength=n)
    distinct_grams = w.doc[at[np.unique(mix(gram ^ mix(w.doc[at].astype(U), 3)), return_index=True)[1]]]
    upper = np.flatnonzero(_SETS[1][w.data[w.start]]) if len(w.start) else np.zeros(0, int)
    return np.column_stack(
        [np.log1p(w.counts), np.bincount(w.doc, w.end - w.start, n) * per_word, symbols, capitals, bangs, bars, by_doc(next_same) * per_word, by_doc(distinct) * per_word, digits, breaks, stops, np.bincount(distinct_grams, minlength=n) / np.maximum(grams, 1), wide, by_doc(upper) * per_word]
    )


def _split(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values of a shallow regression tree over ordered bins."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a * a / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            out[:k], out[k:] = _split(g[:k], h[:k], depth - 1), _split(g[k:], h[k:], depth - 1)
    return out


class Gam:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(y) or y.min() == y.max():
            return
        quantiles = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
        self.cuts = [quantiles(v, BINS) for v in x.T]
        bins = [np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        score = np.full(len(y), self.base)

        def residual():
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                g, h = residual()
                step = RATE * _split(np.bincount(b, g, len(self.tables[f])), np.bincount(b, h, len(self.tables[f])), 2)
                self.tables[f] += step
                score += step[b]
        coarse = [quantiles(v, COARSE) for v in x.T]
        small = [np.searchsorted(c, v, side="right") for c, v in zip(coarse, x.T, strict=True)]
        g, h = residual()
        found = []
        for i in range(x.shape[1]):
            for j in range(i):
                cell = small[i] * COARSE + small[j]
                a, b = np.bincount(cell, g), np.bincount(cell, h)
                found.append((float((a * a / (b + 1)).sum()), i, j))
        for _, i, j in sorted(found, reverse=True)[:PAIRS]:
            self.pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
        for _ in range(ROUNDS // 4):
            for i, j, ci, cj, table in self.pairs:
                g, h = residual()
                cell = small[i] * table.shape[1] + small[j]
                a = np.bincount(cell, g, table.size).reshape(table.shape)
                b = np.bincount(cell, h, table.size).reshape(table.shape)
                # a tree that splits one axis, then the other within each part
                rows = _split(a.sum(1), b.sum(1), 1)
                step = np.zeros_like(table)
                for part in np.unique(rows):
                    k = rows == part
                    step[k] = RATE * _split(a[k].sum(0), b[k].sum(0), 1)
                table += step
                score += step.ravel()[cell]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for cut, table, v in zip(self.cuts, self.tables, x.T, strict=False):
            total += table[np.searchsorted(cut, v, side="right")]
        for i, j, ci, cj, table in self.pairs:
            total += table[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Gam:
    rows = training_rows(docs, labels, label, per_class, max_chars)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = [features(b) for b in batches(map(as_bytes, part.column(2).to_pylist()), lambda x: len(x) + 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.concatenate(done).tolist() if done else [], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = sorted(rows.mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    return Gam(x, np.array([r["label"] for r in got], float))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = [model.value.score(features(b)) for b in batches(map(as_bytes, part.column(2).to_pylist()), lambda x: len(x) + 1)]
            score = np.concatenate(done) if done else np.zeros(0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
