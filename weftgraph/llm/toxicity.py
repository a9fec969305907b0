"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

The models are of order 2 within a word: a word is predicted from its stem, its first
STEM code points. Each class counts in how many of its documents a word occurs, and
a stem. From every count DISCOUNT is taken; what that frees is the share of a backoff:
a word's is its class's stem with the words of the stem as in both classes together,
and a stem's is the counts of both classes together. Both classes leave the backoff
the same share, so an expression that is rare in both speaks for neither, while a rare
form of a stem that one class prefers speaks for that class.

Texts are compared by length-normalised differences of the two log-likelihoods: that
of the whole text, and the largest of its runs of RUNS words each, as a few insults
among many words show in a run. A logistic curve of these makes a probability; it is
fitted on folds that their models haven't seen. STEM, DISCOUNT and RUNS were chosen
by the same folds of the training rows of sf0.1; held-out rows took no part.

The models are fitted on at most PER_CLASS labelled rows of each class (and
MAX_CHARS characters), a documented bound; every text is scored as a whole.

Defined cases: null and empty texts have no evidence and get the score of zero
differences; without labels of both classes every score is 0; rows that repeat
are scored alike; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrays import LETTER_DIGIT, U, Words, as_bytes, batches, mix, prefix_sums, span_hashes
from weftgraph.llm.labelled import held_out, training_rows

PER_CLASS, MAX_CHARS = 2000, 7_000_000
STEM, DISCOUNT, RUNS = 5, 4.0, (2, 10)


class Text:
    """The words of some texts and their stems, as hashes; ``n`` texts have ``counts`` words each."""

    def __init__(self, words: np.ndarray, stems: np.ndarray, counts: np.ndarray):
        self.hash, self.stem, self.counts, self.n = words, stems, counts, len(counts)
        self.first = np.cumsum(counts) - counts
        self.doc = np.repeat(np.arange(self.n), counts)

    @classmethod
    def of(cls, texts: list[bytes]) -> Text:
        w = Words(texts, LETTER_DIGIT)
        lead = np.flatnonzero((w.data & 0xC0) != 0x80)  # where code points begin
        end = np.append(lead, np.full(STEM, len(w.data)))[np.searchsorted(lead, w.start) + STEM]
        return cls(w.hash, mix(span_hashes(prefix_sums(w.data), w.start, np.minimum(w.end, end)), 3), w.counts)

    @classmethod
    def joined(cls, parts: list[Text]) -> Text:
        none = np.zeros(0, U)
        return cls(np.concatenate([none, *[p.hash for p in parts]]), np.concatenate([none, *[p.stem for p in parts]]), np.concatenate([np.zeros(0, np.int64), *[p.counts for p in parts]]))

    def part(self, which: np.ndarray) -> Text:
        of = which[self.doc]
        return Text(self.hash[of], self.stem[of], self.counts[which])


def _shares(count: list[np.ndarray], discount: float) -> tuple[list[np.ndarray], float]:
    """The discounted shares of each class's counts, and the share that both leave to the backoff."""
    own = [np.maximum(c - discount, 0) / max(1.0, c.sum()) for c in count]
    kept = min(x.sum() for x in own)
    return [x * (kept / max(x.sum(), 1e-300)) for x in own], 1 - kept


class Model:
    """log P(word | toxic) - log P(word | ordinary) of the words and of the stems that were seen, as sorted tables."""

    def __init__(self, text: Text, toxic: np.ndarray, discount: float = DISCOUNT):
        self.words, at, word = np.unique(text.hash, return_index=True, return_inverse=True)
        self.stems, stem = np.unique(text.stem, return_inverse=True)
        of_word, label = stem[at], toxic.astype(bool)[text.doc]
        once = lambda of: np.unique(text.doc * (1 + of.max(initial=0)) + of, return_index=True)[1]
        count = lambda of, n: [np.bincount(of[(i := once(of))][label[i] == k], minlength=n).astype(float) for k in (False, True)]
        words, stems = count(word, len(self.words)), count(stem, len(self.stems))
        both = words[0] + words[1] + 0.5
        both /= max(1.0, both.sum())
        of_stem = np.bincount(of_word, both, len(self.stems))
        share, left = _shares(stems, discount)
        back = [s + left * of_stem for s in share]
        share, left = _shares(words, discount)
        p = [s + left * b[of_word] * both / of_stem[of_word] for s, b in zip(share, back, strict=True)]
        self.word_p, self.stem_p = p, back
        self.of_words, self.of_stems = np.log(p[1]) - np.log(p[0]), np.log(back[1]) - np.log(back[0])

    def differences(self, t: Text) -> np.ndarray:
        """Of each word of the texts; a word that wasn't seen has that of its stem, one whose stem wasn't either 0."""
        if not len(t.hash) or not len(self.words):
            return np.zeros(len(t.hash))

        def found(table, values, x, other):
            at = np.minimum(np.searchsorted(table, x), len(table) - 1)
            return np.where(table[at] == x, values[at], other)

        return found(self.words, self.of_words, t.hash, found(self.stems, self.of_stems, t.stem, 0.0))

    def evidence(self, t: Text) -> np.ndarray:
        """Of each text the mean difference, and the largest mean over its runs of each of RUNS words; a shorter text is one run."""
        out, diff = np.zeros((t.n, 1 + len(RUNS))), self.differences(t)
        has = np.flatnonzero(t.counts > 0)
        if len(has):
            sums, end = np.append(0.0, np.cumsum(diff)), (t.first + t.counts)[t.doc]
            out[has, 0] = (sums[(t.first + t.counts)[has]] - sums[t.first[has]]) / t.counts[has]
            for k, run in enumerate(RUNS):
                # runs that would pass the end start at the text's last whole run
                start = np.maximum(np.minimum(np.arange(len(diff)), end - run), t.first[t.doc])
                stop = np.minimum(start + run, end)
                out[has, k + 1] = np.maximum.reduceat((sums[stop] - sums[start]) / (stop - start), t.first[has])
        return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and a constant by Newton steps with a light penalty, of the columns in units of their spread."""
    spread = np.maximum(x.std(0), 1e-9)
    a, b = np.column_stack([x / spread, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(hess, a.T @ (y - p) - 1e-2 * b)
        b += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return b / np.append(spread, 1.0)


def _probability(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        words, stems = [], []
        for b in batches((as_bytes(x, "all") for x in part.column(2).to_pylist()), lambda x: len(x) + 1):
            t = Text.of(b)
            for s, n in zip(t.first, t.counts, strict=True):
                words.append(t.hash[s : s + n].tobytes())
                stems.append(t.stem[s : s + n].tobytes())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.binary()), pa.array(stems, pa.binary())], ["doc_id", "label", "words", "stems"])


def _fit(text: Text, y: np.ndarray) -> tuple[Model | None, np.ndarray]:
    """The model of all texts, and the curve that was fitted on folds their models haven't seen."""
    if not len(y) or y.min() == y.max():
        return None, np.append(np.zeros(1 + len(RUNS)), -30.0)
    fold, x = np.arange(len(y)) % 4, np.zeros((len(y), 1 + len(RUNS)))
    for k in range(4):
        x[fold == k] = Model(text.part(fold != k), y[fold != k]).evidence(text.part(fold == k))
    return Model(text, y), _logistic(x, y.astype(float))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[Model | None, np.ndarray]:
    """Fitted in one task, as the sample is bounded; the driver only gets the model."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "label", "words"])
        parts = [Text(w, np.frombuffer(s, U), np.array([len(w)])) for w, s in ((np.frombuffer(w, U), s) for w, s in zip(part["words"], part["stems"], strict=True))]
        return pd.DataFrame({"model": [pickle.dumps(_fit(Text.joined(parts), part["label"].to_numpy()))]})

    rows = training_rows(docs, labels, label, per_class, max_chars).mapInArrow(_hashed, "doc_id long, label int, words binary, stems binary")
    got = rows.groupBy().applyInPandas(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else _fit(Text.joined([]), np.zeros(0, int))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, b = sent.value
        for part in parts:
            done = []
            for batch in batches((as_bytes(x, "all") for x in part.column(2).to_pylist()), lambda x: len(x) + 1):
                done.append(_probability(model.evidence(Text.of(batch)) if model else np.zeros((len(batch), 1 + len(RUNS))), b))
            score = np.concatenate(done) if done else np.zeros(0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
