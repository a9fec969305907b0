"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become token hashes: lower case, runs of letters and
digits; in scripts that put no spaces between words (Chinese, Japanese, Thai) each
character is a token, and punctuation of any script parts tokens. Grams of ``least`` tokens that a document shares with an item are
seeds; a pair whose seeds can't reach the threshold is dropped (a tile consists
of seeds, so none is lost). Then the longest runs of tokens that are still
unmarked on both sides are found by running Karp-Rabin hashes and marked,
longest first, without overlaps, down to ``least``. The share of an item's
tokens that lie in tiles is its coverage; passages in another order are caught,
as tiles may stand anywhere.

The benchmark is broadcast in blocks of at most BLOCK_BYTES, each with its own
pass over the documents, so its size is bounded wherever it is sent.

Defined cases: null or empty texts and items match nothing, nor do items of fewer
than ``least`` tokens (so few words are no evidence); rows are judged one by one, so repeats each appear; rows
with a null doc_id are judged too; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrays import LETTER_DIGIT, U, Words, _odd, as_bytes, batches, mix

LEAST = 4
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
#: Pairs of a text's and a block's grams that are held at once, if one text alone has no more.
EXPANDED = 4_000_000

#: Characters of scripts written without spaces: Thai, Lao, Burmese with Shan and Karen, Khmer, Tai and New Tai Lue, Tai Tham, Balinese, Javanese,
#: kana and ideographs, Yi. Tibetan parts its syllables by a sign, which is punctuation here.
ALONE = re.compile("[\u0e01-\u0e4e\u0e81-\u0ecd\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u109a-\u109d\u1780-\u17d3\u17dc\u17dd\u1950-\u19c9\u1a20-\u1a7c\u1b00-\u1b4c\u3005-\u3007\u3041-\u30ff\u3400-\u9fff\ua000-\ua48c\ua980-\ua9c0\ua9e0-\ua9ef\ua9fa-\ua9fe\uaa60-\uaac2\uf900-\ufaff\U00020000-\U0003ffff]")
#: Punctuation and signs beyond ASCII.
PARTING = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u0e4f-\u0e5b\u0f01-\u0f14\u0f34-\u0f3d\u0f85\u0fbe-\u0fda\u104a-\u104f\u17d4-\u17db\u1b5a-\u1b60\u2000-\u2bff\u3000-\u3004\u3008-\u303f\ua9c1-\ua9cd\ufe10-\ufe6f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def _plain(text: str | None) -> bytes:
    """Lower-case UTF-8 in which every token is a run of letters and digits."""
    if text and not text.isascii():
        text = ALONE.sub(r" \g<0> ", PARTING.sub(" ", text))
    return as_bytes(text, "all")


def _windows(tokens: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, running hash) of the windows without a marked token."""
    m = len(tokens) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    taken = np.append(0, np.cumsum(marked))
    at = np.flatnonzero(taken[size:] == taken[:-size])
    power = np.cumprod(np.full(len(tokens), _odd[0], U))
    sums = np.append(U(0), np.cumsum(tokens * power))
    inverse = np.cumprod(np.full(len(tokens), U(pow(int(_odd[0]), -1, 1 << 64)), U))
    return at, (sums[at + size] - sums[at]) * inverse[at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of each tile, longest first."""
    in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []

    def shared(size: int):
        a, x = _windows(doc, in_doc, size)
        b, y = _windows(item, in_item, size)
        by = np.argsort(y, kind="stable")
        b, y = b[by], y[by]
        lo, hi = np.searchsorted(y, x), np.searchsorted(y, x, side="right")
        return a, b, lo, hi

    most = min(len(doc), len(item))
    while most >= least:
        low, high = least - 1, most
        while low < high:  # a shared run of one length holds shorter ones
            mid = (low + high + 1) // 2
            _, _, lo, hi = shared(mid)
            low, high = (mid, high) if (hi > lo).any() else (low, mid - 1)
        if low < least:
            break
        a, b, lo, hi = shared(low)
        for k in np.flatnonzero(hi > lo):
            p = int(a[k])
            if in_doc[p] or in_doc[p + low - 1]:
                continue
            for q in sorted(b[lo[k] : hi[k]].tolist()):
                if not in_item[q : q + low].any() and not in_doc[p : p + low].any() and np.array_equal(doc[p : p + low], item[q : q + low]):
                    in_doc[p : p + low] = in_item[q : q + low] = True
                    out.append((p, q, low))
                    break
        most = low - 1 if low > least else 0
    return out


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int):
        self.ids = [i for i, _ in rows]
        self.words = w = Words([_plain(t) for _, t in rows], LETTER_DIGIT)
        at, gram = w.grams(least)
        self.in_order, self.ordered = at, gram
        order = np.argsort(gram, kind="stable")
        self.gram, self.at = gram[order], at[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[gram & U((1 << 20) - 1)] = True
        self.least = least

    def matches(self, texts: list[bytes], coverage: float) -> list[tuple[int, int, int, int, int]]:
        """(text, item, item's tokens, matched tokens, tiles) where coverage is reached."""
        w = Words(texts, LETTER_DIGIT)
        at, gram = w.grams(self.least)
        use = np.flatnonzero(self.maybe[gram & U((1 << 20) - 1)])
        at, gram = at[use], gram[use]
        lo, hi = np.searchsorted(self.gram, gram), np.searchsorted(self.gram, gram, side="right")
        use = np.flatnonzero(hi > lo)
        at, gram, lo, hi, doc = at[use], gram[use], lo[use], hi[use], w.doc[at[use]]
        out = []
        # each gram counts once a text, so a text makes at most as many pairs as the block has grams
        start = np.searchsorted(doc, np.arange(w.n + 1))
        pairs = np.append(0, np.cumsum(hi - lo))[start]
        text = 0
        while text < w.n:
            to = max(text + 1, int(np.searchsorted(pairs, pairs[text] + EXPANDED, side="right")) - 1)
            part = slice(start[text], start[to])
            out += self._of(w, at[part], gram[part], lo[part], hi[part], coverage)
            text = to
        return out

    def _of(self, w: Words, at: np.ndarray, gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, coverage: float) -> list[tuple[int, int, int, int, int]]:
        once = np.sort(np.unique(mix(gram ^ mix(w.doc[at].astype(U), 5)), return_index=True)[1])
        n = (hi - lo)[once]
        doc = np.repeat(w.doc[at[once]], n)
        other = self.at[np.repeat(lo[once] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(n) else np.zeros(0, int)
        pair = doc * len(self.ids) + self.words.doc[other]
        order = np.argsort(pair, kind="stable")
        pair, other = pair[order], other[order]
        cut = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, int)
        out, of = [], w.doc[at]
        for a, b in zip(cut, np.append(cut, len(pair))[1:], strict=True):
            text, item = divmod(int(pair[a]), len(self.ids))
            first, m = self.words.first[item], int(self.words.counts[item])
            seeded = np.zeros(m, bool)
            seeded[((other[a:b] - first)[:, None] + np.arange(self.least)).ravel()] = True
            if seeded.sum() < coverage * m:
                continue
            own = slice(*np.searchsorted(of, [text, text + 1]))
            place = at[own][np.isin(gram[own], self.gram_of(item))]
            near = np.unique(place[:, None] + np.arange(self.least))
            gap = np.flatnonzero(np.diff(near) > 1) + 1  # runs of seeded tokens, a token that matches nothing between them
            tokens = np.insert(w.hash[near], gap, mix(np.arange(len(gap), dtype=U), 77))
            found = tiles(tokens, self.words.hash[first : first + m], self.least)
            matched = sum(x[2] for x in found)
            if matched >= coverage * m:
                out.append((text, item, m, matched, len(found)))
        return out

    def gram_of(self, item: int) -> np.ndarray:
        """The grams of one item."""
        a, b = np.searchsorted(self.in_order, [self.words.first[item], self.words.first[item] + self.words.counts[item]])
        return self.ordered[a:b]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in blocks of bounded size, one at a time: rows come over partition by partition, and a block is let go once it is broadcast."""
    block, size = [], 0
    for i, text in benchmark.toLocalIterator():
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text or "") + 50
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, item_tokens, matched_tokens, n_tiles, coverage."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def found(rows: list):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, least)
            for part in parts:
                rows = zip(part.column(0).to_pylist(), map(_plain, part.column(1).to_pylist()), strict=True)
                for batch in batches(rows, lambda r: len(r[1]) + 1):
                    hits = items.matches([x for _, x in batch], coverage)
                    cols = list(zip(*hits, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch[t][0] for t in cols[0]], pa.int64()), pa.array([items.ids[i] for i in cols[1]], pa.int64()), *[pa.array(c, pa.int64()) for c in cols[2:]], pa.array([m / n for m, n in zip(cols[3], cols[2], strict=True)], pa.float64())],
                        ["doc_id", "item_id", "item_tokens", "matched_tokens", "n_tiles", "coverage"],
                    )

        return source.mapInArrow(run, "doc_id long, item_id long, item_tokens long, matched_tokens long, n_tiles long, coverage double")

    return reduce(DataFrame.unionByName, (found(b) for b in _blocks(benchmark.select("item_id", "text"))))


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows pass straight through, so nothing is shuffled."""
    for rows in _blocks(benchmark.select("item_id", "text")):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, least)
            for part in parts:
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                keep = np.ones(part.num_rows, bool)
                at = 0
                for batch in batches(map(_plain, texts), lambda x: len(x) + 1):
                    for hit in items.matches(batch, coverage):
                        keep[at + hit[0]] = False
                    at += len(batch)
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
