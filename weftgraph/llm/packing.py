"""Best-two-fit packing of token sequences into bins of fixed capacity.

A bin is filled greedily, largest piece first; then its smallest piece is
replaced by two unpacked ones that fit the expanded gap more tightly, while that
helps. How pieces fill bins depends on their lengths only, so the driver packs
the histogram of lengths (at most ``capacity`` numbers, whatever the input):
a bin's contents repeat as often as the counts allow. Each piece then finds its
slot by its rank among pieces of its length; ranks are counted in salted shares,
so a length that many pieces have is dealt over many tasks.

Tokens: a text's ids are those of its white-space separated words, one after the
other (the tokenizer's pattern never crosses white space), so each worker
encodes a word once.

Defined cases: null and empty texts give the end id alone; every row is packed,
repeats too; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.arrays import as_bytes, batches
from weftgraph.llm.store import written

CAPACITY = 4096
END_ID = 1
#: Words that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
LEAST_SHARES, PIECES_PER_SHARE = 16, 20_000


class _Codes(dict):
    """Words to numbers; a new word gets the next one and waits in ``fresh`` for its ids."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


def _parts(word: str) -> tuple[str, str] | None:
    """(lower-case letters, punctuation) of a plain word, None for any other.

    The tokenizer would part such a word there as well; of Latin letters the
    lower case and the composed form are certain.
    """
    letters = word.rstrip(string.punctuation)
    if letters and not (letters.isalpha() and max(letters) <= "\u024f" and "\u0130" not in letters):
        return None
    return letters.lower(), word[len(letters) :]


class WordIds:
    """Ids of words, remembered. Stems of plain words are encoded many at once, without the passes that leave them as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith("</w>")
        self.stems, self.ends = {"": b""}, {"": b""}
        self.clear()

    def clear(self):
        self.code = _Codes()
        if len(self.stems) > REMEMBERED:  # stems stay longer: their ids cost most
            self.stems = {"": b""}
        if len(self.ends) > REMEMBERED:
            self.ends = {"": b""}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self) -> None:
        """Gives fresh words their ids."""
        words, self.code.fresh = [w.decode("utf-8", "replace") for w in self.code.fresh], []
        parts = [_parts(w) for w in words]
        stems = list({p[0] for p in parts if p}.difference(self.stems))
        if stems:
            ids = np.array(self.plain.encode(" ".join(stems), add_special_tokens=False).ids, np.uint32)
            cut = np.append(0, np.flatnonzero(self.last[ids]) + 1)
            assert len(cut) == len(stems) + 1
            self.stems.update((w, ids[a:b].tobytes()) for w, a, b in zip(stems, cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        ends = list({p[1] for p in parts if p}.difference(self.ends))
        self.ends.update(zip(ends, self.whole(ends), strict=True))
        other = iter(self.whole([w for w, p in zip(words, parts, strict=True) if not p]))
        ids = [self.stems[p[0]] + self.ends[p[1]] if p else next(other) for p in parts]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        have, more = len(self.code) - len(words), int(n.sum())
        while len(self.flat) < self.used + more:
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while len(self.n) < have + len(words):
            self.start, self.n = np.append(self.start, np.zeros_like(self.start)), np.append(self.n, np.zeros_like(self.n))
        self.flat[self.used : self.used + more] = np.frombuffer(b"".join(ids), np.uint32)
        self.n[have : have + len(words)] = n
        self.start[have : have + len(words)] = self.used + np.cumsum(n) - n
        self.used += more

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by END_ID, and the texts' lengths."""
        if len(self.code) > REMEMBERED:
            self.clear()
        split = [t.split() for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        code = np.fromiter(map(self.code.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(count.sum()))
        self.learn()
        n = self.n[code]
        ends = np.append(0, np.cumsum(n))
        bounds = ends[np.append(0, np.cumsum(count))]
        out = np.full(int(ends[-1]) + len(texts), END_ID, np.uint32)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        out[np.arange(int(ends[-1])) + doc] = self.flat[np.repeat(self.start[code] - ends[:-1], n) + np.arange(int(ends[-1]))]
        return out, np.diff(bounds) + 1


_known: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _known:
            _known[path] = WordIds(path)
        words = _known[path]
        for part in parts:
            rows = zip(part.column(0).to_pylist(), map(as_bytes, part.column(1).to_pylist()), strict=True)
            for batch in batches(rows, lambda r: len(r[1]) + 1):
                ids, lengths = words.encode([t for _, t in batch])
                data, out, at = ids.astype("<u4").tobytes(), [], 0
                for (i, _), n in zip(batch, lengths.tolist(), strict=True):
                    for k, s in enumerate(range(0, n, capacity)):
                        m = min(capacity, n - s)
                        out.append((i, k, s, m, zlib.crc32(data[4 * (at + s) : 4 * (at + s + m)])))
                    at += n
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(copies, lengths in the bin) such that all ``counts[length]`` pieces are used."""
    left, out = counts.astype(np.int64).copy(), []
    axis = np.arange(capacity + 1)
    while left.any():
        bin_: list[int] = []
        gap = capacity

        def largest(most: int) -> int:
            some = np.flatnonzero(left[: most + 1])
            return int(some[-1]) if len(some) else 0

        while gap and (size := largest(gap)):
            k = int(min(left[size], gap // size))
            bin_ += [size] * k
            left[size] -= k
            gap -= k * size
        while gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            below = np.maximum.accumulate(np.where(left > 0, axis, 0))
            a = np.flatnonzero(left[: room + 1])
            # of a pair of equal lengths there must be two
            b = np.where((2 * a <= room) & (left[a] >= 2), a, below[np.minimum(a - 1, room - a)])
            both = np.where(b > 0, a + b, 0)
            if not len(a) or (best := int(both.argmax())) < 0 or both[best] <= small:
                break
            bin_.pop()
            left[small] += 1
            for x in sorted((int(a[best]), int(b[best])), reverse=True):
                bin_.append(x)
                left[x] -= 1
            bin_.sort(reverse=True)
            gap = capacity - sum(bin_)
        sizes, need = np.unique(bin_, return_counts=True)
        copies = 1 + int((left[sizes] // need).min())
        left[sizes] -= (copies - 1) * need
        out.append((copies, bin_))
    return out


def _slots(bins: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where pieces of a length and of ranks from the first on go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for copies, lengths in bins:
        at = 0
        for x in lengths:
            out.append((x, used.get(x, 0), sequence, at))
            used[x] = used.get(x, 0) + copies
            at += x
        sequence += copies
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(pack_lengths(counts, capacity)))
    shares = int(LEAST_SHARES + counts.sum() // PIECES_PER_SHARE)
    salted = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)).cast("int"))
    before = salted.groupBy("length", "share").count()
    before = before.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")).drop("count")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("base")).drop("share", "base")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        top = int(table[:, 1].max()) + 1 if len(table) else 1
        key = table[:, 0] * top + table[:, 1]
        for part in parts:
            length, rank = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(key, length * top + np.minimum(rank, top - 1), side="right") - 1
            assert (row >= first[length]).all()
            rest = [c for c in part.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in rest], pa.array(table[row, 2] + rank - table[row, 1]), pa.array(table[row, 3])], [*rest, "sequence_id", "offset"])

    names = [*pieces.columns]
    order = ["length", *[c for c in names if c != "length"]]
    schema = ", ".join(f"`{c}` {dict(pieces.dtypes)[c]}" for c in order) + ", sequence_id long, offset long"
    return ranked.select(*order, F.col("rank").cast("long")).mapInArrow(run, schema).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = written(source.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    return pack_pieces(pieces, capacity)
