"""Language identification by language-bitmask n-gram filters.

Each language keeps the TOP n-grams that most of its documents have. They go into
one Bloom filter whose slots hold a bitmask of languages (bit-sliced: one filter
for up to 64 languages costs 2 MB); the AND of an n-gram's HASHES slots is the set
of languages that contain it, all found by one lookup. A text's languages are
counted bit by bit over its n-grams, each count is corrected for false positives -
a language whose filter is filled to a share f answers f ** HASHES of foreign
n-grams - and the largest one decides; of equal ones the language with more
documents, then the first by name. The score is the winner's part of all counts.

An n-gram is SIZES code points of a lower-cased word with a space on either side;
it is told by 44 bits of a hash. Its documents are counted over all documents that
are learned from: within batches by sorting packed numbers, then by one
aggregation. What reaches the driver is the filter, whose size is fixed, and the
list of languages; over MASKS * 64 languages are looked up in several filters one
after the other.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing was learned; a text none of whose n-grams is known gets the
language with the most documents and score 0; rows that repeat are documents of
their own; a null id is not held out; a null lang is not learned from; other
columns are ignored. Texts are worked on in pieces of PIECE code points that end
between words, so counts are those of the whole text; only a single word longer than a
piece is cut.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.arrays import U, mix
from weftgraph.llm.store import dropped, written

SIZES = (3, 4)
TOP = 2_000
SLOT_BITS, HASHES = 18, 3
#: Filters of 64 languages that one pass over the texts looks up (2 MB each).
MASKS = 64
PIECE, HELD, PARTS = 1 << 20, 1_000_000, 32
GRAM = U((1 << 44) - 1)
_odd = np.random.default_rng(77).integers(1, 1 << 62, max(SIZES) + 1, dtype=U) * U(2) + U(1)


@cache
def _letters() -> np.ndarray:
    """Code points that words consist of: letters, and the marks that go with them."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Code points of whole texts or of pieces that end between words, about PIECE together, with the texts' numbers."""
    who, held, size = [], [], 0
    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        at = 0
        while at < len(points):
            end = min(len(points), at + PIECE)
            if end < len(points):
                gap = np.flatnonzero(~_letters()[points[at:end]])
                end = at + int(gap[-1]) + 1 if len(gap) else end
            who.append(i)
            held.append(points[at:end])
            size += end - at
            at = end
            if size >= PIECE:
                yield who, held
                who, held, size = [], [], 0
    if who:
        yield who, held


def grams(who: list[int], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 44-bit n-gram) of all words of the pieces."""
    gap = np.zeros(1, "<u4")
    points = np.concatenate([gap, *[x for p in held for x in (p, gap)]])
    owner = np.repeat(np.array(who, np.int64), [len(p) + 1 for p in held])
    owner = np.append(owner[:1], owner)
    letter = _letters()[points]
    keep = letter.copy()  # one gap stays of each run of others
    keep[1:] |= letter[:-1]
    keep[0] = True
    points, owner, letter = np.where(letter, points, 32)[keep].astype(U), owner[keep], letter[keep]
    docs, out = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inside, total = np.ones(m, bool), np.zeros(m, U)
        for k in range(n):
            total += points[k : k + m] * _odd[k]
            if 0 < k < n - 1:
                inside &= letter[k : k + m]
        docs.append(owner[n - 2 : n - 2 + m][inside])  # the text of a word's last letter
        out.append(mix(total[inside], n) & GRAM)
    return (np.concatenate(docs), np.concatenate(out)) if docs else (np.zeros(0, np.int64), np.zeros(0, U))


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, documents) of this task's texts; input lang, text."""
    number: dict[str, int] = {}
    held: list[np.ndarray] = []  # packed (gram, lang) and counts
    rows = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        start = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        return key[order][start], np.add.reduceat(n[order], start)

    def sent(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        lang = pa.array(list(number), pa.string()).take(pa.array((key & U((1 << 20) - 1)).astype(np.int64)))
        yield from pa.table({"lang": lang, "gram": pa.array((key >> U(20)).astype(np.int64)), "n": pa.array(n)}).combine_chunks().to_batches(max_chunksize=100_000)

    for part in parts:
        langs = np.array([number.setdefault(x, len(number)) for x in part.column(0).to_pylist()], U)
        # pieces of one text are in one batch or in neighbours; a text counts once for an n-gram in each batch
        for who, points in pieces(part.column(1).to_pylist()):
            doc, gram = grams(who, points)
            first = doc.min() if len(doc) else 0
            packed = np.sort((gram << U(20)) | (doc - first).astype(U))
            packed = packed[np.append(True, packed[1:] != packed[:-1])[: len(packed)]]
            key = np.sort((packed & ~U((1 << 20) - 1)) | langs[(packed & U((1 << 20) - 1)).astype(np.int64) + first])
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            if not len(start):
                continue
            held.append((key[start], np.diff(np.append(start, len(key)))))
            rows += len(start)
            if rows > HELD:
                held = [merged()]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield from sent(*held[0])
                    held, rows = [], 0
    if held:
        yield from sent(*merged())


def slots(gram, k: int):
    """The k-th slot of an n-gram, of numpy arrays and of columns alike."""
    if isinstance(gram, np.ndarray):
        return ((gram + U(k) * (gram >> U(SLOT_BITS))) & U((1 << SLOT_BITS) - 1)).astype(np.int64)
    return (gram + k * F.shiftright(gram, SLOT_BITS)).bitwiseAND((1 << SLOT_BITS) - 1)


class Filter:
    """The bitmasks of up to MASKS * 64 languages."""

    def __init__(self, names: list[str], planes: np.ndarray):
        """planes: a row of slots for each 64 languages."""
        self.names, self.planes = names, planes
        bits = [(planes[i // 64] >> U(i % 64)) & U(1) for i in range(len(names))]
        self.false = np.array([float(b.mean()) ** HASHES for b in bits])

    def popcounts(self, doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """Of each of n texts and each language, how many n-grams its filter has."""
        out = np.zeros((n, len(self.names)))
        at = [slots(gram, k) for k in range(HASHES)]
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for a in at[1:]:
                mask &= plane[a]
            for i in range(64 * p, min(64 * p + 64, len(self.names))):
                out[:, i] = np.bincount(doc[((mask >> U(i % 64)) & U(1)).astype(bool)], minlength=n)
        return out

    def corrected(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.maximum(0, (counts - total[:, None] * self.false) / (1 - self.false))


def held_out(id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def filters(docs: DataFrame, top: int = TOP) -> list[Filter]:
    """Learned from the rows (lang, text) of ``docs`` whose lang is not null."""
    spark = docs.sparkSession
    known = docs.where("lang is not null").select("lang", "text")
    names = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not names:
        return []
    counts = known.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language's n-grams are ranked in parts first, so that no task gets more of them than PARTS * top
    counts = counts.withColumn("part", F.col("gram") % PARTS)
    by = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "gram")
    counts = counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).drop("rank", "part")
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    number = spark.createDataFrame(list(enumerate(names)), "number int, lang string")
    chosen = counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).join(number, "lang").select("number", "gram")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64)
    slot = F.explode(F.array(*[slots(F.col("gram"), k) for k in range(HASHES)]))
    table = written(chosen.select((F.col("number") / 64).cast("int").alias("plane"), slot.alias("slot"), bit.alias("bit")).groupBy("plane", "slot").agg(F.bit_or("bit").alias("mask")))
    out = []
    for a in range(0, len(names), 64 * MASKS):
        part = names[a : a + 64 * MASKS]
        planes = np.zeros((-(-len(part) // 64), 1 << SLOT_BITS), U)
        rows = table.where(F.col("plane").between(a // 64, a // 64 + MASKS - 1)).toArrow()
        planes[rows["plane"].to_numpy() - a // 64, rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(U)
        out.append(Filter(part, planes))
    dropped(table)
    return out


def languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(id).alias("held_out"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    learned = filters(rows.where("not held_out"), top)
    schema = "doc_id long, held_out boolean, text string, lang_pred string, best double, total double"

    def looked_up(sent, first: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = sent.value
            for part in parts:
                texts, n = part.column(2).to_pylist(), part.num_rows
                counts, total = np.zeros((n, len(f.names))), np.zeros(n)
                for who, points in pieces(texts):
                    doc, gram = grams(who, points)
                    counts += f.popcounts(doc, gram, n)
                    total += np.bincount(doc, minlength=n)
                counts = f.corrected(counts, total)
                at = counts.argmax(1)  # the first of equal ones
                best, name = counts[np.arange(n), at], [f.names[i] for i in at]
                if first:
                    name = [x if t and any(map(str.isalpha, t)) else "und" for x, t in zip(name, texts, strict=True)]
                else:
                    before = part.column(4).to_numpy()
                    name = [x if b > a and y != "und" else y for x, a, b, y in zip(name, before, best, part.column(3).to_pylist(), strict=True)]
                    best, counts = np.maximum(best, before), np.column_stack([counts, part.column(5).to_numpy()])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(name, pa.string()), pa.array(best), pa.array(counts.sum(1))], ["doc_id", "held_out", "text", "lang_pred", "best", "total"])

        return run

    out = rows.select("doc_id", "held_out", "text", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("best"), F.lit(0.0).alias("total"))
    for k, f in enumerate(learned):
        out = out.mapInArrow(looked_up(spark.sparkContext.broadcast(f), k == 0), schema)
    return out.select("doc_id", "held_out", "lang_pred", F.when((F.col("total") > 0) & (F.col("lang_pred") != "und"), F.col("best") / F.col("total")).otherwise(0.0).alias("score"))
