"""Exact substring de-duplication over a sparse suffix array.

Every byte covered by a ``length``-byte string that also starts in a document
with a smaller doc_id is removed; all strings are judged on the input.

A string of ``length`` bytes always holds the same minimal gram of ``GRAM``
bytes (the leftmost with the smallest hash), so only suffixes that begin at such
anchors are sorted: about one in ten. The steps:

1. Exact copies of a text with a smaller doc_id are known by digest; they are
   removed whole and compared with nothing. The join that tells them carries no
   other duty, so adaptive execution can split a digest that many rows have.
   Texts are dealt into chunk rows of about ``CHUNK`` bytes, written once; a
   longer text is a chunk of its own and is worked on in slices.
2. Each chunk sends its distinct anchor keys to hash buckets; a key that other
   chunks have too comes back, with the place of the chunk in the key's list of
   chunks. Anchors seen nowhere else end here.
3. A chunk sorts the contexts of its remaining anchors and settles what repeats
   inside it, so that of equal strings it passes on those of its first document
   only.
4. Sampled splitters (SPLITTERS at most, from a sample of bounded size) deal the
   suffixes by leading gram, and within a range by the gram's hash if ranges are
   many buckets large. A bucket sorts its suffixes by multikey quicksort with
   8-byte characters and finds, from the common prefixes of neighbours on the right
   and of the reversed left contexts, the smallest doc_id of each string. Equal
   leading grams are never parted, so at a bucket's boundary the neighbours share
   less than a gram and no match crosses it.
5. Every key is settled among ``group`` chunks at a time: of equal strings only
   the smallest doc_id's goes on to the next round, with ``group`` such groups
   together. A key of at most ``group`` chunks is done after one round, one of all
   chunks after the logarithm of their number, and no task gets more of a key than
   a group's share.
6. The covered ranges return to their chunks, which cut them out.

Defined cases: null or empty texts have no bytes; a row with a null doc_id is
left whole and compared with nothing; rows that repeat a doc_id don't cover each
other; texts shorter than ``length`` stay whole; other columns are carried only
when named. A cut inside a character leaves a fragment in the kept bytes; the
kept text drops it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrays import _INVERSE, U, as_bytes, mix, powers, prefix_sums
from weftgraph.llm.store import dropped, released, written

GRAM = 32
CHUNK = 2 << 20
#: Bytes of a text whose anchors are looked for at once.
SLICE = 1 << 20
#: Suffixes in a row that is passed on.
ROW = 50_000
#: Chunks in which a key is settled at once.
GROUP = 64
SPLITTERS, SAMPLES = 4096, 20
KEYS_PER_BUCKET = 1_000_000
SUFFIXES_PER_BUCKET = 150_000
_NONE = np.iinfo(np.int64).max


def _chunked(size: int):
    """(doc_id, text, rest, copy) rows to chunk rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seq, task = zstandard.ZstdCompressor(level=1), 0, TaskContext.get().partitionId()
        ids, rest, copies, bodies, total = [], [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in bodies]], pa.list_(pa.int64())), pa.array([rest], pa.list_(pa.string())), pa.array([copies], pa.list_(pa.bool_())), pa.array([pack.compress(b"".join(bodies))])],
                ["chunk", "ids", "lengths", "rest", "copies", "body"],
            )

        for part in parts:
            for i, text, more, copy in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = as_bytes(text)
                if ids and total + len(data) > size:
                    yield row()
                    ids, rest, copies, bodies, total, seq = [], [], [], [], 0, seq + 1
                ids.append(i)
                rest.append(more)
                copies.append(copy)
                bodies.append(data)
                total += len(data)
        if ids:
            yield row()

    return run


def _least_grams(part: np.ndarray, length: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of the anchors of the windows that are ``inside``."""
    n, width = len(part), length - GRAM + 1
    sums = prefix_sums(part)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1, _INVERSE)[: n - GRAM + 1])
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least[inside] & U(0xFFFFFFFF)).astype(np.int64)
    place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
    return place, mix(h[place], 5)


class _Chunk:
    def __init__(self, ids, lengths, copies, body):
        self.ids = np.array([_NONE if i is None or i != i else i for i in ids], np.int64)
        self.lengths = np.asarray(lengths, np.int64)
        self.copies = np.asarray(copies, bool)
        self.begin = np.cumsum(self.lengths) - self.lengths
        size = int(self.lengths.sum())
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, size)) if size else b"", np.uint8)

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of the leftmost smallest gram of every window of ``length`` bytes within a document."""
        use = np.flatnonzero((self.lengths >= length) & (self.ids != _NONE) & ~self.copies)
        first, last = self.begin[use], self.begin[use] + self.lengths[use] - length
        places, keys, prior = [np.zeros(0, np.int64)], [np.zeros(0, U)], -1
        for at in range(0, max(0, len(self.body) - length + 1), SLICE):
            part = self.body[at : at + SLICE + length - 1]
            m = len(part) - length + 1
            inside = np.zeros(m + 1, np.int32)
            np.add.at(inside, np.clip(first - at, 0, m), 1)
            np.add.at(inside, np.clip(last - at + 1, 0, m), -1)
            place, key = _least_grams(part, length, np.cumsum(inside[:m]) > 0)
            if len(place) and place[0] + at == prior:
                place, key = place[1:], key[1:]
            if len(place):
                prior = int(place[-1]) + at
            places.append(place + at)
            keys.append(key)
        return np.concatenate(places), np.concatenate(keys)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin + self.lengths, place, side="right")


def _bucketed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 40 further bits) of each key."""
    return ((keys & U(0xFFFFFFFF)) % U(buckets)).astype(np.int64), keys >> U(24)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(U).ravel()


def _keyed(length: int, buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for chunk, ids, lengths, copies, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                bucket, bits = _bucketed(np.unique(_Chunk(ids, lengths, copies, body).anchors(length)[1]), buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, bits = bucket[order], bits[order]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
                ends = np.append(cut, len(bucket))[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut]), pa.array(np.full(len(cut), chunk)), pa.array([_five(bits[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "chunk", "bits"]
                )

    return run


def _met(group: int):
    """For each chunk its keys that other chunks have too, with the group that the chunk falls into and the rounds that the key takes."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        bits = [_from_five(x) for x in part["bits"]]
        of = np.repeat(np.arange(len(bits)), [len(x) for x in bits])
        bits = np.concatenate(bits)
        order = np.argsort(bits, kind="stable")
        s = bits[order]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        count = np.diff(np.append(start, len(s)))
        nth, count = np.arange(len(s)) - np.repeat(start, count), np.repeat(count, count)
        use = count > 1
        of, s, nth, count = of[order][use], s[use], nth[use], count[use]
        rounds = np.zeros(len(s), np.uint8)
        while (count > group).any():
            rounds += count > group
            count = -(-count // group)
        back = np.argsort(of, kind="stable")
        of, s, nth, rounds = of[back], s[back], nth[back] // group, rounds[back]
        cut = np.searchsorted(of, np.arange(len(part) + 1))
        keep = [k for k in range(len(part)) if cut[k] < cut[k + 1]]
        of_row = lambda values: [values[cut[k] : cut[k + 1]] for k in keep]
        return pd.DataFrame(
            {
                "chunk": part["chunk"].to_numpy()[keep],
                "bucket": part["bucket"].to_numpy()[keep],
                "bits": [_five(x) for x in of_row(s)],
                "groups": [x.astype("<u4").tobytes() for x in of_row(nth)],
                "rounds": [x.tobytes() for x in of_row(rounds)],
            }
        )

    return run


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of an (n, k) array of 8-byte characters, and the bytes that each row shares with the row before it.

    Multikey quicksort, all ranges of a level at once: ranges of equal
    characters go on to the next character, others are done.
    """
    n, k = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    shared = np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order that may still tie
    for level in range(k):
        now = words[order[open_], level]
        differs = np.append(True, now[1:] != now[:-1])
        if level:
            differs |= starts
        at = open_[differs]
        inner = at if not level else open_[differs & ~starts]
        if len(inner):
            prior = inner[inner > 0]
            x = words[order[prior], level] ^ words[order[prior - 1], level]
            shared[prior] = level * 8 + sum((x < U(1 << 8 * b)).astype(np.int64) for b in range(1, 8))
        same = open_[~differs]
        shared[same] = (level + 1) * 8
        tied = ~differs
        tied[:-1] |= ~differs[1:]
        open_, starts = open_[tied], differs[tied]
        if not len(open_) or level + 1 == k:
            break
        rows, group = order[open_], np.cumsum(starts)
        by = np.lexsort((words[rows, level + 1], group))
        order[open_] = rows[by]
    return order, shared


def _as_words(data: np.ndarray) -> np.ndarray:
    """(n, m) bytes to (n, ceil(m / 8)) big-endian 8-byte characters."""
    n, m = data.shape
    wide = np.zeros((n, -(-m // 8) * 8), np.uint8)
    wide[:, :m] = data
    return wide.view(">u8").astype(U)


def smallest(context: np.ndarray, need: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The smallest doc of each needed string; context: the bytes left of the anchor, then those from it on; need[i, r]: the string that starts r bytes left of anchor i."""
    n, left = len(context), length - GRAM
    out = np.full(need.shape, _NONE)
    if not n:
        return out
    order, shared = multikey_sort(_as_words(context[:, left:]))
    order_l, shared_l = multikey_sort(_as_words(context[:, left - 1 :: -1] if left else context[:, :0]))
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(left + 1):
        rows = np.flatnonzero(need[:, r])
        if not len(rows):
            continue
        right_class[order] = np.cumsum(shared < length - r)
        left_class[order_l] = np.cumsum(shared_l < r)
        key = right_class[rows] * (n + 1) + left_class[rows]
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        least = np.minimum.reduceat(doc[rows][by], first)
        out[rows[by], r] = np.repeat(least, np.diff(np.append(first, len(rows))))
    return out


def _ranges(place: np.ndarray, covered: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): the strings that cover around one anchor overlap, so they make one range."""
    rows = np.flatnonzero(covered.any(1))
    hit = covered[rows]
    least, most = hit.argmax(1), hit.shape[1] - 1 - hit[:, ::-1].argmax(1)
    return rows, place[rows] - most, place[rows] - least + length


def _pairs(start: np.ndarray, end: np.ndarray) -> bytes:
    return np.column_stack([start, end]).astype("<i8").tobytes()


#: What a suffix carries beside its context.
_FIELDS = (("need", "<u4"), ("place", "<u4"), ("doc", "<i8"), ("chunk", "<i8"), ("group", "<u4"), ("rounds", "u1"))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Suffixes as one compressed block; columns stand together, so that sorted contexts shrink."""
    data = [columns[0].tobytes(), *(x.astype(kind).tobytes() for x, (_, kind) in zip(columns[1:], _FIELDS, strict=True))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(data))


def _unpacked(data: bytes, n: int, width: int) -> list[np.ndarray]:
    sizes = [width, *(np.dtype(kind).itemsize for _, kind in _FIELDS)]
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=n * sum(sizes))
    ends = n * np.cumsum([0, *sizes])
    columns = [np.frombuffer(raw[x:y], kind) for x, y, kind in zip(ends[:-1], ends[1:], ["u1", *(k for _, k in _FIELDS)], strict=True)]
    return [columns[0].reshape(n, width), *(c.astype(np.int64) for c in columns[1:])]


def _contexts(length: int, buckets: int, every: int):
    left = length - GRAM

    def run(_, chunks: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunks.itertuples():
            c = _Chunk(row.ids, row.lengths, row.copies, row.body)
            place, key = c.anchors(length)
            doc = c.doc_of(place)
            bucket, bits = _bucketed(key, buckets)
            full = (bucket.astype(U) << U(40)) | bits
            known = [(U(b) << U(40)) | _from_five(x) for b, x in zip(met["bucket"], met["bits"], strict=True)]
            known = np.concatenate(known) if known else np.zeros(0, U)
            group, rounds = np.frombuffer(b"".join(met["groups"]), "<u4"), np.frombuffer(b"".join(met["rounds"]), np.uint8)
            by = np.argsort(known)
            known, group, rounds = known[by], group[by], rounds[by]
            at = np.minimum(np.searchsorted(known, full), max(0, len(known) - 1))
            outside = known[at] == full if len(known) else np.zeros(len(full), bool)
            # keys of two documents or more of this chunk
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, int)
            twice = np.zeros(len(key), bool)
            if len(key):
                low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
                twice[order] = np.repeat(low != high, np.diff(np.append(first, len(key))))
            use = np.flatnonzero(outside | twice)
            place, doc, twice, outside, at = place[use], doc[use], twice[use], outside[use], at[use]
            from_start, to_end = place - c.begin[doc], c.begin[doc] + c.lengths[doc] - place
            r = np.arange(left + 1)
            need = (r <= from_start[:, None]) & (length - r <= to_end[:, None])
            padded = np.concatenate([np.zeros(left, np.uint8), c.body, np.zeros(length, np.uint8)])
            column = np.arange(left + length)
            ids, local = c.ids[doc], b""
            some = np.flatnonzero(twice)
            if len(some):
                low = smallest(padded[place[some][:, None] + column], need[some], ids[some], length)
                covered = need[some] & (low < ids[some][:, None])
                _, s, e = _ranges(place[some], covered, length)
                local = _pairs(s, e)
                need[some] &= ~covered
            send = np.flatnonzero(outside & need.any(1))
            for a in range(0, max(1, len(send)), ROW):
                part = send[a : a + ROW]
                needs = need[part]
                most, least = np.where(needs, r, -1).max(1)[:, None], np.where(needs, r, left + 1).min(1)[:, None]
                context = padded[place[part][:, None] + column]
                # bytes that no open string covers are blanked
                context[(column < left - most) | (column >= left + length - least)] = 0
                sample = _grams(context[::every], left).astype(object).tolist() if len(part) else []
                block = [context, (needs << r).sum(1), place[part], ids[part], np.full(len(part), row.chunk), *((group[at[part]], rounds[at[part]]) if len(part) else (part, part))]
                out.append((row.chunk, len(part), sample, _packed(block), b"" if a else local))
        return pd.DataFrame(out, columns=["chunk", "n", "sample", "suffixes", "local"])

    return run


def _grams(context: np.ndarray, left: int) -> np.ndarray:
    """What splitters divide: the leading grams, as fixed-width byte strings."""
    return np.ascontiguousarray(context[:, left : left + GRAM]).view(f"S{GRAM}").ravel()


def _blocks(columns: list[np.ndarray], bucket: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(bucket, group, n, suffixes) for each bucket and group of the suffixes."""
    order = np.lexsort((columns[5], bucket))
    bucket, group = bucket[order], columns[5][order]
    at = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (group[1:] != group[:-1]))) if len(order) else np.zeros(0, int)
    return [(int(bucket[a]), int(group[a]), int(b - a), _packed([x[order[a:b]] for x in columns])) for a, b in zip(at, np.append(at, len(order))[1:], strict=True)]


def _dealt(splitters: list[bytes], shares: int, length: int):
    """Chunk rows to a row for each bucket and group."""
    left = length - GRAM

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(splitters, f"S{GRAM}")
        for part in parts:
            for n, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if n:
                    columns = _unpacked(data, n, left + length)
                    gram = np.zeros(n, U)
                    for word in _as_words(columns[0][:, left : left + GRAM]).T:
                        gram = mix(gram ^ word)
                    order = np.argsort(_grams(columns[0], left), kind="stable")
                    bucket = np.searchsorted(cuts, _grams(columns[0], left)[order], side="right") * shares + (gram[order] % U(shares)).astype(np.int64)
                    rows = _blocks([x[order] for x in columns], bucket)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "grp", "n", "suffixes"])

    return run


def _settled(length: int, group: int):
    """The covered ranges of a bucket's suffixes by chunk, and what goes on to the next round."""
    left = length - GRAM

    def run(part: pd.DataFrame) -> pd.DataFrame:
        blocks = [_unpacked(x, n, left + length) for x, n in zip(part["suffixes"], part["n"], strict=True)]
        columns = [np.concatenate(x) for x in zip(*blocks, strict=True)]
        context, needs, place, doc, chunk, grp, rounds = columns
        need = (needs[:, None] >> np.arange(left + 1) & 1).astype(bool)
        covered = need & (smallest(context, need, doc, length) < doc[:, None])
        rows, start, end = _ranges(place, covered, length)
        by = np.argsort(chunk[rows], kind="stable")
        of, start, end = chunk[rows][by], start[by], end[by]
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
        out = [(int(of[a]), _pairs(start[a:b], end[a:b]), None, None, 0, None) for a, b in zip(cut, np.append(cut, len(of))[1:], strict=True)]
        need &= ~covered
        on = np.flatnonzero((rounds > 0) & need.any(1))
        if len(on):
            left_over = [context[on], (need[on] << np.arange(left + 1)).sum(1), place[on], doc[on], chunk[on], grp[on] // group, rounds[on] - 1]
            out += [(None, None, b, g, n, x) for b, g, n, x in _blocks(left_over, np.full(len(on), part["bucket"].iloc[0]))]
        return pd.DataFrame(out, columns=["chunk", "ranges", "bucket", "grp", "n", "suffixes"]).astype({"chunk": "Int64", "bucket": "Int64", "grp": "Int64"})

    return run


def _cut(_, chunks: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    out = []
    pairs = np.frombuffer(b"".join(ranges["ranges"]), "<i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    for row in chunks.itertuples():
        c = _Chunk(row.ids, row.lengths, row.copies, row.body)
        lo, hi = np.searchsorted(pairs[:, 0], c.begin), np.searchsorted(pairs[:, 0], c.begin + c.lengths)
        for k, (i, b, n, rest) in enumerate(zip(row.ids, c.begin.tolist(), c.lengths.tolist(), row.rest, strict=True)):
            runs = [(b, b + n)] if c.copies[k] and n else _merged(pairs[lo[k] : hi[k]])
            removed, at, kept = sum(y - x for x, y in runs), b, []
            for x, y in [*runs, (b + n, b + n)]:
                kept.append(c.body[at:x].tobytes())
                at = y
            kept = b"".join(kept)
            out.append((None if i != i else i, n, removed, len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), rest))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "rest"]).astype({"doc_id": "Int64"})


def _merged(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of (start, end) pairs in order of start."""
    if not len(pairs):
        return []
    end = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.append(True, pairs[1:, 0] > end[:-1]))
    return list(zip(pairs[first, 0].tolist(), end[np.append(first[1:] - 1, len(pairs) - 1)].tolist(), strict=True))


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50, carry: tuple[str, ...] = (), chunk: int = CHUNK, group: int = GROUP, bucket: int = SUFFIXES_PER_BUCKET, splitters: int = SPLITTERS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and the columns named in carry), one row per row of ``docs``.

    length: from GRAM + 1 to GRAM + 31, the strings around one anchor being bits of one number.
    """
    if not GRAM < length <= GRAM + 31 or group < 2:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 31}, group at least 2")
    spark = docs.sparkSession
    rest = F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), rest.alias("rest"))
    source = source.withColumn("digest", F.md5("text"))
    long = source.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).select("doc_id", "digest")
    firsts = written(long.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    # the list of copied texts grows with the input, so it is never broadcast: the plan is the same at every size
    source = source.join(firsts.hint("merge"), "digest", "left").select("doc_id", "text", "rest", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"))
    schema = "chunk long, ids array<long>, lengths array<long>, rest array<string>, copies array<boolean>, body binary"
    chunks = written(source.mapInArrow(_chunked(chunk), schema))
    dropped(firsts)
    del source, long
    released(spark)  # the shuffle of the texts
    size = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = min(1 << 24, max(8, math.ceil(size / 10 / KEYS_PER_BUCKET)))
    keys = chunks.select("chunk", "ids", "lengths", "copies", "body").mapInArrow(_keyed(length, buckets), "bucket long, chunk long, bits binary")
    met = keys.groupBy("bucket").applyInPandas(_met(group), "chunk long, bucket long, bits binary, groups binary, rounds binary")
    contexts = chunks.drop("rest").groupBy("chunk").cogroup(met.groupBy("chunk")).applyInPandas(_contexts(length, buckets, max(1, bucket // SAMPLES)), "chunk long, n long, sample array<binary>, suffixes binary, local binary")
    contexts = written(contexts)
    del keys, met
    released(spark)
    n = math.ceil((contexts.agg(F.sum("n")).first()[0] or 0) / bucket)
    ranges_wide = max(1, min(splitters, n))
    grams = contexts.select(F.explode("sample").alias("gram")).orderBy(F.xxhash64("gram"), "gram").limit(SAMPLES * ranges_wide)
    sample = np.sort(np.array([bytes(r[0]) for r in grams.collect()], f"S{GRAM}"))
    cuts = np.unique(sample[np.arange(1, ranges_wide) * len(sample) // ranges_wide]).tolist() if len(sample) else []
    dealt = contexts.select("n", "suffixes").mapInArrow(_dealt(cuts, max(1, math.ceil(n / ranges_wide)), length), "bucket long, grp long, n long, suffixes binary")
    rounds = []
    while not rounds or not dealt.isEmpty():
        settled = dealt.groupBy("bucket", "grp").applyInPandas(_settled(length, group), "chunk long, ranges binary, bucket long, grp long, n long, suffixes binary")
        rounds.append(written(settled))
        dealt = rounds[-1].where("n > 0").select("bucket", "grp", "n", "suffixes")
    found = contexts.where("length(local) > 0").select("chunk", F.col("local").alias("ranges"))
    for settled in rounds:
        found = found.unionByName(settled.where("ranges is not null").select("chunk", "ranges"))
    ranges = written(found)
    del dealt, settled
    for table in (contexts, *rounds):
        dropped(table)
    released(spark)
    out = chunks.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, rest string")
    if carry:
        out = out.withColumn("rest", F.from_json("rest", docs.select(*carry).schema)).select(*[c for c in out.columns if c != "rest"], *[F.col(f"rest.{c}").alias(c) for c in carry])
        return out
    return out.drop("rest")


def suffix_dedup_stage(docs: DataFrame, **params) -> DataFrame:
    """The columns of ``documents`` (others are dropped), repeated passages cut from the texts; a text may end empty, its row stays."""
    out = suffix_dedup(docs, carry=("lang", "source"), **params)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))
