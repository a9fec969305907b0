"""Source divergence audit: how far the word use of each source of a language lies from that of the others.

Sort-based streaming. A task sorts the words of a batch of texts by (language,
source, term, document), so each term is one run whose changes of document are its
document frequency; runs are added up within the task and sent. After
``repartition`` by (language, term) and a secondary sort by source a scan adds the
runs up again, batch by batch: it holds no more of a term than the sources seen
before its MIN_DOCS-th document and writes a kept term's sources as they pass.

A second pass over the kept runs gives the differences. Terms come from a join of
a source's counts with its language's. Pairs of sources are worked on in units
(language, two blocks of sources, slice of terms): each gives the partial sum of
every pair of its blocks, and partial sums are added up. A unit holds at most
BLOCK sources of each block on average and about SLICE terms, however many sources
or terms there are; terms that a unit's sources don't have differ by the pair's
constant and are counted, not made.

Shares are whole numbers: p = 1 + floor(10^9 (count + 5) / (N + 5 V)), by decimals
of 38 digits. A term's equality is that of its bytes: hashes that meet are checked.

Defined cases: null text, lang and source are ''; rows that repeat are documents of
their own; languages without a kept term have pairs of value 0; an empty table has
no rows; other columns are ignored. A text is one value and must fit in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.arrays import Words, as_bytes, batches, mix
from weftgraph.llm.store import released, written

MIN_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Rows that a task holds before it sends them; sources and terms of a unit of pairs.
HELD, BLOCK, SLICE = 400_000, 64, 1024

LETTERS = np.zeros(256, bool)
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    LETTERS[_a:_b] = True

_RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n_docs", pa.int64()), ("n", pa.int64())])
_RUNS_DDL = "lang string, term string, source string, n_docs long, n long"


def _slices(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the slices one after the other, their ends)."""
    end = np.cumsum(length)
    return data[np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)], end


def term_runs(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, documents, occurrences) of each group's terms; group: of each text."""
    w = Words(texts, LETTERS)
    own, length = group[w.doc], w.end - w.start
    key = w.hash ^ mix(own.astype(np.uint64), 5)
    order = np.argsort(key, kind="stable")  # texts are in order already, so documents are within a term
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = (length[order] == length[lead]) & (own[order] == own[lead])
    if not same.all() or not np.array_equal(_slices(w.data, w.start[order], length[order])[0], _slices(w.data, w.start[lead], length[lead])[0]):
        # two terms share a hash: sort by the terms themselves
        terms = [w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        order = np.array(sorted(range(len(terms)), key=lambda i: (own[i], terms[i])), np.int64)
        new = np.array([i == 0 or (own[order[i]], terms[order[i]]) != (own[order[i - 1]], terms[order[i - 1]]) for i in range(len(order))])
    start = np.flatnonzero(new)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = w.doc[order]
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    first = order[start]
    body, end = _slices(w.data, w.start[first], length[first])
    term = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, end).astype(np.int32).tobytes()), pa.py_buffer(body.tobytes()))
    return own[first], term, np.add.reduceat(fresh.astype(np.int64), start), np.diff(np.append(start, len(order)))


def _sent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of this task's texts; input lang, source, text."""
    number: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        done = pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n_docs", "sum"), ("n", "sum")])
        return pa.table({"g": done["g"], "term": done["term"], "n_docs": done["n_docs_sum"], "n": done["n_sum"]})

    def sent(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = list(number)
        g = t["g"].to_numpy()
        lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        out = pa.table({"lang": lang.take(pa.array(g)), "term": t["term"], "source": source.take(pa.array(g)), "n_docs": t["n_docs"], "n": t["n"]}, _RUNS)
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    for part in parts:
        group = np.array([number.setdefault(x, len(number)) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
        at = 0
        for texts in batches((as_bytes(x, "ascii") for x in part.column(2).to_pylist()), lambda x: len(x) + 1):
            g, term, n_docs, n = term_runs(texts, group[at : at + len(texts)])
            at += len(texts)
            held.append(pa.table({"g": g, "term": term, "n_docs": n_docs, "n": n}))
            rows += len(g)
            if rows > HELD:
                held = [merged()]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from sent(held[0])
                    held, rows = [], 0
    if held:
        yield from sent(merged())


def _changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """Rows at which one of the columns differs from the row before."""
    out = np.zeros(len(t), bool)
    out[:1] = True
    for c in names:
        if len(t) > 1:
            out[1:] |= pc.not_equal(t[c].slice(1), t[c].slice(0, len(t) - 1)).to_numpy()
    return out


def _kept(min_docs: int):
    """Scans rows sorted by (lang, term, source): a row per source of each term in ``min_docs`` documents or more, and one of source null for the whole language."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, passed = _RUNS.empty_table(), np.zeros(2, np.int64)  # the open term: its runs that are held, and (documents, occurrences) of those that were written

        def scan(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal left, passed
            start = np.flatnonzero(_changes(t, ["lang", "term", "source"]))
            counts = np.add.reduceat(np.column_stack([t["n_docs"].to_numpy(), t["n"].to_numpy()]), start, axis=0)
            t = t.take(pa.array(start))
            head = np.flatnonzero(_changes(t, ["lang", "term"]))
            total = np.add.reduceat(counts, head, axis=0)
            total[0] += passed
            ends = np.append(head[1:], len(t))
            enough = total[:, 0] >= min_docs
            write = np.repeat(enough, ends - head)
            closed = len(head) if last else len(head) - 1
            if not last:
                # of the open term the last source may go on; the others pass if it is kept
                keep = len(t) - 1 if enough[-1] else head[-1]
                write[keep:] = False
                if closed:
                    passed = np.zeros(2, np.int64)
                passed = passed + counts[head[-1] : keep].sum(0)
                left = pa.table({**{c: t[c].slice(keep) for c in ("lang", "term", "source")}, "n_docs": counts[keep:, 0], "n": counts[keep:, 1]}, _RUNS)
            whole = np.flatnonzero(enough[:closed])
            runs, at = pa.array(np.flatnonzero(write)), pa.array(head[whole])
            for rows, source, n in ((runs, t["source"].take(runs), counts[write]), (at, pa.nulls(len(whole), pa.string()), total[whole])):
                out = pa.table({"lang": t["lang"].take(rows), "term": t["term"].take(rows), "source": source, "n_docs": n[:, 0], "n": n[:, 1]}, _RUNS)
                yield from out.combine_chunks().to_batches()

        for part in parts:
            if part.num_rows:
                yield from scan(pa.concat_tables([left, pa.Table.from_batches([part.cast(_RUNS)])]), False)
        if len(left):
            yield from scan(left, True)

    return run


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n_docs, n) of the kept terms; source null: of the whole language. ``docs``: lang, source, text, none null."""
    sent = docs.select("lang", "source", "text").mapInArrow(_sent, _RUNS_DDL)
    return written(sent.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_kept(min_docs), _RUNS_DDL))


def _share(count: Column, total: str) -> Column:
    """p of a count where the kept terms are V and their occurrences ``total``; 0 without kept terms."""
    whole = lambda x: x.cast("decimal(38,0)")
    scaled = whole(whole(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"))
    return F.when(F.col("v") > 0, 1 + F.call_function("div", scaled, whole(F.col(total) + SMOOTH * F.col("v")))).otherwise(F.lit(0).cast("long"))


def _partial_pairs(key: tuple, runs: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of the pairs of a unit's sources: over its terms, and in slice 0 over all others too."""
    lang, a, b, piece = key
    groups = groups.sort_values("source", ignore_index=True)
    base, block, v = groups["base"].to_numpy(), groups["block"].to_numpy(), int(groups["v"].iloc[0]) if len(groups) else 0
    column = pd.Series(np.arange(len(groups)), groups["source"])
    row, terms = pd.factorize(runs["term"])
    p = np.tile(base, (len(terms), 1))
    if len(runs):
        p[row, column[runs["source"]].to_numpy()] = runs["p"].to_numpy()
    first, second, values = [], [], []
    for i in range(len(groups)):
        others = np.flatnonzero(((block == b) & (np.arange(len(groups)) > i)) if a == b else (block == b) & (block[i] == a))
        apart = np.abs(base[others] - base[i])
        first += [i] * len(others)
        second += others.tolist()
        values.append(np.abs(p[:, others] - p[:, [i]]).sum(0) - len(terms) * apart + (v * apart if piece == 0 else 0))
    name = groups["source"].to_numpy(object)
    value = np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": np.full(len(value), lang, object), "source": name[first], "item": name[second], "value": value})


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source how far every other source is, and the ``top`` terms it uses more than its language."""
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = term_counts(clean, min_docs)
    released(docs.sparkSession)
    whole = kept.where("source is null").select("lang", "term", F.col("n").alias("n_lang"))
    runs = kept.where("source is not null")
    langs = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    sums = runs.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = clean.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    # blocks of a language's sources, and slices of its terms
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    groups = written(groups.join(sizes, "lang").select("*", F.greatest(F.lit(1), F.ceil(F.col("v") / SLICE)).alias("slices"), F.pmod(F.xxhash64("source"), "blocks").alias("block"), _share(F.lit(0), "total").alias("base")))
    shares = runs.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), "total"))

    units = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = lambda rows: rows.withColumn("other", units).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    left = placed(shares).select("lang", "a", "b", F.pmod(F.xxhash64("term"), "slices").alias("slice"), "term", "source", "p")
    right = placed(groups).select("lang", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "source", "block", "base", "v")
    unit = ["lang", "a", "b", "slice"]
    partial = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(_partial_pairs, "lang string, source string, item string, value long")
    pair = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = pair.unionByName(pair.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    q = shares.join(whole, ["lang", "term"]).withColumn("q", _share(F.col("n_lang"), "total_lang")).where("p > q")
    term = q.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    return ranked(pair, "pair").unionByName(ranked(term, "term").where(F.col("rank") <= top))
