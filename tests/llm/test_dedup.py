"""Near-duplicates and suffix dedup against brute force, with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from weftgraph.llm import near_duplicates as near
from weftgraph.llm.arrays import Words, mix
from weftgraph.llm.suffix_dedup import multikey_sort, suffix_dedup

DOCS = "doc_id long, text string, text2 string, bands string, rep long, chunk long"


def corpus(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            w[rng.randrange(len(w))] = word()
        out.append((i, rng.choice([" ", "\n", "\t "]).join(w).replace("a", "A" if i % 7 == 0 else "a")))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "é É"), (n + 6, "x" * 30_000), (n + 7, "ab" * 5_000), (3, out[3][1]), (None, out[0][1])]
    return [(i, t, "x", "y", 1, 2) for i, t in out]


def expected_components(rows, words, num, den):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low))
        sets.append((r[0], frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize(("words", "num", "den", "block"), [(3, 85, 100, None), (5, 4, 5, None), (3, 1, 2, 12)])
def test_near_duplicates(spark, monkeypatch, words, num, den, block):
    if block:  # clusters in several blocks
        monkeypatch.setattr(near, "BLOCK_DOCS", block)
    rows = corpus(words + den)
    got = near.near_duplicates(spark.createDataFrame(rows, DOCS), words=words, num=num, den=den).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_components(rows, words, num, den)


def test_near_duplicate_stage_and_empty_table(spark):
    docs = spark.createDataFrame(corpus(1), DOCS)
    kept = near.near_duplicate_stage(docs)
    want = {r[0] for r in expected_components(corpus(1), 5, 4, 5) if r[3]}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_large_sets_are_exact():
    n, shared = 395_820, 363_727  # 100 * shared >= 85 * union holds from 363,727 on
    assert 100 * shared >= 85 * (n + n - 1 - shared) and 100 * (shared - 1) < 85 * (n + n - 1 - (shared - 1))
    for k in (shared, shared - 1):
        first, second = np.arange(n - 1), np.append(np.arange(k), np.arange(10**6, 10**6 + n - k))
        doc, element = np.repeat([0, 1], [n - 1, n]), mix(np.concatenate([first, second]).astype(np.uint64))
        assert near.linked(doc, element, 2, 85, 100).tolist() == ([0, 0] if k == shared else [0, 1])


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [a[:1], a[:5], a[:300], a[60:360]]
    doc = np.repeat(np.arange(4), [len(s) for s in sets])
    s = near.sketches(doc, mix(np.concatenate(sets)), 4, 512)
    assert (s != np.uint64((1 << 64) - 1)).all()
    assert abs((s[2] == s[3]).mean() - 240 / 360) < 0.1


def test_words_follow_their_definition():
    texts = ["Ab  cd\x0be", "", "é\x85x \x1cy", "a"]
    w = Words([t.encode() for t in texts])
    assert w.counts.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    assert w.hash[0] != w.hash[1] and Words([b"zz Ab"]).hash[1] == w.hash[0]


def expected_cuts(rows, length):
    docs = [(i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, b in docs:
        if i is not None:
            for s in range(len(b) - length + 1):
                least[b[s : s + length]] = min(i, least.get(b[s : s + length], i))
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1 if i is not None else 0):
            if least[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "group", "bucket", "splitters"), [(1 << 21, 64, 150_000, 4096), (3_000, 3, 300, 4096), (2_000, 2, 200, 4)])
def test_suffix_dedup(spark, chunk, group, bucket, splitters):
    rows = corpus(chunk)
    # one passage in every chunk
    rows += [(500 + k, f"{k} " + "the very same passage, longer than fifty bytes, in every one of these texts é" + f" {k * 7}" * 9, "", "", 0, 0) for k in range(60)]
    got = suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3), chunk=chunk, group=group, bucket=bucket, splitters=splitters, carry=("text2",)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == expected_cuts(rows, 50)


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(str(rng.random()) for _ in range(40))
    long = [" ".join(str(rng.randrange(10**9)) for _ in range(600_000)) for _ in range(2)]
    rows = [(1, long[0] + passage), (2, passage), (3, long[1][:4_000_000] + passage + long[1][4_000_000:]), (4, long[0][5_000_000:] + "x"), (5, "y" + passage[:60])]
    got = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(passage)
    assert [got[k].n_removed for k in range(1, 6)] == [0, n, n, len(long[0]) - 5_000_000, 60] and got[3].kept_text == long[1] and got[4].kept_text == "x" and got[1].n_bytes > 5_000_000


@pytest.mark.parametrize("length", [33, 63])
def test_suffix_dedup_lengths(spark, length):
    rows = corpus(length)[:60]
    got = suffix_dedup(spark.createDataFrame(rows, DOCS), length=length, chunk=2_000, group=2, bucket=500).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == expected_cuts(rows, length)
    for wrong in (32, 64):
        with pytest.raises(ValueError):
            suffix_dedup(spark.createDataFrame(rows, DOCS), length=wrong)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.kept_text for r in suffix_dedup(spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()] == ["short", ""]


def test_multikey_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, (500, 24)).astype(np.uint8)
    words = data.view(">u8").astype(np.uint64)
    order, shared = multikey_sort(words)
    rows = [bytes(x) for x in data[order]]
    assert rows == sorted(rows)
    for k in range(1, len(rows)):
        assert shared[k] == next((j for j in range(24) if rows[k][j] != rows[k - 1][j]), 24)
