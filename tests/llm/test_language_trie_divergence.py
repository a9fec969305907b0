"""Language identification, the prefix trie and the divergence audit against brute force, and their defined cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm import divergence, language_id, prefix_trie
from weftgraph.llm.divergence import source_divergence
from weftgraph.llm.language_id import languages
from weftgraph.llm.prefix_trie import conversation_trie

TURNS = "conv_id long, turn long, role string, text string, d long, rep string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - c % 5
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)

    def subtree(s):
        own_saved = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
        below = [subtree(k) for k in kids[s]]
        return (sum(x[0] for x in below) or (0 if below else 1), own_saved + sum(x[1] for x in below))

    out = []
    for s, who in members.items():
        leaves, saved = subtree(s)
        ends = ",".join(map(str, sorted(c for c in who if full[c] == s)))
        out.append((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), len(kids[s]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def random_turns(seed, convs):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(4 * convs), convs):
        for t in range(rng.choice([0, 1, 3, 9, 12])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é b", None, ""]), 7, "x"))
    rows += [(None, 0, "user", "lost", 1, "x")]
    copied = [(c, t, "user", f"turn {t}" * 5, 0, "x") for c in range(1000, 1040) for t in range(4)]
    deep = [(c, t, "user", f"deep {t if t < n else (t, c)}", 0, "x") for c, n in ((2000, 70), (2005, 70), (2010, 41)) for t in range(73)]
    return rows + copied + deep


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_brute_force(spark, seed):
    rows = random_turns(seed, 60)
    got = conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(map(tuple, got)) == brute_trie(rows)


def test_trie_of_one_and_of_none(spark):
    one = [(5, 0, "user", "hello " * 50_000, 0, ""), (5, 1, None, None, 0, "")]
    for rows in (one, [(3, 2, "user", "b", 0, "")], []):
        assert sorted(map(tuple, conversation_trie(spark.createDataFrame(rows, TURNS)).collect())) == brute_trie(rows)


def test_trie_streams_ids_in_order(spark, monkeypatch):
    rows = [(i, 0, "user", "same", 0, "") for i in range(0, 2500, 5)]  # every one continues itself
    got = {(r.conv_id, r.depth): r for r in conversation_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert sorted(map(tuple, got.values())) == brute_trie(rows)
    pieces = list(prefix_trie._joined(iter([__import__("pyarrow").RecordBatch.from_arrays([[1] * 9, [2] * 9, [3] * 9, list(range(9))], ["n", "l1", "l2", "conv"])])))
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    assert len(pieces) == 1
    small = list(prefix_trie._joined(iter([__import__("pyarrow").RecordBatch.from_arrays([[1] * 9, [2] * 9, [3] * 9, list(range(9))], ["n", "l1", "l2", "conv"])])))
    digest = lambda x: [r["sha"] for b in prefix_trie._digests(iter(x)) for r in b.to_pylist()]
    assert digest(pieces) == digest(small) == [hashlib.sha256(b"0,1,2,3,4,5,6,7,8").hexdigest()]


DOCS = "doc_id long, lang string, source string, text string, term string, n long, total long"


def brute_divergence(rows, min_docs, top=50):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, count, groups = Counter(), Counter(), set()
    for _, lang, source, text, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        df.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= min_docs)
        of = sorted(s for x, s in groups if x == lang)
        total = {s: sum(count[lang, s, t] for t in kept) for s in of}
        whole, v = sum(total.values()), len(kept)
        p = {s: [1 + 10**9 * (count[lang, s, t] + 5) // (total[s] + 5 * v) for t in kept] for s in of}
        q = [1 + 10**9 * (sum(count[lang, s, t] for s in of) + 5) // (whole + 5 * v) for t in kept]
        for s in of:
            pair = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True))) for o in of if o != s]
            term = [(t, a - b) for t, a, b in zip(kept, p[s], q, strict=True) if count[lang, s, t] and a > b]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def random_docs(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "été", "Été", "x", "żółw", "日本", "don't", "naïve", "ab", "b", "É", "a1b"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 40))), "the " * 30])
        rows.append((i, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None, "z9", "s10"]), text, "clash", 3, 4))
    return rows + rows[:7] + [(1, "solo", "only", "one two", "", 0, 0), (2, "zz", "a", "12 34", "", 0, 0), (3, "zz", "b", None, "", 0, 0)]


@pytest.mark.parametrize(("block", "piece"), [(64, 1024), (2, 3)])
def test_divergence_is_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SLICE", piece)
    rows = random_docs(block, 150)
    got = source_divergence(spark.createDataFrame(rows, DOCS), min_docs=6, top=5).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, 6, 5)


def test_divergence_long_texts_and_none(spark):
    rows = [(1, "en", "a", "alpha beta " * 200_000, "", 0, 0), (2, "en", "b", "beta " * 10, "", 0, 0)]
    got = source_divergence(spark.createDataFrame(rows, DOCS), min_docs=1).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, 1)
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_where_hashes_meet(monkeypatch):
    texts, group = [b"a b a", b"b c", b"", b"a"], np.array([0, 0, 1, 1])
    want = {(0, "a"): (1, 2), (0, "b"): (2, 2), (0, "c"): (1, 1), (1, "a"): (1, 1)}
    as_dict = lambda g, t, d, n: {(int(a), b): (int(c), int(e)) for a, b, c, e in zip(g, t.to_pylist(), d, n, strict=True)}
    assert as_dict(*divergence.term_runs(texts, group)) == want
    monkeypatch.setattr(divergence, "mix", lambda x, _: x * 0)
    words = divergence.Words

    class Same(words):
        def __init__(self, *a):
            super().__init__(*a)
            self.hash = self.hash * 0

    monkeypatch.setattr(divergence, "Words", Same)
    assert as_dict(*divergence.term_runs(texts, group)) == want


def test_scan_carries_terms_over_batches():
    rows = [("en", t, s, 1, 2) for t in ("a", "b", "c") for s in ("s1", "s1", "s2", "s3", "s3", "s4")] + [("fr", "c", "s1", 9, 9)]
    pa = divergence.pa
    whole = pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=divergence._RUNS)
    for size in (1, 2, 5, 100):
        got = [tuple(r.values()) for b in divergence._kept(4)(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        want = [("en", t, s, n, 2 * n) for t in "abc" for s, n in (("s1", 2), ("s2", 1), ("s3", 2), ("s4", 1))] + [("en", t, None, 6, 12) for t in "abc"] + [("fr", "c", "s1", 9, 9), ("fr", "c", None, 9, 9)]
        assert sorted(got, key=str) == sorted(want, key=str)


SYLLABLES = {"en": "the ing ed tion er and of".split(), "fr": "eau ier qu é ch ou le".split(), "de": "sch ung ich ein der und".split(), "日": "日本 語の 文字 です".split()}
TEXTS = "doc_id long, text string, lang string, total double, best string"


def random_texts(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(2, 60))), lang, 0.5, "x") for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]]


def brute_languages(rows, top):
    """Sets instead of filters."""
    def of(text):
        word, out = "", []
        import unicodedata

        for c in (text or "").lower() + " ":
            if unicodedata.category(c)[0] in "LM":
                word += c
            elif word:
                w, word = f" {word} ", ""
                out += [w[i : i + n] for n in language_id.SIZES for i in range(len(w) - n + 1)]
        return out

    df, docs = defaultdict(Counter), Counter()
    for i, text, lang, *_ in rows:
        if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            df[lang].update(set(of(text)))
            docs[lang] += 1
    names = sorted(docs, key=lambda x: (-docs[x], x))
    known = {x: {g for g, n in df[x].items()} for x in names}
    assert all(len(k) <= top for k in known.values())
    out = {}
    for i, text, *_ in rows:
        found = [sum(g in known[x] for g in of(text)) for x in names]
        best = max(found, default=0)
        out[i] = (names[found.index(best)] if names and text and any(map(str.isalpha, text)) else "und", best, sum(found))
    return out


def test_languages_are_brute_force(spark):
    rows = random_texts(3, 300) + [(900, None, "en", 0.0, ""), (901, "12 % 34", "fr", 0.0, ""), (902, "", None, 0.0, ""), (903, "the of", None, 0.0, ""), (904, "word " * 400_000, None, 0.0, "")]
    want = brute_languages(rows, 2_000)
    got = languages(spark.createDataFrame(rows, TEXTS)).collect()
    assert len(got) == len(rows)
    right = 0
    for r in got:
        lang, best, total = want[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == lang
        assert r.score == pytest.approx(best / total if total and lang != "und" else 0, abs=1e-3)
        right += r.held_out and r.doc_id < 300 and lang == rows[r.doc_id][2]
    assert right >= 0.97 * sum(r.held_out and r.doc_id < 300 for r in got)


def test_languages_over_several_filters(spark, monkeypatch):
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    rows = [(i * 150 + k, "".join(rng.choices(letters[4 * k : 4 * k + 4], k=30)), f"l{k}", 0.0, "") for i in range(6) for k in range(150)]
    df = spark.createDataFrame(rows, TEXTS)
    one = sorted(map(tuple, languages(df).collect()))
    monkeypatch.setattr(language_id, "MASKS", 1)
    three = sorted(map(tuple, languages(df).collect()))
    assert [x[:3] for x in one] == [x[:3] for x in three]
    assert [x[3] for x in one] == pytest.approx([x[3] for x in three])
    assert all(x[2] == f"l{x[0] % 150}" for x in one)


def test_languages_without_learned_rows(spark):
    rows = [(1, "some text", None, 0.0, ""), (None, None, None, 0.0, "")]
    assert sorted((r.lang_pred, r.score) for r in languages(spark.createDataFrame(rows, TEXTS)).collect()) == [("und", 0.0), ("und", 0.0)]
    assert languages(spark.createDataFrame([], TEXTS)).count() == 0


def test_grams_of_pieces(monkeypatch):
    texts = ["Ab cde, fgh é1 x", None, "", "..", "žluťoučký kůň"]
    whole = [sorted(zip(*map(np.ndarray.tolist, language_id.grams(*p)), strict=True)) for p in language_id.pieces(texts)]
    monkeypatch.setattr(language_id, "PIECE", 10)
    cut = [x for p in language_id.pieces(texts) for x in zip(*map(np.ndarray.tolist, language_id.grams(*p)), strict=True)]
    assert len(whole) == 1
    assert whole[0] == sorted(cut)


def test_false_positives_are_taken_away():
    rng = np.random.default_rng(1)
    planes = (rng.random((1, 1 << language_id.SLOT_BITS)) < 0.5).astype(np.uint64)
    f = language_id.Filter(["x"], planes)
    gram = rng.integers(0, 1 << 44, 200_000).astype(np.uint64)
    counts = f.popcounts(np.zeros(len(gram), np.int64), gram, 1)
    assert abs(counts[0, 0] / len(gram) - 0.125) < 0.01
    assert f.corrected(counts, np.array([len(gram)]))[0, 0] < 0.01 * len(gram)
