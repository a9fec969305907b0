"""The pipeline as a whole against a plain-Python version of its five stages."""

import collections
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(rng):
    names = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(names, k=n))
    passage, items = text(25), [(1, text(20)), (2, text(16)), (3, "one two"), (4, None)]
    docs = []
    for i in range(30):
        docs.append((f"{text(35)}\n{'Read MORE  of this here' if i % 2 else 'read more of this here'}\n{text(12)}", "host"))
    docs += [(f"read more of this here\n{text(2)}\n" * 9, "host"), (text(12), "a"), (None, "a"), ("", None), ("same words again and again now " * 20, "a")]
    base = [text(70) for _ in range(4)]
    for b in base:
        docs.append((b, "b"))
        for _ in range(3):
            w = b.split()
            w[rng.randrange(10, 60)] = rng.choice(names)
            docs.append((" ".join(w), "c"))
    docs += [(f"{text(20)} {passage} {text(rng.randint(5, 30))}", "d") for _ in range(5)]
    docs += [(f"{text(25)} {items[0][1]} {text(9)}", "e"), (f"{text(25)}. {' '.join(items[1][1].split()[8:])}, {text(30)} {' '.join(items[1][1].split()[:8])}", "e"), (f"{text(30)} {' '.join(items[0][1].split()[:7])} {text(9)}", "e")]
    rng.shuffle(docs)
    return [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(docs)], items


def base_fails(words):
    seen = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    again = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words) < 20 or 100 * len(again) > 30 * len(words)


def quality(docs):
    key = lambda line: " ".join(WORD.findall(line.lower()))
    holds, texts = collections.defaultdict(set), collections.defaultdict(set)
    for t, s in docs.values():
        texts[s].add(t or "")
        for line in (t or "").split("\n"):
            if WORD.search(line):
                holds[s, key(line)].add(t)
    hot = {k for k, v in holds.items() if len(v) > 10 and len(v) > 0.005 * len(texts[k[0]])}
    out = {}
    for i, (t, s) in docs.items():
        n = len(WORD.findall(t or ""))
        left = [line for line in (t or "").split("\n") if (s, key(line)) not in hot or not WORD.search(line)]
        if not base_fails(WORD.findall(t or "")) and n - len(WORD.findall("\n".join(left))) <= 0.7 * n:
            out[i] = ("\n".join(left), s)
    return out


def near(docs):
    sets = {}
    for i, (t, _) in docs.items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    component = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if a != b and both and 100 * both >= 80 * either and component[b] < component[a]:
                    component[a], changed = component[b], True
    return {i: x for i, x in docs.items() if component[i] == i}


def suffixes(docs):
    out, seen = {}, set()
    for i in sorted(docs):
        t = docs[i][0].encode()
        gone = {k + j for k in range(len(t) - 49) if t[k : k + 50] in seen for j in range(50)}
        out[i] = (bytes(c for k, c in enumerate(t) if k not in gone).decode(), docs[i][1])
        seen |= {t[k : k + 50] for k in range(len(t) - 49)}
    return out


def clean(docs, items):
    """Longest shared runs of free tokens first, four at least; a text that covers half of an item goes."""
    def covered(a, b):
        in_a, in_b, total = [False] * len(a), [False] * len(b), 0
        while True:
            best = (3, 0, 0)
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and not in_a[p + n] and not in_b[q + n]:
                        n += 1
                    best = max(best, (n, -p, -q))
            n, p, q = best[0], -best[1], -best[2]
            if n < 4:
                return total
            in_a[p : p + n], in_b[q : q + n], total = [True] * n, [True] * n, total + n

    tokens = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    return {i: x for i, x in docs.items() if not any(len(b) >= 4 and covered(tokens(x[0]), b) >= 0.5 * len(b) for b in (tokens(t) for _, t in items))}


def test_pipeline_is_its_plain_version(spark, tmp_path):
    rows, items = corpus(random.Random(21))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = {i: (t, s) for i, t, _, s, _ in rows}
    passed = [quality(docs)]
    for stage in (near, suffixes, lambda d: clean(d, items)):
        passed.append(stage(passed[-1]))
    counts = [len(docs), *map(len, passed)]
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] + 2  # each stage has work
    assert any(passed[2][i][0] != passed[1][i][0] for i in passed[2])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, (t, _) in passed[-1].items():
        want[i] = tokenizer.encode(t, add_special_tokens=False).ids + [1]
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    for k in {r.sequence_id for r in got}:
        parts = sorted((r.offset, r.length) for r in got if r.sequence_id == k)
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 4096
