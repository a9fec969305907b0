"""Quality rules, decontamination, packing, chat formatting and the licence scan against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, licenses
from weftgraph.llm.chat import chat_digests, format_chats, format_turns, parse, unescape
from weftgraph.llm.decontaminate import contaminated, decontaminate_stage, tiles
from weftgraph.llm.packing import CAPACITY, WordIds, pack_documents, pack_lengths
from weftgraph.llm.quality_rules import judged, quality_stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def metrics(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n


def test_quality_rules(spark):
    rng = random.Random(4)
    some = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(some) for _ in range(n))
    rows = [(k, f"{text(30)}\n{'Cookie   notice, all RIGHTS' if k % 2 else 'cookie notice, all rights'} reserved\n{text(9)}", "hot") for k in range(60)]
    rows += [(100, None, "a"), (101, "", None), (102, "x\ny\n\n x\ny", "a"), (103, "# $ | é <b> " * 12, "a"), (104, " ".join(["a b c d e f g h"] * 9), "a"), (105, text(25) + " " + " ".join(some[:9]) + " q " + " ".join(some[:9]), None), (106, "\x0b\x1c\x85 " * 30, "a"), (0, rows[0][1], "hot"), (None, text(40), "a")]
    rows += [(200 + k, "cookie notice, all rights reserved\n" * 3 + text(3), "hot") for k in range(3)]
    docs = spark.createDataFrame([(i, t, s, "en", 1, 7) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long, n_words long").drop("n_words")
    got = judged(docs).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
    for i, t, _ in rows:
        for r in of[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == metrics(t), (i, t)
    assert all(r.n_lost_words == 5 and r.kept and "ookie" not in r.clean_text for i in range(60) for r in of[i])
    assert all(of[200 + k][0].base_failed is True for k in range(3)) and of[105][0].n_lost_words == 0
    stage = quality_stage(docs)
    assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in stage.collect()} == {r.doc_id for r in got if r.kept}
    assert judged(docs.limit(0)).count() == 0


def test_quality_rejects_depleted(spark):
    rows = [(k, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen\n" + " ".join(f"{k}{j}" for j in range(60 if k else 5)), "h") for k in range(40)]
    got = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept is False and got[0].n_lost_words == 16 and not got[0].base_failed and got[1].kept is True


def plain_tiles(doc, item, least):
    in_doc, in_item, out = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not in_doc[p + n] and not in_item[q + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((p, q))
        if best < least:
            return out
        for p, q in found:
            if not any(in_doc[p : p + best]) and not any(in_item[q : q + best]):
                in_doc[p : p + best], in_item[q : q + best] = [True] * best, [True] * best
                out.append((p, q, best))


def test_tiles():
    rng = np.random.default_rng(3)
    for k in range(60):
        d, t = (rng.integers(0, 3, n).astype(np.uint64) for n in (int(rng.integers(0, 40)), int(rng.integers(0, 20))))
        assert tiles(d, t, 3) == plain_tiles(d.tolist(), t.tolist(), 3), k


def test_decontamination(spark):
    words = [f"tok{k}" for k in range(400)]
    item = words[:30]
    rows = [(1, " ".join(words[100:150] + item + words[150:160])), (2, " ".join(words[100:110] + item[15:] + ["x"] + item[:15])), (3, ", ".join(item).upper() + "!!"), (4, " ".join(item[:12])), (5, " ".join(words[200:300])), (6, None), (7, ""), (1, " ".join(item)), (None, " ".join(item)), (8, " ".join(words[300:390] * 300 + item))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (13, " ".join(words[350:352] + ["zz"] * 9))], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.matched_tokens, r.n_tiles, r.coverage) for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 10, 30, 1, 1.0), (2, 10, 30, 2, 1.0), (3, 10, 30, 1, 1.0), (1, 10, 30, 1, 1.0), (None, 10, 30, 1, 1.0), (8, 10, 30, 1, 1.0)], key=str)
    left = decontaminate_stage(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {4, 5, 6, 7}
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_without_spaces(spark):
    """Scripts without spaces are matched by the character, and punctuation of any script parts words."""
    item = "\u5317\u4eac\u7684\u79cb\u5929\u5929\u6c14\u51c9\u723d\uff0c\u5f88\u9002\u5408\u51fa\u53bb\u8d70\u8d70\u3002"
    thai = "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e0a\u0e32\u0e27\u0e42\u0e25\u0e01"
    docs = spark.createDataFrame([(1, "\u6628\u5929\u6211\u8bf4" + item + "\u4f60\u5462"), (2, item[9:] + item[:9]), (3, "\u660e\u5929\u4f1a\u4e0b\u5927\u96e8"), (4, "x" + thai + "y"), (5, "\u00abIl \u00e9tait\u2014une fois\u00bb"), (6, "il \u00e9tait une fin")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, thai), (3, "il \u00e9tait une fois")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in contaminated(docs, bench).collect()) == [(1, 1, 1.0), (2, 1, 1.0), (4, 2, 1.0), (5, 3, 1.0)]
    assert {r.doc_id for r in decontaminate_stage(docs, bench).collect()} == {3, 6}


@pytest.mark.parametrize("item", ["ព្រះរាជាណាចក្រកម្ពុជា ជាប្រទេសមួយ។", "မြန်မာနိုင်ငံသည်အရှေ့တောင်အာရှတွင်ရှိသည်။", "ສາທາລະນະລັດປະຊາທິປະໄຕປະຊາຊົນລາວ", "བོད་ཀྱི་སྐད་ཡིག་ནི་བོད་རིགས་ཀྱི་སྐད་ཡིག་ཡིན།", "ꦲꦏ꧀ꦱꦫꦗꦮ", "ꀊꆈꌠꁱꂷꀋꉬ"])
def test_decontamination_of_further_scripts(spark, item):
    """An item that stands verbatim within a sentence without spaces is found, as is one cut in two; half of it isn't."""
    around = item[3] + item[1]
    n = len(item)
    docs = spark.createDataFrame([(1, around + item + around), (2, item[n // 2 :] + "x" + item[: n // 2]), (3, item[: n // 4]), (4, "x " * 40)], "doc_id long, text string")
    assert {r.doc_id for r in contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()} == {1, 2}


def test_seeds_and_threshold_against_brute_force(monkeypatch):
    """Whole matches(): every pair of texts and items, from the definition alone; with few pairs held at once."""
    rng = random.Random(7)
    for expanded in (4_000_000, 10):
        monkeypatch.setattr(decontaminate, "EXPANDED", expanded)
        items = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))) for k in range(12)]
        texts = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 20, 60]))) for _ in range(15)] + ["", items[3][1] + " x " + items[5][1]]
        got = decontaminate.Items(items, 4).matches([t.encode() for t in texts], 0.6)
        want = []
        for t, text in enumerate(texts):
            for i, (_, item) in enumerate(items):
                found = plain_tiles(text.split(), item.split(), 4)
                matched, m = sum(x[2] for x in found), len(item.split())
                if m >= 4 and matched >= 0.6 * m:
                    want.append((t, i, m, matched, len(found)))
        assert sorted(got) == want and len(want) > 5


def test_word_ids_equal_the_tokenizers():
    texts = ["", "  ", "don't I'm we'll 've's ŒUVRE Σίσυφος ΟΔΟΣ İstanbul ǅ ª º", "<|endoftext|> a<|startoftext|>b </w> x_y 12ab3 é Ａ \x1c\x1d a\x85b", "a...b ,, 'tis (hello) \"q\" **bold** don't. 1,000.50 naïve—dash …", "日本語 mix한국 ٣٤ ½ ²"]
    w = WordIds(TOKENIZER)
    ids, n = w.encode([t.encode() for t in texts])
    want = [w.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta,", "Gamma", "δ", "x1!"]) for _ in range(rng.choice([0, 3, 40, 700, 2500, 9000]))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(3, texts[3], 5), (None, "null id", 5)], "doc_id long, text string, length int")
    got = pack_documents(docs, TOKENIZER).collect()
    w = WordIds(TOKENIZER)
    ids = {k: np.array(w.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for k, t in [*enumerate(texts), (None, "null id")]}
    total, bins = collections.Counter(), collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), r.start, zlib.crc32(part.tobytes())) == (r.length, r.piece * CAPACITY, r.ids_crc32)
        total[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert total == {k: len(v) * (2 if k == 3 else 1) for k, v in ids.items()}
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= CAPACITY
    assert len(bins) <= math.ceil(sum(total.values()) / CAPACITY) + 2
    assert pack_documents(docs.limit(0), TOKENIZER).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_pack_lengths(lengths):
    counts = np.bincount(lengths, minlength=51) if lengths else np.zeros(51, int)
    bins = pack_lengths(counts, 50)
    used = collections.Counter(x for copies, b in bins for x in b for _ in range(copies))
    assert used == collections.Counter(lengths) and all(sum(b) <= 50 for _, b in bins)
    # bin by bin, in plain Python: greedily the largest, then a pair for the smallest as long as that fits more tightly
    left, want = sorted(lengths), []
    while left:
        bin_ = []
        for x in left[::-1]:
            if sum(bin_) + x <= 50:
                bin_.append(x)
                left.remove(x)
        while sum(bin_) < 50 and len(bin_) > 1:
            small, room = min(bin_), 50 - sum(bin_) + min(bin_)
            pairs = [(a + b, -a, b) for i, b in enumerate(left) for a in left[i + 1 :] if small < a + b <= room]
            if not pairs:
                break
            _, a, b = max(pairs)
            bin_.remove(small)
            left.append(small)
            for x in (-a, b):
                left.remove(x)
                bin_.append(x)
            left.sort()
        want.append(sorted(bin_))
    assert sorted(want) == sorted(sorted(b) for copies, b in bins for _ in range(copies))


def test_two_documents_replace_one():
    counts = np.bincount([30, 12, 9, 9], minlength=51)
    assert [(n, sorted(b)) for n, b in pack_lengths(counts, 50)] == [(1, [9, 9, 30]), (1, [12])]
    counts = np.bincount([30, 12, 9, 9] * 3, minlength=51)
    assert sorted((n, sorted(b)) for n, b in pack_lengths(counts, 50))[-1] == (3, [9, 9, 30])


PIECES = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", " ", "ok", "[ROLE=x]", "[/ROLE]", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool [x]"]), PIECES), PIECES), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = format_turns(turns)
    assert parse(formatted) == turns
    assert "".join(unescape(formatted[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_chats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (1, 1, "assistant", "b")]
    got = {r.conv_id: r for r in chat_digests(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].formatted_chars, got[2].n_turns, got[None].n_turns) == (3, 2, len("[INST] a [/INST]") + 2 * len("<s> b </s>"), 1, 1)
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.txt", "hello world"), (3, "a/b/LICENSE.md", "Released under the MIT License.\nCopyright"), (4, "z/q.txt", None), (5, None, "x\nReleased under the MIT License."),
        (6, "a/b/d/e/f.txt", "licensed work"), (7, "ab/x.txt", ""), (8, "a/z.txt", "This work is licensed under the GNU General Public License, version 3."), (8, "a/z.txt", "This work is licensed under the GNU General Public License, version 3."), (9, "LICENSE.x/y", "MIT License"),
    ]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, path string, text string, license string, other double")
    got = {r.doc_id: (r.license, r.basis) for r in licenses.license_scan(docs).collect()}
    assert got == {1: ("Apache-2.0", "licence file"), 2: ("MIT", "inherited"), 3: ("MIT", "licence file"), 4: (None, None), 5: ("MIT", "header"), 6: ("MIT", "inherited"), 7: (None, None), 8: ("GPL-3.0", "header"), 9: (None, None)}
    assert licenses.license_scan(docs.limit(0)).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GNU = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
import os
"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
"""


def test_wrapped_licenses_and_full_texts(spark):
    rows = [(1, "m/LICENSE", MIT_TEXT), (2, "m/src/a.py", "import os"), (3, "g/a.py", GNU.format("", 3)), (4, "g/b.py", GNU.format("Affero ", 3)), (5, "g/c.py", GNU.format("", 2)), (6, "b/a.c", BSD), (7, "t/LICENSE", "MIT License"), (8, "t/x/y.c", "int x;"), (9, "s/a.c", "// SPDX-License-Identifier: MIT\nint x;"),
            (10, "l/COPYING", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright"), (11, "n/a.txt", "a text of\nlicensed software"), (12, "m2/a.py", MIT_TEXT)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.basis) for r in licenses.license_scan(docs).collect()}
    assert got == {1: ("MIT", "licence file"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "header"), 4: ("AGPL-3.0", "header"), 5: ("GPL-2.0", "header"), 6: ("BSD-3-Clause", "header"), 7: ("MIT", "licence file"), 8: ("MIT", "inherited"), 9: ("MIT", "header"), 10: ("LGPL-3.0", "licence file"), 11: (None, None), 12: ("MIT", "header")}


def best_units(rows, n_files, df):
    """The operator's definition, in plain Python: row -> (s, line_no, license, span)."""
    weights = licenses.Weights(n_files, df)
    found = {}
    for at, (_, path, text) in enumerate(rows):
        is_file = bool(re.search(licenses.LICENCE_FILE, path or ""))
        lines = [(k, re.findall("[a-z0-9]+", x.lower())) for k, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        most = licenses.TITLE if is_file else licenses.NOTICE
        first = [(k, 1, t, most) for k, t in lines] + ([(-1, 1, sum((t for _, t in lines), []), licenses.TEXT)] if is_file else [])
        runs = [(lines[a][0], s, sum((t for _, t in lines[a : a + s]), []), most) for a in range(len(lines)) for s in range(2, licenses.WINDOW + 1) if a + s <= len(lines)]
        for units in (first, [u for u in runs if len(u[2]) <= licenses.longest_run()]):
            hits = []
            for line_no, span, terms, kinds in units:
                v = {t: c * weights.idf.get(t, weights.other) for t, c in collections.Counter(terms).items()}
                norm = math.sqrt(sum(x * x for x in v.values())) or 1
                for kind, name, ws in weights.vectors:
                    score = round(sum(x * ws.get(t, 0) for t, x in v.items()) / norm, 6)
                    if kind <= kinds and score >= licenses.THRESHOLD:
                        hits.append((-score, line_no, name, span))
            if hits:
                found[at] = min(hits)
                break
    return found


def test_license_cosines(spark):
    rng = random.Random(1)
    terms = sorted({t for _, _, c in licenses.template_terms() for t in c})[:60] + ["foo", "bar"]
    rows = []
    for k in range(120):
        words = rng.choice(licenses.ALL)[2].split()
        cut = rng.randint(1, max(1, min(40, len(words))))
        body = [*words[:cut], *rng.choices(terms, k=rng.randint(0, 3))]
        width = rng.choice([4, 7, 50])
        rows.append((k, rng.choice(["a/LICENSE", "a/b.txt"]), "\n".join(["foo bar"] * rng.randint(0, 2) + [" ".join(body[i : i + width]) for i in range(0, len(body), width)])))
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    n, df = licenses.document_frequencies(docs, "text")
    assert n == 120
    want = best_units(rows, n, df)
    own = licenses.own_license(F.col("path"), F.col("text"), licenses.Weights(n, df))
    got = {r.doc_id: r.o for r in docs.select("doc_id", own.alias("o")).collect() if r.o}
    assert got.keys() == want.keys() and len(got) > 20 and any(x.span > 1 for x in got.values()) and any(x.line_no == -1 for x in got.values())
    for i, x in got.items():
        assert (x.line_no, x.license, x.span) == want[i][1:] and x.s == pytest.approx(want[i][0], abs=2e-6)


def test_license_rows_are_judged_alone(spark):
    rows = [(None, "a.txt", "Released under the MIT License."), (1, "b.txt", "hello"), (1, "c.txt", "Released under the MIT License."), (2, "d.txt", "word " * 200_000 + "\nLicensed under CC BY 4.0."), (3, None, None)]
    got = {(r.doc_id, r.path): r.license for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {(None, "a.txt"): "MIT", (1, "b.txt"): None, (1, "c.txt"): "MIT", (2, "d.txt"): "CC-BY-4.0", (3, None): None}
