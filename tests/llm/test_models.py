"""The three models: held-out accuracy, exact look-ups, defined cases; and the pipeline as a whole."""

import collections
import pathlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import lm_scoring as lm
from weftgraph.llm import quality_classifier, toxicity
from weftgraph.llm.arrays import LETTER_DIGIT, Words
from weftgraph.llm.labelled import training_rows
from weftgraph.llm.quality_classifier import quality_scores
from weftgraph.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.01"


def _accuracy(spark, scores, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in held) / len(held)


def test_quality_accuracy(spark):
    assert _accuracy(spark, quality_scores, "quality") >= 0.95


def test_toxicity_recall_and_precision(spark):
    """On held-out rows at the contract's 0.5, always saying no would give a recall of 0."""
    for sf, least in ((SF, 0.6), ("/root/testdata/sf0.1", 0.9)):
        labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        got = toxicity_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
        assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
        hit = sum(p == y == 1 for p, y in held)
        assert hit >= least * sum(y for _, y in held), sf
        assert hit >= least * sum(p for p, _ in held), sf


def plain_models(texts, toxic, discount):
    """Both classes' P(word), in plain Python from the definition; a word's stem is its first STEM letters."""
    stem = lambda w: w[: toxicity.STEM]
    words = sorted({w for t in texts for w in t})
    count = [collections.Counter(w for t, y in zip(texts, toxic, strict=True) if y == k for w in set(t)) for k in (0, 1)]
    stems = [collections.Counter(x for t, y in zip(texts, toxic, strict=True) if y == k for x in {stem(w) for w in t}) for k in (0, 1)]
    both = {w: count[0][w] + count[1][w] + 0.5 for w in words}
    both = {w: n / sum(both.values()) for w, n in both.items()}
    of_stem = collections.Counter()
    for w in words:
        of_stem[stem(w)] += both[w]

    def discounted(counts):
        own = [{x: max(n - discount, 0) / sum(c.values()) for x, n in c.items()} for c in counts]
        kept = min(sum(x.values()) for x in own)
        return [{x: v * kept / (sum(o.values()) or 1) for x, v in o.items()} for o in own], 1 - kept

    s, left = discounted(stems)
    back = [{x: s[k].get(x, 0) + left * of_stem[x] for x in of_stem} for k in (0, 1)]
    s, left = discounted(count)
    return [{w: s[k].get(w, 0) + left * back[k][stem(w)] * both[w] / of_stem[stem(w)] for w in words} for k in (0, 1)], back


@pytest.mark.parametrize("discount", [0.75, 1.0, 3.0])
def test_class_models_are_proper_and_follow_their_definition(discount):
    rng = np.random.default_rng(int(4 * discount))
    names = [a + b for a in ("grüße", "hello", "hél", "x") for b in ("", "n", "nde", "ß")]
    texts = [[str(x) for x in rng.choice(names, rng.integers(0, 12))] for _ in range(60)]
    toxic = rng.integers(0, 2, 60)
    text = toxicity.Text.of([" ".join(t).encode() for t in texts])
    model = toxicity.Model(text, toxic, discount)
    p, back = plain_models(texts, toxic, discount)
    assert all(sum(q.values()) == pytest.approx(1) and sum(b.values()) == pytest.approx(1) for q, b in zip(p, back, strict=True))
    assert all(q.sum() == pytest.approx(1) for q in (*model.word_p, *model.stem_p))
    diff = model.differences(text)
    assert diff == pytest.approx([np.log(p[1][w] / p[0][w]) for t in texts for w in t], abs=1e-9)
    # a new form of a stem that was seen speaks as the stem does, a new stem not at all
    new = model.differences(toxicity.Text.of(["grüßezzz andere".encode()]))
    assert new == pytest.approx([np.log(back[1]["grüße"] / back[0]["grüße"]), 0], abs=1e-9)
    got = model.evidence(text)
    for k, (s, n) in enumerate(zip(text.first, text.counts, strict=True)):
        part = diff[s : s + n]
        assert got[k, 0] == pytest.approx(part.mean() if n else 0, abs=1e-9)
        for j, run in enumerate(toxicity.RUNS):
            want = max((part[i : i + run].mean() for i in range(max(1, n - run + 1))), default=0) if n else 0
            assert got[k, j + 1] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_defined_cases(spark, scores):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "x y", 3), (1, "a " * 50_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = scores(docs, some).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert scores(docs.limit(0), labels).count() == 0


def test_training_rows_are_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(k, "x" * 10) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    got = training_rows(docs, labels, "quality", 20, 150).collect()
    assert len(got) == 30 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_training_rows_pass_over_what_does_not_fit(spark):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    known = [(k, 1) for k in ids] + [(k, 1) for k in range(1000, 1400)]  # the latter have no document
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    for long in ids[:6]:
        docs = spark.createDataFrame([(k, "x" * (10 * len(ids) if k == long else 10)) for k in ids], "doc_id long, text string")
        assert {r.doc_id for r in training_rows(docs, labels, "quality", 60, 10 * len(ids) - 1).collect()} == {*ids} - {long}
        if long == ids[0]:
            assert training_rows(docs, labels, "quality", 20, 10 * len(ids) - 1).count() == 20


def test_documented_bounds_are_the_codes():
    said = re.sub(r"\s+", " ", (pathlib.Path(__file__).parents[2] / "README.md").read_text())
    q, t = quality_classifier, toxicity
    assert f"at most {q.PER_CLASS:,} (quality) and {t.PER_CLASS:,} (toxicity) rows of each class and {q.MAX_CHARS:,} and {t.MAX_CHARS:,} characters" in said


def test_training_rows_of_a_repeated_id(spark):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    hot = ids[0]
    labels = spark.createDataFrame([(k, 0) for k in ids], "doc_id long, toxic int")
    docs = spark.createDataFrame([(hot, f"text {k % 500}") for k in range(2000)] + [(k, "other") for k in ids[1:]] * 2, "doc_id long, text string")
    got = training_rows(docs, labels, "toxic", len(ids) + 10, 10_000).collect()
    assert {r.doc_id for r in got} == {*ids} and len(got) == len({*got}) == len(ids) + 10
    assert {r.doc_id for r in training_rows(docs, labels, "toxic", 10, 10_000).collect()} <= {*ids}
    few = training_rows(docs, labels, "toxic", 10, 10_000).collect()
    assert len(few) == len({r.doc_id for r in few}) == 10


def test_lm_gradient():
    rng = np.random.default_rng(2)
    net = lm.Network(rng.integers(0, 50, lm.GROUPS * lm.MEMBERS), kind=np.float64)
    net.flat += rng.normal(0, 0.1, len(net.flat))
    window, target = rng.integers(0, lm.EDGE + 1, (30, 2 * lm.SIDE)), rng.integers(0, lm.RARE + 1, 30)
    g = {}
    net.forward(window, target, g)
    rows = g.pop("rows")
    for k, x in g.items():
        full = np.zeros_like(net.part[k])
        full[rows if k == "word" else slice(None)] = x
        for at in rng.choice(np.flatnonzero(full), 5):
            cell = net.part[k].reshape(-1)
            old, ends = cell[at], []
            for shift in (1e-5, -1e-5):
                cell[at] = old + shift
                ends.append(-net.forward(window, target).mean())
            cell[at] = old
            assert full.ravel()[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-9), k
    every = np.arange(lm.RARE + 1)
    assert np.exp(net.forward(np.repeat(window[:1], len(every), 0), every)).sum() == pytest.approx(1)


def _lm_parts(docs):
    chunks = lm.sharded(docs, "doc_id", "text")
    known, index, outputs = lm.vocabulary_of(lm.word_counts(chunks))
    return chunks, known, index, outputs


def test_lm_scores(spark):
    """Every score is the sum of the trained network's log-probabilities, told in plain Python from each text alone."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(list("abcdefghijklmnopq"), int(rng.integers(1, 30))))) for k in range(40)]
    rows += [(50, "The cat, the mat"), (51, "the cat the mat"), (52, None), (53, ""), (54, "zebra"), (None, "a b c"), (7, rows[7][1]), (55, "a long text " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, log_prob double")
    got = sorted((tuple(r) for r in lm.lm_scores(docs.repartition(3)).collect()), key=str)
    chunks, known, index, outputs = _lm_parts(docs)
    net = lm.Network(outputs, lm.trained(chunks, known, index, outputs))
    words = [re.findall("[a-z]+", (t or "").lower()) for _, t in rows]
    count, frequent = collections.Counter(w for x in words for w in x), set(known.tolist())
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        t = lm.Texts([" ".join(w).encode()], known, index)
        total = float(net.forward(t.windows(), t.target).sum()) if w else 0.0
        total += sum(np.log((count[x] - w.count(x) + 1) / (outputs[lm.RARE] + 1)) for x, h in zip(w, t.words.hash.tolist(), strict=True) if h not in frequent)
        want.append((i, len(w), total, total / len(w) if w else None))
    for g, x in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == x[:2] and g[2] == pytest.approx(x[2], rel=1e-4, abs=1e-3) and (g[3] is None) == (x[3] is None)
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_lm_rare_words():
    """Words without an output: which they are, where, and how often in their own text."""
    known = np.sort(Words([b"a b"], LETTER_DIGIT).hash)
    t = lm.Texts([b"x a x y", b"", b"y b z y x"], known, np.arange(2))
    words, at, of, own = t.rare()
    assert len(words) == 3 and at.tolist() == [0, 2, 3, 4, 6, 7, 8]
    assert words[of].tolist() == t.words.hash[at].tolist() and own.tolist() == [2, 2, 1, 2, 1, 2, 1]


def test_lm_texts_are_read_once(spark, monkeypatch):
    """Chunks hold words and not texts: corpus counts need the different words only, the rest comes from their codes."""
    monkeypatch.setattr(lm, "SHARD", 1 << 9)
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(rng.choice(["Éa", "b", "c1", "dd", "e"], int(rng.integers(0, 40))))) for k in range(60)] + [(60, None), (61, "  ")]
    chunks = lm.sharded(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    want = collections.Counter(h for _, t in rows for h in Words([(t or "").lower().encode()], LETTER_DIGIT).hash.tolist())
    assert {r.word & (1 << 64) - 1: r.n for r in lm.word_counts(chunks.select("words", "counts")).collect()} == want
    texts, got = dict(rows), chunks.collect()
    assert len(got) > 3 and sorted(i for r in got for i in r.ids) == sorted(texts)
    for r in got:
        coded, w = lm._coded(r.lengths, r.words, r.body), Words([(texts[i] or "").lower().encode() for i in r.ids], LETTER_DIGIT)
        assert coded.hash.tolist() == w.hash.tolist() and coded.doc.tolist() == w.doc.tolist()


def test_lm_averages(spark, monkeypatch):
    """A round's network is the mean of its shards' networks by their numbers of words, told here one shard after another."""
    monkeypatch.setattr(lm, "SHARD", 1 << 14)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    chunks, known, index, outputs = _lm_parts(docs)
    state, shards = lm.Trainer(outputs).state(), chunks.collect()
    assert len(shards) > 2 * lm.ROUNDS
    for k in range(lm.ROUNDS):
        states, seen = [], []
        for r in shards:
            if (r.chunk >> 20) % lm.ROUNDS == k:
                t, trainer = lm.Texts(lm._coded(r.lengths, r.words, r.body), known, index), lm.Trainer(outputs, state)
                cut = np.linspace(0, len(t.target), max(1, round(len(t.target) / lm.STEP)) + 1).astype(int)
                for a, b in zip(cut, cut[1:]):
                    trainer.step(t.windows()[a:b], t.target[a:b])
                states.append(trainer.state())
                seen.append(len(t.target))
        state = np.average(states, axis=0, weights=seen)
    assert np.abs(lm.trained(chunks.repartition(5), known, index, outputs) - state[: len(state) // 2]).max() < 1e-4


def test_lm_partitionings_agree(spark, monkeypatch):
    """However rows are dealt, shards and the network's averages are the same; one pair of neighbours is in every text."""
    monkeypatch.setattr(lm, "SHARD", 1 << 17)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.concat(F.lit("the the "), "text"))
    one, two = ({r.doc_id: r.mean_log_prob for r in lm.lm_scores(docs.repartition(n)).collect()} for n in (2, 17))
    assert one.keys() == two.keys() and lm.sharded(docs, "doc_id", "text").count() > 8
    assert max(abs(one[k] - two[k]) for k in one if one[k] is not None) < 1e-6


def test_lm_network_learns(spark):
    """Held-out texts of a language in which a word follows from its neighbours: far better than by word frequency."""
    rng = np.random.default_rng(1)
    names = [f"w{k}" for k in range(60)]

    def text():
        k, out = int(rng.integers(60)), []
        for _ in range(80):
            out.append(names[k])
            k = (k + int(rng.choice([1, 7]))) % 60
        return " ".join(out)

    docs = spark.createDataFrame([(k, text()) for k in range(12_000)], "doc_id long, text string")
    chunks, known, index, outputs = _lm_parts(docs)
    flat = lm.trained(chunks, known, index, outputs)
    held = lm.Texts([text().encode() for _ in range(50)], known, index)
    net, unigram = lm.Network(outputs, flat), np.log(np.maximum(outputs, 1) / outputs.sum())[held.target].mean()
    assert net.forward(held.windows(), held.target).mean() > unigram + 1.0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert docs.count() == corpus_pipeline.run(spark, sf).count()
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
