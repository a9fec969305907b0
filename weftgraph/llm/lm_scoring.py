"""Document scores by masked pseudo-likelihood.

Every word is masked in turn and predicted from both of its sides. A network
reads a window of SIDE words on each side (shared embeddings, weighted by place,
a hidden layer) and predicts the word by a two-level softmax over the most
frequent words; the last output stands for all others, among which a word has its
share of what the corpus has of them, without the document's own. The sum of the
words' log-probabilities scores a document.

The network is trained in numpy on every word of every text, once. Documents are
dealt by a hash to shards of about SHARD bytes, which follows from the rows alone and
not from how they are partitioned. ROUNDS groups of shards take turns: each shard of
a group goes on from the network so far by Adagrad, and the shards' networks (and
their squares) are averaged by their numbers of words, cell by cell.

Texts are read for words once: a shard is kept as its different words, by hash, and
for each word its place among them. Networks are averaged by blocks of cells.

What is looked up is the corpus's count of each rare word: a table of words, which
grows with the corpus. A shard asks once for each of its different rare words; a
rare word isn't among the OUTPUTS most frequent, and adds one row a shard at most.

Defined cases: null, empty and wordless texts have no words and log_prob 0, mean
null; rows that repeat are documents of their own; a corpus without words scores
nothing; other columns are ignored. A text is one value and must fit in a worker, and
rows that are equal in id and text are of one shard, which is cut after CUT bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrays import LETTER_DIGIT, U, Words
from weftgraph.llm.store import released, written

SIDE, WIDTH, GROUPS, MEMBERS = 3, 16, 64, 64
#: Words with an output of their own; the last output is RARE. Other words enter by hash; EDGE lies outside a text.
RARE = GROUPS * MEMBERS - 1
HASHED = 4096
EDGE = RARE + 1 + HASHED
STEP, RATE, BOUND = 8192, 0.1, 4.0
SHARD, CUT, ROUNDS = 1 << 21, 1 << 23, 3
#: Averages are rounded to multiples of GRAIN, so that they don't depend on the order in which they are added up.
GRAIN = 2.0**-20
#: Cells of a network that are averaged together.
BLOCK = 1024
#: lengths: words of each text; words, counts: hashes of the different words, and how often each is there; body: for each word its place among them.
CHUNKS = "chunk long, ids array<long>, lengths array<long>, words binary, counts binary, body binary"
SUMS = "block long, total binary, weight long"


class Network:
    """The parameters, kept as one flat array so that tasks' networks can be averaged."""

    SHAPES = {"word": (EDGE + 1, WIDTH), "place": (2 * SIDE, WIDTH), "bias": (WIDTH,), "group": (GROUPS, WIDTH), "group_bias": (GROUPS,), "member": (GROUPS * MEMBERS, WIDTH), "member_bias": (GROUPS * MEMBERS,)}

    def __init__(self, counts: np.ndarray, flat: np.ndarray | None = None, kind=np.float32):
        """counts: of the GROUPS * MEMBERS outputs, which the biases start from."""
        sizes = [math.prod(s) for s in self.SHAPES.values()]
        ends = np.cumsum(sizes)
        self.flat = np.zeros(ends[-1], kind)
        self.part = {k: self.flat[e - n : e].reshape(s) for (k, s), n, e in zip(self.SHAPES.items(), sizes, ends, strict=True)}
        if flat is not None:
            self.flat[:] = flat
            return
        rng = np.random.default_rng(5)
        for k in ("word", "group", "member"):
            self.part[k][:] = rng.normal(0, 0.1, self.SHAPES[k])
        self.part["place"][:] = 1
        smooth = counts.reshape(GROUPS, MEMBERS) + 0.5
        self.part["group_bias"][:] = np.log(smooth.sum(1) / smooth.sum())
        self.part["member_bias"][:] = np.log(smooth / smooth.sum(1, keepdims=True)).ravel()

    def forward(self, window: np.ndarray, target: np.ndarray, gradient: dict | None = None) -> np.ndarray:
        """log P of each target from its window of 2 * SIDE inputs; gradient: filled with that of the mean negative."""
        p = self.part
        seen = p["word"].take(window, axis=0)
        h = np.tanh(np.einsum("bpw,pw->bw", seen, p["place"]) + p["bias"])
        # rows by their word's group, so that each group's rows are one slice
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")  # small numbers sort by radix
        own_group, own = np.divmod(target[order], MEMBERS)
        cut = np.searchsorted(own_group, np.arange(GROUPS + 1)).tolist()
        slices = [(g, slice(cut[g], cut[g + 1])) for g in range(GROUPS) if cut[g] < cut[g + 1]]
        # the outputs' biases are weights of a unit that is always on; weights are kept within BOUND, so nothing overflows
        on, at = np.column_stack([h, np.ones(len(h), h.dtype)]).take(order, axis=0), np.arange(len(h)) * MEMBERS
        group, member = np.column_stack([p["group"], p["group_bias"]]), np.column_stack([p["member"], p["member_bias"]]).reshape(GROUPS, MEMBERS, -1)
        ones = np.ones(MEMBERS, h.dtype)

        def softmax(e: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            """log P of what is wanted, from the outputs; these become the gradient."""
            flat, cell = e.reshape(-1), at + wanted
            logit = flat.take(cell)
            np.exp(e, out=e)
            total = e @ ones
            if gradient is not None:
                e *= (1 / total)[:, None]
                flat[cell] -= 1
            return logit - np.log(total)

        first, second = on @ group.T, np.empty((len(h), MEMBERS), h.dtype)
        for g, rows in slices:
            np.matmul(on[rows], member[g].T, out=second[rows])
        out = np.empty(len(h), h.dtype)
        out[order] = softmax(first, own_group) + softmax(second, own)
        if gradient is not None:
            back, moved, wide, inner = first.T @ on, np.zeros_like(member), np.empty_like(h), p["member"].reshape(GROUPS, MEMBERS, -1)
            for g, rows in slices:
                np.matmul(second[rows].T, on[rows], out=moved[g])
                np.matmul(second[rows], inner[g], out=wide[rows])
            moved, dh = moved.reshape(GROUPS * MEMBERS, -1), np.empty_like(h)
            dh[order] = wide + first @ p["group"]
            gradient |= {"group": back[:, :-1], "group_bias": back[:, -1], "member": moved[:, :-1], "member_bias": moved[:, -1]}
        if gradient is not None:
            dh *= 1 - h * h
            gradient |= {"bias": dh.sum(0), "place": np.einsum("bw,bpw->pw", dh, seen)}
            flat = window.ravel().astype(np.uint16)
            by = np.argsort(flat, kind="stable")
            flat = flat.take(by)
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            # dh times each place's weights, as one product with their diagonal matrices
            rows = (dh @ np.hstack([np.diag(x) for x in p["place"]])).reshape(-1, WIDTH).take(by, axis=0)
            # reduceat goes column by column, so two are added at once as one complex number
            word = np.add.reduceat(rows.view(np.result_type(rows, np.complex64)), first, axis=0).view(rows.dtype)
            gradient |= {"rows": flat[first].astype(np.int64), "word": word}
            for k in gradient.keys() - {"rows"}:
                gradient[k] = gradient[k] / len(target)
        return out


class Trainer:
    """Adagrad steps from a network and its squares."""

    def __init__(self, counts: np.ndarray, state: np.ndarray | None = None):
        """state: the network's cells and then their squares; None: the start."""
        self.net = Network(counts) if state is None else Network(counts, state[: len(state) // 2])
        self.square, self.seen = Network(counts, 1e-3 if state is None else state[len(state) // 2 :]), 0

    def step(self, window: np.ndarray, target: np.ndarray) -> None:
        g: dict = {}
        self.net.forward(window, target, g)
        rows = g.pop("rows")
        for k, x in g.items():
            at = rows if k == "word" else slice(None)
            x *= 100.0  # gradients of a mean are small beside the start of the squares
            self.square.part[k][at] += x * x
            new = self.net.part[k][at] - np.float32(RATE) * x / np.sqrt(self.square.part[k][at])
            self.net.part[k][at] = new if k.endswith("bias") else np.clip(new, -BOUND, BOUND)
        self.seen += len(target)

    def state(self) -> np.ndarray:
        return np.concatenate([self.net.flat, self.square.flat]).astype(float)


class Coded:
    """The words of some texts: the different ones, by hash, and for each word in order which of them it is."""

    def __init__(self, distinct: np.ndarray, code: np.ndarray, counts: np.ndarray):
        """counts: of each text's words."""
        self.distinct, self.code, self.counts, self.n = distinct, code, counts, len(counts)
        self.doc = np.repeat(np.arange(self.n), counts)

    @classmethod
    def of(cls, texts: list[bytes]) -> Coded:
        w = Words(texts, LETTER_DIGIT)
        return cls(*np.unique(w.hash, return_inverse=True), w.counts)

    @property
    def hash(self) -> np.ndarray:
        return self.distinct[self.code]


def inputs_of(words: np.ndarray, known: np.ndarray, index: np.ndarray) -> np.ndarray:
    """What each word, by its hash, is in a window: its output, or without one a number beyond RARE.

    known: sorted hashes of the words with outputs of their own; index: these outputs.
    """
    hashed = (RARE + 1 + (words % U(HASHED)).astype(np.int64)).astype(np.uint16)
    if not len(known):
        return hashed
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, index[at].astype(np.uint16), hashed)


class Texts:
    """The words of some texts: outputs, and windows of inputs."""

    def __init__(self, texts: list[bytes] | Coded, known: np.ndarray | None = None, index: np.ndarray | None = None, inputs: np.ndarray | None = None):
        """inputs: those of the different words, if they are known; they follow else from known and index."""
        self.words = w = texts if isinstance(texts, Coded) else Coded.of(texts)
        inputs = inputs_of(w.distinct, known, index) if inputs is None else inputs
        self.frequent = inputs < RARE
        self.input = inputs[w.code]
        self.target = np.where(self.frequent, inputs, RARE).astype(np.int64)[w.code]

    def windows(self) -> np.ndarray:
        """The inputs before and after each word, with SIDE times EDGE between texts."""
        at = np.arange(len(self.input)) + SIDE * (self.words.doc + 1)
        row = np.full(len(at) + SIDE * (self.words.n + 1), EDGE, np.uint16)
        row[at] = self.input
        return np.column_stack([row[at + s] for s in (*range(-SIDE, 0), *range(1, SIDE + 1))])

    def rare_places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where rare words stand; which of the different ones stands there, and how often it does in its document."""
        at = np.flatnonzero(self.target == RARE)
        of = (np.cumsum(~self.frequent) - 1)[self.words.code[at]]
        _, which, n = np.unique(of * self.words.n + self.words.doc[at], return_inverse=True, return_counts=True)
        return at, of, n[which]

    def rare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different rare words, and their places."""
        return self.words.distinct[~self.frequent], *self.rare_places()


def _sharded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, doc_id, text), by shard, to chunk rows: the words of a shard's texts, or of so much of it as CUT allows."""
    pack = zstandard.ZstdCompressor(level=1)
    shard, k, ids, bodies, total = None, 0, [], [], 0

    def row():
        w = Coded.of(bodies)
        # high bytes of codes are alike, so they are kept beside each other
        planes = w.code.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        of_words = w.distinct.tobytes(), np.bincount(w.code, minlength=len(w.distinct)).astype(np.int32).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([(shard << 20) + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([w.counts], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (*of_words, pack.compress(planes)))], ["chunk", "ids", "lengths", "words", "counts", "body"])

    for part in parts:
        for own, i, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            if ids and (own != shard or total + len(data) > CUT):
                yield row()
                k = k + 1 if own == shard else 0
                ids, bodies, total = [], [], 0
            shard = own
            ids.append(i)
            bodies.append(data)
            total += len(data)
    if ids:
        yield row()


def sharded(docs: DataFrame, id: str, text: str) -> DataFrame:
    """CHUNKS: the words of the lower-cased texts by shards that depend on nothing but the rows. Texts are read for words here only."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.lower(F.col(text).cast("string")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(size / SHARD))))
    rows = rows.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", F.xxhash64("doc_id", "text"), "doc_id", "text")
    return written(rows.select("shard", "doc_id", "text").mapInArrow(_sharded, CHUNKS))


def _coded(lengths: list[int], words: bytes, body: bytes) -> Coded:
    """words: left empty where only places are asked for."""
    lengths = np.array(lengths, np.int64)
    planes = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, 4 * int(lengths.sum())))
    code = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return Coded(np.frombuffer(words, U), code.astype(np.int64), lengths)


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its hash, is in the corpus."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            words, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return words, np.bincount(of, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

        def row(words, n):
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for part in parts:
            for words, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                held.append((np.frombuffer(words, U), np.frombuffer(n, np.int32)))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield row(*held[0])
                        held, size = [], 0
        if held:
            yield row(*merged())

    return written(chunks.select("words", "counts").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the words with outputs of their own, these outputs, counts of all outputs); RARE words at most reach the driver."""
    top = counts.orderBy(F.col("n").desc(), "word").limit(RARE).collect()
    words, n = np.array([r["word"] for r in top], np.int64).view(U), np.array([r["n"] for r in top], np.int64)
    outputs = np.append(n, np.zeros(GROUPS * MEMBERS - len(n), np.int64))
    outputs[RARE] = (counts.agg(F.sum("n")).first()[0] or 0) - n.sum()
    by = np.argsort(words)
    return words[by], by, outputs


def trained(chunks: DataFrame, known: np.ndarray, index: np.ndarray, outputs: np.ndarray) -> np.ndarray:
    """The network, after ROUNDS rounds."""
    spark, state = chunks.sparkSession, Trainer(outputs).state()
    vocabulary = spark.sparkContext.broadcast((known, index, outputs))

    def round_of(sent):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, index, outputs = vocabulary.value
            total, seen = None, 0
            for part in parts:
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    t, trainer = Texts(_coded(*row), known, index), Trainer(outputs, sent.value)
                    # steps of about equal size, however many words there are
                    windows, steps = t.windows(), max(1, round(len(t.target) / STEP))
                    for a, b in zip(*(np.linspace(0, len(t.target), steps + 1).astype(int)[k : steps + k] for k in (0, 1)), strict=True):
                        if b > a:
                            trainer.step(windows[a:b], t.target[a:b])
                    if trainer.seen:
                        moved = trainer.state() * trainer.seen
                        total, seen = moved if total is None else total + moved, seen + trainer.seen
            if seen:
                blocks = [total[a : a + BLOCK].tobytes() for a in range(0, len(total), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary()), pa.array([seen] * len(blocks), pa.int64())], ["block", "total", "weight"])

        return run

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (block, total, weight), all of a block, to their sums."""
        sums: dict = {}
        for part in parts:
            for block, total, weight in zip(*(c.to_pylist() for c in part.columns), strict=True):
                cells, seen = sums.get(block, (0, 0))
                sums[block] = cells + np.frombuffer(total), seen + weight
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], ["block", "total", "weight"])

    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(state)
        shards = chunks.where(F.shiftright("chunk", 20) % ROUNDS == k).select("lengths", "words", "body")
        rows = shards.mapInArrow(round_of(sent), SUMS).repartition("block").mapInArrow(added, SUMS).collect()
        if rows:
            state = state.copy()
            for r in rows:
                at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
                state[at] = np.round(np.frombuffer(r["total"]) / r["weight"] / GRAIN) * GRAIN
            squares = state[len(state) // 2 :]
            np.maximum(squares, 1e-3, out=squares)
        sent.destroy()
        del rows
        released(spark)  # a round's sums aren't needed beside the next one's
    vocabulary.destroy()
    return state[: len(state) // 2].astype(np.float32)


def _asked(vocabulary):
    """Chunks to rows of (word, chunk, place): a chunk's different rare words, numbered."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for chunk, words in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = np.frombuffer(words, U)
                words = words[inputs_of(words, *vocabulary.value[:2]) > RARE]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.full(len(words), chunk)), pa.array(np.arange(len(words), dtype=np.int32))], ["word", "chunk", "place"])

    return run


def _told(vocabulary):
    """Chunks with the inputs of their different words in place of hashes, so that less is shuffled."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            inputs = [inputs_of(np.frombuffer(w, U), *vocabulary.value[:2]).tobytes() for w in part.column("words").to_pylist()]
            yield part.drop_columns(["words"]).append_column("inputs", pa.array(inputs, pa.binary()))

    return run


def _scored(vocabulary, network):
    def run(_, chunks: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        outputs = vocabulary.value[2]
        net, out = Network(outputs, network.value), []
        counts = np.zeros(len(counted), np.int64)
        counts[counted["place"].to_numpy()] = counted["n"].to_numpy(np.int64)
        for row in chunks.itertuples():
            t = Texts(_coded(row.lengths, b"", row.body), inputs=np.frombuffer(row.inputs, np.uint16))
            p, windows = np.empty(len(t.target)), t.windows()
            for a in range(0, len(p), STEP):
                p[a : a + STEP] = net.forward(windows[a : a + STEP], t.target[a : a + STEP])
            at, of, own = t.rare_places()
            if len(at):
                p[at] += np.log((counts[of] - own + 1) / (outputs[RARE] + 1))
            total, n = np.bincount(t.words.doc, p, t.words.n), t.words.counts
            out += [(None if i is None or i != i else int(i), int(k), float(x), float(x) / int(k) if k else None) for i, k, x in zip(row.ids, n, total, strict=True)]
        return pd.DataFrame(out, columns=["doc_id", "n_words", "log_prob", "mean_log_prob"]).astype({"doc_id": "Int64", "mean_log_prob": "Float64"})

    return run


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob), one row per row of ``docs``."""
    spark = docs.sparkSession
    chunks = sharded(docs, id, text)
    released(spark)
    counts = word_counts(chunks)
    known, index, outputs = vocabulary_of(counts)
    network = spark.sparkContext.broadcast(trained(chunks, known, index, outputs))
    released(spark)
    vocabulary = spark.sparkContext.broadcast((known, index, outputs))
    asked = chunks.select("chunk", "words").mapInArrow(_asked(vocabulary), "word long, chunk long, place int")
    counted = asked.join(counts, "word").select("chunk", "place", "n")
    told = chunks.drop("counts").mapInArrow(_told(vocabulary), "chunk long, ids array<long>, lengths array<long>, body binary, inputs binary")
    return told.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(_scored(vocabulary, network), "doc_id long, n_words long, log_prob double, mean_log_prob double")
