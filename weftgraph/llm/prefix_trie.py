"""The trie of conversations' shared beginnings, by partition refinement.

A conversation is a sequence of turns; each different beginning of d turns is a node
of depth d, whose members are the conversations that begin so. Conversations with
equal turns throughout are one weighted sequence. All sequences start in one class;
a round splits the classes that are still active by their next turns - first FIRST of
them, twice as many in each further round - with one aggregation by (depth, label):
a label is what the turns so far have in common, the XOR of a 128-bit hash of each
turn and its place. A sequence that is alone in a class is retired, and its remaining
turns become a unary chain without being grouped again. So rounds are the logarithm of
the longest beginning that different sequences share.

The fold back needs no walk up: a node belongs to its smallest member, which keeps it
down to its own end, so a class's subtree is what its members own below it: sums over
members, less what the class's owner owns above.

Turns are numbered by a range partitioning by (conversation, turn), so that a very
long conversation is spread, and running sums are taken within blocks of BLOCK turns
and over blocks. The ids that end in a node are joined to text piece by piece in
ranges of ids; their SHA-256 takes the pieces as they come in order, so a node with
very many ids streams through a task.

Defined cases: rows without a conv_id belong to no conversation; null roles and
texts are empty; a null turn comes first; turns with equal numbers are in the order
of role and text; without conversations there are no nodes, not even a root; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.store import written

FIRST, BLOCK, MOST_TURNS = 8, 4096, 4096
#: Ids of a node that are joined to one piece of text.
IDS = 20_000


def _zero() -> Column:
    return F.lit(0).cast("long")


def _hash(*of: str) -> list[Column]:
    """Two 64-bit hashes of a place and a turn's digest."""
    return [F.xxhash64(*of).alias("x1"), F.xxhash64(F.lit(7), *reversed(of)).alias("x2")]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, d, digest, bytes): the turns of each conversation from 0 on. ``turns``: conv_id, turn, role, text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv", "turn", "role", "text"]
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(" "), "role", "text"), 256), 1, 32))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    placed = written(placed)
    starts = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), _zero())
    starts = starts.select("conv", "part", (before - F.col("first")).alias("shift"))
    return placed.join(starts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("d"), "digest", "bytes")


def rebuilt(turns: DataFrame, every: int = 5, least: int = 9) -> tuple[DataFrame, DataFrame]:
    """((conv, n), (conv, d, digest, bytes)): each conversation c continued after the first crc32(c) % ``least`` turns of c - c % ``every``."""
    own = written(numbered(turns))
    size = written(own.groupBy("conv").agg(F.count("*").alias("n")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % least
    base = F.col("conv") - F.col("conv") % every
    known = size.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = size.select("conv", "n", h.alias("h"), base.alias("base")).join(known, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", _zero())))
    head = convs.select("conv", "base", "taken").join(own.where(F.col("d") < least - 1).withColumnRenamed("conv", "base"), "base").where("d < taken").select("conv", "d", "digest", "bytes")
    # an own turn is after the first h; where the base has fewer, it moves up
    moved = convs.where("n > h and taken < h").select("conv", (F.col("h") - F.col("taken")).alias("up"))
    tail = own.where(F.col("d") >= h).join(moved, "conv", "left").select("conv", (F.col("d") - F.coalesce("up", _zero())).alias("d"), "digest", "bytes")
    total = convs.select("conv", (F.col("taken") + F.greatest(_zero(), F.col("n") - F.col("h"))).alias("n"))
    return total, head.unionByName(tail)


def _running(rows: DataFrame, key: str, d: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the key's rows with a smaller ``d``: within blocks, and over blocks."""
    rows = rows.withColumn("block", F.floor(F.col(d) / BLOCK))
    sums = rows.groupBy(key, "block").agg(F.sum(value).alias("whole"))
    upto = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "block", F.coalesce(F.sum("whole").over(upto), _zero()).alias("earlier"))
    within = Window.partitionBy(key, "block").orderBy(d).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, [key, "block"]).withColumn(out, F.col("earlier") + F.coalesce(F.sum(value).over(within), _zero())).drop("block", "earlier")


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces (l1, l2, n, first, ids) of each node, which come in order."""
    node, state = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(("n", "l1", "l2"), node, strict=True), sha=state.hexdigest())], schema)

    schema = pa.schema([("n", pa.int64()), ("l1", pa.int64()), ("l2", pa.int64()), ("sha", pa.string())])
    for part in parts:
        for *key, ids in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if key != node:
                if node is not None:
                    yield row()
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if node is not None:
        yield row()


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids (n, l1, l2, conv), sorted, to pieces of comma-joined text (n, l1, l2, first, ids)."""
    node, held = None, []

    def row():
        return (*node, held[0], ",".join(map(str, held)))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["n", "l1", "l2", "first", "ids"])

    for part in parts:
        rows = []
        for *key, conv in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if held and (key != node or len(held) >= IDS):
                rows.append(row())
                held = []
            node = key
            held.append(conv)
        if rows:
            yield batch(rows)
    if held:
        yield batch([row()])


def ends_of(convs: DataFrame) -> DataFrame:
    """(n, l1, l2, sha) of conversations (conv, n, l1, l2): the digest of each label's ids in ascending order."""
    order = ["n", "l1", "l2", "conv"]
    pieces = convs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "n long, l1 long, l2 long, first long, ids string")
    label = order[:3]
    return pieces.repartition(*label).sortWithinPartitions(*label, "first").mapInArrow(_digests, "n long, l1 long, l2 long, sha string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of sequences: ``convs`` (conv, n), ``turns`` (conv, d, digest, bytes) with d from 0.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), see the module.
    """
    turns = written(turns.select("conv", (F.col("d") + 1).alias("d"), *[h.alias(n) for h, n in zip(_hash("d", "digest"), ("h1", "h2"), strict=True)], "bytes"))
    label = turns.groupBy("conv").agg(F.bit_xor("h1").alias("l1"), F.bit_xor("h2").alias("l2"))
    convs = written(convs.join(label, "conv", "left").na.fill(0, ["l1", "l2"]))
    seqs = written(convs.groupBy("n", "l1", "l2").agg(F.min("conv").alias("rep"), F.count("*").alias("weight")))
    seqs_turns = written(turns.withColumnRenamed("conv", "rep").join(seqs.select("rep", "weight", F.col("n").alias("len")), "rep"))

    # split: rows (rep, d, p, l: labels before and after the turn) of sequences in a class of several, and where each is alone
    rounds, alone = [], []
    root = seqs.select("rep", _zero().alias("d"), *[_zero().alias(c) for c in ("p1", "p2", "l1", "l2")], _zero().alias("bytes"), "weight")
    if seqs.limit(2).count() < 2:
        alone.append(root.select("rep", F.col("d").alias("at"), "p1", "p2"))
        active = None
    else:
        rounds.append(root)
        active = seqs.where("n > 0").select("rep", F.col("n").alias("len"), _zero().alias("s1"), _zero().alias("s2"))
    done, step = 0, FIRST
    while active is not None:
        rows = seqs_turns.where(F.col("d").between(done + 1, done + step)).join(active.drop("len"), "rep")
        for k in ("1", "2"):
            rows = rows.withColumn(f"l{k}", F.expr(f"s{k} ^ bit_xor(h{k}) OVER (PARTITION BY rep ORDER BY d)")).withColumn(f"p{k}", F.expr(f"l{k} ^ h{k}"))
        rows = written(rows.select("rep", "d", "p1", "p2", "l1", "l2", "bytes", "weight", "len"))
        single = rows.groupBy("d", "l1", "l2").agg(F.min("rep").alias("rep"), F.count("*").alias("reps")).where("reps = 1")
        heads = written(single.groupBy("rep").agg(F.min("d").alias("at")))
        alone.append(rows.join(heads, "rep").where("d = at").select("rep", "at", "p1", "p2"))
        rounds.append(rows.join(heads, "rep", "left").where("at is null or d < at").select("rep", "d", "p1", "p2", "l1", "l2", "bytes", "weight"))
        done += step
        active = written(rows.where((F.col("d") == done) & (F.col("len") > done)).join(heads, "rep", "left_anti").select("rep", "len", F.col("l1").alias("s1"), F.col("l2").alias("s2")))
        step = min(2 * step, MOST_TURNS)
        if active.limit(1).count() == 0:
            active = None

    union = lambda parts: reduce(DataFrame.unionByName, parts)
    retired = written(union(alone))
    heads = retired.select("rep", "at")
    empty = root.where("false")
    shared = written(union(rounds) if rounds else empty)
    classes = written(shared.groupBy("d", "l1", "l2").agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    chains = seqs_turns.join(heads, "rep").where(F.col("d") >= F.col("at")).select(F.col("rep").alias("conv_id"), "d", "bytes", F.col("weight").alias("n_convs"), F.col("len"), "at")
    if not rounds:
        chains = chains.unionByName(root.join(seqs.select("rep", F.col("n").alias("len")), "rep").select(F.col("rep").alias("conv_id"), "d", "bytes", F.col("weight").alias("n_convs"), "len", _zero().alias("at")))

    # who owns what: running sums of what each sequence's nodes save, from its first node down
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = classes.select("conv_id", "d", "l1", "l2", "p1", "p2", "n_convs", saved.alias("saved"), F.lit(None).cast("long").alias("len"), F.lit(None).cast("long").alias("at"))
    nodes = nodes.unionByName(chains.select("conv_id", "d", *[F.lit(None).cast("long").alias(c) for c in ("l1", "l2", "p1", "p2")], "n_convs", saved.alias("saved"), "len", "at"))
    nodes = written(_running(nodes, "conv_id", "d", "saved", "above"))
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("owned"))
    of_rep = written(seqs.select("rep").join(owned.withColumnRenamed("conv_id", "rep"), "rep", "left").join(heads.select("rep", F.lit(1).alias("leaf")), "rep", "left").na.fill(0))
    below = shared.join(of_rep, "rep").groupBy("d", "l1", "l2").agg(F.sum("owned").alias("below"), F.sum("leaf").alias("n_leaves"))

    # children of classes: classes and the first nodes of chains
    children = classes.where("d > 0").select("d", "p1", "p2", "conv_id").unionByName(retired.where("at > 0").select(F.col("at").alias("d"), "p1", "p2", F.col("rep").alias("conv_id")))
    key = [(F.col("d") - 1).alias("d"), F.col("p1").alias("l1"), F.col("p2").alias("l2")]
    n_children = children.select(*key).groupBy("d", "l1", "l2").agg(F.count("*").alias("n_children"))
    parents = children.select("conv_id", *key).join(classes.select("d", "l1", "l2", F.col("conv_id").alias("parent_conv_id")), ["d", "l1", "l2"]).select("conv_id", (F.col("d") + 1).alias("d"), "parent_conv_id")
    ends = written(ends_of(convs))
    nothing = F.lit(hashlib.sha256().hexdigest())

    at_class = nodes.where("at is null").join(below, ["d", "l1", "l2"]).join(n_children, ["d", "l1", "l2"], "left").join(ends.withColumnRenamed("n", "d"), ["d", "l1", "l2"], "left").join(parents, ["conv_id", "d"], "left")
    at_class = at_class.select("conv_id", "d", "parent_conv_id", "n_convs", F.coalesce("n_children", _zero()).alias("n_children"), "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens"), "sha")
    last = ends.join(seqs.select("n", "l1", "l2", F.col("rep").alias("conv_id")), ["n", "l1", "l2"]).select("conv_id", F.col("n").alias("d"), "sha")
    at_chain = nodes.where("at is not null").join(of_rep.select(F.col("rep").alias("conv_id"), "owned"), "conv_id").join(last, ["conv_id", "d"], "left").join(parents, ["conv_id", "d"], "left")
    at_chain = at_chain.select("conv_id", "d", F.when(F.col("d") > F.col("at"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (F.col("owned") - F.col("above")).alias("saved_tokens"), "sha")
    out = at_class.unionByName(at_chain)
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", nothing).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    return prefix_trie(*rebuilt(turns))
