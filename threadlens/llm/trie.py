"""A prefix trie of rebuilt conversations, as double arrays.

Turns and prefixes are known by 128-bit digests. Equal conversations are one sequence with a
count. A prefix that many sequences share is an *upper* node; every sequence belongs to the
shortest of its prefixes that few share, all below such a prefix lies in one shard, and each
shard packs its sequences into a double array over dense turn ids: state ``s`` has the child
``BASE[s] + c`` for turn ``c`` if ``CHECK`` there is ``s``. Walking the sequences through
the arrays gives the nodes; what they sum up to at a shard's prefixes is then merged into the
upper nodes above them, over all shards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialise, prepare_workers

BASES_EVERY = 100   # conversation c starts with turns of c - c % 100
MOST_BORROWED = 6   # crc32(decimal c) % 6 of them
GROUP = 256         # a prefix of more distinct sequences is an upper node
SHARD = 16_384      # distinct sequences in a shard, about
ROOT = bytes(16)
_RUN = 12           # conv_ids that agree in all but so many bits are joined into one string


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the rebuilt turns of each conversation as digests of (role, text) with
    their code points. Rows count by turn (null first); of one turn, by the digest. A null role
    or text is empty, rows without a conv_id are left out, repeated rows are repeated turns.
    Further columns are ignored. A conversation is one row of about 30 bytes a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    same = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").alias("turn"), same.alias("id"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    base = own.where(F.col("conv_id") % BASES_EVERY == 0).select(
        F.col("conv_id").alias("base"), F.slice("own", 1, MOST_BORROWED - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED).cast("int")
    borrowed = F.when(F.col("first").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("first", F.lit(1), h))
    turns = F.concat(borrowed, F.slice("own", h + 1, F.size("own")))
    return own.join(base, F.col("conv_id") - F.col("conv_id") % BASES_EVERY == F.col("base"), "left").select(
        "conv_id", F.transform(turns, lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def with_prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, ids, chars, prefixes, whole): the digest of every prefix, and of all turns."""
    prepare_workers(rebuilt.sparkSession)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes, whole = [], []
            for ids in b.column("ids").to_pylist():
                at, own = ROOT, []
                for t in ids:
                    at = hashlib.blake2b(at + t, digest_size=16).digest()
                    own.append(at)
                prefixes.append(own)
                whole.append(at)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(prefixes, pa.list_(pa.binary())), pa.array(whole, pa.binary())],
                names=["conv_id", "ids", "chars", "prefixes", "whole"])

    return rebuilt.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars")).mapInArrow(
        of_batch, "conv_id long, ids array<binary>, chars array<long>, prefixes array<binary>, whole binary")


class DoubleArray:
    """A trie over sequences of symbols 0, 1, ... in BASE and CHECK; cell 0 is the root.

    Symbols get dense ids 1, 2, ... as they are first met, level by level and parent by parent,
    so that siblings mostly have neighbouring ids and fit into neighbouring cells.
    """

    TRIES = 64   # places from the lowest free cell on that are tried before one behind all others

    def __init__(self, sequences: list[np.ndarray]):
        self.ids: dict[int, int] = {}
        self.base, self.check = [0], [-2]
        self._low = 1
        states = np.zeros(len(sequences), np.int64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        for d in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > d)
            symbols = np.array([sequences[i][d] for i in on], np.int64)
            edges = np.unique(np.stack([states[on], symbols], 1), axis=0)
            codes = [self.ids.setdefault(s, len(self.ids) + 1) for s in edges[:, 1].tolist()]
            starts = [0, *(np.flatnonzero(np.diff(edges[:, 0])) + 1).tolist(), len(edges)]
            for lo, hi in zip(starts, starts[1:]):
                self._add(int(edges[lo, 0]), sorted(codes[lo:hi]))
            states[on] = [self.base[s] + self.ids[c] for s, c in zip(states[on].tolist(), symbols.tolist())]

    def _fits(self, at: int, codes: list[int]) -> bool:
        have, gap = len(self.check), at - codes[0]
        return all(gap + c >= have or self.check[gap + c] == -1 for c in codes)

    def _add(self, parent: int, codes: list[int]) -> None:
        at = next((t for t in range(self._low, self._low + self.TRIES) if self._fits(t, codes)), len(self.check))
        base = at - codes[0]
        more = base + codes[-1] + 2 - len(self.check)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more
        self.base[parent] = base
        for c in codes:
            self.check[base + c] = parent
        while self.check[self._low] != -1:
            self._low += 1

    def walk(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, places of the sequences that are as long, their states there)."""
        base, check = np.array(self.base, np.int64), np.array(self.check, np.int64)
        states = np.zeros(len(sequences), np.int64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        for d in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > d)
            cells = base[states[on]] + np.array([self.ids[int(sequences[i][d])] for i in on], np.int64)
            if (check[cells] != states[on]).any():
                raise KeyError("a sequence is not in the trie")
            states[on] = cells
            yield d, on, cells


NODE = ("node binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, above array<binary>, above_chars array<long>")


def shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of one shard from its sequences (n, conv_id, deep, above, above_chars, ids, chars, prefixes):
    the last three from the shard's prefix on, which has ``deep`` turns. Only that prefix's node has ``above``."""
    n = rows.column("n").to_numpy()
    conv = rows.column("conv_id").to_numpy()
    deep = rows.column("deep").to_numpy()
    ids, prefixes, chars = (rows.column(c).to_pylist() for c in ("ids", "prefixes", "chars"))
    # The first symbol is the shard's prefix itself, the others are turns.
    flat = [t for p, own in zip(prefixes, ids) for t in (b"^" + p[0], *own[1:])]
    symbols = pd.factorize(np.array(flat + [None], object)[:-1])[0]
    sequences = np.split(symbols, np.cumsum([len(own) for own in ids])[:-1])
    trie = DoubleArray(sequences)
    cells = len(trie.check)
    convs, least, leaves, saved, text, depth = (np.zeros(cells, np.int64) for _ in range(6))
    least[:] = np.iinfo(np.int64).max
    label, tops, levels = {}, {}, []
    for d, on, at in trie.walk(sequences):
        np.add.at(convs, at, n[on])
        np.minimum.at(least, at, conv[on])
        first = dict(zip(at.tolist(), on.tolist()))
        for cell, i in first.items():
            label[cell] = prefixes[i][d]
            text[cell], depth[cell] = chars[i][d], deep[i] + d
        if d == 0:
            tops = first
        levels.append(np.fromiter(first, np.int64, len(first)))
    check = np.array(trie.check, np.int64)
    nodes = np.concatenate(levels)
    children = np.bincount(check[nodes], minlength=cells)
    leaves[nodes] = children[nodes] == 0
    saved[nodes] = (convs[nodes] - 1) * text[nodes]
    for level in levels[:0:-1]:
        np.add.at(leaves, check[level], leaves[level])
        np.add.at(saved, check[level], saved[level])
    above, above_chars = (rows.column(c).to_pylist() for c in ("above", "above_chars"))
    at = nodes.tolist()
    return pa.table({
        "node": pa.array([label[c] for c in at], pa.binary()),
        "parent_conv_id": pa.array([None if c in tops else int(least[check[c]]) for c in at], pa.int64()),
        "conv_id": least[nodes], "depth": depth[nodes], "n_convs": convs[nodes], "n_children": children[nodes].astype(np.int64),
        "n_leaves": leaves[nodes], "saved_tokens": saved[nodes],
        "above": pa.array([above[tops[c]] if c in tops else None for c in at], pa.list_(pa.binary())),
        "above_chars": pa.array([above_chars[tops[c]] if c in tops else None for c in at], pa.list_(pa.int64()))})


def deal(sequences: DataFrame) -> DataFrame:
    """``sequences`` with ``deep``: how many turns has the shortest prefix that at most GROUP of them
    share; one more than a sequence has, if it has none."""
    steps = materialise(sequences.select("whole", F.posexplode("prefixes").alias("at", "prefix")), "trie-steps")
    hot = steps.groupBy("prefix").count().where(F.col("count") > GROUP)
    deepest = join_counted(steps, hot, "prefix", steps.count()).groupBy("whole").agg(F.max("at").alias("at"))
    return sequences.join(deepest, "whole", "left").withColumn("deep", F.coalesce(F.col("at") + 2, F.lit(1))).drop("at")


def ends(convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end. Runs of close ids are joined where they
    lie; only the digest itself goes through a node's strings one after the other, a batch at a time."""
    runs = convs.groupBy("whole", F.shiftright("conv_id", _RUN).alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            nodes, found = [], []
            for whole, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if whole != node:
                    if node is not None:
                        nodes.append(node)
                        found.append(sha.hexdigest())
                    node, sha = whole, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())],
                                             names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])],
                                             names=["node", "ends_sha256"])

    return runs.repartition("whole").sortWithinPartitions("whole", "run").select("whole", "ids").mapInArrow(
        of_batch, "node binary, ends_sha256 string")


def upper_nodes(tops: DataFrame, short: DataFrame) -> DataFrame:
    """The upper nodes, merged over all shards from the ``tops`` of the shards' prefixes and the
    ``short`` sequences that end in an upper node."""
    total = ["conv_id", "n_convs", "n_leaves", "saved_tokens"]
    zero = F.lit(0).cast("long")
    records = tops.select("above", "above_chars", *total, F.lit(1).alias("child")).unionByName(
        short.select(F.concat(F.array(F.lit(ROOT)), "prefixes").alias("above"),
                     F.concat(F.array(zero), "chars").alias("above_chars"), "conv_id", F.col("n").alias("n_convs"),
                     zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(0).alias("child")))
    each = records.select(F.posexplode("above").alias("depth", "node"), "*")
    last = F.col("depth") == F.size("above") - 1
    merged = materialise(each.groupBy("node").agg(
        F.first("depth").cast("long").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"),
        F.sum(F.when(last, F.col("child")).otherwise(0)).alias("tops"),
        F.first(F.struct(F.slice("above", F.lit(1), F.col("depth") + 1).alias("path"),
                         F.get("above_chars", "depth").alias("chars"))).alias("own"))
        .select("*", ((F.col("n_convs") - 1) * F.col("own.chars")).alias("gain"), F.col("own.path").alias("path"),
                F.when(F.col("depth") > 0, F.get("own.path", (F.col("depth") - 1).cast("int"))).alias("parent")).drop("own"),
        "trie-upper")
    gains = merged.select(F.explode("path").alias("node"), "gain").groupBy("node").agg(F.sum("gain").alias("gains"))
    inner = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("inner"))
    out = materialise(merged.drop("gain").join(gains, "node").join(inner, "node", "left")
                      .withColumn("inner", F.coalesce("inner", F.lit(0)))
                      .withColumn("n_children", F.col("tops") + F.col("inner")), "trie-upper")
    parents = out.where("inner > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                            F.col("inner").alias("count"))
    known = join_counted(out.where("parent is not null"), parents, "parent", out.count())
    every = known.unionByName(out.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    return materialise(every.select(
        "node", "parent_conv_id", "conv_id", "depth", "n_convs", "n_children", (F.col("below_leaves") + leaf).alias("n_leaves"),
        (F.col("below_saved") + F.col("gains")).alias("saved_tokens"), "tops"), "trie-upper")


def nodes(conversations: DataFrame) -> DataFrame:
    """Per node of the trie over all rebuilt conversations: conv_id (its smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has (conv_id, turn, role, text). No conversation, no node: an empty table
    gives no rows. For nulls, ties and repeated rows see ``rebuild``; texts are whole. A conversation
    whose rebuilt form has no turn is a member of the root and ends there.
    """
    spark = conversations.sparkSession
    convs = materialise(with_prefixes(rebuild(conversations)), "trie-conversations")
    classes = convs.groupBy("whole").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    sequences = materialise(classes.join(convs.drop("whole"), "conv_id"), "trie-sequences")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sequences.count() / SHARD))
    dealt = materialise(deal(sequences), "trie-dealt")
    deep = F.col("deep")
    inside = F.size("prefixes") >= deep
    own = {c: F.slice(c, deep, F.size("prefixes")) for c in ("ids", "chars", "prefixes")}
    before = {"above": F.concat(F.array(F.lit(ROOT)), F.slice("prefixes", F.lit(1), deep - 1)),
              "above_chars": F.concat(F.array(F.lit(0).cast("long")), F.slice("chars", F.lit(1), deep - 1))}
    shard = F.pmod(F.xxhash64(F.get("prefixes", deep - 1)), F.lit(shards))
    lower = materialise(dealt.where(inside).select(
        shard.alias("shard"), "n", "conv_id", deep.cast("long").alias("deep"), *[v.alias(k) for k, v in before.items()],
        *[v.alias(k) for k, v in own.items()]).groupBy("shard").applyInArrow(shard_nodes, NODE), "trie-nodes")
    tops = lower.where("above is not null")
    upper = upper_nodes(tops, dealt.where(~inside))
    parents = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"), F.col("tops").alias("count"))
    out = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    with_parent = join_counted(tops.withColumn("parent", F.element_at("above", -1)), parents, "parent",
                               tops.count()).drop("parent_conv_id").withColumnRenamed("of_parent", "parent_conv_id")
    every = (lower.where("above is null").select(*out).unionByName(with_parent.select(*out))
             .unionByName(upper.select(*out)))
    return every.join(ends(convs), "node", "left").select(
        *out[1:], F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
