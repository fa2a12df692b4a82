"""Near-duplicate vectors by lattice hashing.

A table projects unit vectors at random to 16 numbers and decodes them, as two eights, to
the nearest points of the lattice E8; the pair of lattice points is a vector's home cell. It
also probes the neighbouring cells that its projection is closest to. Vectors of which one
probes the other's home, in one of several tables, are candidates, the signs of 64 further
projections drop most that are not alike, and the cosine of the rest is computed.

No group is spread into all its pairs. Equal vectors are one node. In a few rounds each node
is tried with one other of each of its cells, which ties large groups together; only then are
nodes of one cell but different components compared. Links lie inside components, so they are
counted there, block by block, each pair once, without a row for a pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare_workers
from .neardup import components

COSINE = 0.9
TABLES, BLOCKS = 18, 2
WIDTH = 1.8            # of a lattice step, in standard deviations of a projected unit vector
PROBES = 8             # cells besides the home
_NEAR = 8              # neighbours of a lattice point that probes are made of
# A pair at 0.9 meets in a table with a chance of 0.31 (measured), so none of 18 tables joins
# it with 0.13 %; at 0.95 the chances are 0.62 and 2e-8. Vectors at right angles meet with 3e-5.
SIGN_BITS = 64
MOST_UNEQUAL = 24      # a pair at 0.9 differs in 9.2 signs, with a standard deviation of 2.8
STAND_INS = 4
ROUNDS = 3
BLOCK = 256            # nodes of a cell or a component compared with so many others in one task
_SEED = 20240707


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of -1 or 1, or all of -1/2 or 1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    out = np.rint(x)
    rest = x - out
    odd = np.flatnonzero(out.sum(-1) % 2)
    worst = np.abs(rest[odd]).argmax(-1)
    out[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: even-sum integers, or those shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit number for each lattice point (last axis of 8)."""
    h = np.full(points.shape[:-1], salt, np.uint64)
    for k in range(8):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + (2 * points[..., k]).astype(np.int64).view(np.uint64))
    return h


class Tables:
    """The projections of vectors of one length."""

    def __init__(self, width: int):
        rng = np.random.default_rng([_SEED, width])
        self.planes = rng.normal(size=(TABLES, BLOCKS, width, 8)) / WIDTH
        self.offsets = rng.uniform(-8, 8, size=(TABLES, BLOCKS, 8))
        self.signs = rng.normal(size=(width, SIGN_BITS))
        self.salt = width

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + PROBES) keys, the home first, then neighbours by distance."""
        out = np.empty((len(unit), TABLES, 1 + PROBES), np.uint64)
        for t in range(TABLES):
            keys, extra = [], []
            for b in range(BLOCKS):
                x = unit @ self.planes[t, b] + self.offsets[t, b]
                home = decode(x)
                rest = x - home
                # |rest - v|^2 - |rest|^2 for the shortest v, all of squared length 2
                d = 2 - 2 * rest @ SHORTEST.T
                near = np.argsort(d, axis=1, kind="stable")[:, :_NEAR]
                points = np.concatenate([home[:, None], home[:, None] + SHORTEST[near]], axis=1)
                keys.append(_hashed(points, self.salt * 64 + t * BLOCKS + b))
                extra.append(np.concatenate([np.zeros((len(unit), 1)), np.take_along_axis(d, near, 1)], axis=1))
            both = (keys[0][:, :, None] + _mixed(keys[1])[:, None, :]).reshape(len(unit), -1)
            cost = (extra[0][:, :, None] + extra[1][:, None, :]).reshape(len(unit), -1)
            cost[:, 0] = -1
            chosen = np.argsort(cost, axis=1, kind="stable")[:, :1 + PROBES]
            out[:, t] = np.take_along_axis(both, chosen, 1)
        return out

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit @ self.signs > 0).astype(np.uint64)
        return (bits << np.arange(SIGN_BITS, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def hashed(vectors: DataFrame) -> DataFrame:
    """(node, unit, sketch, homes, probes) of (node, vector): the vector at length 1 and its cells."""
    prepare_workers(vectors.sparkSession)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        longs = pa.list_(pa.int64())
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for width in np.unique(sizes).tolist():
                b = batch if (sizes == width).all() else batch.filter(pa.array(sizes == width))
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                if width not in tables:
                    tables[width] = Tables(width)
                own = tables[width]
                cells = own.cells(unit).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(list(unit), pa.list_(pa.float64())), pa.array(own.sketch(unit)),
                     pa.array(list(cells[:, :, 0]), longs), pa.array(list(cells[:, :, 1:].reshape(len(unit), -1)), longs)],
                    names=["node", "unit", "sketch", "homes", "probes"])

    return vectors.select("node", "vector").mapInArrow(
        of_batch, "node long, unit array<double>, sketch long, homes array<long>, probes array<long>")


def _unequal(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def confirmed(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with a cosine of at least COSINE."""
    each = lambda c: units.select(F.col("node").alias(c), F.col("unit").alias(f"unit_{c}"))
    joined = pairs.join(each("a"), "a").join(each("b"), "b")
    dot = F.aggregate(F.zip_with("unit_a", "unit_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return joined.where((F.size("unit_a") == F.size("unit_b")) & (dot >= COSINE)).select("a", "b")


def _linked(pairs: DataFrame, units: DataFrame, classes: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The classes (node, component) with the confirmed ones of the pairs, and whether there were any."""
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                        f"lattice-pairs-{name}")
    found = materialise(confirmed(pairs, units), f"lattice-links-{name}")
    if found.isEmpty():
        return classes, False
    known = classes.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")
    return materialise(components(found.unionAll(known)), f"lattice-classes-{name}"), True


def _apart(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of cells that reach into more than one component, with their component."""
    rows = members.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (rows.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("cell"))
    return rows.join(mixed, "cell", "left_semi").select("cell", "home", "node", "component", "sketch")


def classes_of(signed: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are linked with others."""
    cells = signed.select("node", F.explode("homes").alias("cell"), F.lit(True).alias("home")).unionAll(
        signed.select("node", F.explode("probes").alias("cell"), F.lit(False).alias("home")))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("home")).where("n > 1 and home").select("cell")
    members = materialise(cells.join(shared, "cell", "left_semi").join(signed.select("node", "sketch"), "node"), "lattice-members")
    units = signed.select("node", "unit")
    classes = materialise(members.select("node", F.col("node").alias("component")).limit(0), "lattice-classes")

    # Rounds of one try a node, so pairs stay as many as nodes: a few members of every home
    # cell, others each round, stand for it, and a node is tried with the most similar one.
    at_home = members.where("home")
    for turn in range(ROUNDS):
        apart = _apart(at_home, classes)
        who = F.struct("node", "component", "sketch")
        some = apart.groupBy("cell").agg(F.array(*[
            F.min_by(who, F.xxhash64("node", F.lit(turn * STAND_INS + i))) for i in range(STAND_INS)]).alias("some"))
        tries = F.transform(F.filter("some", lambda p: p["component"] != F.col("component")),
                            lambda p: F.struct(_unequal(F.col("sketch"), p["sketch"]).alias("u"), p["node"].alias("other")))
        best = (apart.join(some, "cell").select("node", F.array_min(tries).alias("t")).where(F.col("t.u") <= MOST_UNEQUAL)
                .groupBy("node").agg(F.min("t").alias("t")))
        classes, more = _linked(best.select(F.col("node").alias("a"), F.col("t.other").alias("b")), units, classes, f"round-{turn}")
        if not more:
            break

    # Then all that still shares a cell and has similar signs, but lies in two components. At
    # most one of a pair is in the cell's largest component, so the others are compared with all,
    # in blocks, and a large group that is one component costs no more than its rows.
    apart = materialise(_apart(members, classes), "lattice-apart")
    largest = (apart.groupBy("cell", "component").agg(F.count("*").alias("n"))
               .groupBy("cell").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"))
               .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    dealt = apart.join(largest, "cell")
    names = ("node", "component", "sketch", "home")
    every = dealt.select("cell", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"),
                         *[F.col(c).alias(f"{c}_a") for c in names], (F.col("component") == F.col("largest")).alias("main"))
    others = dealt.where("component <> largest").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_b") for c in names])
    meet = F.expr("component_a <> component_b and (home_a or home_b) and (main or node_a < node_b)") & (
        _unequal(F.col("sketch_a"), F.col("sketch_b")) <= MOST_UNEQUAL)
    left = every.join(others.hint("merge"), ["cell", "block"]).where(meet)
    return _linked(left.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), units, classes, "rest")[0]


def _counted(rows: pa.Table) -> pa.Table:
    """(node, n): the copies that each of the rows with ``left`` finds at or above COSINE among those
    with ``right``, itself not counted."""
    unit = np.array(rows.column("unit").to_pylist(), np.float64)
    node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
    a = np.flatnonzero(rows.column("left").to_numpy(zero_copy_only=False))
    b = np.flatnonzero(rows.column("right").to_numpy(zero_copy_only=False))
    linked = (unit[a] @ unit[b].T >= COSINE) & (node[a][:, None] != node[b][None, :])
    return pa.table({"node": node[a], "n": linked @ copies[b]})


def counted_links(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n): how many copies of other nodes each node of a component is linked with. A component's
    nodes are cut into blocks, and a task compares one block with one other."""
    sizes = classes.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.select("component", "node", F.col("block").alias("i"), other.alias("j"), F.lit(True).alias("left"),
                         F.lit(False).alias("right")).unionAll(
        dealt.select("component", "node", other.alias("i"), F.col("block").alias("j"), F.lit(False), F.lit(True)))
    tiles = tiles.groupBy("component", "i", "j", "node").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    full = tiles.join(nodes.select("node", "unit", "copies"), "node")
    return full.groupBy("component", "i", "j").applyInArrow(_counted, "node long, n long").groupBy("node").agg(
        F.sum("n").alias("n"))


def link(rows: DataFrame) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine is at least 0.9. n_links counts the other vectors linked
    directly, component_id is the smallest vec_id reachable, and kept whether that is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing, nor
    are vectors of different lengths. Rows with a null vec_id get a null component, are linked with
    nothing and kept. Repeated rows are one vector; an id with several vectors stands for several,
    in one component. An empty table gives no rows; further columns are ignored.
    """
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists(
        "vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    usable = vectors.where(fine)
    key = F.md5(F.concat_ws(",", F.col("vector").cast("array<string>"))).alias("digest")
    ids = materialise(usable.select("vec_id", key, "vector").groupBy("vec_id", "digest").agg(F.first("vector").alias("vector")),
                      "lattice-ids")
    nodes = materialise(ids.groupBy("digest").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")
    signed = materialise(hashed(nodes), "lattice-signed")
    classes = classes_of(signed)
    links = counted_links(classes, nodes.select("node", "copies").join(signed.select("node", "unit"), "node"))
    by_node = materialise(nodes.select("node", "digest", "least", "copies").join(classes, "node", "left").join(links, "node", "left")
                          .select("digest", "least", F.coalesce("component", "node").alias("component"),
                                  (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "lattice-found")
    # An id may hold several vectors, so components are joined once more over ids.
    held = materialise(ids.select("vec_id", "digest").join(by_node, "digest"), "lattice-held")
    least = held.groupBy("component").agg(F.min("least").alias("smallest"))
    ties = components(held.join(least, "component").select(F.col("vec_id").alias("a"), F.col("smallest").alias("b")))
    per_id = held.groupBy("vec_id").agg(F.sum("n").alias("n"))
    out = vectors.select("vec_id").join(per_id, "vec_id", "left").join(
        ties.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
