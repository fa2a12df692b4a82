"""Near-duplicate documents by b-bit MinHash.

Word shingles of a document are hashed; 240 minima make 48 bands of 5, and the low two
bits of every minimum are packed into a signature of 60 bytes. Documents that share a band
are candidates, the equal bits of their signatures estimate their similarity (corrected
for chance agreement), and what the estimate leaves is confirmed on full shingle sets.

No group is spread into all its pairs. Equal sets are one node, named by a number. In a few rounds
each node is tried with one other of its bands, and the links make components; only then are nodes
of one band but different components compared, by signature inside the join, so rows come
out for those alone that may yet connect two components. Rows of (band, node) hold numbers only;
signatures and sets move with the pairs that are tried, never with the bands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare_workers

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 5, 48        # a pair at 0.75 shares no band with a chance of 2e-6
HASHES = ROWS * BANDS
LOW_BITS = 2
# A pair goes on if its estimate is at least this. At a similarity of 0.75 the estimate's
# standard deviation is 0.034, so one in 300,000 such pairs would fall below.
MIN_ESTIMATE = 0.60
# Before what is left is confirmed, a longer signature of the nodes in question narrows it:
# its standard deviation is 0.0115, so the limit is as safe as the one above.
FINE_HASHES, MIN_FINE = 2048, 0.697
STAND_INS = 2              # members that stand for a band in a round
ROUNDS = 3                 # of one try a node, before what is left is compared in full
BLOCK = 256                # nodes of a band that others are compared with in one task
FEW = 8                    # partners in a band of one tile up to which a node's pairs move, not its rows
KEY = "__threadlens_key"
_STEP = 1024               # shingles of one document hashed at once
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_seeds = np.random.default_rng(20240229)
_MULTIPLY = (_seeds.integers(0, 1 << 32, FINE_HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _seeds.integers(0, 1 << 32, FINE_HASHES, dtype=np.uint64).astype(np.uint32)
_SALTS = [int(x) for x in _seeds.integers(0, 1 << 63, 64)]    # XOR with one puts nodes into another order
_PLACE = _mix(np.arange(1, 2 * SHINGLE + BANDS + ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's 5-word shingles. A-Z count as a-z.
    Fewer words make one shingle; none, or no text, the empty set."""
    flat, counts = [], []
    for t in texts:
        own = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        flat += own
        counts.append(len(own))
    values = np.empty(len(flat), object)
    values[:] = flat
    h = pd.util.hash_array(values, categorize=False) if flat else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts:
        w = h[at:at + n]
        at += n
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < SHINGLE:
            out.append(_mix((w * _PLACE[SHINGLE:SHINGLE + n]).sum(keepdims=True) + np.uint64(n)))
        else:
            s = np.zeros(n - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                s += w[k:k + len(s)] * _PLACE[k]
            out.append(np.unique(_mix(s)))
    return out


def minima(s: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The least of each of so many 32-bit hashes over a set."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(hashes, 0xFFFFFFFF, np.uint32)
    step = max(1, _STEP * HASHES // hashes)
    for at in range(0, len(low), step):
        np.minimum(least, (low[at:at + step, None] * _MULTIPLY[:hashes] + _ADD[:hashes]).min(0), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 32 minima to a 64-bit number."""
    bits = _mix(least.astype(np.uint64)) & np.uint64((1 << LOW_BITS) - 1)
    per = 64 // LOW_BITS
    padded = np.zeros(-(-len(least) // per) * per, np.uint64)
    padded[:len(least)] = bits
    return (padded.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(LOW_BITS))).sum(1, dtype=np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; keys of different bands differ."""
    rows = _mix(least.astype(np.uint64)).reshape(BANDS, ROWS) * _PLACE[-ROWS:]
    return _mix(rows.sum(1, dtype=np.uint64) + _PLACE[2 * SHINGLE:2 * SHINGLE + BANDS])


def text_key() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64("text")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, digest, signature, bands) of each whole text; the last three are
    null for an empty set. Equal sets have equal digests (128 bits)."""
    prepare_workers(docs.sparkSession)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, signatures, bands = [], [], [], []
            for s in shingle_sets(b.column(2).to_pylist()):
                sizes.append(len(s))
                if len(s):
                    least = minima(s)
                    digests.append(_digest(s))
                    signatures.append(signature(least).view(np.int64))
                    bands.append(band_keys(least).view(np.int64))
                else:
                    digests.append(None)
                    signatures.append(None)
                    bands.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(signatures, longs), pa.array(bands, longs)],
                names=["doc_id", "key", "n_shingles", "digest", "signature", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text").mapInArrow(
        of_batch, "doc_id long, key long, n_shingles long, digest binary, signature array<long>, bands array<long>")


def _of_sets(texts: DataFrame, name: str, longs) -> DataFrame:
    """(node, name): an array of 64-bit numbers made of the shingle set of each text (node, digest, text)
    that has the node's digest."""
    prepare_workers(texts.sparkSession)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, s) for n, d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                              shingle_sets(b.column(2).to_pylist())) if _digest(s) == d]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in rows], pa.int64()),
                 pa.array([longs(s).view(np.int64) for _, s in rows], pa.list_(pa.int64()))], names=["node", name])

    return texts.select("node", "digest", "text").mapInArrow(of_batch, f"node long, `{name}` array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """(node, set): the shingle hashes."""
    return _of_sets(texts, "set", lambda s: s)


def fine_signatures(texts: DataFrame) -> DataFrame:
    """(node, fine): signatures of FINE_HASHES minima."""
    return _of_sets(texts, "fine", lambda s: signature(minima(s, FINE_HASHES)))


def estimate(a: Column, b: Column, hashes: int = HASHES) -> Column:
    """Similarity from two signatures: the share of equal low bits, less what chance gives."""
    odd = F.lit(0x5555555555555555)

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(odd))

    unequal = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << LOW_BITS)
    return (1 - unequal / hashes - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b): the smallest node it is connected with.

    Star contraction: each round ties the larger neighbours of every node to the smallest
    one around it, then does the same from below, until every component is a star. Rounds
    grow with the logarithm of a chain's length and run until nothing changes; a node's
    neighbours are only ever aggregated, never gathered.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, edges = None, materialise(edges, "links")
    while True:
        # Large star: v > u are tied to the least of u and its neighbours.
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges_large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u <> v").distinct())
        # Small star: u and its smaller neighbours are tied to the least of these.
        least = edges_large.groupBy("u").agg(F.min("v").alias("m"))
        edges_small = (edges_large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                       .where("u <> v").distinct())
        edges = materialise(edges_small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _member_texts(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, digest, text), a materialised table: the texts (one a node, or repeated rows) of the nodes that share a
    band with another. Only these are ever compared, so all other texts move once and no more."""
    wanted = members.select("node").distinct().join(nodes.select("node", "digest", "doc_id", "key"), "node")
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text").join(
        wanted, ["doc_id", "key"]).select("node", "digest", "text"), "texts")


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, digest, text) of the nodes of the pairs (a, b)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return texts.join(wanted, "node", "left_semi")


def _with_both(pairs: DataFrame, of_node: DataFrame, name: str) -> DataFrame:
    """The pairs with the column ``name`` of a and of b. Bare pairs move first; rows that carry it are dealt by b,
    and adaptive execution splits what one node would make large."""
    return (pairs.join(of_node.select(F.col("node").alias("a"), F.col(name).alias("of_a")), "a")
            .join(of_node.select(F.col("node").alias("b"), F.col(name).alias("of_b")), "b"))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a materialised table, whose full sets have 100 * intersection >= 75 * union. Sets are made
    anew from the texts of the nodes in question only."""
    sets = materialise(full_sets(_texts_of(pairs, texts)), "sets")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return _with_both(pairs, sets, "set").where(
        both * 100 >= (F.size("of_a") + F.size("of_b") - both) * PERCENT).select("a", "b").distinct()


def _with_component(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _tries(members: DataFrame, nodes: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node and the most similar one, by signature, of the nodes that stand for its bands this
    turn and lie in another component. The same few nodes stand for all bands they share, so the distinct
    pairs are far fewer than the rows of the bands."""
    rows = _with_component(members, classes)
    salts = [F.lit(x) for x in _SALTS[turn * STAND_INS:(turn + 1) * STAND_INS]]
    some = rows.groupBy("band").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        *[F.min(F.col("node").bitwiseXOR(x)).alias(f"s{i}") for i, x in enumerate(salts)]).where("lo < hi").select(
        "band", F.array_distinct(F.array(*[F.col(f"s{i}").bitwiseXOR(x) for i, x in enumerate(salts)])).alias("some"))
    pairs = rows.join(some, "band").select("node", "component", F.explode("some").alias("other")).where("node <> other").distinct()
    theirs = classes.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
    pairs = pairs.join(theirs, "other", "left").where(F.col("component") != F.coalesce("theirs", "other")).select(
        F.col("node").alias("a"), F.col("other").alias("b"))
    alike = estimate(F.col("of_a"), F.col("of_b"))
    return (_with_both(pairs, nodes, "signature").select("a", F.struct(alike.alias("e"), "b").alias("t"))
            .where(F.col("t.e") >= MIN_ESTIMATE).groupBy("a").agg(F.max("t").alias("t")).select("a", "t.b"))


def _apart(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, node, component) of the bands that reach into more than one component."""
    rows = _with_component(members, classes)
    mixed = (rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("band"))
    return rows.join(mixed, "band", "left_semi").select("band", "node", "component")


def _groups(apart: DataFrame, classes: DataFrame) -> DataFrame:
    """(whole, band, node, component): what is compared, a band's nodes or (``whole``, named by the component) those of
    a component and all nodes next to it.

    Bands that lie mostly in one component hold much the same nodes, over and over. Where a component makes half
    of a band or more, and the band holds a quarter of the component or more, the component stands for the band:
    its nodes come once instead of once a band. So at most four times the pairs of the bands are compared.
    """
    sizes = classes.groupBy(F.col("component").alias("largest")).agg(F.count("*").alias("size"))
    covered = (apart.groupBy("band", "component").agg(F.count("*").alias("n"))
               .groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
               .select("band", F.col("top.component").alias("largest"), F.col("top.n").alias("n"), "all")
               .join(sizes, "largest").where("2 * n >= all and 4 * n >= size").select("band", "largest"))
    covered = materialise(covered, "covered")
    rest = apart.join(covered, "band", "left_anti").select(F.lit(False).alias("whole"), "band", "node", "component")
    near = apart.join(covered, "band").where("component <> largest").select(
        F.lit(True).alias("whole"), F.col("largest").alias("band"), "node", "component").distinct()
    own = classes.join(covered.select(F.col("largest").alias("component")).distinct(), "component", "left_semi").select(
        F.lit(True).alias("whole"), F.col("component").alias("band"), "node", "component")
    return rest.unionAll(near).unionAll(own)


def _sides(rows: DataFrame, of_node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparison of a group's nodes, dealt into tiles (whole, band, i, j) of at most about BLOCK by
    BLOCK, with the columns of ``of_node``. At most one of a pair is in the group's largest component (``main``), so all
    nodes stand on one side and on the other those of all other components. What a node carries joins it once it is dealt."""
    group = ["whole", "band"]
    largest = (rows.groupBy(*group, "component").agg(F.count("*").alias("n"))
               .groupBy(*group).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
               .select(*group, F.col("top.component").alias("largest"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"),
                       F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("cols")))
    dealt = rows.join(largest, group)
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = lambda x: of_node.select(*[F.col(c).alias(f"{c}_{x}") for c in of_node.columns])
    every = dealt.where("cols > 0").select(
        *group, place("rows").alias("i"), over("cols").alias("j"), F.col("node").alias("node_a"), F.col("component").alias("component_a"),
        (F.col("component") == F.col("largest")).alias("main"), (F.col("rows") == 1).alias("alone")).join(carried("a"), "node_a")
    # Columns of their own, as both sides of a cogroup need.
    whole, band = (F.col("whole") | F.lit(False)).alias("whole"), F.col("band").bitwiseOR(F.lit(0).cast("long")).alias("band")
    others = dealt.where("component <> largest").select(
        whole, band, over("rows").alias("i"), place("cols").alias("j"), F.col("node").alias("node_b"),
        F.col("component").alias("component_b")).join(carried("b"), "node_b")
    return every, others


def _partnered(left: pa.Table, right: pa.Table) -> pa.Table:
    """The partners in a tile: nodes of both sides that lie in different components and are similar by the short
    signature. In a band of one tile, pairs with an end that has few partners come out as (node, other), which is
    little and the same in all bands they share; for all others (whole, band, node, component) of both ends."""
    a, b = ([np.array(t.column(f"signature_{x}").to_pylist(), np.int64).view(np.uint64) for t, x in ((left, "a"), (right, "b"))]
            if left.num_rows and right.num_rows else (None, None))
    ours, theirs = left.column("component_a").to_pylist(), right.column("component_b").to_pylist()
    found, few = {}, []
    if a is not None:
        code = {c: k for k, c in enumerate({*ours, *theirs})}
        unequal = np.zeros((len(a), len(b)), np.int64)
        for k in range(a.shape[1]):
            d = a[:, k][:, None] ^ b[:, k][None, :]
            unequal += np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555))
        chance = 1 / (1 << LOW_BITS)
        near = ((1 - unequal / HASHES - chance) / (1 - chance) >= MIN_ESTIMATE - 1e-9) & (
            np.array([code[c] for c in ours])[:, None] != np.array([code[c] for c in theirs])[None, :])
        nodes_a, nodes_b = left.column("node_a").to_pylist(), right.column("node_b").to_pylist()
        if left.column("alone")[0].as_py():
            light = near & ((near.sum(1) <= FEW)[:, None] | (near.sum(0) <= FEW)[None, :])
            few = sorted({tuple(sorted((nodes_a[i], nodes_b[j]))) for i, j in np.argwhere(light).tolist()})
            near &= ~light
        for own, parts, at in ((nodes_a, ours, near.any(1)), (nodes_b, theirs, near.any(0))):
            found |= {own[i]: parts[i] for i in np.flatnonzero(at).tolist()}
    whole, band = (left.column(c)[0].as_py() if left.num_rows else None for c in ("whole", "band"))
    nothing = [None] * len(few)
    return pa.table({"whole": pa.array([whole] * len(found) + nothing, pa.bool_()),
                     "band": pa.array([band] * len(found) + nothing, pa.int64()),
                     "node": pa.array([*found, *[x for x, _ in few]], pa.int64()),
                     "component": pa.array([*found.values(), *nothing], pa.int64()),
                     "other": pa.array([None] * len(found) + [x for _, x in few], pa.int64())})


def _linked(pairs: DataFrame, texts: DataFrame, classes: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The classes with the confirmed ones of the pairs (a, b), and whether there were any."""
    pairs = materialise(pairs.distinct(), f"pairs-{name}")
    if pairs.isEmpty():
        return classes, False
    found = materialise(confirm(pairs, texts), f"links-{name}")
    if found.isEmpty():
        return classes, False
    known = classes.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")
    return materialise(components(found.unionAll(known)), f"classes-{name}"), True


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, digest, component) per row; component is null for rows without an id
    or words, else the smallest node connected with the row's."""
    signed = materialise(sign(docs), "signatures")
    # A node is a set; its smallest document gives its text.
    nodes = materialise(signed.where("doc_id is not null and digest is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "key")).alias("text"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "text.doc_id", "text.key", "signature", "bands"), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = materialise(banded.join(shared, "band"), "members")
    texts = _member_texts(members, nodes, docs)
    classes = materialise(members.select("node", F.col("node").alias("component")).limit(0), "classes")

    # Rounds of one try a node, so pairs that are confirmed stay as many as nodes: in each band a few
    # members, others each round, stand for the band.
    for turn in range(ROUNDS):
        best = _tries(members, nodes, classes, turn)
        classes, more = _linked(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
                                texts, classes, f"round-{turn}")
        if not more:
            break

    # Then all that still shares a band and is similar by both signatures, but lies in two
    # components. The short signature first tells, tile by tile, the pairs of nodes with few such partners
    # and which other nodes have one at all; only for these the longer one is made and moved.
    groups = materialise(_groups(materialise(_apart(members, classes), "apart"), classes), "groups")
    every, others = _sides(groups, nodes.select("node", "signature"))
    tile = ["whole", "band", "i", "j"]
    partners = materialise(every.groupBy(*tile).cogroup(others.groupBy(*tile)).applyInArrow(
        _partnered, "whole boolean, band long, node long, component long, other long").distinct(), "partnered")
    partnered = partners.where("other is null").drop("other")
    few = partners.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    ends = partners.select(F.col("node").alias("a"), F.coalesce("other", "node").alias("b"))
    fine = materialise(fine_signatures(_texts_of(ends, texts)).dropDuplicates(["node"]).join(
        nodes.select("node", "signature", "bands"), "node"), "fine")
    near = _with_both(few, fine, "fine").where(estimate(F.col("of_a"), F.col("of_b"), FINE_HASHES) >= MIN_FINE).select("a", "b")
    every, others = _sides(partnered, fine)
    first = F.filter(F.zip_with("bands_a", "bands_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())[0]
    meet = F.expr("component_a <> component_b and (main or node_a < node_b)") & (
        estimate(F.col("signature_a"), F.col("signature_b")) >= MIN_ESTIMATE) & (F.col("whole") | (first == F.col("band"))) & (
        estimate(F.col("fine_a"), F.col("fine_b"), FINE_HASHES) >= MIN_FINE)
    left = every.join(others, tile).where(meet)
    classes, _ = _linked(left.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).unionAll(near),
                         texts, classes, "rest")

    named = _with_component(nodes.select("node", "digest"), classes).select("digest", "component")
    rows = signed.select("doc_id", "key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return rows.join(named, "digest", "left")


def link(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, kept whether that is the
    document's own. Texts that are null or without words have no shingles and are linked
    with nothing. Rows with a null doc_id get a null component, are linked with nothing and
    kept. Repeated rows share their set and so their component; rows that share an id but not
    the set each have their own text's component. An empty table gives no rows; further columns
    are ignored.
    """
    rows = materialise(_rows(docs), "rows")
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.join(least, "component", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest id, of its texts
    one, of repeated rows one. Rows without an id or without words all stay."""
    rows = materialise(_rows(docs).where("component is not null"), "rows")
    chosen = rows.groupBy("component").agg(F.min(F.struct("doc_id", "digest", "key")).alias("own")).select("own.doc_id", "own.key")
    known = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    dropped = known.join(chosen, ["doc_id", "key"], "left_anti").select("doc_id", F.col("key").alias(KEY))
    repeated = known.join(chosen, ["doc_id", "key"], "left_semi").where("n > 1").select("doc_id", F.col("key").alias(KEY))
    kept = docs.withColumn(KEY, text_key()).join(dropped, ["doc_id", KEY], "left_anti")
    once = kept.join(repeated, ["doc_id", KEY], "left_semi").dropDuplicates(["doc_id", KEY])
    return kept.join(repeated, ["doc_id", KEY], "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
