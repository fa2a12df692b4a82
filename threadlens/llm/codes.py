"""Vector compression by product codebooks, fitted over metric trees.

Vectors of integers are cut into 16 parts, and each part has a codebook of 64 entries that
two exact rounds of k-means improve. Every batch of vectors becomes one row that holds 16
metric trees, built once by the anchors hierarchy: about sqrt(n) anchors share the points
out (a point is looked at only where the triangle inequality lets a new anchor have it), are
then merged upwards into balls, nearest first, and split further downwards, each by anchors
of its own. A ball caches the sum and the number of its points. In every round a ball
inherits the entries that may be nearest to one of its points from the ball around it and
drops those that its radius rules out; once one is left, the whole ball is that entry's.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialise, prepare_workers, replace_columns

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LEAF = 32              # points that are no longer split
LARGEST = 1 << 24      # components count as at most this, up and down: distances stay exact in 64 bits
_SLACK = 1e-3          # above the rounding of distances; entries this close are compared exactly
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CHUNKS_AT_ONCE = 8    # rows that hold a batch of vectors each


@contextmanager
def _few_rows(spark: SparkSession):
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(_CHUNKS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x), at most LARGEST up and down."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def anchors(points: np.ndarray) -> list[np.ndarray]:
    """Places of the points, dealt out to about sqrt(n) anchors; one group if all are equal."""
    pivots = [points[0]]
    owner = np.zeros(len(points), np.int64)
    far = _distance(points, points[0])
    for new in range(1, math.isqrt(len(points) - 1) + 1):
        furthest = int(far.argmax())
        if far[furthest] == 0:
            break
        pivot = points[furthest]
        # A point nearer to its anchor than half the way to the new one stays.
        between = _distance(np.array(pivots), pivot)
        asked = np.flatnonzero(2 * far >= between[owner] - _SLACK)
        d = _distance(points[asked], pivot)
        stolen = d < far[asked]
        owner[asked[stolen]], far[asked[stolen]] = new, d[stolen]
        pivots.append(pivot)
    groups = [np.flatnonzero(owner == i) for i in range(len(pivots))]
    return [g for g in groups if len(g)]


class Ball:
    """A node of a tree while it is built: its points' sum and count, a centre and a radius around it."""

    def __init__(self, points: np.ndarray, idx: np.ndarray | None, parts: tuple = ()):
        self.idx, self.parts = idx, parts
        if parts:
            self.sum, self.n = sum(p.sum for p in parts), sum(p.n for p in parts)
            self.centre = self.sum / self.n
            self.radius = max(float(_distance(p.centre, self.centre)) + p.radius for p in parts)
        else:
            own = points[idx]
            self.sum, self.n = own.sum(0), len(idx)
            self.centre = self.sum / self.n
            self.radius = float(_distance(own, self.centre).max())


def middle_out(points: np.ndarray, idx: np.ndarray) -> Ball:
    """The tree over some points: anchors in the middle, merged upwards, split downwards."""
    groups = anchors(points[idx]) if len(idx) > LEAF else [idx]
    if len(groups) == 1:
        return Ball(points, idx)
    balls = [middle_out(points, idx[g]) for g in groups]
    centres = np.array([b.centre for b in balls])
    radii = np.array([b.radius for b in balls])
    width = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + radii[:, None] + radii[None]
    np.fill_diagonal(width, np.inf)
    for _ in range(len(balls) - 1):
        i, j = divmod(int(width.argmin()), len(balls))
        balls[i] = ball = Ball(points, None, (balls[i], balls[j]))
        centres[i], radii[i] = ball.centre, ball.radius
        width[j], width[:, j] = np.inf, np.inf
        on = np.isfinite(width[i])
        width[i, on] = width[on, i] = _distance(centres[on], ball.centre) + radii[on] + ball.radius
    return balls[i]


def tree_arrays(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree as arrays. Ball k holds order[lo[k]:hi[k]]; right[k] is its second child (the first
    is k + 1) or 0; the root is ball 0."""
    balls, order, lo, right, at = [], [], [], [], 0
    stack = [(middle_out(points, np.arange(len(points))), None)]
    while stack:
        ball, second_of = stack.pop()
        if second_of is not None:
            right[second_of] = len(balls)
        balls.append(ball)
        lo.append(at)
        right.append(0)
        if ball.parts:
            stack += [(ball.parts[1], len(balls) - 1), (ball.parts[0], None)]
        else:
            order.append(ball.idx)
            at += ball.n
    lo_all = np.array(lo, np.int32)
    return {"order": np.concatenate(order).astype(np.int32), "lo": lo_all,
            "hi": lo_all + np.array([b.n for b in balls], np.int32), "right": np.array(right, np.int32),
            "centre": np.array([b.centre for b in balls]), "radius": np.array([b.radius for b in balls]),
            "sum": np.array([b.sum for b in balls])}


def owned(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray):
    """Yields (ball, entry) for balls that are one entry's, and (lo, entries) for the points of other
    leaves from place ``lo`` of the order on. ``points`` are in tree order."""
    lo, hi, right, centre, radius = (tree[k] for k in ("lo", "hi", "right", "centre", "radius"))
    stack = [(0, np.arange(len(book)))]
    while stack:
        ball, entries = stack.pop()
        d = _distance(book[entries], centre[ball])
        entries = entries[d <= d.min() + 2 * radius[ball] + _SLACK]
        if len(entries) == 1:
            yield ball, int(entries[0]), None
        elif right[ball]:
            stack += [(int(right[ball]), entries), (ball + 1, entries)]
        else:
            apart = ((points[lo[ball]:hi[ball], None] - book[entries][None]) ** 2).sum(2)
            yield int(lo[ball]), None, entries[apart.argmin(1)]


def assign(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each point (in tree order), ties to the lower one."""
    out = np.empty(len(points), np.int64)
    for at, entry, entries in owned(tree, points, book):
        if entries is None:
            out[tree["lo"][at]:tree["hi"][at]] = entry
        else:
            out[at:at + len(entries)] = entries
    return out


def entry_sums(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points each entry has, and their sums; whole balls count by what they cache."""
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    for at, entry, entries in owned(tree, points, book):
        if entries is None:
            counts[entry] += tree["hi"][at] - tree["lo"][at]
            sums[entry] += tree["sum"][at]
        else:
            np.add.at(counts, entries, 1)
            np.add.at(sums, entries, points[at:at + len(entries)])
    return counts, sums


def _packed(vectors: np.ndarray) -> bytes:
    arrays = {}
    for p, points in enumerate(np.split(vectors, PARTS, axis=1)):
        tree = tree_arrays(points)
        arrays |= {f"{k}{p}": v for k, v in tree.items()}
        arrays[f"points{p}"] = points[tree["order"]].astype(np.int32)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    with np.load(io.BytesIO(data), allow_pickle=False) as f:
        for p in range(PARTS):
            yield ({k: f[f"{k}{p}"] for k in ("order", "lo", "hi", "right", "centre", "radius", "sum")},
                   f[f"points{p}"].astype(np.int64))


def plant(rows: DataFrame) -> DataFrame:
    """(ids, labels, trees): one row for each batch of the rows (vec_id, label_key, vector)."""
    prepare_workers(rows.sparkSession)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = integers(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())),
                 pa.array([b.column(1).to_pylist()], pa.list_(pa.string())), pa.array([_packed(vectors)], pa.binary())],
                names=["ids", "labels", "trees"])

    return rows.mapInArrow(of_batch, "ids array<long>, labels array<string>, trees binary")


def improved(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all rows: every task adds up its own rows first, and at most
    16 x 64 x width rows, whatever the table, come to the driver."""
    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for data in batch.column(0):
                for p, (tree, points) in enumerate(_unpacked(data.as_py())):
                    n, s = entry_sums(tree, points, books[p])
                    counts[p] += n
                    sums[p] += s
        for p, (n, s) in enumerate(zip(counts, sums)):
            e, w = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(s.size, p, np.int32)), pa.array(e.ravel().astype(np.int32)),
                 pa.array(w.ravel().astype(np.int32)), pa.array(np.repeat(n, s.shape[1])), pa.array(s.ravel())],
                names=["part", "entry", "place", "n", "total"])

    with _few_rows(trees.sparkSession):
        found = trees.select("trees").mapInArrow(of_batch, "part int, entry int, place int, n long, total long").groupBy(
            "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect()
    new = [b.copy() for b in books]
    for r in found:
        new[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return new


def coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label_key, code, error) by the codebooks as they are, written."""
    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, data in zip(b.column(0), b.column(1), b.column(2)):
                codes = np.empty((len(ids), PARTS), np.uint8)
                errors = np.zeros(len(ids), np.int64)
                for p, (tree, points) in enumerate(_unpacked(data.as_py())):
                    entry = assign(tree, points, books[p])
                    codes[tree["order"], p] = entry
                    errors[tree["order"]] += ((points - books[p][entry]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)],
                    names=["vec_id", "label_key", "code", "error"])

    with _few_rows(trees.sparkSession):
        return materialise(trees.mapInArrow(of_batch, "vec_id long, label_key string, code string, error long"), "codes")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row (vec_id, embedding, label) kept.

    Rows whose vector is null or empty or holds null or non-finite components are dropped, and so are
    vectors whose length isn't a multiple of 16, or isn't that of the first one kept. The codebooks
    start with the 64 smallest vec_ids, null last, of equal ones by their vectors; fewer rows make
    fewer entries. Repeated rows are rows of their own, a null label is a label. Components whose
    integers lie beyond 2**24 count as 2**24 (with their sign). Empty tables give no rows; further
    columns are ignored.
    """
    number = F.col("embedding").cast("array<double>")
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label_key"), number.alias("vector")).where(
        fine & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    kept = kept.where(F.size("vector") == len(first[0]["vector"]))
    start = integers(np.array([r["vector"] for r in kept.orderBy(*order).limit(ENTRIES).collect()]))
    books = np.split(start, PARTS, axis=1)
    trees = materialise(plant(kept), "vector-trees")
    for _ in range(ROUNDS):
        books = improved(trees, books)
    out = coded(trees, books)
    errors = out.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("count"))
    return replace_columns(join_counted(out, errors, "label_key", out.count()), {"codebooks_sha256": F.lit(digest(books))}).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")
