"""Packing documents into sequences with a bounded number of open windows.

Each partition streams its documents past a fixed number of open windows. A piece
goes to the window that it fits best. When none fits, the fullest window is topped up
with the head of the piece and emitted, and the tail goes on. What is left open at the
end of the partitions is merged in rounds, a fixed number of partitions to a task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare_workers
from .tokens import encoder

LENGTH = 2048
OPEN_WINDOWS = 32
MERGE_FAN_IN = 64   # open windows of so many partitions meet in one task

SCHEMA = ("sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, "
          "ids binary, left_open boolean, part long")
FIELDS = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
                    ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
                    ("left_open", pa.bool_()), ("part", pa.int64())])

# A piece: (doc_id, start, doc_tokens, ids as bytes of four each).
Piece = tuple[int | None, int, int, bytes]


class Windows:
    """At most ``limit`` open windows of ``length`` tokens."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.free: list[tuple[int, int]] = []          # (free tokens, window), ascending
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece; yields the windows that this fills."""
        doc_id, start, total, ids = piece
        while ids:
            n = len(ids) // 4
            if n >= self.length:                        # a whole window of its own
                yield [(doc_id, start, total, ids[:self.length * 4])]
                start, ids = start + self.length, ids[self.length * 4:]
                continue
            at = bisect_left(self.free, (n, -1))        # the least room that is enough
            if at == len(self.free) and len(self.free) < self.limit:
                self.made += 1
                self.held[self.made] = []
                self.free.append((self.length, self.made))
            at = at if at < len(self.free) else 0       # none fits: the fullest
            room, w = self.free.pop(at)
            take = min(n, room)
            self.held[w].append((doc_id, start, total, ids[:take * 4]))
            start, ids = start + take, ids[take * 4:]
            if take == room:
                yield self.held.pop(w)
            else:
                insort(self.free, (room - take, w))

    def rest(self) -> list[list[Piece]]:
        """The open windows, the fullest first."""
        return [self.held[w] for _, w in self.free]


def _rows(windows: list[list[Piece]], first_id: int, left_open: bool, part: int) -> pa.RecordBatch:
    rows = []
    for k, window in enumerate(windows):
        offset = 0
        for doc_id, start, total, ids in window:
            n = len(ids) // 4
            rows.append((first_id + k, offset, doc_id, start, n, total, ids, left_open, part))
            offset += n
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FIELDS)],
                                      schema=FIELDS)


def _first_id(level: int, part: int) -> int:
    """Sequences are numbered by merge round, task, and order in the task."""
    return (level << 56) + (part << 32)


def pack_ids(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1,
             open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most ``length`` tokens:
    sequence_id, offset in it, doc_id, start in the document, length, doc_tokens, and
    ids (bytes, unsigned 32-bit little-endian).

    Every document ends with ``end_id``; a null or empty text is that id alone. Documents
    are cut at will, so all sequences are full but the last one. Rows stand for themselves:
    null or repeated ids and repeated texts are packed like any other. An empty table gives
    no rows; further columns are ignored. One partition is read as a stream with
    ``open_windows`` windows in memory; a merge task holds at most
    MERGE_FAN_IN * open_windows of them.
    """
    prepare_workers(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(tokenizer).encode, Windows(length, open_windows)
        part, sequences = TaskContext.get().partitionId(), 0
        for b in batches:
            full = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1))):
                ids += end
                full += windows.place((doc_id, 0, len(ids) // 4, ids))
            if full:
                yield _rows(full, _first_id(0, part) + sequences, False, part)
                sequences += len(full)
        if windows.free:
            yield _rows(windows.rest(), _first_id(0, part) + sequences, True, part)

    def merge(level: int):
        def of_group(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            windows, full, part = Windows(length, 1), [], key[0].as_py()
            rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            for piece in zip(*(rows[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                full += windows.place(piece)
            first = _first_id(level, part)
            return pa.Table.from_batches([_rows(full, first, False, part),
                                          _rows(windows.rest(), first + len(full), True, part)])
        return of_group

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = materialise(source.mapInArrow(stream, SCHEMA), "pack-0")
    out, level = [done.where("not left_open")], 0
    rest = done.where("left_open")
    while (last := rest.agg(F.max("part")).first()[0]) is not None and (level == 0 or last > 0):
        level += 1
        by = rest.withColumn("part", F.floor(F.col("part") / MERGE_FAN_IN))
        done = materialise(by.groupBy("part").applyInArrow(merge(level), SCHEMA), f"pack-{level}")
        out.append(done.where("not left_open"))
        rest = done.where("left_open")
    whole = rest
    for part in out:
        whole = whole.unionByName(part)
    return whole.drop("left_open", "part")
