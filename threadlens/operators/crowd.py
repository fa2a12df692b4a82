"""Pairs of users who share threads, counted by matrices inside one tile of two blocks of users."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_THREADS = 256            # threads of a matrix at a time
_CANDIDATES = 2_000_000   # candidates of small threads at a time
_OUT = 250_000            # pairs that leave a tile at once


def _product(c: np.ndarray, at: list[np.ndarray], of: list[np.ndarray], threads: np.ndarray) -> None:
    """Adds to ``c`` how often users meet in ``threads``, by products of two membership matrices."""
    for k in range(0, len(threads), _THREADS):
        some = threads[k:k + _THREADS]
        column = np.full(max(int(x.max(initial=-1)) for x in of) + 1, -1)
        column[some] = np.arange(len(some))
        x, y = (np.bincount(a[m] * len(some) + column[t[m]], minlength=n * len(some)).reshape(n, len(some)).astype(np.float32)
                for a, t, n in zip(at, of, c.shape) for m in [column[t] >= 0])
        c += (x @ y.T).astype(np.int32)


def _listed(c: np.ndarray, at: list[np.ndarray], of: list[np.ndarray], held: list[np.ndarray], threads: np.ndarray) -> None:
    """The same for threads of few users here, by their candidates one by one."""
    flat = c.reshape(-1)
    order = [np.argsort(t, kind="stable") for t in of]
    one, two = (a[o] for a, o in zip(at, order))
    first = [np.cumsum(h) - h for h in held]
    ends = np.cumsum(held[0][threads] * held[1][threads])
    for part in np.split(threads, np.flatnonzero(np.diff(ends // _CANDIDATES)) + 1):
        n, m = held[0][part], held[1][part]
        take = np.repeat(first[0][part] - np.cumsum(n) + n, n) + np.arange(n.sum())     # users on one side ...
        thread = np.repeat(np.arange(len(part)), n)
        with_ = m[thread]                                                               # ... each with all on the other
        inside = np.arange(with_.sum()) - np.repeat(np.cumsum(with_) - with_, with_)
        other = np.repeat(first[1][part][thread], with_) + inside
        flat += np.bincount(np.repeat(one[take], with_) * c.shape[1] + two[other], minlength=len(flat)).astype(np.int32)


def tile_pairs(n_keys: int, min_shared: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one tile's rows (keys, a, b, post_id, at, us): the users ``us``, by their places in block ``at``
    (a or b), of a thread. Gives (keys, u, v, shared_interactions) of the pairs of at least ``min_shared`` threads;
    a user's number is block · 2^32 + place."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        blocks = [t.column(n_keys)[0].as_py(), t.column(n_keys + 1)[0].as_py()]
        thread = t.column("post_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lists = t.column("us").combine_chunks()
        length = np.diff(lists.offsets.to_numpy())
        user, thread = lists.flatten().to_numpy().astype(np.int64), np.repeat(thread, length)
        block = np.repeat(t.column("at").to_numpy(), length)
        sides = [np.flatnonzero(block == x) for x in blocks]
        if not all(map(len, sides)):
            return
        at, of = [user[s] for s in sides], [thread[s] for s in sides]
        held = [np.bincount(x, minlength=int(thread.max()) + 1) for x in of]
        c = np.zeros([int(x.max()) + 1 for x in at], np.int32)
        both = held[0] * held[1]
        small = both * 200 < c.size      # a candidate costs as much as about 200 cells of a product
        _product(c, at, of, np.flatnonzero((both > 0) & ~small))
        if ((both > 0) & small).any():
            _listed(c, at, of, held, np.flatnonzero((both > 0) & small))
        if blocks[0] == blocks[1]:
            c = np.triu(c, 1)
        u, v = np.nonzero(c >= min_shared)
        for k in range(0, len(u), _OUT):
            r, s = u[k:k + _OUT], v[k:k + _OUT]
            same = [pa.repeat(t.column(i)[0], len(r)) for i in range(n_keys)]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array((blocks[0] << 32) + r), pa.array((blocks[1] << 32) + s), pa.array(c[r, s].astype(np.int64))],
                names=[*t.column_names[:n_keys], "u", "v", "shared_interactions"])

    return counted
