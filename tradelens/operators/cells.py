"""Pairs of wallets of a table in which many others trade around each trade, cell by cell.

There the pairs that meet outnumber the trades by far, and a shuffle of them is what fills the disks. So wallets are dealt into groups,
and a cell is two groups, or one with itself: each pair of wallets lies in one cell, whenever it trades. Trades are packed to a few bytes
each and sent to the cells of their group; a cell's task sorts them by time, adds up its pairs in strips of a bounded number of meetings and hands
out only what is asked for: pairs with ``least`` or more, their sums and components, or lists of related wallets.

What is shuffled is the trades, once for each group. There are ``GROUPS`` groups until one would have more than ``GROUP_ROWS`` trades;
so up to ``GROUPS * GROUP_ROWS`` trades the shuffle grows with the trades, and beyond that with their square over ``GROUP_ROWS``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: Groups of a large table, trades of a group at most, and trades of a group from which on a small table gets another one.
GROUPS, GROUP_ROWS, FEW_ROWS = 16, 2_500_000, 20_000
#: Meetings of a strip, pairs that wait for being written out as lists, and pairs of a batch.
STRIP, WAITING, BATCH = 1_000_000, 2_000_000, 500_000


class Side(NamedTuple):
    """A group of wallets: its classes with their sizes and wallets, and its trades by time; ``who`` is a place in ``ids``."""

    ids: np.ndarray
    size: np.ndarray
    first: np.ndarray
    wallets: np.ndarray
    who: np.ndarray
    t: np.ndarray
    n: np.ndarray


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers as the least one and the distances from it, in as few bytes as these need."""
    far = x.view(np.uint64) - x.min().view(np.uint64)
    small = far.astype(np.min_scalar_type(far.max()))
    return x.min().tobytes() + bytes([small.itemsize]) + small.tobytes()


def _values(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[8]}", offset=9).astype(np.int64) + np.frombuffer(x, np.int64, 1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, kind, a, b, n) of whole numbers to one row a group and batch, of bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        g, kind, *values = (np.ascontiguousarray(x.to_numpy(zero_copy_only=False), np.int64) for x in batch.columns)
        key = 2 * g + kind
        order = np.argsort(key, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
        head = [pa.array([int(x[p[0]]) for p in parts], pa.int32()) for x in (g, kind)]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array([_bytes(x[p]) for p in parts], pa.binary()) for x in values)], ["g", "kind", "a", "b", "n"])


def _side(rows: list[dict]) -> Side:
    """The group that was packed to ``rows``: of kind 0 (wallet, t, n), of kind 1 (class, wallet)."""
    read = lambda kind, name: np.concatenate([_values(r[name]) for r in rows if r["kind"] == kind] or [np.zeros(0, np.int64)])
    named, wallets = read(1, "a"), read(1, "b")
    order = np.argsort(named, kind="stable")
    wallets = wallets[order]
    ids, first, size = np.unique(named[order], return_index=True, return_counts=True)
    w, t, n = read(0, "a"), read(0, "b"), read(0, "n")
    if n.sum() <= 2 * len(n):  # a few seconds with several trades are as many rows, and nothing has to be weighed
        w, t, n = np.repeat(w, n), np.repeat(t, n), np.ones(int(n.sum()), np.int64)
    order = np.argsort(t, kind="stable")
    return Side(ids, size, first, wallets, np.searchsorted(ids, w[order]).astype(np.int32), t[order], n[order])


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places low, low + 1, ... of each row, ``count`` of them, in a row."""
    return np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _strips(one: Side, two: Side, window_s: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, pairs) of places in ``one.ids`` and ``two.ids`` with ``least`` or more, sorted, each i in one strip alone."""
    if not len(one.t) or not len(two.t):
        return
    low = np.searchsorted(two.t, one.t - window_s, "left")
    count = np.searchsorted(two.t, one.t + window_s, "right") - low
    order = np.argsort(one.who, kind="stable")
    who, low, count, n = one.who[order], low[order], count[order], one.n[order]
    before = np.concatenate([[0], np.cumsum(count)])
    starts = np.searchsorted(who, np.arange(len(one.ids) + 1))
    at, plain, wide = before[starts], one.n.max() == two.n.max() == 1, len(two.ids)
    a = 0
    while a < len(one.ids):
        b = max(a + 1, int(np.searchsorted(at, at[a] + STRIP, "right")) - 1)
        s, e = starts[a], starts[b]
        if at[b] - at[a] > STRIP:  # one wallet
            total = np.zeros(wide, np.int64)
            while s < e:
                u = min(e, max(s + 1, int(np.searchsorted(before, before[s] + STRIP, "right")) - 1))
                place = _spread(low[s:u], count[s:u])
                np.add.at(total, two.who[place], np.repeat(n[s:u], count[s:u]) * two.n[place])
                s = u
            j = np.flatnonzero(total >= max(least, 1))
            yield np.full(len(j), a), j, total[j]
        elif at[b] > at[a]:
            place = _spread(low[s:e], count[s:e])
            small = np.int32 if (b - a) * wide < 2**31 else np.int64
            key = np.repeat(((who[s:e] - a).astype(np.int64) * wide).astype(small), count[s:e]) + two.who[place].astype(small)
            key, pairs = _runs(key, None if plain else np.repeat(n[s:e], count[s:e]) * two.n[place], max(least, 1))
            yield a + key // wide, key % wide, pairs
        a = b


def _runs(key: np.ndarray, weight: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys whose number, or sum of weights, is ``least`` or more, with it."""
    heads = lambda k: np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if weight is not None:
        order = np.argsort(key, kind="stable")
        key, first = key[order], heads(key[order])
        pairs = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)
        kept = pairs >= least
        return key[first][kept].astype(np.int64), pairs[kept]
    key.sort()
    kept = key[: max(len(key) - least + 1, 0)]
    kept = kept[key[least - 1 :] == kept]
    first = heads(kept)
    return kept[first].astype(np.int64), np.diff(np.append(first, len(kept))) + least - 1


def _found(one: Side, two: Side | None, window_s: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_strips``, without ``two`` of a group with itself: then each pair once, and a class of several wallets with itself."""
    for i, j, pairs in _strips(one, two or one, window_s, least):
        if two is None:
            kept = (i < j) | ((i == j) & (one.size[i] > 1))
            i, j, pairs = i[kept], j[kept], pairs[kept]
        if len(i):
            yield i, j, pairs


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least place of each place's component, after the edges (a, b)."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BATCH], pa.int64()) for x in columns], names)


def _as_pairs(one: Side, two: Side | None, window_s: int, least: int) -> Iterator[pa.RecordBatch]:
    for i, j, pairs in _found(one, two, window_s, least):
        u, v = one.ids[i], (two or one).ids[j]
        yield from _batches(["w1", "w2", "pairs"], np.minimum(u, v), np.maximum(u, v), pairs)


def _as_links(one: Side, two: Side | None, window_s: int, least: int) -> Iterator[pa.RecordBatch]:
    """(class, near, related, coordinated): sums over the cell, and one class of the component that the cell shows."""
    ids, size = (one.ids, one.size) if two is None else (np.concatenate([one.ids, two.ids]), np.concatenate([one.size, two.size]))
    label, related, coordinated = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for i, j, pairs in _found(one, two, window_s, least):
        j = j if two is None else j + len(one.ids)
        for u, v in ((i, j), (j, i)):
            mine = (u != v) | (u is i)  # a class with itself is told once
            others = (size[v] - (u == v)) * mine
            np.add.at(related, u, others)
            np.add.at(coordinated, u, others * pairs)
        label = joined_labels(label, i, j)
    kept = np.flatnonzero(related)
    yield from _batches(["class", "near", "related", "coordinated"], ids[kept], ids[label[kept]], related[kept], coordinated[kept])


def _as_lists(one: Side, two: Side | None, window_s: int, least: int) -> Iterator[pa.RecordBatch]:
    """(class, related, coordinated, others): sums and wallets, a class's own among them, in one row or more."""
    other = two or one

    def rows(a: Side, b: Side, u: np.ndarray, v: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(u, kind="stable")
        u, v, pairs = u[order], v[order], pairs[order]
        upto, s = np.cumsum(b.size[v]), 0
        while s < len(u):
            e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + WAITING, "right")))
            x, y, p = u[s:e], v[s:e], pairs[s:e]
            heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            told, sizes = b.size[y], b.size[y] - ((x == y) if a is b else 0)
            values = b.wallets[_spread(b.first[y], told)]
            ends = np.append(np.concatenate([[0], np.cumsum(told)])[heads], told.sum())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
            sums = [pa.array(np.add.reduceat(z, heads), pa.int64()) for z in (sizes, sizes * p)]
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[x[heads]], pa.int64()), *sums, lists], ["class", "related", "coordinated", "others"])
            s = e

    def written(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        i, j, pairs = (np.concatenate(x) for x in zip(*held))
        if two is not None:
            yield from rows(one, other, i, j, pairs)
            yield from rows(other, one, j, i, pairs)
        else:
            back = i != j
            yield from rows(one, one, np.concatenate([i, j[back]]), np.concatenate([j, i[back]]), np.concatenate([pairs, pairs[back]]))

    held, waiting = [], 0
    for strip in _found(one, two, window_s, least):
        held.append(strip)
        waiting += len(strip[0])
        if waiting >= WAITING:
            yield from written(held)
            held, waiting = [], 0
    if held:
        yield from written(held)


def _cells(form: Callable, window_s: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, list[dict]] = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                cells[row["cell"]].append(row)
        for cell in sorted(cells):
            rows = cells.pop(cell)
            groups = sorted({r["g"] for r in rows})
            sides = [_side([r for r in rows if r["g"] == g]) for g in groups]
            if len(sides) == 2:
                yield from form(*sides, window_s, least)
            elif rows[0]["alone"]:
                yield from form(sides[0], None, window_s, least)

    return run


def _run(seconds: DataFrame, who: DataFrame, form: Callable, schema: str, window_s: int, least: int) -> DataFrame:
    """``form`` of every cell; ``seconds(wallet, t, n)`` of one wallet of each class, and ``members``."""
    trades = seconds.where("wallet is not null and t is not null")
    rows = trades.count()
    k = max(1, min(GROUPS, -(-rows // FEW_ROWS)), -(-rows // GROUP_ROWS))
    group = lambda name: F.pmod(F.xxhash64(c(name).cast("long")), F.lit(k)).cast("int").alias("g")
    long = lambda name: c(name).cast("long")
    kinds = trades.select(group("wallet"), F.lit(0).alias("kind"), long("wallet").alias("a"), long("t").alias("b"), long("n").alias("n"))
    kinds = kinds.unionByName(who.select(group("class"), F.lit(1).alias("kind"), long("class").alias("a"), long("wallet").alias("b"), F.lit(1).cast("long").alias("n")))
    packed = kinds.mapInArrow(_packed, "g int, kind int, a binary, b binary, n binary")
    met = packed.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    cell = (F.least("g", "h") * k + F.greatest("g", "h")).alias("cell")
    sent = met.select(cell, (c("g") == c("h")).alias("alone"), "g", "kind", "a", "b", "n").repartition(k * (k + 1) // 2, "cell")
    return sent.mapInArrow(_cells(form, window_s, least), schema)


def class_pairs(seconds: DataFrame, who: DataFrame, window_s: int, least: int) -> DataFrame:
    """(w1, w2, pairs) of classes with ``least`` pairs or more, a class with itself where it has several wallets."""
    return _run(seconds, who, _as_pairs, "w1 long, w2 long, pairs long", window_s, least)


def class_links(seconds: DataFrame, who: DataFrame, window_s: int, least: int) -> DataFrame:
    """(class, near, related, coordinated), a row a class and cell: related wallets, sum of their pairs, and a class of the same component."""
    return _run(seconds, who, _as_links, "class long, near long, related long, coordinated long", window_s, least)


def class_lists(seconds: DataFrame, who: DataFrame, window_s: int, least: int) -> DataFrame:
    """(class, related, coordinated, others), some rows a class: as ``class_links``, with the related wallets and the class's own."""
    return _run(seconds, who, _as_lists, "class long, related long, coordinated long, others array<long>", window_s, least)
