"""Label propagation over a large graph, with the result of visiting its nodes one by one in sorted order.

A node depends in a sweep only on the new labels of smaller neighbours and the
old ones of larger, so nodes whose longest chain of smaller neighbours is as
long (their level) are visited at once.  Nodes are numbered in sorted order;
the links of a block of nodes are one row of arrays, written once and read by
level.  Tasks hold the labels of all nodes as 32-bit numbers and return the
changed ones; a node without a changed neighbour is left out, as it would vote
as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.shared import numbered, save

#: Bounds: nodes that every task can hold labels of, levels, links of a block, links dealt at once, grades that fit a key.
DENSE, LEVELS, BLOCK, DEALT, GRADES = 1 << 24, 32, 500_000, 2_000_000, 1 << 15
_NUMBER, _GRADE = (1 << 24) - 1, GRADES - 1
_ROW = "block int, links long, nodes binary, counts binary, near binary, grades binary"
_CHANGED = "n int, who binary, what binary"


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            of = lambda name: batch.column(at[name])[i].as_py()
            n, counts = of("links"), np.frombuffer(of("counts"), np.int32)
            yield of("block"), n, np.frombuffer(of("nodes"), np.int32), counts, _unpack(of("near"), np.int32, n), _unpack(of("grades"), np.int16, n)


def _row(block: int, key: np.ndarray) -> pa.RecordBatch:
    """A block from sorted keys of node, neighbour and grade."""
    node = (key >> 39).astype(np.int32)
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    counts = np.diff(np.r_[start, len(node)]).astype(np.int32)
    near, grades = ((key >> 15) & _NUMBER).astype(np.int32), (key & _GRADE).astype(np.int16)
    data = [[block], [len(node)], [node[start].tobytes()], [counts.tobytes()], [_pack(near)], [_pack(grades)]]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], names=["block", "links", "nodes", "counts", "near", "grades"])


def _sorted(key: np.ndarray, once: bool) -> np.ndarray:
    key.sort()
    return key[np.r_[True, key[1:] != key[:-1]]] if once else key


def _blocks(ends: DataFrame, starts: np.ndarray, codes: Broadcast | None, once: bool) -> DataFrame:
    """Links both ways of ``a, b, grade``, one row a block; ``codes`` tells the numbers of ends that are none yet."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            a, b, g = (np.concatenate([h[i] for h in held]) for i in range(3))
            if codes is not None:
                a, b = np.searchsorted(codes.value, a), np.searchsorted(codes.value, b)
            key = _sorted(np.concatenate([a << 39 | b << 15 | g, b << 39 | a << 15 | g]), once)
            cut = np.r_[np.searchsorted(key, starts.astype(np.int64) << 39), len(key)]
            for i in np.flatnonzero(np.diff(cut)):
                yield _row(int(i), key[cut[i]:cut[i + 1]])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= DEALT:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for block, _, nodes, counts, near, g in _rows(batches):
            if block != now and held:
                yield _row(now, _sorted(np.concatenate(held), once))
                held = []
            now = block
            held.append(np.repeat(nodes.astype(np.int64) << 39, counts) | near.astype(np.int64) << 15 | g)
        if held:
            yield _row(now, _sorted(np.concatenate(held), once))

    parts = min(len(starts), max(4 * ends.sparkSession.sparkContext.defaultParallelism, len(starts) // 8))
    dealt = ends.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("grade").cast("long")).mapInArrow(deal, _ROW)
    return save(dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(gather, _ROW), "blocks", "block")


def _ask(blocks: DataFrame, of: np.ndarray, visit: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with a new value, and the values, of the given blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, nodes, counts, near, grades in _rows(batches):
            who, what = visit(nodes, counts, near, grades)
            if len(who):
                packed = [pa.array([_pack(x.astype(np.int32))], pa.binary()) for x in (who, what)]
                yield pa.RecordBatch.from_arrays([pa.array([len(who)], pa.int32()), *packed], names=["n", "who", "what"])

    rows = blocks.where(F.col("block").isin([int(b) for b in of])).mapInArrow(run, _CHANGED).toArrow()
    counts, *both = (rows.column(i).to_pylist() for i in range(3))
    none = [np.empty(0, np.int32)]
    who, what = (np.concatenate(none + [_unpack(x, np.int32, n) for x, n in zip(packed, counts)]) for packed in both)
    return who, what


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts, dtype=np.int64) - counts


def _levels(blocks: DataFrame, n: int, block_of: np.ndarray) -> np.ndarray | None:
    """Level of each node; none if there are more than ``LEVELS``."""
    sc = blocks.sparkSession.sparkContext
    level, some = np.zeros(n, np.int8), np.unique(block_of)
    for _ in range(LEVELS + 1):
        held = sc.broadcast(level)

        def visit(nodes, counts, near, grades):
            below = near < np.repeat(nodes, counts)
            new = np.maximum.reduceat(np.where(below, held.value[near] + np.int8(1), np.int8(0)), _starts(counts))
            other = new != held.value[nodes]
            return nodes[other], new[other]

        who, what = _ask(blocks, some, visit)
        held.destroy()
        if not len(who):
            return level
        level[who] = what
    return None


def _vote(labels: np.ndarray, use: np.ndarray, nodes: np.ndarray, counts: np.ndarray, near: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The label of the largest total grade, the smallest of equals, of the nodes in ``use`` that get another."""
    links = np.repeat(use, counts)
    key = np.repeat(np.arange(len(nodes), dtype=np.int64), counts)[links] << 39
    key |= labels[near[links]].astype(np.int64) << 15
    key |= grades[links]
    key.sort()
    group = key >> 15
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    total, group = np.add.reduceat(key & _GRADE, start), group[start]
    at = group >> 24
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    best = np.maximum.reduceat((total << 24) | (_NUMBER - (group & _NUMBER)), first)
    who, what = nodes[at[first]], _NUMBER - (best & _NUMBER)
    other = what != labels[who]
    return who[other], what[other]


def sweep(blocks: DataFrame, n: int, block_of: np.ndarray, sweeps: int) -> np.ndarray | None:
    """The label of each node, itself a node's number; none if the graph is too deep."""
    sc = blocks.sparkSession.sparkContext
    level = _levels(blocks, n, block_of)
    if level is None:
        return None
    depth = int(level.max()) + 1
    some = [np.unique(block_of[level == k]) for k in range(depth)]
    levels = sc.broadcast(level)
    labels, changed = np.arange(n, dtype=np.int32), np.zeros(n, np.int16)
    seen, now = [-1] * depth, 0
    for _ in range(sweeps):
        still = True
        for k in range(depth):
            now += 1
            fresh, seen[k] = changed > seen[k], now - 1
            if not fresh.any():
                continue
            held = sc.broadcast((labels, fresh))

            def visit(nodes, counts, near, grades, k=k, held=held):
                known, new = held.value
                use = (levels.value[nodes] == k) & np.logical_or.reduceat(new[near], _starts(counts))
                return _vote(known, use, nodes, counts, near, grades) if use.any() else (nodes[:0], nodes[:0])

            who, what = _ask(blocks, some[k], visit)
            held.destroy()
            if len(who):
                labels[who], changed[who], still = what, now, False
        if still:
            break
    levels.destroy()
    return labels


def propagated(ends: DataFrame, sweeps: int, once: bool = False) -> DataFrame | None:
    """``node, community, size`` of links ``a, b, grade`` between nodes of any ordered type.

    Longs, which are not negative, are numbered by search in a sorted array,
    other types by joins.  ``once`` takes equal links one time.  None if the
    graph is beyond the bounds of this form.
    """
    spark = ends.sparkSession
    sc = spark.sparkContext
    long = dict(ends.dtypes)["a"] == "bigint"
    low, least, most = ends.agg(F.min(F.least("a", "b")), F.min("grade"), F.max("grade")).first()
    if least is None or least < 0 or most >= GRADES or long and low < 0:
        return None
    both = ends.select(F.col("a").alias("node")).unionAll(ends.select("b"))
    ranked = numbered(both.groupBy("node").agg(F.count("*").alias("degree")), F.col("node"))
    n = ranked.count()
    if n > DENSE:
        return None
    degree, codes = _collected(ranked, n, long)
    block_of = _starts(degree) // BLOCK
    starts = np.flatnonzero(np.r_[True, block_of[1:] != block_of[:-1]])
    block_of = np.repeat(np.arange(len(starts), dtype=np.min_scalar_type(len(starts))), np.diff(np.r_[starts, n]))
    del degree
    if codes is None:
        of = lambda end: ranked.select(F.col("node").alias(end), F.col("no").alias(f"{end}_no"))
        ends = ends.join(of("a"), "a").join(of("b"), "b").select(F.col("a_no").alias("a"), F.col("b_no").alias("b"), "grade")
    else:
        codes = sc.broadcast(codes)
    blocks = _blocks(ends, starts, codes, once)
    if codes is not None:
        codes.destroy()
        codes = None
    labels = sweep(blocks, n, block_of, sweeps)
    if labels is None:
        return None
    size, first, place = np.bincount(labels, minlength=n), np.empty(n, np.int32), np.empty(n, np.int32)
    first[labels[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)
    found = np.flatnonzero(size)
    found = found[np.lexsort((first[found], -size[found]))]
    place[found] = np.arange(len(found), dtype=np.int32)
    of_node, sizes = sc.broadcast(place[labels]), sc.broadcast(size[found])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = of_node.value[batch.column(1).to_numpy()]
            some, where = np.unique(c, return_inverse=True)
            names = pa.array([f"c{x}" for x in some], pa.string()).take(pa.array(where))
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(sizes.value[c])], names=["node", "community", "size"])

    kind = ranked.schema["node"].dataType.simpleString()
    return ranked.select("node", "no").mapInArrow(name, f"node {kind}, community string, size long")


def _collected(ranked: DataFrame, n: int, long: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Links and codes of all nodes by number; a partition at a time, as the driver has room for little more than these."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=[f"c{i}" for i in range(len(arrays))])

    rows = ranked.select("no", F.col("degree").cast("long"), *(["node"] if long else []))
    degree, codes = np.empty(n, np.int64), np.empty(n, np.int64) if long else None
    for row in rows.mapInArrow(pack, ", ".join(f"c{i} binary" for i in range(3 if long else 2))).toLocalIterator():
        no = np.frombuffer(row[0], np.int64)
        degree[no] = np.frombuffer(row[1], np.int64)
        if long:
            codes[no] = np.frombuffer(row[2], np.int64)
    return degree, codes
