"""Connected components of an edge table, by alternating large and small stars.

Edges are first reduced to a spanning forest within each task, and those forests
once more in tasks of about ``TASK`` edges; if one task holds them all, that is the
result.  Otherwise rounds follow.  A round is two steps, each an aggregation and a join on node ids; a hub with any number of
neighbours is reduced before the shuffle, and the join of a hot node can be split
among tasks, as a write follows it.  Each step counts what it changes while it is
written to the shared folder, so that no further job has to find the end, and its
predecessor's table is deleted.

Cases: loops and repeated edges change nothing; edges with a null end are
ignored; an empty table has no components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.sources.scratch import forget, written

#: Edges that a task holds before it reduces them, and nodes before it sends its forest on.
HELD = 1 << 20
TASK = 1 << 16


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and the smallest node that each is connected to."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: u.size], at[u.size :]
    root = np.arange(nodes.size)
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def forest(batches):
    """Edges (u, v) of a task as stars: (smallest node, other node) for each component among them."""

    def star(u, v):
        nodes, root = _roots(u, v)
        other = nodes != root
        return root[other], nodes[other]

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(u, v):
        return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    for batch in batches:
        u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        held.append((u, v))
        size += u.size
        if size > 2 * HELD:
            u, v = star(*(np.concatenate(x) for x in zip(*held)))
            if u.size > HELD:
                yield out(u, v)
                u = v = np.zeros(0, np.int64)
            held, size = [(u, v)], u.size
    if size:
        yield out(*star(*(np.concatenate(x) for x in zip(*held))))


def _distinct(batches):
    """Edges without repeats within a batch."""
    for batch in batches:
        u, v, moved = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if u.size:
            order = np.lexsort((v, u))
            u, v, moved = u[order], v[order], moved[order]
            first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
            yield pa.record_batch({"u": pa.array(u[first]), "v": pa.array(v[first]), "moved": pa.array(np.maximum.reduceat(moved, np.flatnonzero(first)))})


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of node and neighbours."""
    near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).cast("int").alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    # the smallest neighbour's own row links the node
    end = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return moved.select(end.alias("u"), F.col("m").alias("v"), (F.col("v") > F.col("m")).cast("int").alias("moved"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for each node of an edge; ``component`` is the smallest node reachable."""
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v")
    now = written(now.mapInArrow(forest, "u long, v long"), "star", n=F.count(F.lit(1)))
    tasks = -(-now.observed["n"] // TASK)
    if tasks:
        last, now = now, written(now.coalesce(tasks).mapInArrow(forest, "u long, v long"), "star")
        forget(last)
    still = 0 if tasks > 1 else 2  # steps without a change, one after the other
    step = _large_star
    while still < 2:
        last, now = now, written(step(now).mapInArrow(_distinct, "u long, v long, moved int"), "star", moved=F.sum("moved"))
        still = 0 if now.observed["moved"] else still + 1
        forget(last)
        step = _small_star if step is _large_star else _large_star
    # each edge now leads from a node to its centre, either way round
    now = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    nodes = now.distinct() if tasks > 1 else now
    return nodes.unionAll(now.select(F.col("component").alias("node"), "component").distinct())


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (node, component) after components ``more`` (node, component) of its components."""
    up = more.select(F.col("node").alias("component"), F.col("component").alias("up"))
    return labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
