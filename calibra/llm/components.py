"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import map_arrow, materialise

#: Links that one task may settle.
LOCAL = 1 << 20


def forest(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links a-b, by hooking and pointer jumping.

    ``label`` is what came of earlier links; it is changed. So links can be taken in chunk by chunk.
    """
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        far = la != lb
        if not far.any():
            break
        a, b, la, lb = a[far], b[far], la[far], lb[far]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(jumped := label[label], label):
            label[:] = jumped
    return label


def stars(work: Callable, most: int = 1 << 16) -> Callable:
    """``work``, a generator of links {a, b}, with its links contracted as they come: stars around the smallest node of
    about ``most`` links at a time, as connected as before.

    It runs in the worker that makes the links. A mapInArrow of its own would take a second Python worker a task, and
    idle workers keep the memory that later operators take in them.
    """

    def run(batches):
        held, count = [], 0
        for links in chain(work(batches), [None]):
            if links is not None and len(links["a"]):
                held.append([np.asarray(links[c], dtype=np.int64) for c in ("a", "b")])
                count += len(links["a"])
            if held and (links is None or count >= most):
                a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
                nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = forest(place[: len(a)], place[len(a) :], len(nodes))
                leaf = np.flatnonzero(label != np.arange(len(nodes)))
                yield {"a": nodes[leaf], "b": nodes[label[leaf]]}
                held, count = [], 0

    return run


def settled(links: DataFrame) -> DataFrame:
    """(node, component) of links that fit in one task."""

    def work(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            yield {"node": nodes, "component": nodes[forest(place[: len(a)], place[len(a) :], len(nodes))]}

    return map_arrow(links.coalesce(1), work, "node long, component long")


def connected_components(links: DataFrame, most_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """links (a, b) -> (node, component): every node of a link, with the smallest node that it reaches.

    Links to null and to oneself count as none. ``local`` links or fewer, 16 MB, are settled by one task; more go through
    rounds of joins, until they are as few or nothing changes. Each step of a round is written to the shared folder, so a
    lost executor costs a step at most, and joins are of two tables, whose hot keys (a star's centre) Spark can split.
    Nothing is collected but a count and a sum a round.
    """
    pairs = links.select(F.col(links.columns[0]).cast("long").alias("a"), F.col(links.columns[1]).cast("long").alias("b")).dropna().where("a <> b")
    edges = materialise(pairs)
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] <= local:
            return settled(edges)
        if state == before:
            break
        before = state
        both = edges.union(edges.select("b", "a"))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # in each link b is the smaller; the smallest such neighbour of a node takes the node and its other neighbours
        hub = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(hub, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialise(small)
    else:
        raise RuntimeError("components didn't settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b"), F.col("b")).distinct())
