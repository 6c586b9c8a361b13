"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import Scratch


CONTRACT = 500_000


def roots_of(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least index connected with each of n, by pairs (2 x m)."""
    root = np.arange(n)
    while pairs.size:
        low = np.minimum(root[pairs[0]], root[pairs[1]])
        before = root.copy()
        for end in pairs:
            np.minimum.at(root, before[end], low)
            np.minimum.at(root, end, low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links, CONTRACT at a time, as each node's link to the least that they connect it with."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b[c].to_numpy() for b in held]) for c in ("a", "b")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        root = nodes[roots_of(len(nodes), at.reshape(2, -1))]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CONTRACT:
            yield stars(held)
            held = []
    if held and sum(b.num_rows for b in held):
        yield stars(held)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node's neighbours to the least node among it and them."""
    both = edges.select("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b"))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    linked = near.join(least, "a")
    if large:
        return linked.where("b > a").selectExpr("b AS a", "low AS b").where("a <> b").distinct()
    return linked.selectExpr("b AS a", "low AS b").where("a <> b").unionByName(least.selectExpr("a", "low AS b")).distinct()


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b), where component is the least node of its component.

    A star's centre may have any number of neighbours: minima are combined before the shuffle and the join that
    follows can be split by skew. Links are first contracted within each partition, so that most of them never
    travel. Each round is written to the shared folder. Self-links and repeated links are
    ignored, except that a node with only a self-link is its own component; null ends are dropped.
    """
    scratch = Scratch(spark)
    every = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    every = scratch.keep(every.mapInArrow(_contract, "a long, b long").distinct(), "links")  # nodes without other links keep one to themselves
    now = every.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for i in range(rounds):
        now = scratch.keep(_star(_star(now, True), False), f"round{i}")
        size = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if i:
            scratch.free(f"round{i - 1}")
        if size == before:
            break
        before = size
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    nodes = every.selectExpr("a AS node").distinct()
    return nodes.join(now.selectExpr("a AS node", "b AS component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
