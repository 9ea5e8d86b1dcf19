"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many fixed random lines.  On each line a query collides
with what lies in a window centred at it; a pair whose cosine reaches the threshold is
close in space, so it collides on almost all lines, and a pair of unrelated vectors on
few.  Pairs that collide often enough are verified by their cosine in double precision.
The window is ``WIDTH`` standard deviations of a threshold pair's distance on a line; the
least count is the largest that threshold pairs reach with probability ``RECALL`` (a
binomial tail), so pairs above the threshold are found with a greater one.

Vectors are compared within a group (label and dimension).  Equal vectors collapse to one
node with a multiplicity first.  Nodes are sorted by group and their place on the first
line by a range partitioning, so a hot group spreads over many tasks, and cut into
blocks.  Two blocks meet in a task if their ranges on the first line come within reach.
There the lines are counted tile by tile, in stages that drop hopeless pairs early; what leaves the
task is not the pairs but, per node, its number of links, and a spanning forest of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components and
vectors with a null label link with nothing; equal vectors of a group link with each other
(repeated rows too); a null id is counted as a link and names a component only if all
its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.components import components
from stratafold.scratch import materialize

THRESHOLD = 0.93
#: Lines in all, lines of the stages, window in standard deviations, wanted recall at the threshold.
LINES = 48
STAGES = (8, 20, LINES)
WIDTH = 2.4
RECALL = 0.998
#: Reach on the first line, which prunes pairs of blocks, in standard deviations.
REACH = 4.0
#: Nodes of a block and of a tile at most.
BLOCK = 8192
TILE = 1024


@lru_cache(maxsize=8)
def lines(dimension: int) -> np.ndarray:
    """Random directions, one column each; the same everywhere."""
    return np.random.default_rng([977, dimension]).standard_normal((dimension, LINES))


def deviation(threshold: float) -> float:
    """Standard deviation of the distance on a line of two unit vectors with that cosine."""
    return math.sqrt(2 - 2 * threshold)


@lru_cache(maxsize=8)
def least_counts(recall: float = RECALL) -> tuple[int, ...]:
    """By stage the largest count that a threshold pair misses with its share of 1 - recall."""
    hit = math.erf(WIDTH / math.sqrt(2))
    found = []
    for n in STAGES:
        tail, least = 0.0, n
        while least >= 0:
            tail += math.comb(n, least) * hit**least * (1 - hit) ** (n - least)
            if tail >= 1 - (1 - recall) / len(STAGES):
                break
            least -= 1
        found.append(max(0, least))
    return tuple(found)


def near_pairs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked rows of x and y (unit vectors) with their places on the lines."""
    window, least = WIDTH * deviation(threshold), least_counts()
    count = np.zeros((len(x), len(y)), np.uint8)
    for k in range(STAGES[0]):
        count += np.abs(px[:, k, None] - py[None, :, k]) <= window
    i, j = np.nonzero(count >= least[0])
    count = count[i, j]
    for before, after, need in zip(STAGES, STAGES[1:], least[1:], strict=False):
        count = count + (np.abs(px[i, before:after] - py[j, before:after]) <= window).sum(axis=1)
        keep = count >= need
        i, j, count = i[keep], j[keep], count[keep]
    keep = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], y[j[a : a + 65536]]) >= threshold for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index of each node's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a node's place on the first line; columns: node, label, embedding, copies."""
    for batch in batches:
        place = []
        for v in batch.column(2):
            x = np.asarray(v.values, np.float64)
            place.append(float(x @ lines(len(x))[:, 0]) / float(np.linalg.norm(x)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.float64())], names=[*batch.schema.names, "place"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted nodes (node, label, size, place, copies, embedding) -> blocks of one label and size."""
    waiting: list[tuple] = []

    def block() -> pa.RecordBatch:
        node, label, size, place, copies, vector = zip(*waiting, strict=True)
        row = (label[0], size[0], place[0], place[-1], np.array(node, np.int64).tobytes(), np.array(copies, np.int64).tobytes(), b"".join(vector))
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["label", "size", "low", "high", "nodes", "copies", "vectors"])

    kinds = None
    for batch in batches:
        kinds = kinds or [batch.column(1).type, pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        rows = zip(*(batch.column(k).to_pylist() for k in range(5)), (np.asarray(v.values, np.float64).tobytes() for v in batch.column(5)), strict=True)
        for row in rows:
            if waiting and (row[1:3] != waiting[0][1:3] or len(waiting) >= BLOCK):
                yield block()
            waiting.append(row)
    if waiting:
        yield block()


def _met(threshold: float):
    """Mapper over pairs of blocks -> (node, links) and forest edges (node, other)."""

    def unit(nodes: bytes, copies: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, copies = np.frombuffer(nodes, np.int64), np.frombuffer(copies, np.int64)
        x = np.frombuffer(vectors, np.float64).reshape(len(nodes), -1)
        return nodes, copies, x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, *payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes, copies, x = unit(*payload[:3])
                others, weights, y = (nodes, copies, x) if same else unit(*payload[3:])
                px, py = x @ lines(x.shape[1]), y @ lines(y.shape[1])
                links, back = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                ends: list[list[np.ndarray]] = [[], []]
                reach = REACH * deviation(threshold)
                for a in range(0, len(x), TILE):
                    for b in range(a if same else 0, len(y), TILE):
                        s, t = slice(a, a + TILE), slice(b, b + TILE)
                        if px[s, 0].min() > py[t, 0].max() + reach or py[t, 0].min() > px[s, 0].max() + reach:
                            continue
                        i, j = near_pairs(x[s], y[t], px[s], py[t], threshold)
                        i, j = i + a, j + b
                        if same and a == b:
                            i, j = i[i < j], j[i < j]
                        np.add.at(links, i, weights[j])
                        np.add.at(back, j, copies[i])
                        root = _forest(i, j + len(x), len(x) + len(y))
                        moved = np.flatnonzero(root != np.arange(len(root)))
                        ends[0].append(moved)
                        ends[1].append(root[moved])
                both = np.concatenate((nodes, others))
                u, v = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)
                have = np.concatenate((links, back))
                at = np.flatnonzero(have)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((both[at], both[u]))),
                        pa.concat_arrays([pa.array(have[at]), pa.nulls(len(u), pa.int64())]),
                        pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(both[v])]),
                    ],
                    names=["node", "links", "other"],
                )

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = materialize(rows.withColumn("usable", usable), "vectors-rows")
    grouped = rows.where("usable").groupBy("label", "embedding").agg(F.min("rid").alias("node"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = materialize(grouped, "vectors-nodes")
    shape = nodes.select("node", "label", "embedding", "copies")
    placed = materialize(shape.mapInArrow(_placed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.schema.fields) + ", place double"), "vectors-placed")
    sorted_nodes = placed.select("node", "label", F.size("embedding").alias("size"), "place", "copies", "embedding")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_nodes = sorted_nodes.repartitionByRange(parts, "label", "size", "place", "node").sortWithinPartitions("label", "size", "place", "node")
    kind = rows.schema["label"].dataType.simpleString()
    blocks = sorted_nodes.mapInArrow(_blocks, f"label {kind}, size int, low double, high double, nodes binary, copies binary, vectors binary")
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "vectors-blocks")
    ends = blocks.select("block", "label", "size", "low", "high")
    x, y = ends.alias("x"), ends.alias("y")
    reach = F.lit(REACH * deviation(threshold))
    near = (F.col("x.low") <= F.col("y.high") + reach) & (F.col("y.low") <= F.col("x.high") + reach)
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.block") <= F.col("y.block")) & near)
    pairs = pairs.select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    side = lambda k: blocks.select(F.col("block").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("nodes", "copies", "vectors")))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select((F.col("a") == F.col("b")).alias("same"), *(f"{k}_{c}" for k in "ab" for c in ("nodes", "copies", "vectors")))
    met = materialize(joined.mapInArrow(_met(threshold), "node bigint, links bigint, other bigint"), "vectors-met")
    links = met.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(met.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "vectors-components")
    facts = nodes.select("node", "first_id", "copies").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = materialize(facts, "vectors-facts")
    names = facts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    facts = facts.join(names, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = nodes.select("node", "label", "embedding").join(facts, "node").drop("node").withColumn("usable", F.lit(True))
    done = rows.join(known, ["label", "embedding", "usable"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
