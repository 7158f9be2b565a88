"""Gradient-boosted trees for two classes, grown best leaf first, from histograms that are summed in tasks and added up by Spark.

Columns are binned once: up to `bins` ranges by approximate quantiles, and a bin of its own for missing values, which a split sends to the side that gains more. A pass over the rows gives each one its node and sums gradients, curvatures and rows by node, column and bin; a cell's sums go to the
driver, whatever the number of rows: at most 2 * leaves * columns * 256 of them. Best first needs the gain of a split's halves before the next split is chosen; so a pass takes all nodes that the choice among the known splits would reach, and passes end when the choice meets no unknown
node: about as many as the tree is deep. Rows keep the sum of the trees before, written anew every REWRITE trees; those since then are added in the pass.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import discard, materialize

MISSING = 255
#: Trees after which the rows' sums are written anew, and the least curvature of a leaf.
REWRITE, LEAST_CURVATURE = 10, 1e-3


@dataclass
class Node:
    """A node of a tree: its sums, its best split once it is known, and its children's numbers once it is split."""

    g: float
    h: float
    n: int
    gain: float | None = None
    column: int = 0
    bin: int = 0
    missing_left: bool = False
    sums: tuple = ()
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def places(self, x: np.ndarray, chosen: set[int] | None = None) -> np.ndarray:
        """The node that each row of bins ends in; chosen: the only nodes that count as split."""
        at = np.zeros(len(x), dtype=np.int32)
        for i, node in enumerate(self.nodes):  # children come after their parents
            if node.left >= 0 and (chosen is None or i in chosen):
                here = np.flatnonzero(at == i)
                own = x[here, node.column]
                left = np.where(own == MISSING, node.missing_left, own <= node.bin)
                at[here] = np.where(left, node.left, node.right)
        return at


@dataclass(frozen=True)
class Grown:
    """A finished tree: what evaluation needs."""

    tree: Tree
    chosen: frozenset[int]
    values: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.values[self.tree.places(x, self.chosen)]


@dataclass(frozen=True)
class Boosting:
    """Parameters, and fit()."""

    iterations: int = 100
    leaves: int = 15
    least_rows: int = 50
    rate: float = 0.1
    l2: float = 1.0
    bins: int = 255

    def fit(self, rows: DataFrame, columns: list[str], label: str = "label") -> Model:
        shares = [i / self.bins for i in range(1, self.bins)]
        clean = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y"))
        seen = clean.agg(F.count("*").alias("n"), F.sum("y").alias("p"), *[F.percentile_approx(f"c{i}", shares, 10_000).alias(f"c{i}") for i in range(len(columns))]).first()
        edges = [np.unique(np.array(seen[f"c{i}"] or [], dtype=np.float64)) for i in range(len(columns))]
        n, positive = seen["n"], seen["p"] or 0.0
        prior = min(max(positive / max(1, n), 1e-9), 1 - 1e-9)
        model = Model(edges, math.log(prior / (1 - prior)), [])
        start = model.prior

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _bins(edges, [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(edges))])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(len(edges)), pa.array(np.full(len(x), start))], names=["x", "y", "raw"])

        held, written = materialize(clean.mapInArrow(binned, "x binary, y double, raw double"), "binned"), 0
        for turn in range(self.iterations if n else 0):
            if turn - written == REWRITE:
                after = materialize(held.mapInArrow(_advanced(model.trees[written:], len(columns)), "x binary, y double, raw double"), "binned")
                discard(held)
                held, written = after, turn
            model.trees.append(self._grown(held, model.trees[written:], len(columns)))
        discard(held)
        return model

    def _grown(self, held: DataFrame, pending: list[Grown], width: int) -> Grown:
        tree, unknown = Tree(), [0]
        while unknown:
            cells = held.mapInArrow(_histograms(tree, unknown, pending, width), "cell long, g double, h double, n long").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()
            sums = np.zeros((3, len(unknown), width, MISSING + 1))
            if cells:
                at = np.array([r[0] for r in cells])
                sums.reshape(3, -1)[:, at] = np.array([[r[1], r[2], r[3]] for r in cells]).T
            if not tree.nodes:
                tree.nodes.append(Node(*(float(s[0, 0].sum()) for s in sums[:2]), int(sums[2, 0, 0].sum())))
            for k, i in enumerate(unknown):
                self._split(tree.nodes[i], sums[:, k])
            chosen, unknown = self._choose(tree)
        values = np.array([-self.rate * node.g / (node.h + self.l2) for node in tree.nodes])
        return Grown(tree, frozenset(chosen), values)

    def _split(self, node: Node, sums: np.ndarray) -> None:
        """The split of a node that gains most: the first column, bin and side of equals."""
        score = lambda g, h: g * g / (h + self.l2)
        node.gain = 0.0
        for c in range(sums.shape[1]):
            below, lost = np.cumsum(sums[:, c, :MISSING], axis=1), sums[:, c, MISSING]
            for missing_left in (False, True):
                left = below + lost[:, None] * missing_left
                right = np.array([node.g, node.h, node.n])[:, None] - left
                fair = (left[2] >= self.least_rows) & (right[2] >= self.least_rows) & (left[1] >= LEAST_CURVATURE) & (right[1] >= LEAST_CURVATURE)
                gains = np.where(fair, score(left[0], left[1]) + score(right[0], right[1]) - score(node.g, node.h), -np.inf)
                best = int(np.argmax(gains))
                if gains[best] > node.gain + 1e-12:
                    node.gain, node.column, node.bin, node.missing_left, node.sums = float(gains[best]), c, best, missing_left, tuple(left[:, best])
                if not lost[2]:
                    break

    def _choose(self, tree: Tree) -> tuple[set[int], list[int]]:
        """Nodes to split, best first, up to `leaves` leaves, by the gains that are known; and the nodes that this choice reaches but does not know."""
        chosen, unknown, heap, leaves = set(), [], [], 1
        reach = lambda i: unknown.append(i) if tree.nodes[i].gain is None else heapq.heappush(heap, (-tree.nodes[i].gain, i)) if tree.nodes[i].gain > 0 else None
        reach(0)
        while heap and leaves < self.leaves:
            i = heapq.heappop(heap)[1]
            node = tree.nodes[i]
            if node.left < 0:
                g, h, n = node.sums
                node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
                tree.nodes += [Node(float(g), float(h), round(n)), Node(float(node.g - g), float(node.h - h), round(node.n - n))]
            chosen.add(i)
            leaves += 1
            for child in (node.left, node.right):
                if tree.nodes[child].n < 2 * self.least_rows:
                    tree.nodes[child].gain = 0.0
                reach(child)
        return chosen, unknown


@dataclass
class Model:
    """Bin edges by column, the prior's log odds, and the trees."""

    edges: list[np.ndarray]
    prior: float
    trees: list[Grown]

    def score(self, df: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
        """df with the probability of class 1."""
        edges, prior, trees = self.edges, self.prior, self.trees

        @F.pandas_udf("double")
        def probability(*given: pd.Series) -> pd.Series:
            x = _bins(edges, [s.to_numpy(dtype=np.float64, na_value=np.nan) for s in given])
            return pd.Series(1 / (1 + np.exp(-sum((t.of(x) for t in trees), np.full(len(x), prior)))))

        return df.withColumn(name, probability(*[F.col(c).cast("double") for c in columns]))


def _bins(edges: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Rows of bins: how many edges of its column are below each value, MISSING for NaN."""
    out = np.empty((len(columns[0]), len(columns)), dtype=np.uint8)
    for i, (own, values) in enumerate(zip(edges, columns)):
        values = np.asarray(values, dtype=np.float64)
        out[:, i] = np.where(np.isnan(values), MISSING, np.searchsorted(own, values, side="left"))
    return out


def _advanced(pending: list[Grown], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, raw = _rows(batch, pending, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw)], names=["x", "y", "raw"])

    return run


def _rows(batch: pa.RecordBatch, pending: list[Grown], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's bins, and its sums with those of the pending trees."""
    x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, width)
    return x, sum((t.of(x) for t in pending), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64))


def _histograms(tree: Tree, unknown: list[int], pending: list[Grown], width: int):
    """Sums of gradients, curvatures and rows by cell (unknown node, column, bin) of a task's rows."""
    place = {node: k for k, node in enumerate(unknown)}
    lookup = np.array([place.get(i, -1) for i in range(max(1, len(tree.nodes)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(unknown), width, MISSING + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, raw = _rows(batch, pending, width)
            own = lookup[tree.places(x)]
            here = np.flatnonzero(own >= 0)
            p = 1 / (1 + np.exp(-raw[here]))
            weights = p - batch.column(1).to_numpy(zero_copy_only=False)[here], p * (1 - p), np.ones(len(here))
            for c in range(width):
                cell = own[here] * (MISSING + 1) + x[here, c]
                for t, w in enumerate(weights):
                    total[t, :, c] += np.bincount(cell, w, len(unknown) * (MISSING + 1)).reshape(len(unknown), -1)
        g, h, n = total.reshape(3, -1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at]), pa.array(h[at]), pa.array(n[at].astype(np.int64))], names=["cell", "g", "h", "n"])

    return run
