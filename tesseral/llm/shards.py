"""Shards of documents that are about the same.

A document is sketched by signed sums of its terms, weighted by how rare they are. A tree
of two-means splits, fitted on a sample of the sketches, has leaves of like documents, each cut
into buckets along its widest direction. Leaves and buckets in the order of the tree are the
cells; every document of the corpus is given its cell, and cells are joined, or split by a hash,
to shards of bounded size.

What is fitted on a sample is the tree and the rarity used in sketches, from about SAMPLE_DOCS
documents chosen by hash; it decides who is whose neighbour, never whether a document is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents the tree is fitted on, about; numbers in a sketch; splits from root to leaf; buckets a leaf.
SAMPLE_DOCS, DIMS, DEPTH, BUCKETS = 4096, 256, 7, 64
#: Tokens of a document that is too short to be about something.
FILLER = 64


def rarity(df_of: np.ndarray, n: float) -> np.ndarray:
    """The weight of each term by the number of the ``n`` documents that hold it."""
    return np.log1p((n - df_of + 0.5) / (df_of + 0.5))


class Sketcher:
    """Adds weighted terms up to DIMS sums, each term with a sign of its own in one of them; equal for equal weights wherever it is made."""

    def __init__(self, weights: np.ndarray, size: int) -> None:
        w = np.full(size, weights.max() if len(weights) else 1.0)  # a term the sample has not is rare
        w[: min(size, len(weights))] = weights[:size]
        # Drawn one after the other, so that a larger vocabulary only adds terms.
        self.place, self.weight = np.random.default_rng(11).integers(0, DIMS, size), np.random.default_rng(12).choice([-1.0, 1.0], size) * w

    def sketch(self, terms: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Unit vectors of the documents whose terms stand between their offsets; zero where there are none."""
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n) * DIMS, np.diff(offsets))
        out = np.bincount(doc + self.place[terms], self.weight[terms] * np.log1p(counts), n * DIMS).reshape(n, DIMS).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Cells:
    """The fitted tree: which cell a sketch belongs to."""

    def __init__(self, vectors: np.ndarray) -> None:
        rng = np.random.default_rng(7)
        vectors = vectors[np.lexsort(vectors.T[::-1])] if len(vectors) else np.zeros((1, DIMS), np.float32)
        #: Where the leaves [lo, hi) of a branch are split: {(lo, hi): mid}.
        self.mid: dict[tuple[int, int], int] = {}
        leaves = [vectors[ix] for ix in self._split(vectors, np.arange(len(vectors)), DEPTH, rng, 0)]
        self.centres = np.stack([x.mean(axis=0) for x in leaves])
        self.centres /= np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-9)
        self.axes = np.stack([np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0] for x in leaves]).astype(np.float32)
        along = [x @ a for x, a in zip(leaves, self.axes)]
        self.edges = np.stack([np.quantile(a, np.arange(1, BUCKETS) / BUCKETS) for a in along])

    def _split(self, v: np.ndarray, ix: np.ndarray, depth: int, rng: np.random.Generator, lo: int) -> list[np.ndarray]:
        if depth == 0 or len(ix) < 8:
            return [ix]
        x = v[ix]
        c = x[rng.choice(len(ix), 2, replace=False)]
        for _ in range(12):
            second = x @ (c[1] - c[0]) > 0
            if second.all() or not second.any():
                break
            c = np.stack([x[~second].mean(axis=0), x[second].mean(axis=0)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        if min(second.mean(), 1 - second.mean()) < 0.02:
            along = x @ (c[1] - c[0])
            second = along > np.median(along)
        if second.all() or not second.any():
            return [ix]
        one = self._split(v, ix[~second], depth - 1, rng, lo)
        two = self._split(v, ix[second], depth - 1, rng, lo + len(one))
        self.mid[lo, lo + len(one) + len(two)] = lo + len(one)
        return one + two

    def cell_of(self, vectors: np.ndarray) -> np.ndarray:
        if not len(vectors):
            return np.zeros(0, np.int32)
        leaf = (vectors @ self.centres.T).argmax(axis=1)
        along = np.einsum("ij,ij->i", vectors, self.axes[leaf])
        return (leaf * BUCKETS + (along[:, None] > self.edges[leaf]).sum(axis=1)).astype(np.int32)


def cell_shards(sizes: list[tuple[int, int, int]], docs: int, tokens: int, mid: dict[tuple[int, int], int] | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, first shard, parts) of each (cell, documents, tokens), and the number of shards, none planned for more than asked.

    A branch of the tree that fits a shard is not cut; neighbouring ones share a shard while they fit.
    """
    by_leaf: dict[int, list[tuple[int, int, int]]] = {}
    for x in sorted(sizes):
        by_leaf.setdefault(x[0] // BUCKETS, []).append(x)

    def groups(lo: int, hi: int) -> list[list[tuple[int, int, int]]]:
        mine = [x for leaf in range(lo, hi) for x in by_leaf.get(leaf, ())]
        if sum(x[1] for x in mine) <= docs and sum(x[2] for x in mine) <= tokens:
            return [mine] if mine else []
        m = (mid or {}).get((lo, hi), hi if hi - lo == 1 else (lo + hi) // 2)
        return [[x] for x in mine] if m == hi else groups(lo, m) + groups(m, hi)

    out, shard, n, t = [], 0, 0, 0
    for group in groups(0, max(max(by_leaf, default=0) + 1, max((hi for _, hi in mid or ()), default=1))):
        d, k = sum(x[1] for x in group), sum(x[2] for x in group)
        parts = max(1, -(-d // docs), -(-k // tokens))
        if n and (n + d > docs or t + k > tokens):
            shard, n, t = shard + 1, 0, 0
        out += [(cell, shard, parts) for cell, _, _ in group]
        if parts > 1:
            shard += parts
        else:
            n, t = n + d, t + k
    return out, shard + (n > 0)


def with_shards(docs: DataFrame, max_docs: int, max_tokens: int, cells: Cells | None = None, filler: int = FILLER) -> tuple[DataFrame, int]:
    """``docs`` (row, cell, n_tokens, ...) with a column ``shard``, and how many shards there are.

    Documents of at most ``filler`` tokens are spread over all shards by a hash: they say little about anything, and
    every shard needs some to fill its last gaps. The table of cells has at most 2 ** DEPTH * BUCKETS rows whatever
    the corpus; it is collected and broadcast.
    """
    about = F.col("n_tokens") > filler
    sizes = [tuple(r) for r in docs.groupBy(F.when(about, F.col("cell")).otherwise(-1).alias("cell")).agg(F.count("*"), F.sum("n_tokens")).collect()]
    placed, n = cell_shards([x for x in sizes if x[0] >= 0], max_docs, max_tokens, cells.mid if cells else None)
    n = max(n, -(-sum(d for _, d, _ in sizes) // (2 * max_docs)))
    table = docs.sparkSession.createDataFrame(placed, "cell int, first int, parts int")
    part: Column = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    spread = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(max(1, n))).cast("int")
    return docs.join(F.broadcast(table), "cell", "left").withColumn("shard", F.when(about, part).otherwise(spread)).drop("cell", "first", "parts"), n
