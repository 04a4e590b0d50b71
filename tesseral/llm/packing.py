"""Filling windows of fixed capacity with documents that belong together.

Documents are measured and indexed by the token ids of a public vocabulary and sharded by what
they are about (:mod:`tesseral.llm.shards`), a bounded number a shard. Each shard has its BM25
inverted index with the whole corpus' document frequencies. The largest document not yet placed
seeds a window; the index returns its unused neighbours, best first, which fill the window as far
as any fits; what room is left takes the largest that fits.

Defined cases
- a document larger than the capacity is cut into pieces of exactly the capacity, each a window of
  its own, and a rest that is packed like a document; no other is cut;
- null, empty and blank texts: their tokens are counted (0 for null and empty); documents of 0
  tokens take their place in a window without using room;
- repeated texts and ties are items each for itself, ties broken by the row id;
- a capacity that is null or not positive gives no rows; empty tables give none;
- other columns are ignored, so their names cannot clash.

Collected are document frequencies, at most one number a token of the vocabulary, the sketches of
the sample the shards' tree is fitted on, and a count a cell of that tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.llm.shards import DIMS, SAMPLE_DOCS, Cells, Sketcher, rarity, with_shards
from tesseral.llm.tokenizer import VOCABULARIES, blocks, encoder_of, read_model
from tesseral.session import cut

#: Documents and tokens a shard is planned for, and shards a task.
SHARD_DOCS, SHARD_TOKENS, TASK_SHARDS = 2_000, 4_000_000, 16
K1, B = 1.2, 0.75
#: A term in at least one of so many documents of a shard is common there.
DENSE = 32
#: Pairs of documents added up at once, and neighbours looked at before all are put in order.
PAIRS, NEAREST = 2_000_000, 32


def measured(df: DataFrame, row: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, cells: tuple[np.ndarray, Cells] | None = None) -> DataFrame:
    """(row, cell, n_tokens, terms, counts): each document's distinct tokens and how often each stands there.

    ``cells`` are the weights of terms and the tree that give a document its cell; without them it is 0.
    """
    shared = df.sparkSession.sparkContext.broadcast((read_model(vocabulary, folder), cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cells = shared.value
        enc = encoder_of(model)
        sketcher = Sketcher(cells[0], len(enc.vocabulary.rank)) if cells else None
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in blocks(texts):
                sizes, ids = enc.encode(texts[lo:hi])
                key = np.repeat(np.arange(hi - lo) << 32, sizes) | ids
                key.sort()
                first = np.flatnonzero(np.diff(key, prepend=-1))
                times = np.diff(np.append(first, len(key)))
                key = key[first]
                offsets, terms = np.searchsorted(key >> 32, np.arange(hi - lo + 1)), key & 0xFFFFFFFF
                cell = cells[1].cell_of(sketcher.sketch(terms, times, offsets)) if cells else np.zeros(hi - lo, np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(cell, pa.int32()), pa.array(sizes, pa.int64()), *lists], ["row", "cell", "n_tokens", "terms", "counts"])

    return df.select(F.col(row).cast("bigint").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row bigint, cell int, n_tokens bigint, terms array<int>, counts array<int>")


def frequencies(docs: DataFrame) -> np.ndarray:
    """In how many documents each token stands, up to the largest that occurs."""
    found = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
    term = found["term"].to_numpy()
    out = np.zeros(term.max(initial=0) + 1)
    out[term] = found["n"].to_numpy()
    return out


def fit_cells(df: DataFrame, row: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> tuple[np.ndarray, Cells]:
    """The weights of terms and the tree of cells, from about SAMPLE_DOCS documents."""
    every = max(1, df.count() // SAMPLE_DOCS)
    sample = cut(measured(df.where(F.pmod(F.xxhash64(row, text), F.lit(every)) == 0), row, text, vocabulary, folder))
    weights = rarity(frequencies(sample), sample.count())
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shared.value, len(shared.value))
        for b in batches:
            terms, counts = b.column("terms"), b.column("counts")
            offsets = terms.offsets.to_numpy()
            v = sketcher.sketch(terms.flatten().to_numpy(), counts.flatten().to_numpy(), offsets - offsets[0])
            v = v[np.diff(offsets) > 0]
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), DIMS).cast(pa.list_(pa.float32()))], ["v"])

    found = sample.select("terms", "counts").mapInArrow(run, "v array<float>").toArrow()["v"].combine_chunks()
    return weights, Cells(found.flatten().to_numpy().reshape(-1, DIMS))


class Shard:
    """The inverted index of one shard's documents, and by it the BM25 of every document for every other one's terms."""

    def __init__(self, sizes: np.ndarray, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.n, self.sizes = len(sizes), sizes
        doc = np.repeat(np.arange(self.n), np.diff(offsets))
        weight = idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * sizes[doc] / max(mean, 1e-9)))
        found, place = np.unique(terms, return_inverse=True)
        n = np.bincount(place, minlength=len(found))
        # What terms in many of the documents give is added up for all pairs at once, as a product of matrices.
        often = n * DENSE >= max(1, self.n)
        at = np.cumsum(often) - 1
        held = often[place]
        asks, gives = np.zeros((self.n, int(often.sum())), np.float32), np.zeros((self.n, int(often.sum())), np.float32)
        asks[doc[held], at[place[held]]] = 1
        gives[doc[held], at[place[held]]] = weight[held]
        self.bm25 = asks @ gives.T
        # The others have short lists: each entry is asked for by every document of its list; some documents at once, for bounded memory.
        doc, place, weight = doc[~held], place[~held], weight[~held]
        order = np.argsort(place, kind="stable")
        listed, gave, starts = doc[order], weight[order], np.cumsum(n * ~often) - n * ~often
        bounds = np.searchsorted(doc, np.arange(self.n + 1))
        pairs = np.concatenate([[0], np.cumsum(n[place])])[bounds]  # asked for by the documents before
        first = 0
        while first < self.n:
            last = max(first + 1, int(np.searchsorted(pairs, pairs[first] + PAIRS, side="right")) - 1)
            lo, hi = bounds[first], bounds[last]
            size = n[place[lo:hi]]
            to = np.repeat(starts[place[lo:hi]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            asking = np.repeat((doc[lo:hi] - first) * self.n, size)
            self.bm25[first:last] += np.bincount(asking + listed[to], gave[to], (last - first) * self.n).reshape(last - first, self.n)
            first = last

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms."""
        return self.bm25[seed]


class _Sizes:
    """Unplaced items by size: the largest, and the largest that fits."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.sorted = sizes[self.order]
        self.place = np.empty(len(sizes), np.int64)
        self.place[self.order] = np.arange(len(sizes))
        self.below = list(range(len(sizes) + 1))  # 0: none; i + 1: the place i if alive, else what is below
        self.alive = np.ones(len(sizes), bool)

    def remove(self, item: int) -> None:
        self.alive[item] = False
        self.below[int(self.place[item]) + 1] = int(self.place[item])

    def fitting(self, room: int) -> int:
        """The largest alive item of at most ``room``; -1 if none."""
        i = int(np.searchsorted(self.sorted, room, side="right"))
        trail = []
        while self.below[i] != i:
            trail.append(i)
            i = self.below[i]
        for t in trail:
            self.below[t] = i
        return int(self.order[i - 1]) if i else -1


def _nearest(near: np.ndarray, score: np.ndarray) -> Iterator[np.ndarray]:
    """The neighbours best first, ties in their order: first about NEAREST of them, then the rest, put in order only if asked for."""
    if len(near) > 4 * NEAREST:
        least = np.partition(score, len(score) - NEAREST)[len(score) - NEAREST]
        best = score > least
        yield near[best][np.argsort(-score[best], kind="stable")]
        near, score = near[~best], score[~best]
    yield near[np.argsort(-score, kind="stable")]


def pack_shard(shard: Shard, capacity: int) -> list[tuple[int, int, int, int, int, int, float]]:
    """(bin, place, document, piece, first token, tokens, score) of every piece of the shard's documents."""
    out, bins = [], 0
    whole, rest = np.divmod(shard.sizes, capacity)
    cutting = shard.sizes > capacity
    for d in np.flatnonzero(cutting):
        for k in range(int(whole[d])):
            out.append((bins, 0, int(d), k, k * capacity, capacity, 0.0))
            bins += 1
    items = np.flatnonzero(~cutting | (rest > 0))
    sizes = np.where(cutting[items], rest[items], shard.sizes[items])
    left = _Sizes(sizes)
    pos = np.full(shard.n, -1)
    pos[items] = np.arange(len(items))

    def put(i: int, place: int, score: float) -> None:
        d = int(items[i])
        k = int(whole[d]) if cutting[d] else 0
        out.append((bins, place, d, k, k * capacity, int(sizes[i]), score))
        left.remove(i)

    every = len(items) == shard.n
    while (seed := left.fitting(capacity)) >= 0:
        room, place = capacity - int(sizes[seed]), 1
        put(seed, 0, 0.0)
        if left.fitting(room) >= 0:
            score = shard.scores(int(items[seed]))
            score = score if every else score[items]
            near = np.flatnonzero(left.alive & (sizes <= room) & (score > 0))
            for part in _nearest(near, score[near]):
                part = part[sizes[part] <= room]
                while len(part):
                    i = int(part[0])
                    put(i, place, float(score[i]))
                    room -= int(sizes[i])
                    place += 1
                    part = part[1:][sizes[part[1:]] <= room]
                if left.fitting(room) < 0:
                    break
        while (i := left.fitting(room)) >= 0:
            put(i, place, 0.0)
            room -= int(sizes[i])
            place += 1
        bins += 1
    return out


def pack(df: DataFrame, windows: DataFrame, row: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(window_id, bin, place, row, piece, first_token, n_tokens, score): every document in windows of every capacity.

    ``windows`` (window_id, capacity_tokens) is a fixed small table and is collected; a bin's number is unique within its window_id.
    """
    spark = df.sparkSession
    sizes = [(r["window_id"], int(r["capacity_tokens"])) for r in windows.select("window_id", "capacity_tokens").distinct().orderBy("window_id", "capacity_tokens").collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    cells = fit_cells(df, row, text, vocabulary, folder)
    docs = cut(measured(df, row, text, vocabulary, folder, cells))
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    shared = spark.sparkContext.broadcast(rarity(frequencies(docs), total["n"]))
    mean = total["tokens"] / max(1, total["n"])
    sharded, shards = with_shards(docs, SHARD_DOCS, SHARD_TOKENS, cells[1])
    # A task works several shards, one after the other, once there are more than tasks to keep busy.
    tasks = max(1, min(shards, max(-(-shards // TASK_SHARDS), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in _shards(batches):
            terms, counts = t["terms"].combine_chunks(), t["counts"].combine_chunks()
            if isinstance(terms, pa.ChunkedArray):
                terms, counts = terms.chunk(0), counts.chunk(0)
            offsets = terms.offsets.to_numpy()
            shard = Shard(t["n_tokens"].to_numpy(), offsets - offsets[0], terms.flatten().to_numpy(), counts.flatten().to_numpy(), shared.value, mean)
            rows, base = t["row"].to_numpy(), number << 32
            for window, capacity in sizes:
                got = list(zip(*pack_shard(shard, capacity)))
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(got[0]), window), pa.int32()), pa.array(np.array(got[0]) + base, pa.int64()), pa.array(got[1], pa.int32()), pa.array(rows[np.array(got[2])], pa.int64()), pa.array(got[3], pa.int32()), pa.array(got[4], pa.int64()), pa.array(got[5], pa.int64()), pa.array(got[6], pa.float64())],
                        ["window_id", "bin", "place", "row", "piece", "first_token", "n_tokens", "score"],
                    )

    placed = sharded.repartitionById(tasks, F.expr(f"cast(cast(shard as bigint) * {tasks} div {max(1, shards)} as int)")).sortWithinPartitions("shard", "row")
    return placed.select("shard", "row", "n_tokens", "terms", "counts").mapInArrow(run, "window_id int, bin bigint, place int, row bigint, piece int, first_token bigint, n_tokens bigint, score double")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Sorted batches as one table a shard."""
    held: list[pa.Table] = []
    now = None
    for b in batches:
        shard = b.column("shard").to_numpy()
        starts = [*np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)), len(shard)] if len(shard) else []
        for lo, hi in zip(starts, starts[1:]):
            if held and shard[lo] != now:
                yield now, pa.concat_tables(held).combine_chunks()
                held = []
            now = int(shard[lo])
            held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
    if held:
        yield now, pa.concat_tables(held).combine_chunks()
