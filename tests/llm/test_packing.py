"""Windows filled with documents."""

import numpy as np
import pytest

from tesseral.llm.packing import Shard, _Sizes, fit_cells, measured, pack, pack_shard
from tesseral.llm.shards import Sketcher, cell_shards, rarity, with_shards


@pytest.fixture(scope="module")
def windows(spark):
    return spark.createDataFrame([(1, "s", 16), (2, "l", 64), (3, "none", None), (4, "zero", 0)], "window_id int, name string, capacity_tokens bigint")


def run(spark, texts, windows):
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None, "clash", 7) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, terms string, row int")
    return [r.asDict() for r in pack(df, windows, "doc_id", "text").collect()]


def check(out, capacity, window, n_docs):
    rows = [r for r in out if r["window_id"] == window]
    fill = {}
    for r in rows:
        fill[r["bin"]] = fill.get(r["bin"], 0) + r["n_tokens"]
    assert max(fill.values()) <= capacity
    assert {r["row"] for r in rows} == set(range(n_docs))
    for d in range(n_docs):
        mine = sorted((r["first_token"], r["n_tokens"], r["piece"]) for r in rows if r["row"] == d)
        total = sum(n for _, n, _ in mine)
        assert [p for _, _, p in mine] == list(range(len(mine)))
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(mine, mine[1:])) and mine[0][0] == 0
        assert len(mine) == 1 if total <= capacity else all(n == capacity for _, n, _ in mine[:-1])
    return fill


def test_every_document_once_and_none_cut_without_need(spark, windows):
    texts = [None, "", " ", "word " * 200, "alpha beta", "alpha beta", *(f"alpha gamma delta {i} " * (i % 5 + 1) for i in range(60))]
    out = run(spark, texts, windows)
    assert {r["window_id"] for r in out} == {1, 2}
    check(out, 16, 1, len(texts))
    fill = check(out, 64, 2, len(texts))
    assert sum(fill.values()) / (64 * len(fill)) > 0.9


def test_empty(spark, windows):
    assert run(spark, [], windows) == []


def test_neighbours_share_a_window():
    # Three topics of eight documents; 8 x 8 tokens fill a window of 64.
    n, terms = 24, np.concatenate([np.arange(8) + 10 * (i % 3) for i in range(24)])
    shard = Shard(np.full(n, 8), np.arange(n + 1) * 8, terms, np.ones(len(terms), int), np.ones(40), 8.0)
    by = {}
    for b, _, d, *_ in pack_shard(shard, 64):
        by.setdefault(b, []).append(d % 3)
    # Three quarters of a window go by neighbourhood, the rest by size.
    assert len(by) == 3
    assert max(by[0].count(t) for t in range(3)) >= 6


def test_scores_match_a_plain_bm25():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 12))) for _ in range(50)]
    counts = [rng.integers(1, 4, len(s)) for s in sets]
    sizes, idf = np.array([c.sum() for c in counts]), rng.random(30) + 0.1
    shard = Shard(sizes, np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets), np.concatenate(counts), idf, sizes.mean())
    for q in (0, 7, 49):
        want = [sum(idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sizes[d] / sizes.mean())) for t, c in zip(sets[d], counts[d]) if t in set(sets[q])) for d in range(50)]
        assert np.allclose(shard.scores(q), want, rtol=1e-4)


def test_best_fit():
    s = _Sizes(np.array([5, 3, 9, 3]))
    assert s.fitting(8) == 0
    s.remove(0)
    assert s.fitting(8) in (1, 3) and s.fitting(2) == -1 and s.fitting(100) == 2


def test_neighbours_fill_the_last_room_before_sizes_do():
    # 0 fills more than three quarters; 1 shares its term, 2 is larger and fits but shares none
    one = np.ones(3, np.int64)
    shard = Shard(np.array([52, 6, 12]), np.arange(4), np.array([1, 1, 2]), one, np.ones(3), 20.0)
    bins = {d: b for b, _, d, *_ in pack_shard(shard, 64)}
    assert bins[0] == bins[1] != bins[2]


def test_cells_become_shards_of_bounded_size():
    rng = np.random.default_rng(1)
    sizes = [(c, int(rng.integers(1, 300)) if c % 7 else 5000, int(rng.integers(1, 9000))) for c in range(40)]
    cells, n = cell_shards(sizes, 1000, 20_000)
    docs = np.zeros(n)
    for (cell, first, parts), (_, d, _) in zip(cells, sizes):
        assert parts == (5 if d == 5000 else 1)
        docs[first : first + parts] += d / parts
    assert docs.max() <= 1000 and docs.min() > 0 and [c for c, *_ in cells] == list(range(40))
    assert cell_shards([], 10, 10) == ([], 0)


def test_neighbours_are_in_the_shard_of_their_topic(spark, monkeypatch):
    """Recall of the corpus' ten best by BM25 inside a document's own shard, against brute force; by chance it would be 1 / n.

    A topic has 40 documents and a shard at most 60, so every other topic is cut by a shard's end.
    """
    monkeypatch.setattr("tesseral.llm.packing.SHARD_DOCS", 60)
    rng = np.random.default_rng(4)
    letters = "abcdefghijklmnopqrstuvwxyzабвгдежзиклмнопрсту"
    topics = [["".join(rng.choice(list(letters[3 * t : 3 * t + 3]), 5)) for _ in range(30)] for t in range(12)]
    texts = [" ".join(rng.choice(topics[i % 12], 20)) for i in range(480)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    cells = fit_cells(df, "doc_id", "text")
    sharded, n = with_shards(measured(df, "doc_id", "text", cells=cells), 60, 10**9, cells[1], filler=0)
    rows = sorted(sharded.collect(), key=lambda r: r["row"])
    assert n >= 8 and [r["row"] for r in rows] == list(range(480))
    offsets = np.cumsum([0, *(len(r["terms"]) for r in rows)])
    terms, counts = (np.concatenate([r[c] for r in rows]) for c in ("terms", "counts"))
    whole = Shard(np.array([r["n_tokens"] for r in rows]), offsets, terms, counts, rarity(np.bincount(terms), len(rows)), 1.0)
    shard = np.array([r["shard"] for r in rows])
    found = []
    for q in range(0, 480, 10):
        s = whole.scores(q).astype(float)
        s[q] = -1
        best = np.argsort(-s, kind="stable")[:10]
        found.append((shard[best] == shard[q]).mean())
    assert np.mean(found) >= max(0.7, 5 / n)


def test_two_runs_number_alike(spark, windows):
    texts = [f"alpha {i % 7} beta {i % 3} " * (i % 9 + 1) for i in range(90)]
    key = lambda r: (r["window_id"], r["row"], r["piece"])
    assert sorted(run(spark, texts, windows), key=key) == sorted(run(spark, texts, windows), key=key)


def test_sketches_do_not_depend_on_the_size_of_the_vocabulary():
    terms, counts, offsets = np.array([1, 5, 7, 2]), np.array([1, 2, 1, 3]), np.array([0, 3, 3, 4])
    w = np.arange(1.0, 9.0)
    a, b = (Sketcher(w, n).sketch(terms, counts, offsets) for n in (8, 5000))
    assert np.array_equal(a, b) and not a[1].any() and abs(np.linalg.norm(a[0]) - 1) < 1e-5


def test_short_documents_are_spread(spark):
    df = spark.createDataFrame([(i, 0, 5 if i % 2 else 500) for i in range(400)], "row bigint, cell int, n_tokens bigint")
    sharded, n = with_shards(df, 50, 10**9)
    rows = sharded.collect()
    long, short = ([r["shard"] for r in rows if (r["n_tokens"] > 64) is want] for want in (True, False))
    assert n == 4 and len(rows) == 400 and set(long) == set(short) == set(range(4))
    only, m = with_shards(df.where("n_tokens < 10"), 50, 10**9)
    assert only.count() == 200 and m == 2 and {r["shard"] for r in only.collect()} == {0, 1}
