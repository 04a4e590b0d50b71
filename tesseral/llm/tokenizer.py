"""Encoding a corpus with a public byte-level BPE vocabulary, by speculation and verification.

Words unseen by a worker are encoded together. Greedy longest match proposes the tokens of each;
whether two tokens may stand next to each other is a property of the pair alone, so all distinct
adjacent pairs are tested at once with numpy, undoing merges on both sides of the seam until one
of them would have been made across it. A word all of whose pairs are compatible is exactly what
merging would give; only the others are merged, exactly.

Defined cases
- null and empty text: no ids (an empty list, not null); blank text has the ids of its white space;
- the strings of special tokens are ordinary text;
- repeated texts and rows are encoded each for itself; very long texts and words are whole, merged
  in n log n; other columns are ignored, so their names cannot clash;
- empty table: no rows.

There is no shuffle. The vocabulary (a few MB, fixed) is read once on the driver from the folder
given and broadcast; a worker's memory of words is bounded by CACHE_CHARS and starts anew beyond.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARIES = "/opt/tokenizers"
#: Words of at most so many characters are remembered, up to so many characters in all.
CACHE_WORD, CACHE_CHARS = 64, 24_000_000
#: Characters of text a worker encodes at once.
BLOCK_CHARS = 2_000_000

# Fixed value: the pattern that cuts text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: white space in the sense of that pattern.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = regex.compile(f"([{_WS}]{{2,}})")


def _byte_of() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else 256 and up."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the compatibility of neighbours."""

    def __init__(self, model: str) -> None:
        m = json.loads(model)["model"]
        byte = _byte_of()
        self.ids: dict[bytes, int] = {}
        n = max(m["vocab"].values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)  # of a byte: itself
        rank = np.zeros(n, np.int64)  # of a byte: 0, below every merge
        pairs: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(m["merges"], 1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = m["vocab"][a], m["vocab"][b], m["vocab"][a + b]
            pairs[x, y] = z
            if not rank[z]:
                self.left[z], self.right[z], rank[z] = x, y, r
        self.rank, self.pairs = rank, pairs
        for t, i in m["vocab"].items():
            if rank[i] or len(t) == 1:  # special tokens are no words
                self.ids[bytes(map(byte.__getitem__, t))] = i
        keys = np.fromiter((x << 32 | y for x, y in pairs), np.int64, len(pairs))
        made = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], made[order]
        # How long tokens get that begin with certain three bytes; shorter tokens begin with none.
        self.reach: dict[bytes, int] = {}
        for t in self.ids:
            if len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: whether merging the bytes of both gives these two tokens again."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)  # merges from this rank on cannot happen at the seam any more
        live = np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.rank[self.pair_made[at]], np.iinfo(np.int64).max) < lim
            ok[live[across]] = False
            live, x, y = live[~across], x[~across], y[~across]
            # Undo the later of the two tokens' last merges; of equal ones the left token's came first.
            rx, ry = self.rank[x], self.rank[y]
            go = (rx > 0) | (ry > 0)
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok

    def propose(self, word: bytes) -> list[int]:
        """The greedy longest-match tokens."""
        ids, reach, out, i, n = self.ids, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach.get(word[i : i + 3], 2))
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """The exact tokens: of all neighbours the one of least rank, the leftmost first, is merged until none is left."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[z], i, ids[i], ids[i + 1], z) for i in range(n - 1) if (z := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (w := self.pairs.get((z, ids[k]))) is not None:
                    heapq.heappush(heap, (self.rank[w], i, z, ids[k], w))
            h = before[i]
            if h >= 0 and (w := self.pairs.get((ids[h], z))) is not None:
                heapq.heappush(heap, (self.rank[w], h, ids[h], z, w))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Tokens of each word, and how many words had to be merged."""
        tokens = [self.propose(w) for w in words]
        long = [i for i, t in enumerate(tokens) if len(t) > 1]
        if not long:
            return tokens, 0
        sizes = np.fromiter((len(tokens[i]) - 1 for i in long), np.int64, len(long))
        first = np.fromiter((x for i in long for x in tokens[i][:-1]), np.int64, int(sizes.sum()))
        second = np.fromiter((x for i in long for x in tokens[i][1:]), np.int64, int(sizes.sum()))
        pairs, back = np.unique(first << 32 | second, return_inverse=True)
        ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        failing = np.flatnonzero(~np.logical_and.reduceat(ok, starts))
        for k in failing:
            tokens[long[k]] = self.merge(words[long[k]])
        return tokens, len(failing)


class _Known(dict):
    """Numbers of pieces; a piece asked for the first time gets the next number and is noted as fresh."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.fresh: list[str] = []
        self.next = 1

    def __missing__(self, piece: str) -> int:
        i = self[piece] = self.next
        self.next += 1
        self.fresh.append(piece)
        return i


class Encoder:
    """Texts to token ids, remembering words.

    A text is cut at blanks and line ends that stand alone between other characters: those are
    always ends of words of the pattern. What lies between is a piece, known or encoded anew.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.words: dict[str, list[int]] = {}
        self.chars = 0
        self.store, self.starts, self.sizes = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.used, self.count = 0, 1

    def pieces(self, text: str) -> list[str]:
        if "\0" in text:
            return self.pattern.findall(text)
        if _RUN.search(text) is None:
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        parts, out, lead = _RUN.split(text), [], ""
        for i, p in enumerate(parts):
            if i % 2 == 0:
                if p or lead:
                    out += (lead + p).replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if p else [lead]
                lead = ""
            elif i == len(parts) - 2 and not parts[-1]:
                out.append(p)
            else:
                out.append(p[:-1])
                lead = p[-1]
                if lead != " ":
                    out.append(lead)
                    lead = ""
        return out

    def learn(self, pieces: list[str]) -> None:
        # A run of ASCII letters, with a blank before it or without, is one word of the pattern.
        split = [[p] if p.isascii() and (p.isalpha() or p[:1] == " " and p[1:].isalpha()) else self.pattern.findall(p) for p in pieces]
        of = self.words
        words = list({w for s in split for w in s}.difference(of))
        tokens, _ = self.vocabulary.encode_words([w.encode() for w in words])
        of.update(zip(words, tokens))
        flat: list[int] = []
        sizes = []
        for p, s in zip(pieces, split):
            before = len(flat)
            for w in s:
                flat += of[w]
            sizes.append(len(flat) - before)
            self.chars += len(p) + 20
        for w in words:
            if len(w) > CACHE_WORD:
                del of[w]
        self.chars += sum(map(len, words)) + 40 * len(words)
        n = len(pieces)
        while self.count + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        got = np.array(sizes, np.int64)
        self.sizes[self.count : self.count + n] = got
        self.starts[self.count : self.count + n] = self.used + np.cumsum(got) - got
        self.store[self.used : self.used + len(flat)] = flat
        self.count += n
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): how many tokens each text has, and all tokens in order."""
        if self.chars > CACHE_CHARS:
            self.forget()
        cut = [self.pieces(t) if t else [] for t in texts]
        flat = [p for c in cut for p in c]
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        new, self.known.fresh = self.known.fresh, []
        if new:
            self.learn(new)
        for p in new:
            if len(p) > CACHE_WORD:
                del self.known[p]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.store[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([len(c) for c in cut])
        total = np.concatenate([[0], ends])[last] if len(cut) else np.zeros(0, np.int64)
        return np.diff(total, prepend=0), ids


_encoders: dict[int, Encoder] = {}


def encoder_of(model: str) -> Encoder:
    """This worker's encoder of a vocabulary."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(model))
    return _encoders[key]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS together."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= BLOCK_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def read_model(vocabulary: str, folder: str = VOCABULARIES) -> str:
    """The vocabulary file's text."""
    return Path(folder, f"{vocabulary}.json").read_text(encoding="utf-8")


def encode(df: DataFrame, row: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(row, ids): the token ids of every row's text, without special tokens."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in blocks(texts):
                sizes, ids = enc.encode(texts[lo:hi])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["row", "ids"])

    return df.select(F.col(row).cast("bigint").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row bigint, ids array<int>")
