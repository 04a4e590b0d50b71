"""Text quality: statistics of each document, and whether it is prose, list, table or junk.

The statistics' thresholds are noisy labelling functions, each voting for what it speaks for or
abstaining. How far each can be trusted is learned by expectation-maximisation from how they
agree over all documents; a document's types are the posterior given its votes. One voter knows
how the lines were read, the others see counts of words, marks and lines only.

Defined cases
- null and blank texts have no type (null) and zero statistics; they are never found as not prose;
- repeated texts and ties are judged each for itself and alike; texts are read whole;
- empty table: no rows; other columns are ignored, so their names cannot clash;
- a text without words of a known language and without any list or table is junk.

Votes are counted by pattern with partial aggregation. There are at most SYMBOLS ** len(VOTERS)
patterns, in practice about a hundred; they alone reach the driver, where the model is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.session import cut

TYPES = ("prose", "list", "table", "junk")
#: A vote is 0 (abstains) or one more than the place of a type.
SYMBOLS = len(TYPES) + 1
VOTERS = ("shares", "common", "length", "symbols", "digits", "ends", "repeats", "marked", "celled", "lines")

_NUMBERED = regex.compile(r"\s*\(?\d{1,4}[.)）．、]\s*\S")
_FIRST = regex.compile(r"\s*\(?1[.)）．、]\s")
_ITEM = regex.compile(r"\s*(?:[-*+•◦–—‣▪●○■□·・※→]\s+\S|\(?(?:[A-Za-z]|[ivxIVX]{2,4})[.)）]\s+\S|[①-⑳]\s*\S|\[[ xX]\]\s+\S)")
#: Characters a cell has on average at most.
CELL = 24
_MARK = regex.compile(r"\s*(?:[-*+•◦–—‣▪●○■□·・※→]\s|\(?(?:\d{1,4}|[A-Za-z]|[ivxIVX]{2,4})[.)）．、]\s|[①-⑳])")
_GAP = regex.compile(r"\S {2,}(?=\S)")
_QUOTE = regex.compile(r"\s*(?:>\s?)+")
_HEADING = regex.compile(r"\s*#{1,6}\s+\S")
_END = regex.compile(r"[.!?…。！？][\"'”’)»\]]*$")
_RULED = regex.compile(r"[-+=|]{5,}|[-dlrwx]{10}\s")
_BREAK = regex.compile("\r\n|[\n\r\x0b\x0c\u2028\u2029]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
# Characters of Japanese and Chinese that carry grammar, not matter.
_PARTICLES = regex.compile(r"[のはをにがでとてもへやかられるすまし的了是在不把再有和就也都会要请被这那没给让从对们]")
_MARKS = "{}[]<>=_|\\@$^~*;/+#&%"
_TRIM = ".,;:!?…\"'`“”‘’()[]{}<>«»¿¡*_-–—。、！？「」"

STATS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "distinct_words", "n_lines", "words_per_line", "marked_share", "cell_share", "unspaced_share",
    "prose_share", "list_share", "table_share", "junk_share",
)


class Common:
    """The common words of several languages: for each word the languages that have it, as bits."""

    def __init__(self, words: list[tuple[str, str]]) -> None:
        self.langs = sorted({lang for lang, _ in words})
        self.bits: dict[str, int] = {}
        for lang, word in words:
            self.bits[word.lower()] = self.bits.get(word.lower(), 0) | 1 << self.langs.index(lang)

    def best(self, masks: dict[int, int]) -> int:
        """How many words are common in the language that explains most."""
        return max((sum(n for m, n in masks.items() if m >> i & 1) for i in range(len(self.langs))), default=0)


class _Part:
    """A line or a run of lines: its counts."""

    __slots__ = ("chars", "words", "letters", "masks", "marks", "digits", "cjk", "particles", "lines")

    def __init__(self) -> None:
        self.chars = self.words = self.letters = self.marks = self.digits = self.cjk = self.particles = self.lines = 0
        self.masks: dict[int, int] = {}

    def add(self, o: _Part) -> None:
        for c in ("chars", "words", "letters", "marks", "digits", "cjk", "particles", "lines"):
            setattr(self, c, getattr(self, c) + getattr(o, c))
        for m, n in o.masks.items():
            self.masks[m] = self.masks.get(m, 0) + n

    def connected(self, common: Common) -> bool:
        """Whether it reads as sentences: words of grammar in the share that sentences have, of the length words have, few marks."""
        if self.cjk > 0.25 * self.chars:
            return self.particles >= 0.08 * self.cjk
        if not self.words or self.marks > 0.12 * self.chars or self.letters > 11 * self.words:
            return False
        return 0.25 <= common.best(self.masks) / self.words <= 0.92

    def items(self) -> bool:
        """Whether running text that is not connected is a bare list: lines of a word or few."""
        return self.lines >= 3 and self.words <= 3.5 * self.lines and self.chars <= 50 * self.lines and not self.masks


class _Reader:
    """Counts lines, remembering tokens (as many as TOKENS)."""

    TOKENS = 200_000

    def __init__(self, common: Common) -> None:
        self.common, self.known = common, {}

    def look(self, token: str) -> tuple[str, int, int, int, int]:
        """A token's word (lower case, trimmed), its letters, the languages it is common in, marks and digits."""
        w = token.strip(_TRIM).lower().replace("\u2019", "'")
        if w.isdecimal():
            w = ""
        bits = self.common.bits
        m = bits.get(w) or (bits.get(w.partition("'")[0], 0) if "'" in w else 0)
        got = (w, len(w), m, sum(map(token.count, _MARKS)), sum(map(str.isdigit, token)))
        if len(self.known) >= self.TOKENS:
            self.known.clear()
        if len(token) < 64:
            self.known[token] = got
        return got

    def line(self, line: str, seen: set[str]) -> _Part:
        p, known, masks = _Part(), self.known, {}
        words = chars = letters = marks = digits = 0
        for token in line.split():
            chars += len(token)
            w, n, m, k, d = known.get(token) or self.look(token)
            if w:
                words += 1
                letters += n
                seen.add(w)
                if m:
                    masks[m] = masks.get(m, 0) + 1
            marks += k
            digits += d
        p.chars, p.words, p.letters, p.marks, p.digits, p.masks, p.lines = chars, words, letters, marks, digits, masks, 1
        if line and not line.isascii() and (found := _CJK.findall(line)):
            p.cjk, p.particles = len(found), len(_PARTICLES.findall(line))
        return p


def statistics(text: str, reader: _Reader) -> tuple[float, ...]:
    """The values of STATS for one text that is not blank."""
    common = reader.common
    shares = dict.fromkeys(TYPES, 0)
    whole, ended, marked, items, celled, seen = _Part(), 0, 0, 0, 0, set()
    run, kind, closed = _Part(), "", True

    def close() -> None:
        nonlocal run
        if run.chars:
            shares["prose" if run.connected(common) else "list" if run.items() else "junk"] += run.chars
        run = _Part()

    for raw in _BREAK.split(text):
        if not raw.strip():
            close()
            kind = ""
            continue
        line = _QUOTE.sub("", raw, 1) if ">" in raw else raw
        p = reader.line(line, seen)
        whole.add(p)
        done = _END.search(line.rstrip()) is not None
        ended += done
        if _MARK.match(line):
            marked, items = marked + p.chars, items + 1
        celled += p.chars if _celled(line) else 0
        fluent = p.words >= 3 and p.letters <= 11 * p.words and common.best(p.masks) >= 0.25 * p.words or p.cjk > 3
        kind = _kind(raw, line, p, kind, closed, fluent)
        closed = done or line.rstrip()[-1:] in ":："
        if kind == "text":
            run.add(p)
        else:
            close()
            shares[{"list": "list", "table": "table"}.get(kind, "junk")] += p.chars
    close()
    n, w, lines = max(1, whole.chars), whole.words, max(1, whole.lines)
    fluency = min(1.0, whole.particles / whole.cjk * 2) if whole.cjk > 0.25 * n else common.best(whole.masks) / max(1, w)
    raw = (w, whole.letters / max(1, w), whole.marks / n, whole.digits / n, ended / lines, fluency, len(seen) / max(1, w), lines, w / lines, marked / n if items > 1 else 0.0, celled / n, whole.cjk / n)
    return (*raw, *(shares[t] / n for t in TYPES))


def _celled(line: str) -> bool:
    """Whether a line has separators enough for cells of at most CELL characters."""
    marks = line.count("\t") + line.count("|") + line.count(";") + line.count(",") - line.count(", ")
    if "  " in line:
        marks += len(_GAP.findall(line))
    return marks >= 2 and len(line) <= CELL * (marks + 1)


def _kind(raw: str, line: str, p: _Part, before: str, closed: bool, fluent: bool) -> str:
    """What a line that is not blank is by its own shape: heading, list, table, junk or text.

    A number that begins a line inside running text is an item's only if the line before was closed.
    """
    code = p.marks > 0.12 * p.chars and not fluent
    if _HEADING.match(line):
        return "heading"
    if _ITEM.match(line) or ((before != "text" or closed or _FIRST.match(line)) and _NUMBERED.match(line)):
        return "junk" if code and line.lstrip()[:1] in "+-" and "[ ]" not in line and "[x]" not in line else "list"
    if line.lstrip()[:1] == "|" and line.count("|") >= 2 or line.count('";"'):
        return "table"
    if not fluent and (" | " in line or "\t" in line.strip() or line.count(",") >= 2 and line.count(", ") < line.count(",") or line.count(";") >= 2 or (len(line.strip().split("  ")) >= 3 and raw[:1] not in " \t@+-") or _RULED.match(line)):
        return "table"
    if before == "list" and raw[:1].isspace():
        return "list"
    return "junk" if code else "text"


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """What each labelling function says of a document's statistics.

    Each is a threshold on what was counted of words, marks and lines; only ``shares`` knows how
    the lines were read. Those on words take a list of sentences for prose, those on marks know no
    language: which of them to trust for which type is the model's to learn.
    """
    prose, list_, table, junk = 1, 2, 3, 4
    shares = [s["list_share"], s["table_share"], s["junk_share"]]
    unspaced, common, length, lines = s["unspaced_share"] > 0.25, s["common_words"], s["mean_word_length"], s["n_lines"]
    marked, celled = s["marked_share"] >= 0.5 and lines >= 3, s["cell_share"] >= 0.5 and lines >= 2
    fluent = common >= 0.16 if unspaced else 0.25 <= common <= 0.92 and length <= 9 and s["digit_ratio"] <= 0.5
    runs = fluent and not marked and not celled
    said = {
        "shares": prose if s["prose_share"] >= 0.5 else 2 + max(range(3), key=shares.__getitem__),
        "common": prose if (fluent if unspaced else 0.3 <= common <= 0.75) else junk if not unspaced and common > 0.92 or common < 0.05 and not marked and not celled else 0,
        "length": junk if not unspaced and not celled and not 2.5 <= length <= 12 else prose if fluent and (unspaced or length < 5.5) else 0,
        "symbols": junk if s["symbol_ratio"] > 0.25 else table if celled and s["symbol_ratio"] > 0.03 else prose if runs and s["symbol_ratio"] < 0.02 else 0,
        "digits": table if celled and s["digit_ratio"] > 0.15 else junk if s["digit_ratio"] > 0.5 else prose if runs and s["digit_ratio"] < 0.05 else 0,
        "ends": prose if fluent and s["punctuated_lines"] >= 0.5 else list_ if s["punctuated_lines"] < 0.05 and lines >= 3 and not celled and s["words_per_line"] <= 6 else 0,
        "repeats": junk if s["distinct_words"] < 0.05 and s["n_words"] > 20 else 0,
        "marked": list_ if marked else 0,
        "celled": table if celled else 0,
        "lines": prose if runs and (unspaced or s["words_per_line"] >= 8) else list_ if lines >= 4 and s["words_per_line"] <= 3.5 and not celled and common < 0.3 else 0,
    }
    return tuple(said[v] for v in VOTERS)


def text_statistics(df: DataFrame, row: str, text: str, common: DataFrame) -> DataFrame:
    """(row, blank, STATS..., votes): the statistics of every row and what they vote for.

    ``common`` (lang, word) is a fixed list of function words; it is collected and sent along.
    """
    words = Common([(r["lang"], r["word"]) for r in common.where("lang is not null and word is not null").select("lang", "word").distinct().orderBy("lang", "word").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(words)
        for b in batches:
            out, codes, blank = [], [], []
            for t in b.column(1).to_pylist():
                empty = t is None or not t.strip()
                blank.append(empty)
                s = (0.0,) * len(STATS) if empty else statistics(t, reader)
                out.append(s)
                code = 0
                for v in () if empty else votes(dict(zip(STATS, s))):
                    code = code * SYMBOLS + v
                codes.append(code)
            cols = list(zip(*out)) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blank, pa.bool_()), *(pa.array(map(float, c), pa.float64()) for c in cols), pa.array(codes, pa.int32())], ["row", "blank", *STATS, "votes"])

    return df.select(F.col(row).cast("bigint").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row bigint, blank boolean, " + ", ".join(f"{s} double" for s in STATS) + ", votes int")


def unpack(codes: np.ndarray) -> np.ndarray:
    """Vote codes as a matrix, a column a voter."""
    n = len(VOTERS)
    return np.stack([codes // SYMBOLS ** (n - 1 - i) % SYMBOLS for i in range(n)], axis=1) if len(codes) else np.zeros((0, n), int)


class LabelModel:
    """P(type) and, for each labelling function, P(vote | type)."""

    def __init__(self, prior: np.ndarray, table: np.ndarray) -> None:
        self.prior, self.table = prior, table  # (types), (voters, types, symbols)

    def posterior(self, matrix: np.ndarray) -> np.ndarray:
        log = np.log(self.prior) + sum(np.log(self.table[v, :, matrix[:, v]]) for v in range(matrix.shape[1]))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, matrix: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
        """Expectation-maximisation from the majority's opinion; a prior keeps each voter better than chance."""
        voters, types = matrix.shape[1], len(TYPES)
        start = np.stack([(matrix == t + 1).sum(axis=1) for t in range(types)], axis=1) + 0.1
        belief = start / start.sum(axis=1, keepdims=True)
        honest = np.full((types, SYMBOLS), 1.0)
        for t in range(types):
            honest[t, t + 1] += 8.0
        model = cls(np.full(types, 1 / types), np.ones((voters, types, SYMBOLS)) / SYMBOLS)
        for _ in range(rounds):
            weight = belief * counts[:, None]
            prior = weight.sum(axis=0) + 1
            table = np.stack([honest + np.stack([weight[matrix[:, v] == s].sum(axis=0) for s in range(SYMBOLS)], axis=1) for v in range(voters)])
            model = cls(prior / prior.sum(), table / table.sum(axis=2, keepdims=True))
            belief = model.posterior(matrix)
        return model


def fit(stats: DataFrame) -> LabelModel:
    """The model of all documents that are not blank, from the counts of their vote patterns."""
    rows = stats.where("not blank").groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    codes, counts = np.array([r["votes"] for r in rows], int), np.array([r["n"] for r in rows], float)
    return LabelModel.fit(unpack(codes), counts)


def text_types(df: DataFrame, row: str, text: str, common: DataFrame) -> DataFrame:
    """The statistics of :func:`text_statistics` with p_<type> of each type and the likeliest ``text_type``."""
    stats = cut(text_statistics(df, row, text, common))
    model = fit(stats)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blank = b.column("blank").to_numpy(zero_copy_only=False)
            p = model.posterior(unpack(b.column("votes").to_numpy()))
            names = pa.array([None if e else TYPES[k] for e, k in zip(blank, p.argmax(axis=1))] if len(p) else [], pa.string())
            kept = [b.column(c) for c in b.schema.names if c != "votes"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.where(blank, np.nan, p[:, i]), pa.float64(), from_pandas=True) for i in range(len(TYPES))), names], [*(c for c in b.schema.names if c != "votes"), *(f"p_{t}" for t in TYPES), "text_type"])

    fields = ", ".join([f"{c} {t}" for c, t in stats.dtypes if c != "votes"] + [f"p_{t} double" for t in TYPES] + ["text_type string"])
    return stats.mapInArrow(judge, fields)
