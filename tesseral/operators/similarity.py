"""Texts that share most of their words in order.

Exact copies are one class each; only a representative of each class is compared. Two
representatives can reach the containment only if they share one of the rarest shingles of the
smaller: of a set of n shingles, the n - ceil(t n) + 1 rarest. So these alone are looked up in the
index of all shingles, which avoids the lists of common phrases without leaving out a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.text import let
from tesseral.session import cut

# Fixed value: words that make no shingle.
STOP = "the and for are was with that this from have you your all any but not use into onto out".split()
WORDS, THRESHOLD = 5, 0.8


def normal(text: Column) -> Column:
    """Without fenced and inline code and addresses; white space runs one blank; lower case."""
    t = F.regexp_replace(text, r"(?s)```.*?```", " ")
    for p in (r"`[^`]+`", r"https?://\S+"):
        t = F.regexp_replace(t, p, " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def shingles(text: Column, words: int = WORDS) -> Column:
    """The distinct runs of so many words; words are three letters or more, without the stop words."""
    return _runs(normal(text), words)


def _runs(text: Column, words: int) -> Column:
    """The shingles of a normal text."""
    stop = F.array(*map(F.lit, STOP))
    kept = F.filter(F.regexp_extract_all(text, F.lit(r"([a-z][a-z0-9-]{2,})"), F.lit(1)), lambda x: ~F.array_contains(stop, x))

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) >= words, F.sequence(F.lit(1), F.size(w) - words + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(w, i, words), " ")))

    return let(kept, runs)


def containment(a: Column, b: Column) -> Column:
    """Shared shingles over the smaller set's; 0 if either is empty."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def sketches(df: DataFrame, doc: str, text: str, words: int = WORDS) -> DataFrame:
    """(doc, h, s): the hash of each normal text and of its shingles; a text is made normal once."""
    both = let(normal(F.col(text)), lambda t: F.struct(F.sha2(t, 256).alias("h"), F.transform(_runs(t, words), lambda s: F.xxhash64(s)).alias("s")))
    return df.where(F.col(text).isNotNull()).select(doc, both.alias("_x")).select(doc, "_x.h", "_x.s")


def classes(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, class_id): copies of one normal text have one class, its least doc."""
    x = df.where(F.col(text).isNotNull()).select(doc, F.sha2(normal(F.col(text)), 256).alias("_h"))
    return x.join(x.groupBy("_h").agg(F.min(doc).alias("class_id")), "_h").select(doc, "class_id")


def similar_pairs(reps: DataFrame, doc: str, text: str, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, shared, similarity): every pair of texts that reaches the containment; doc_a has fewer shingles."""
    return _similar_sets(cut(sketches(reps, doc, text, words).where("size(s) > 0").select(F.col(doc).alias("d"), "s", F.size("s").alias("n"))), threshold)


def _similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of (d, s, n), sets of n hashes, that reach the containment. ``sets`` is read several times."""
    all_ = sets.select("d", "n", F.explode("s").alias("h"))
    often = all_.groupBy("h").agg(F.count("*").alias("df"))
    # Rarest first; the prefix that any partner must share one shingle of.
    w = Window.partitionBy("d").orderBy("df", "h")
    prefix = all_.join(often, "h").withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    a, b = prefix.select(F.col("d").alias("doc_a"), F.col("n").alias("n_a"), "h"), all_.select(F.col("d").alias("doc_b"), F.col("n").alias("n_b"), "h")
    cand = a.join(b, "h").where((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_a") < F.col("doc_b")))).select("doc_a", "doc_b").distinct()
    x = cand.join(sets.select(F.col("d").alias("doc_a"), F.col("s").alias("s_a"), F.col("n").alias("n_a")), "doc_a").join(sets.select(F.col("d").alias("doc_b"), F.col("s").alias("s_b")), "doc_b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return x.select("doc_a", "doc_b", shared.alias("shared"), (shared / F.col("n_a")).alias("similarity")).where(F.col("similarity") >= threshold)


def shared_phrase(a: Column, b: Column, words: int = WORDS) -> Column:
    """The longest shingle both have; of equal ones the first by letters."""
    both = F.transform(F.array_intersect(shingles(a, words), shingles(b, words)), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))
    return F.array_min(both)["s"]


def near_copies(df: DataFrame, doc: str, text: str, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, class_id, links): one row a text, with its class of copies and how many other classes that one is similar to."""
    every = cut(sketches(df, doc, text, words))
    least = every.groupBy("h").agg(F.min(doc).alias("class_id"))
    c = every.select(doc, "h").join(least, "h").select(doc, "class_id")
    sets = cut(every.where("size(s) > 0").join(least.select(F.col("class_id").alias(doc)), doc, "left_semi").select(F.col(doc).alias("d"), "s", F.size("s").alias("n")))
    p = _similar_sets(sets, threshold)
    n = p.select(F.explode(F.array("doc_a", "doc_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return c.join(n, "class_id", "left").select(doc, "class_id", F.coalesce("links", F.lit(0)).alias("links"))
