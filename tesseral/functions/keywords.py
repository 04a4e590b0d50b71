"""Keywords of a text and how far another is about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.functions.text import let

# Fixed value: words that are no keywords.
STOP = "about above after again always before below between could every first have having their there these those through under until where which while would should rules rule block section files file code task tasks".split()
# Fixed value: phrases that give reasons.
CAUSAL = r"(?i)\b(I'?ll|I'?m going to|Let me|Let's|I should|I need to|I want to|I'?ve|because|since|per\b|as the rule|the rule says|in line with|to comply|to follow|skipping|ignoring|following|noting|so I|so let)\b"


def keywords(text: Column, prompt: Column | None = None, n: int = 12, least: int = 5) -> Column:
    """The first distinct long words, without stop words and the words of the prompt."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"\b([A-Za-z][A-Za-z0-9_-]{{{least - 1},}})\b"), F.lit(1)), lambda w: F.lower(w)))
    kept = F.array_except(words, F.array(*map(F.lit, STOP)))
    if prompt is not None:
        kept = F.array_except(kept, F.coalesce(F.regexp_extract_all(prompt, F.lit(rf"\b([A-Za-z][A-Za-z0-9_-]{{{least - 1},}})\b"), F.lit(1)), F.array().cast("array<string>")))
    return F.slice(kept, 1, n)


def hits(text: Column, words: Column) -> Column:
    """How many of the words a text contains."""
    return let(F.lower(text), lambda t: F.size(F.filter(words, lambda w: t.contains(w))))


def bonus(text: Column, weights: dict[str, int]) -> Column:
    """Points of a text whatever the keywords are: those of each pattern it matches."""
    return sum((F.when(text.rlike(p), n).otherwise(0) for p, n in weights.items()), F.lit(0))


def grams(text: Column, n: int = 5) -> Column:
    """The distinct runs of ``n`` characters inside the text's words, lower case: a word of n or more that a text contains begins with one of them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"([a-z0-9_-]{{{n},}})"), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n)))))


def sentences(text: Column) -> Column:
    """Sentences of more than eight characters."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.length(s) > 8)


def reason_sentence(text: Column, keep: int = 280) -> Column:
    """The first sentence that gives a reason, else the first."""
    s = sentences(text)
    return F.substring(F.coalesce(F.get(F.filter(s, lambda x: x.rlike(CAUSAL)), F.lit(0)), F.get(s, F.lit(0)), F.trim(text)), 1, keep)


def backticked(text: Column) -> Column:
    """What stands in single backticks."""
    return F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), F.lit(1))
