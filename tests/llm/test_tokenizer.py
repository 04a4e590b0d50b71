"""Encoding with a public vocabulary."""

import base64
import random
from pathlib import Path

import numpy as np
import pytest
import tiktoken

from tesseral.llm.tokenizer import PATTERN, VOCABULARIES, Encoder, Vocabulary, encode, read_model


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_model("byte_bpe_50k"))


@pytest.fixture(scope="module")
def judge():
    lines = Path(VOCABULARIES, "byte_bpe_50k.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(vocabulary, texts):
    sizes, flat = Encoder(vocabulary).encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if texts else []


TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na\tb\r\n", "don't we'LL I'm", "<|endoftext|> x", "été 漢字かな ​ 　x", "\x1c\x00 \x85\xa0", "👩‍💻🇩🇪", "x" * 5000, "ab" * 3000, "1234567", " !?", "a\n", "\n a"]


def test_special_shapes(vocabulary, judge):
    assert ids(vocabulary, TEXTS) == [judge.encode_ordinary(t) for t in TEXTS]


def test_random_texts(vocabulary, judge):
    rnd = random.Random(4)
    letters = "aabbcde  \n\t'’.,-_0129é漢　 ßΩ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    assert ids(vocabulary, texts) == [judge.encode_ordinary(t) for t in texts]


def test_every_token_is_its_own_encoding(vocabulary):
    words = list(vocabulary.ids)
    assert [t for t, _ in zip(vocabulary.encode_words(words)[0], words)] == [[vocabulary.ids[w]] for w in words]


def test_speculation_agrees_with_merging(vocabulary):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 14))).encode() for _ in range(4000)]
    tokens, merged = vocabulary.encode_words(words)
    assert tokens == [vocabulary.merge(w) for w in words]
    assert 0 < merged < len(words)


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr("tesseral.llm.tokenizer.CACHE_CHARS", 10)
    e = Encoder(vocabulary)
    first = [e.encode([t])[1].tolist() for t in TEXTS]
    assert first == ids(vocabulary, TEXTS)


def test_rows_nulls_repeats_and_clashing_columns(spark, judge):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the same", "x"), (3, "the same", "x"), (4, " ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["row"], r["ids"]) for r in encode(df, "doc_id", "text").collect())
    assert got == sorted((i, judge.encode_ordinary(t or "")) for i, t, _ in rows)
    assert encode(df.limit(0), "doc_id", "text").collect() == []
