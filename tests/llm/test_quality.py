"""Statistics and types of texts."""

import numpy as np
import pytest

from tesseral.llm.quality import STATS, SYMBOLS, TYPES, VOTERS, Common, LabelModel, _Reader, statistics, text_statistics, text_types, unpack, votes

WORDS = [("en", w) for w in "the of and to in a is that it for was on are as with be by this not or from at have an but which they we when will".split()] + [("de", w) for w in "der die das und in zu den nicht ist mit".split()]
PROSE = "This is the text that was written for the test, and it is not a list. When they have read it, we will be in a state that is of use to them."
CASES = {
    "prose": [PROSE, PROSE.lower().replace(".", "").replace(",", ""), "\n".join(PROSE.split(". ")), "> " + PROSE, "# Title\n\n" + PROSE, PROSE + "\n\n- one\n- two", "これは一度しか使われていないので、規則から外してください。長い場合は先に読みます。", "The end of it was that\nit was on line\n7. They have read it in the house by the sea, and it is not here."],
    "list": ["- the end of it\n- a state of the thing\n* that is for us", "These are items:\n1. It is the one that was on the list.\n2. This is not the one that was in it.", "a) one; b\nb) two; c\nc) three; d", "lib/a.py\nlib/b.py\nsrc/c.rs\ndocs/d.md"],
    "table": ["| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "a,b,c\n1,2,3\n4,5,6\n7,8,9", "x\ty\tz\n1\t2\t3\n4\t5\t6", '"a";"b"\n"c";"d"'],
    "junk": ["0" * 500, "ZQ" * 300, "the of and to in a is that it for was on are as with be by this not or from", "Zelshi tas zelrenganqua minyzelqua exshiwamgan shiny renplufi korrenwamqua", "@ if (a_b.c !== null) {\n+  return x[3];\n-  }\n", "00000000  27 0c 5c 6f 0e e4 19 9e\n00000010  6f 1d a1 32 23 87 de a1"],
}


@pytest.fixture(scope="module")
def judged(spark):
    texts = [(kind, t) for kind, ts in CASES.items() for t in ts] * 3 + [("", None), ("", ""), ("", " \n\t")]
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, (_, t) in enumerate(texts)], "doc_id bigint, text string, votes string, n_words double")
    common = spark.createDataFrame([*WORDS, (None, "x"), ("en", None)], "lang string, word string")
    out = {r["row"]: r for r in text_types(df, "doc_id", "text", common).collect()}
    return [(kind, t, out[i]) for i, (kind, t) in enumerate(texts)]


def test_types(judged):
    wrong = [(kind, r["text_type"], t[:40]) for kind, t, r in judged if kind and (kind == "prose") != (r["text_type"] == "prose")]
    assert wrong == []
    assert sum(r["text_type"] == kind for kind, _, r in judged if kind) >= 0.9 * sum(bool(k) for k, _, _ in judged)


def test_blank_texts_have_no_type(judged):
    for kind, _, r in judged:
        if not kind:
            assert r["text_type"] is None and r["blank"] and r["n_words"] == 0 and r["p_prose"] is None


def test_posteriors_sum_to_one(judged):
    assert all(abs(sum(r[f"p_{t}"] for t in TYPES) - 1) < 1e-9 for kind, _, r in judged if kind)


def test_statistics_of_a_small_text():
    s = dict(zip(STATS, statistics("It is on.\nXyz was 12!", _Reader(Common(WORDS)))))
    assert s["n_words"] == 5 and s["punctuated_lines"] == 1 and s["common_words"] == 4 / 5 and s["n_lines"] == 2
    assert abs(s["digit_ratio"] - 2 / 16) < 1e-9


def test_model_learns_who_can_be_trusted():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 4, 4000)
    matrix = np.stack([np.where(rng.random(4000) < p, truth, rng.integers(0, 4, 4000)) + 1 for p in (0.9, 0.9, 0.85, 0.0, 0.0, 0.0, 0.0, 0.0)], axis=1)
    pats, back, n = np.unique(matrix, axis=0, return_inverse=True, return_counts=True)
    model = LabelModel.fit(pats, n.astype(float))
    assert (model.posterior(pats).argmax(axis=1)[back.ravel()] == truth).mean() > 0.9


def test_codes_round_trip():
    v = np.array([[1, 0, 3, 4, 2, 0, 1, 4, 0, 3]])
    code = 0
    for x in v[0]:
        code = code * SYMBOLS + int(x)
    assert (unpack(np.array([code])) == v).all() and len(VOTERS) == v.shape[1]


def _mixed(n):
    """Prose, lists of fragments and lists of sentences, tables and junk, with how many of each."""
    items = "\n".join(f"- {w} {w}ing" for w in ("red", "blue", "green", "grey"))
    said = "\n".join(f"{i}. It is the one that was on the list, and we have it." for i in range(1, 6))
    return [("prose", PROSE)] * (7 * n) + [("list", items)] * (2 * n) + [("list", said)] * (n // 2) + [("table", "\n".join("a,7,9,12" for _ in range(5)))] * n + [("junk", "0" * 400)] * n


def test_the_model_decides_and_not_the_majority(spark):
    """Lists of sentences win more votes for prose than for list; what the voters are worth tells them apart."""
    texts = _mixed(20)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id bigint, text string")
    common = spark.createDataFrame(WORDS, "lang string, word string")
    got = {r["row"]: r["text_type"] for r in text_types(df, "doc_id", "text", common).collect()}
    assert all((got[i] == "prose") == (k == "prose") for i, (k, _) in enumerate(texts))
    stats = text_statistics(df, "doc_id", "text", common).collect()
    matrix = unpack(np.array([r["votes"] for r in sorted(stats, key=lambda r: r["row"])]))
    majority = np.stack([(matrix == t + 1).sum(axis=1) for t in range(len(TYPES))], axis=1).argmax(axis=1)
    wrong = [k for (k, t), m in zip(texts, majority) if k == "list" and m == 0 and t.startswith("1.")]
    assert len(wrong) == 10


def test_the_model_overrules_the_reading_of_lines():
    """A voter that says prose alone against several that are worth more does not win."""
    reader = _Reader(Common(WORDS))
    texts = [t for _, t in _mixed(20)]
    m = [votes(dict(zip(STATS, statistics(t, reader)))) for t in texts]
    m.append((1, *votes(dict(zip(STATS, statistics("a,7,9,12\n" * 5, reader))))[1:]))
    m = np.array(m)
    pats, n = np.unique(m, axis=0, return_counts=True)
    assert LabelModel.fit(pats, n.astype(float)).posterior(m[-1:]).argmax() == TYPES.index("table")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert text_types(df, "doc_id", "text", spark.createDataFrame(WORDS, "lang string, word string")).collect() == []
