"""Documents, similarity, formats, rules."""

from pyspark.sql import functions as F

from tesseral.functions import format as fmt
from tesseral.functions import keywords as kw
from tesseral.operators import rules, similarity
from tesseral.sources import documents as docs


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(col).collect()[0][0]


def test_blocks_respect_fences(spark):
    text = "before\n# One  \nline\n```\n# not a heading\n```\n### third level\n## Two\n\nlast"
    b = docs.markdown_blocks(spark.createDataFrame([(1, text), (2, None), (3, "no heading")], "d int, t string"), "d", "t").orderBy("block_idx").collect()
    assert [(r["title"], r["level"], r["start_line"], r["end_line"]) for r in b] == [("One", 1, 2, 7), ("Two", 2, 8, 10)]
    assert b[0]["content"].startswith("line\n```") and b[1]["content"] == "last"


def test_references_take_the_first_root(spark):
    d = spark.createDataFrame([(1, "see @a.md and @b.md, not x@c.md")], "d int, t string")
    files = spark.createDataFrame([("r2/a.md",), ("r1/a.md",), ("/b.md",)], "path string")
    got = docs.resolve(docs.references(d, "d", "t"), files, ["r1", "r2"]).collect()
    assert [(r["ref"], r["path"]) for r in got] == [("a.md", "r1/a.md")]


def test_formats(spark):
    for n in [0, 999, 1000, 1050, 1250, 1350, 1750, 6250, 7100, 9949, 9950, 12_000, 12_500, 13_500, 999_499, 1_200_000]:
        want = str(n) if n < 1000 else f"{n / 1000:.1f}k" if n < 10_000 else f"{n / 1000:.0f}k" if n < 1_000_000 else f"{n / 1e6:.1f}M"
        assert one(spark, fmt.short_count(F.col("n")), n=n) == want
    assert [one(spark, fmt.duration(F.col("n")), n=n) for n in (5, 125, 3720)] == ["5s", "2m05s", "1h02m"]
    assert one(spark, fmt.file_slug(F.col("p")), p="/Home/My Dir/x.md") == "home-my-dir-x-md"
    assert one(spark, fmt.title_slug(F.col("p")), p="!!") == "block"
    assert one(spark, fmt.normal_path(F.col("p")), p=" /a//./b/ ") == "/a/b"
    assert one(spark, fmt.preview(F.col("p")), p="x" * 141) == "x" * 140 + "…"


def test_keywords(spark):
    t = "Always check the Pipeline and the pipeline-runner before deploying Pipeline widgets"
    assert one(spark, F.array_join(kw.keywords(F.col("t"), F.lit("widgets please")), ","), t=t) == "check,pipeline,pipeline-runner,deploying"
    assert one(spark, kw.hits(F.col("t"), F.array(F.lit("check"), F.lit("none"))) + kw.bonus(F.col("t"), {kw.CAUSAL: 2, "the rule": 1}), t="I'll check it") == 3
    assert one(spark, kw.reason_sentence(F.col("t")), t="This is a start. Because of that we go. End of it.") == "Because of that we go."


def test_similar_texts_against_brute_force(spark):
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join(base[:-2]), " ".join(base[:30] + ["other"] + base[31:]), " ".join(reversed(base)), "too short", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "d bigint, t string")
    got = {r["d"]: (r["class_id"], r["links"]) for r in similarity.near_copies(df, "d", "t").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in enumerate(texts) if t is not None and i != 1 for w in [t.lower().split()]}
    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and min(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.8:
                links[a] += 1
                links[b] += 1
    assert got == {i: (0 if i == 1 else i, links[0 if i == 1 else i]) for i in range(7)}
    assert links[0] == 2


def check(**k):
    return {"id": "c", "kind": "forbidden_pattern", "pattern": "bad", "applies_to": ["**/*.py"], "confidence": "high", "self_test": {"should_match": ["bad"], "should_not_match": ["good"]}} | k


def test_stripping_keeps_places():
    src = 'x = "bad" # bad\n"""bad\nbad"""\ny'
    out = rules.strip_code(src, "a.py")
    assert len(out) == len(src) and out.count("bad") == 1 and out.count("\n") == src.count("\n")
    assert "bad" not in rules.strip_code(src, "a.py", strings=True)
    assert rules.strip_code("a // bad\n/* bad */ 'bad'", "a.ts") == "a       \n          'bad'"
    assert rules.strip_code("# bad", "a.md") == "# bad"


def test_judgement():
    assert rules.judge(check(), "x/a.py", "ok\nbad") == ("violated", 2, "bad")
    assert rules.judge(check(), "x/a.ts", "bad") is None
    assert rules.judge(check(), "a.py", "# bad")[0] == "unclear"
    assert rules.judge(check(), "a.py", "# ctx-allow: c\nbad")[0] == "acknowledged"
    assert rules.judge(check(), "a.py", "# ctx-allow: other\nbad")[0] == "violated"
    assert rules.judge(check(kind="required_pattern"), "a.py", "\n  good") == ("violated", 2, "good")
    assert rules.judge(check(kind="required_order", first_pattern="a", second_pattern="b"), "a.py", "b a")[0] == "violated"
    co = check(kind="forbidden_co_occurrence", with_pattern="worse")
    assert rules.judge(co, "a.py", "bad worse")[0] == "violated" and rules.judge(co, "a.py", "bad") is None
    assert rules.judge(check(kind="required_co_occurrence", with_pattern="worse"), "a.py", "bad")[0] == "violated"


def test_gate_refuses():
    good, bad = rules.load_checks({"checks": [check(), check(id=""), check(kind="x"), check(pattern="("), check(confidence="?"), check(self_test={}), check(pattern="never"), check(applies_to=[])]})
    assert len(good) == 1 and len(bad) == 7


def test_findings_and_states(spark):
    edit = lambda p, t: ("Edit", '{"file_path":"%s","new_string":"%s"}' % (p, t))
    rows = [("s", *edit("a.py", "bad")), ("s", *edit("a.py", "more")), ("s", "Bash", '{"command":"test it"}'), ("t", "Bash", '{"command":"test it"}'), ("t", "Bash", '{"command":"build it"}'), ("u", "Read", '{"file_path":"a.py"}')]
    calls = spark.createDataFrame([(s, i, 0, n, j) for i, (s, n, j) in enumerate(rows)], "session_key string, event_idx bigint, item_idx int, name string, input string")
    need = check(id="b", kind="required_command", pattern="^build", trigger_pattern="^test")
    f = rules.findings(calls, [check(), need])
    assert sorted((r["session_key"], r["check_id"], r["path"], r["line"]) for r in f.collect()) == [("s", "b", "(shell)", 1), ("s", "c", "a.py", 1)]
    used = rules.written_files(calls).select("session_key").union(rules.shell_commands(calls).select("session_key"))
    assert {r["session_key"]: (r["state"], r["findings"]) for r in rules.states(f, calls.select("session_key").distinct(), used).collect()} == {"s": ("violated", 2), "t": ("clear", 0), "u": ("not-exercised", 0)}


def test_a_long_session_keeps_every_finding(spark):
    # 30 acknowledged findings of the first check stand before 30 violations of the second
    rows = [("s", i, 0, "Edit", '{"file_path":"a%d.py","new_string":"# ctx-allow: c\\nbad"}' % i) for i in range(30)] + [("s", 30 + i, 0, "Bash", '{"command":"lint %d"}' % i) for i in range(30)]
    calls = spark.createDataFrame(rows, "session_key string, event_idx bigint, item_idx int, name string, input string")
    f = rules.findings(calls, [check(), check(id="l", kind="forbidden_command", pattern="^lint")])
    assert {(r["check_id"], r["state"]): r["count"] for r in f.groupBy("check_id", "state").count().collect()} == {("c", "acknowledged"): 30, ("l", "violated"): 30}
    sessions = calls.select("session_key").distinct()
    assert [tuple(r) for r in rules.states(f, sessions, sessions).collect()] == [("s", "violated", 60)]


def test_fallback_and_binding(spark):
    got = rules.fallback_checks("T", "Never call `os.system` in `*.py`. Avoid `Foo()`; do not use `plain`. Never call `os.system` again.")
    assert [(c["id"], c["applies_to"]) for c in got] == [("fallback-os-system", ["*.py"]), ("fallback-foo", ["*.py"])]
    assert rules.fallback_checks("T", None) == []
    blocks = spark.createDataFrame([(1, 0, "Code Style", 1, 5, "k0"), (1, 1, "Tests", 6, 9, "k1"), (2, 0, "Tests", 1, 2, "k2")], "doc int, block_idx int, title string, start_line int, end_line int, rule_key string")
    checks = spark.createDataFrame([(1, "a", "code-style section", "k0"), (1, "b", "line 7", "old"), (1, "c", "nothing", None)], "doc int, check_id string, rule_ref string, rule_key string")
    assert sorted((r["check_id"], r["block_idx"], r["stale"]) for r in rules.bind(checks, blocks).collect()) == [("a", 0, False), ("b", 1, True)]


def test_listings(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    files = spark.createDataFrame([("r/a.md", t(1)), ("r/a/SKILL.md", t(1)), ("r/b/SKILL.md", t(1)), ("r/b/x.md", t(1)), ("p/x/1/s.md", t(2)), ("p/x/2/s.md", t(3)), ("r/a.checks.json", t(1)), ("r/b/x.md.checks.json", t(1))], "path string, modified timestamp")
    assert sorted(map(tuple, docs.units(files, "r/").collect())) == [("a", "r/a.md"), ("b", "r/b/SKILL.md")]
    assert [tuple(r) for r in docs.newest(files, r"^p/([^/]+)/[^/]+/s\.md$").collect()] == [("x", "p/x/2/s.md")]
    d = spark.createDataFrame([("r/a.md",), ("r/b/x.md",), ("r/none.md",)], "path string")
    assert {r["path"]: r["sidecar"] for r in docs.sidecars(d, files).collect()} == {"r/a.md": "r/a.checks.json", "r/b/x.md": "r/b/x.md.checks.json", "r/none.md": None}


def test_commands_in_prompts(spark):
    from tesseral.functions.messages import mentions_command, wrapper_name

    df = spark.createDataFrame([("run", "please /RUN it"), ("run", "a/run"), ("run", "/runner"), ("a.b", "/a.b"), ("a.b", "/axb")], "n string, p string")
    assert [r[0] for r in df.select(mentions_command(F.col("n"), F.col("p"))).collect()] == [True, False, False, True, False]
    assert one(spark, wrapper_name(F.col("t")), t="<command-name> /Deploy </command-name>") == "deploy"
