"""Rules as checks: declared patterns evaluated over written files, commands and paths.

Patterns are Python regular expressions, so matching runs in Arrow batches; everything around it
(who is in scope, what a session's commands satisfy, how findings fold to states) is DataFrame
work. A check must pass its own examples before it is used.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The closed vocabulary of checks, what each needs, and the marker that suppresses one.
SOURCE = {"forbidden_pattern": ("pattern",), "required_pattern": ("pattern",), "forbidden_co_occurrence": ("pattern", "with_pattern"), "required_co_occurrence": ("pattern", "with_pattern"), "required_order": ("first_pattern", "second_pattern")}
SHELL = {"forbidden_command": ("pattern",), "required_command": ("pattern", "trigger_pattern")}
PATH = {"forbidden_path": ("pattern",)}
NEEDS = SOURCE | SHELL | PATH
CONFIDENCE = ("high", "medium", "low")
SUPPRESS = re.compile(r"ctx-allow(?:\s*:\s*([A-Za-z0-9_-]+))?", re.I)
STATES = ["violated", "acknowledged", "unclear", "clear", "not-exercised", "not-checkable"]
# Extensions whose comments begin with a hash, and those of the C family.
HASH_EXT = ".py .sh .bash .zsh .rb .yml .yaml .toml .cfg .ini .pl .r".split()
C_EXT = ".ts .tsx .js .jsx .mjs .cjs .mts .cts .go .rs .java .kt .swift .c .h .cc .cpp .hpp .cs .m .mm .php .scala .dart .css .scss .less .sass .vue .svelte .json5 .proto".split()
TRIPLE_EXT = [".py"]

_C = re.compile(r"""(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)""")
_HASH = re.compile(r"""(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<comment>\#[^\n]*)""")
_TRIPLE = re.compile(r'''(?P<comment>"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|\#[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)''')


def strip_code(text: str, path: str, strings: bool = False) -> str:
    """The text with comments (and ``strings``) blanked, every other character in its place."""
    ext = "." + path.rpartition(".")[2].lower() if "." in path else ""
    rule = _TRIPLE if ext in TRIPLE_EXT else _HASH if ext in HASH_EXT else _C if ext in C_EXT else None
    if rule is None:
        return text
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    return rule.sub(lambda m: blank(m[0]) if m.lastgroup == "comment" or strings else m[0], text)


def in_scope(path: str, globs: list[str]) -> bool:
    """Whether a path or its name matches a glob; ``*`` crosses slashes and a leading ``**/`` may be absent."""
    names = (path, path.rpartition("/")[2])
    return not globs or any(fnmatch.fnmatchcase(n, v) for g in globs for v in {g, g.removeprefix("**/")} for n in names)


def span(check: dict[str, Any], text: str) -> tuple[int, int] | None:
    """What to cite where a source check fires on a text, else None."""
    find = lambda k: re.search(check[k], text, re.MULTILINE)
    kind = check["kind"]
    if kind == "required_order":
        a, b = find("first_pattern"), find("second_pattern")
        return a.span() if a and b and a.start() > b.start() else None
    hit = find("pattern")
    if kind == "required_pattern":
        line = None if hit else re.search(r"^.*\S.*$", text, re.MULTILINE)
        return line.span() if line else None
    if not hit or (kind != "forbidden_pattern" and bool(find("with_pattern")) != (kind == "forbidden_co_occurrence")):
        return None
    return hit.span()


def suppressed(text: str, at: int, check_id: str) -> bool:
    """Whether a marker for the check stands on the line or the one above."""
    n = text.count("\n", 0, at)
    return any((m := SUPPRESS.search(x)) is not None and (not m[1] or m[1] == check_id) for x in text.split("\n")[max(0, n - 1) : n + 1])


def judge(check: dict[str, Any], path: str, text: str) -> tuple[str, int, str] | None:
    """(state, line, match) of a source check on one file.

    Violated needs the text as it stands and the text without comments to agree; one alone is unclear.
    """
    if not in_scope(path, check.get("applies_to") or []):
        return None
    plain, bare = span(check, text), span(check, strip_code(text, path, bool(check.get("ignore_strings"))))
    if not plain and not bare:
        return None
    if plain and bare and text[slice(*bare)].strip():
        at, state = bare, "acknowledged" if suppressed(text, bare[0], check["id"]) else "violated"
    else:
        at, state = plain or bare, "unclear"
    return state, text.count("\n", 0, at[0]) + 1, text[slice(*at)].strip()


def problem(check: dict[str, Any]) -> str | None:
    """Why a check can't be used, else None: shape, patterns, and its own examples."""
    if not isinstance(check, dict):
        return "no object"
    kind = check.get("kind")
    if not check.get("id"):
        return "no id"
    if kind not in NEEDS:
        return f"unknown kind {kind}"
    if kind in SOURCE and not check.get("applies_to"):
        return "no applies_to"
    for k in NEEDS[kind]:
        try:
            re.compile(check[k])
        except KeyError:
            return f"no {k}"
        except re.error as e:
            return f"bad {k}: {e}"
    if check.get("confidence") not in CONFIDENCE:
        return "bad confidence"
    tests = check.get("self_test") or {}
    if not tests.get("should_match") or not tests.get("should_not_match"):
        return "no self test"
    path = (check.get("applies_to") or ["x.txt"])[0].replace("**/", "").replace("*", "x")

    def fires(example: str) -> bool:
        if kind in SOURCE:
            return (got := judge(check, path, example)) is not None and got[0] == "violated"
        if kind == "required_command":
            return bool(re.search(check["trigger_pattern"], example, re.M)) and not re.search(check["pattern"], example, re.M)
        return bool(re.search(check["pattern"], example, re.M))

    for want, examples in ((True, tests["should_match"]), (False, tests["should_not_match"])):
        for x in examples:
            if fires(x) is not want:
                return "self test failed"
    return None


def load_checks(data: dict[str, Any]) -> tuple[list[dict[str, Any]], list[tuple[str, str]]]:
    """(accepted checks, (id, reason) of the rejected)."""
    good, bad = [], []
    for c in data.get("checks") or []:
        reason = problem(c)
        if reason is None:
            good.append(c)
        else:
            bad.append((str(c.get("id") or "") if isinstance(c, dict) else "", reason))
    return good, bad


def not_checkable(data: dict[str, Any]) -> list[tuple[str, str, str]]:
    """(rule_ref, rule_text, why) of the rules a file says can't be checked; entries of another shape are left out."""
    return [(str(x.get("rule_ref") or ""), str(x.get("rule_text") or ""), str(x.get("why") or "")) for x in data.get("not_checkable") or [] if isinstance(x, dict)]


# How a text forbids something, and what in backticks looks like code or a glob.
FORBIDS = re.compile(r"\b(?:never|don't|do not|avoid|must not|no longer)\b[^.\n]{0,40}?`([A-Za-z_][A-Za-z0-9_.]{2,}(?:\(\))?)`", re.I)
GLOB = re.compile(r"`(\*{1,2}[^`\s]*\.\w+|[\w*/.-]+\.\w+)`")
CODE_SHAPED = re.compile(r"[A-Z_.]|\(\)$")
#: Checks taken from one text at most: a guess is kept small.
FALLBACK = 5


def fallback_checks(title: str, content: str | None) -> list[dict[str, Any]]:
    """Checks guessed from a text that forbids code by name; of low confidence, for code files only."""
    text = content or ""
    globs = [g for g in GLOB.findall(text) if "*" in g or g[0] == "."] or sorted(f"**/*{e}" for e in HASH_EXT + C_EXT)
    names = {n.lower(): n for n in reversed(FORBIDS.findall(text)) if CODE_SHAPED.search(n)}
    first = sorted(names.values(), key=text.index)[:FALLBACK]
    return [
        {"id": "fallback-" + re.sub("[^a-z0-9]+", "-", n.lower()).strip("-"), "rule_ref": title, "rule_text": text.strip()[:200], "kind": "forbidden_pattern", "pattern": rf"\b{re.escape(n.rstrip('()'))}\b", "applies_to": globs, "confidence": "low"} for n in first
    ]


def bind(checks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, block_idx, check_id, stale): checks (doc, check_id, rule_ref, rule_key) with the block their reference names.

    A reference names a block by its heading, either containing the other, or by a line inside it. A
    check is stale if its key is not the block's any more. Headings are compared inside a document only.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    ref, title = flat(F.col("rule_ref")), flat(F.col("title"))
    line = F.regexp_extract("rule_ref", r"(\d+)\s*$", 1).try_cast("int")
    named = (title != "") & (ref != "") & (ref.contains(title) | title.contains(ref))
    j = checks.join(blocks.withColumnRenamed("rule_key", "_key"), "doc").where(named | line.between(F.col("start_line"), F.col("end_line")))
    return j.select("doc", "block_idx", "check_id", (F.col("rule_key").isNotNull() & (F.col("rule_key") != F.col("_key"))).alias("stale"))


def written_files(calls: DataFrame) -> DataFrame:
    """(session_key, path, first, text): what a session wrote into each file, its pieces in order."""
    j = lambda k: F.get_json_object("input", f"$.{k}")
    edits = F.transform(F.from_json(j("edits"), "array<struct<new_string:string>>"), lambda e: e["new_string"])
    text = F.coalesce(F.when(F.col("name") == "MultiEdit", F.array_join(edits, "\n")), j("new_string"), j("content"))
    c = calls.where("name in ('Edit', 'Write', 'MultiEdit')").select("session_key", j("file_path").alias("path"), F.struct("event_idx", "item_idx").alias("at"), text.alias("text")).where("path is not null and text is not null")
    g = c.groupBy("session_key", "path").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_t"))
    return g.select("session_key", "path", "first", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("text"))


def shell_commands(calls: DataFrame) -> DataFrame:
    return calls.where("name = 'Bash'").select("session_key", F.struct("event_idx", "item_idx").alias("at"), F.get_json_object("input", "$.command").alias("command")).where("command is not null")


def findings(calls: DataFrame, checks: list[dict[str, Any]]) -> DataFrame:
    """(session_key, check_no, check_id, state, confidence, path, line, match): every finding of every check."""
    files = written_files(calls)
    schema = "session_key string, check_no int, check_id string, state string, confidence string, path string, line int, match string"
    by = {k: [(i, c) for i, c in enumerate(checks) if c["kind"] in g] for k, g in (("source", SOURCE), ("shell", SHELL), ("path", PATH))}

    def row(r: Any, i: int, c: dict, state: str, path: str, line: int, match: str) -> tuple:
        return (r.session_key, i, c["id"], state, c["confidence"], path, line, match)

    def over_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for i, c in by["source"]:
                    if (got := judge(c, r.path, r.text)) is not None:
                        out.append(row(r, i, c, got[0], r.path, got[1], got[2]))
                for i, c in by["path"]:
                    if m := re.search(c["pattern"], r.path, re.M):
                        out.append(row(r, i, c, "violated", r.path, 1, m[0].strip()))
            yield pd.DataFrame(out, columns=names)

    def over_commands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for i, c in by["shell"]:
                    need = c["kind"] == "required_command"
                    if need and re.search(c["pattern"], r.command, re.M):
                        out.append(row(r, i, c, "satisfied", "", 0, ""))
                    if m := re.search(c["trigger_pattern" if need else "pattern"], r.command, re.M):
                        state = "acknowledged" if suppressed(r.command, m.start(), c["id"]) else "violated"
                        out.append(row(r, i, c, state, "(shell)", r.command.count("\n", 0, m.start()) + 1, m[0].strip()))
            yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in schema.split(", ")]
    a = files.select("session_key", "path", "text").mapInPandas(over_files, schema)
    s = shell_commands(calls).select("session_key", "command").mapInPandas(over_commands, schema)
    # A required command that any command of the session satisfies is no finding.
    met = s.where("state = 'satisfied'").select("session_key", "check_no").distinct()
    return a.unionByName(s.where("state <> 'satisfied'").join(met, ["session_key", "check_no"], "left_anti"))


def states(found: DataFrame, sessions: DataFrame, exercised: DataFrame) -> DataFrame:
    """(session_key, state, findings): the gravest state of each session; clear or not exercised where nothing was found."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    f = found.groupBy("session_key").agg(F.min(rank).alias("_r"), F.count("*").alias("findings"))
    x = sessions.join(f, "session_key", "left").join(exercised.select("session_key").distinct().withColumn("_e", F.lit(True)), "session_key", "left")
    worst = F.when(F.col("_r").isNotNull(), F.get(F.array(*map(F.lit, STATES)), (F.col("_r") - 1).cast("int")))
    return x.select("session_key", F.coalesce(worst, F.when(F.col("_e"), "clear").otherwise("not-exercised")).alias("state"), F.coalesce("findings", F.lit(0)).alias("findings"))
