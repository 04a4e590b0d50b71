"""Columns over parsed messages: content items, texts and what makes a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.functions.text import SPACE, is_blank, strip
from tesseral.functions.variant import items_at, text_at

# The tags and markers that agent sessions write into user texts.
STDOUT = "<local-command-stdout>"
CAVEAT = "<local-command-caveat>"
NOTIFICATION = "<task-notification>"
NAME_TAG = r"(?s)<command-name>(.*?)</command-name>"
ARGS_TAG = r"(?s)<command-args>(.*?)</command-args>"
INTERRUPTED = rf"\[Request interrupted by user[^\]]*\]{SPACE}*\z"
#: Tools that start a subagent.
AGENT_TOOLS = ("Agent", "Task", "Workflow")
NOTIFICATION_FIELDS = ("task-id", "tool-use-id", "status", "summary", "result", "subagent_tokens", "tool_uses", "duration_ms")


def items(message: Column) -> Column:
    """The content list as typed structs; empty where content is no list."""
    get = lambda x, k: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{k}", "variant")) == "STRING", F.try_variant_get(x, f"$.{k}", "string"))
    return F.transform(
        F.coalesce(items_at(message, "content"), F.array().cast("array<variant>")),
        lambda x: F.struct(
            F.try_variant_get(x, "$.type", "string").alias("kind"), get(x, "text").alias("text"), F.try_variant_get(x, "$.name", "string").alias("name"), F.try_variant_get(x, "$.id", "string").alias("id"),
            F.try_variant_get(x, "$.tool_use_id", "string").alias("tool_use_id"), F.try_variant_get(x, "$.input", "variant").alias("input"), F.try_variant_get(x, "$.content", "variant").alias("content"),
        ),
    )


def result_text(content: Column) -> Column:
    """A tool result's text: a string as it is, of a list the items' texts line by line, else empty."""
    listed = F.transform(F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.coalesce(text_at(c, "text"), F.lit("")))
    return F.coalesce(text_at(content), F.array_join(listed, "\n"))


def user_text(message: Column, parts: Column) -> Column:
    """A user's own words: a string content as it is; of a list the stripped texts, null if it holds a tool result."""
    said = F.transform(F.filter(parts, lambda i: (i["kind"] == "text") & ~F.coalesce(is_blank(i["text"]), F.lit(True))), lambda i: strip(i["text"]))
    listed = F.when(~F.exists(parts, lambda i: F.coalesce(i["kind"] == "tool_result", F.lit(False))), F.array_join(said, "\n"))
    return F.coalesce(text_at(message, "content"), F.when(items_at(message, "content").isNotNull(), listed))


def is_stdout(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{SPACE}*{STDOUT}"), F.lit(False))


def prompt_text(kind: Column, is_meta: Column, text: Column, output_next: Column) -> Column:
    """The prompt a user event states, or null if it states none.

    ``output_next`` says whether the next event of the file is a command's output. A command wrapper
    is the prompt ``name args``, unless its output follows, in which case it ran locally.
    """
    # Expressions over whole texts are asked only where a plain search has found their tag.
    name, args = F.regexp_extract(text, NAME_TAG, 1), F.regexp_extract(text, ARGS_TAG, 1)
    wrapped = F.when(text.contains("<command-name>"), name != "").otherwise(False)
    none = (
        (kind != "user") | kind.isNull() | F.coalesce(is_meta, F.lit(False)) | text.isNull() | is_stdout(text) | (wrapped & output_next)
        | text.rlike(f"^{SPACE}*(?:{CAVEAT}|{NOTIFICATION}|{INTERRUPTED}|\\z)")
    )
    return F.when(~none, F.when(wrapped, strip(F.concat_ws(" ", strip(name), strip(args)))).otherwise(text))


def notification(text: Column) -> Column:
    """The fields of a task notification as a struct; a missing tag is null, numbers are read or null."""
    get = lambda t: F.nullif(F.regexp_extract(text, f"(?s)<{t}>(.*?)</{t}>", 1), F.lit(""))
    plain = [strip(get(t)).alias(t.replace("-", "_")) for t in NOTIFICATION_FIELDS[:5]]
    numbers = [strip(get(t)).try_cast("bigint").alias(t) for t in NOTIFICATION_FIELDS[5:]]
    return F.when(strip(text).startswith(NOTIFICATION), F.struct(*plain, *numbers))


def mentions_command(name: Column, prompt: Column) -> Column:
    """Whether a prompt calls ``/name``: not inside a path or a longer word, in any letter case."""
    return F.rlike(prompt, F.concat(F.lit(r"(?i)(?<![\w./:-])/\Q"), name, F.lit(r"\E(?![\w:-])")))


def wrapper_name(text: Column) -> Column:
    """The command a wrapper names, lower case and without its slash; null if there is none."""
    return F.nullif(F.lower(F.regexp_replace(strip(F.regexp_extract(text, NAME_TAG, 1)), "^/", "")), F.lit(""))
