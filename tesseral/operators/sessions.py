"""Order-based operators over the events of sessions: turns, usage, transitions, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.variant import kind_bit
from tesseral.operators.blocks import _carried, block_of, earlier, running_sum

USAGE = {
    "input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens", "cache_creation_1h": "cache_creation.ephemeral_1h_input_tokens",
    "cache_creation_5m": "cache_creation.ephemeral_5m_input_tokens", "thinking": "output_tokens_details.thinking_tokens",
}
# A cache break needs so much cached before, at most this share left and this share written anew.
BREAK_MIN, BREAK_LEFT, BREAK_NEW = 5000, 0.2, 0.5


def in_order(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def turns(df: DataFrame, session: str, order: str) -> DataFrame:
    """(session, turn_idx, start, end, prompt): half-open ranges of sessionized rows."""
    return df.where("turn_idx is not null").groupBy(session, "turn_idx").agg(F.min(order).alias("start_event"), (F.max(order) + 1).alias("end_event"), F.min(F.struct(order, "turn_carry"))["turn_carry"].alias("prompt"))


def first_at_or_after(rows: DataFrame, marks: DataFrame, session: str, order: str, at: str, mark: str, bucket: int = 3_600_000_000) -> DataFrame:
    """For each mark the least ``order`` among its session's rows with ``at`` >= the mark's: first in file order, not in time.

    Rows and marks are laid in one order of time; the least order from a point on is one running
    minimum from the end, so no pair is made. It runs inside buckets of time; what the later buckets
    come to is carried by a table of one row a bucket.
    """
    a = rows.where(F.col(at).isNotNull()).select(session, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.col(order).alias("_o"), F.lit(None).cast(marks.schema[mark].dataType).alias(mark))
    b = marks.select(session, F.col(at).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(rows.schema[order].dataType).alias("_o"), mark)
    x = a.unionByName(b).withColumn("_b", block_of("_t", bucket))
    later = Window.partitionBy(session).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    least = x.groupBy(session, "_b").agg(F.min("_o").alias("_m")).select(session, "_b", F.min("_m").over(later).alias("_later"))
    w = Window.partitionBy(session, "_b").orderBy(F.desc("_t"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return _carried(x.withColumn("_i", F.min("_o").over(w)).where("_k = 0"), least, [session]).select(session, mark, F.least("_i", "_later").alias(order))


def count_of(v: Column, path: str) -> Column:
    """A token count: whole numbers as they are, broken ones cut off, anything else 0, booleans as 0 or 1."""
    x = F.try_variant_get(v, f"$.{path}", "variant")
    bit = kind_bit(x)
    return F.coalesce(F.when(bit == 8, F.try_variant_get(v, f"$.{path}", "boolean").cast("bigint")).when(bit == 1, F.try_variant_get(v, f"$.{path}", "bigint")).when(bit == 2, F.try_variant_get(v, f"$.{path}", "double").cast("bigint")), F.lit(0).cast("bigint"))


def usage_series(df: DataFrame, session: str, order: str, request: str, usage: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a request with its token counts: the first row of a request id in a session; rows without an id all stand.

    Columns to ``carry`` come along, so that nothing need be joined back.
    """
    rows = df.where(F.col(usage).isNotNull()).select(session, order, *carry, F.col(request).alias("request_id"), *(count_of(F.col(usage), p).alias(n) for n, p in USAGE.items()))
    key = F.coalesce(F.concat(F.lit("="), "request_id"), F.concat(F.lit("#"), F.col(order).cast("string")))
    kept = F.struct(order, "request_id", *USAGE, *carry)
    return rows.groupBy(session, key.alias("_key")).agg(F.min(kept).alias("_k")).select(session, "_k.*")


def usage_totals(series: DataFrame, keys: list[str]) -> DataFrame:
    """Requests and sums of the counts, with the tokens of prompts."""
    t = series.groupBy(*keys).agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in USAGE))
    return t.withColumn("prompt_tokens", F.col("input") + F.col("cache_read") + F.col("cache_creation"))


def cache_breaks(series: DataFrame, session: str, order: str) -> DataFrame:
    """Requests at which most of the cache was lost and written anew."""
    x = series.withColumn("_b", block_of(order))
    last = F.max(F.struct(order, "cache_read"))["cache_read"].alias("_l")
    before = x.groupBy(session, "_b").agg(last).select(session, "_b", F.last("_l", ignorenulls=True).over(earlier([session])).alias("_prior"))
    inside = F.lag("cache_read").over(in_order([session, "_b"], [order]))
    s = _carried(x.withColumn("_lag", inside), before, [session]).withColumn("prior_cache_read", F.coalesce("_lag", "_prior"))
    p = F.col("prior_cache_read")
    return s.where((p >= BREAK_MIN) & (F.col("cache_read") <= BREAK_LEFT * p) & (F.col("cache_creation") >= BREAK_NEW * p)).select(session, order, "prior_cache_read", "cache_read", "cache_creation")


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before."""
    return running_sum(df, keys, order, F.col(value), name, own=False)


def split_turns(ev: DataFrame, compactions: DataFrame | None = None, session: str = "session_key", order: str = "event_idx", at: str = "us") -> DataFrame:
    """Adds turn_idx, turn_prompt and after_compaction to events that carry ``prompt``.

    A turn begins at each prompt and at the first event at or after each compaction; the first
    takes what stands before its prompt, so that the first event is always its start. A turn
    carved by a compaction keeps the prompt before it. A session without prompts has no turns.
    ``compactions`` has (session, at).
    """
    rows = ev.withColumn("_b", block_of(order))
    if compactions is not None:
        marks = compactions.where(F.col(at).isNotNull()).select(session, at).distinct().withColumn("_mark", F.monotonically_increasing_id())
        hits = first_at_or_after(ev, marks, session, order, at, "_mark").where(F.col(order).isNotNull()).select(session, order).distinct().withColumn("_hit", F.lit(True))
        rows = rows.join(hits, [session, order], "left")
    else:
        rows = rows.withColumn("_hit", F.lit(None).cast("boolean"))
    asked, hit = F.col("prompt").isNotNull(), F.coalesce(F.col("_hit"), F.lit(False))
    said = F.when(asked, F.struct(F.col(order).alias("at"), "prompt", hit.alias("hit")))
    # One row a block: what its session begins with, the last prompt before it, and how many turns began before it. A turn begins
    # with the session, with each prompt but the session's first, and with each hit, so the two special rows are set right.
    marked = F.struct(F.col(order).alias("at"), (asked | hit).alias("counts"))
    whole, prior = Window.partitionBy(session), earlier([session])
    ends = rows.groupBy(session, "_b").agg(F.min(marked).alias("_f"), F.count_if(asked | hit).alias("_n"), F.min(said).alias("_p"), F.max(said).alias("_q"))
    ends = ends.withColumns({"_from": F.min("_f").over(whole), "_any": F.min("_p").over(whole)})
    of_first = F.when((F.col("_f.at") == F.col("_from.at")) & ~F.col("_from.counts"), 1).otherwise(0)
    of_prompt = F.when((F.col("_p.at") == F.col("_any.at")) & (F.col("_any.at") != F.col("_from.at")) & ~F.col("_any.hit"), 1).otherwise(0)
    blocks = ends.withColumn("_n", F.col("_n") + of_first - F.coalesce(of_prompt, F.lit(0))).select(
        session, "_b", F.col("_from.at").alias("_from"), "_any", F.max("_q").over(prior).alias("_prior"), F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before")
    )
    x = _carried(rows, blocks, [session])
    first = F.col(order) == F.col("_from")
    x = x.withColumn("after_compaction", hit & ~first).withColumn("_begin", first | (asked & (F.col(order) != F.col("_any.at"))) | hit)
    inside = Window.partitionBy(session, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({
        "turn_prompt": F.coalesce(F.last("prompt", ignorenulls=True).over(inside), F.col("_prior.prompt"), F.col("_any.prompt")),
        "_n": F.sum(F.when(F.col("_begin"), 1).otherwise(0)).over(inside),
    })
    return x.withColumn("turn_idx", F.when(F.col("_any").isNotNull(), F.col("_before") + F.col("_n") - 1).cast("bigint")).drop("_b", "_from", "_any", "_prior", "_before", "_begin", "_hit", "_n")
