"""Subagents: spawns and their reports, lanes, fan-outs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.operators.blocks import running_sum


def pair_by_id(spawns: DataFrame, returns: DataFrame, session: str, spawn_id: str, return_ref: str) -> DataFrame:
    """Every spawn with its reports; a spawn without any is open."""
    r = returns.withColumnRenamed(session, "_s").withColumnRenamed(return_ref, "_ref")
    return spawns.join(r, (F.col(session) == F.col("_s")) & (F.col(spawn_id) == F.col("_ref")), "left").withColumn("status", F.when(F.col("_ref").isNull(), "open").otherwise("returned")).drop("_s", "_ref")


def pair_with_names(spawns: DataFrame, returns: DataFrame) -> DataFrame:
    """Reports paired in order of events: by id if it names a spawn, else by name with the earliest spawn still open.

    ``spawns`` (session, at, spawn, name), ``returns`` (session, at, report, ref, name). A report
    whose id names some other call stays unmatched. Which spawn is open depends on all matches
    before, so a session is one group in order; it holds spawns and reports only.
    """
    a = spawns.select("session", "at", F.lit(0).alias("k"), F.col("spawn").alias("id"), "name")
    b = returns.select("session", "at", F.lit(1).alias("k"), F.col("ref").alias("id"), "name", "report", "foreign")
    schema = "session string, report string, spawn string, matched_by string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        open_: dict[str, list[str]] = {}
        closed, known, out = set(), set(), []
        for row in pdf.sort_values(["at", "k", "report", "id"], kind="stable").itertuples():
            if row.k == 0:
                known.add(row.id)
                open_.setdefault(row.name, []).append(row.id)
                continue
            spawn, how = None, "unmatched"
            if isinstance(row.id, str) and row.id in known:
                spawn, how = row.id, "id"
            elif not row.foreign:
                free = [x for x in open_.get(row.name, ()) if x not in closed]
                if free:
                    spawn, how = free[0], "name"
            if spawn:
                closed.add(spawn)
            out.append((row.session, row.report, spawn, how))
        return pd.DataFrame(out, columns=["session", "report", "spawn", "matched_by"])

    return a.unionByName(b, allowMissingColumns=True).groupBy("session").applyInPandas(run, schema)


def lanes(steps: DataFrame, session: str, order: list[str], agent: str, opens: str) -> DataFrame:
    """(session, agent, lane): each agent takes the lowest lane free at its opening and frees it at its closing step.

    ``steps`` has a row an opening and, for those that ever close, one a closing. The fold is
    sequential; it streams the sorted steps of each session and holds the lanes in use only, so a
    session's length is no matter of memory.
    """
    cols = [session, agent]
    parts = steps.select(session, F.struct(*order).alias("_o"), agent, opens).repartition(session).sortWithinPartitions(session, "_o").select(session, agent, opens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, free, lanes_ = None, {}, [], 0  # free: a heap of lanes given back
        for b in batches:
            out = []
            for s, a, o in b.itertuples(index=False):
                if s != current:
                    current, used, free, lanes_ = s, {}, [], 0
                if o:
                    if free:
                        used[a] = heapq.heappop(free)
                    else:
                        used[a], lanes_ = lanes_, lanes_ + 1
                    out.append((s, a, used[a]))
                elif a in used:
                    heapq.heappush(free, used.pop(a))
            yield pd.DataFrame(out, columns=[*cols, "lane"])

    types = dict(parts.dtypes)
    return parts.mapInPandas(run, f"{session} {types[session]}, {agent} {types[agent]}, lane int")


def occupancy(steps: DataFrame, session: str, order: list[str], agent: str, opens: str) -> DataFrame:
    """(session, step, agent, opens, lane, through): at each step the agent's own lane and the lanes of all others open, in order.

    The same fold as :func:`lanes`, with a row a step.
    """
    parts = steps.select(session, F.struct(*order).alias("_o"), agent, opens).repartition(session).sortWithinPartitions(session, "_o").select(session, agent, opens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, free, step = None, {}, [], 0
        for b in batches:
            out = []
            for s, a, o in b.itertuples(index=False):
                if s != current:
                    current, used, free, step = s, {}, [], 0
                if o:
                    used[a] = heapq.heappop(free) if free else len(used)
                lane = used.get(a)
                through = sorted(n for x, n in used.items() if x != a)
                out.append((s, step, a, o, lane, ",".join(map(str, through))))
                if not o and a in used:
                    heapq.heappush(free, used.pop(a))
                step += 1
            yield pd.DataFrame(out, columns=[session, "step", agent, opens, "lane", "through"]).astype({"lane": "Int32"})

    types = dict(parts.dtypes)
    return parts.mapInPandas(run, f"{session} {types[session]}, step bigint, {agent} {types[agent]}, {opens} boolean, lane int, through string")


def fan_outs(rows: DataFrame, session: str, order: list[str], kind: str, ref: str) -> DataFrame:
    """Maximal runs of consecutive spawns that all report before the next turn: (session, first, size, members).

    ``rows`` in order are turns, spawns and returns (``kind``), the latter two with the agent ``ref``.
    """
    w = Window.partitionBy(session).orderBy(*order)
    place = rows.withColumn("_n", F.row_number().over(w))
    # The next turn is the least one before in the reverse order: a running value.
    ahead = Window.partitionBy(session).orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    place = place.withColumn("_turn", F.min(F.when(F.col(kind) == "turn", F.col("_n"))).over(ahead))
    spawn = F.col(kind) == "spawn"
    islands = place.withColumn("_island", F.col("_n") - F.sum(F.when(spawn, 1).otherwise(0)).over(Window.partitionBy(session).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.where(spawn).select(session, "_island", "_n", "_turn", ref)
    back = place.where(F.col(kind) == "return").groupBy(session, ref).agg(F.min("_n").alias("_back"))
    joined = runs.join(back, [session, ref], "left")
    ok = F.col("_back").isNotNull() & (F.col("_turn").isNull() | (F.col("_back") < F.col("_turn")))
    g = joined.groupBy(session, "_island").agg(F.min("_n").alias("first_row"), F.count("*").alias("size"), F.count_if(ok).alias("_ok"), F.array_sort(F.collect_list(ref)).alias("members"))
    return g.where((F.col("size") > 1) & (F.col("_ok") == F.col("size"))).select(session, "first_row", "size", F.array_join("members", ",").alias("members"))


def in_flight(steps: DataFrame, session: str, order: list[str], opens: str) -> DataFrame:
    """Adds how many agents are open after each step."""
    return running_sum(steps, [session], order, F.when(F.col(opens), 1).otherwise(-1), "in_flight")
