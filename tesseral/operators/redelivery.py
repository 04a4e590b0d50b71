"""Messages delivered more than once: keep one copy of each.

Each time bucket has its Bloom filter. A bucket's identifiers are screened by the filter of all
earlier buckets; what it does not know is new for certain. The few it may know go down a tree of
filters to the earlier buckets' own ones, and only the storage of buckets that answer is read to
compare the identifiers exactly. False positives therefore cost work, never a row.

Defined cases
- a null or blank identifier equals nothing: its rows are never repeats;
- identifiers are compared without white space at both ends and regardless of letter case;
- the copy with the least (time, row id) stays; a null time counts as later than every time;
- the row id must be unique but for rows repeated as a whole, which are one row here;
- empty table: no rows; other columns are ignored.

Hot identifiers collapse by partial aggregation to one row per bucket before anything is
shuffled; shards of the screen hold a bounded number of distinct identifiers. Rows are read again
only for identifiers with three copies or more in a bucket, hot ones by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions.text import strip
from tesseral.operators.skew import lookup
from tesseral.session import cut

#: Distinct (bucket, identifier) rows a shard of the screen is planned for, bits an identifier and probes.
SHARD_ROWS, BITS, PROBES = 200_000, 16, 5
_LAST = "timestamp '9999-12-31 23:59:59'"


class Bloom:
    """A Bloom filter over pairs of 64-bit hashes, vectorised."""

    def __init__(self, n: int) -> None:
        self.size = np.uint64(1 << max(6, math.ceil(math.log2(max(1, n) * BITS))))
        self.bits = np.zeros(int(self.size) // 8, np.uint8)

    def _at(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(PROBES):
            yield (h1 + np.uint64(i) * (h2 | np.uint64(1))) & (self.size - np.uint64(1))

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for p in self._at(h1, h2):
            np.bitwise_or.at(self.bits, p >> np.uint64(3), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def may_hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        yes = np.ones(len(h1), bool)
        for p in self._at(h1, h2):
            yes &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return yes


def screen_shard(t: pa.Table) -> pa.Table:
    """Of one shard's distinct (bucket, ident, ..., h1, h2): the rows worth comparing, each with the old_bucket to compare with."""
    order = np.argsort(t["bucket"].to_numpy(), kind="stable")
    b, h1, h2 = (t[c].to_numpy()[order] for c in ("bucket", "h1", "h2"))
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    cuts = [*np.flatnonzero(np.diff(b, prepend=b[0] - 1)), len(b)] if len(b) else [0]
    spans = list(zip(cuts, cuts[1:]))
    seen, rows, olds = Bloom(len(b)), [], []
    # levels[k][i] knows buckets i * 2 ** k and up to the next: a possible repeat finds its buckets by going down.
    levels: list[dict[int, Bloom]] = [{}]
    while 1 << (len(levels) - 1) < len(spans):
        levels.append({})
    for n, (lo, hi) in enumerate(spans):
        x1, x2 = h1[lo:hi], h2[lo:hi]
        maybe = np.flatnonzero(seen.may_hold(x1, x2))
        open_ = [(len(levels) - 1, 0, maybe)] if len(maybe) else []
        while open_:
            k, i, at = open_.pop()
            f = levels[k].get(i)
            at = at[f.may_hold(x1[at], x2[at])] if f is not None else at[:0]
            if not len(at):
                continue
            if k == 0:
                rows.append(order[lo + at])
                olds.append(np.full(len(at), b[spans[i][0]]))
            else:
                open_ += [(k - 1, 2 * i, at), (k - 1, 2 * i + 1, at)]
        seen.add(x1, x2)
        for k, level in enumerate(levels):
            i = n >> k
            if i not in level:
                level[i] = Bloom(spans[min(len(spans), (i + 1) << k) - 1][1] - spans[i << k][0])
            level[i].add(x1, x2)
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    old = np.concatenate(olds).astype(np.int64) if olds else np.zeros(0, np.int64)
    return t.drop_columns(["h1", "h2", "shard"]).take(pa.array(at)).append_column("old_bucket", pa.array(old))


def identity(c: Column) -> Column:
    """The identifier as it is compared; null if it equals nothing."""
    x = F.lower(strip(c.cast("string")))
    return F.when(x != "", x)


def find_repeats(df: DataFrame, ident: str, at: str, row_id: str, bucket_seconds: int = 86_400) -> DataFrame:
    """(row_id) of every row that repeats an earlier one."""
    t = F.coalesce(F.col(at).cast("timestamp"), F.expr(_LAST))
    named = df.select(identity(F.col(ident)).alias("ident"), F.unix_micros(t).alias("us"), F.col(row_id).cast("bigint").alias("row_id")).where("ident is not null").withColumn("bucket", F.expr(f"us div {bucket_seconds * 1_000_000}"))
    # The bucketed storage: one row per bucket and identifier with its first and last copy.
    copy = F.struct("us", "row_id")
    stored = cut(named.groupBy("bucket", "ident").agg(F.min(copy).alias("first"), F.max(copy).alias("last"), F.count("*").alias("n")).select("bucket", "ident", F.col("first.row_id").alias("first_id"), F.col("last.row_id").alias("last_id"), "n"))
    shards = max(1, -(-stored.count() // SHARD_ROWS))
    hashed = stored.withColumns({"h1": F.xxhash64("ident"), "h2": F.xxhash64("ident", F.lit(7)), "shard": F.pmod(F.hash("ident", F.lit(1)), F.lit(shards))})
    maybe = hashed.groupBy("shard").applyInArrow(screen_shard, "bucket bigint, ident string, first_id bigint, last_id bigint, n bigint, old_bucket bigint")
    # Exact comparison, with the storage of the matching buckets only.
    again = cut(maybe.join(stored.select("ident", F.col("bucket").alias("old_bucket")), ["ident", "old_bucket"], "left_semi").drop("old_bucket").distinct())
    fresh = stored.where("n > 1").join(again.where("n > 1").select("bucket", "ident"), ["bucket", "ident"], "left_anti")
    # Nearly all identifiers have one copy or two, whose rows are known; only for the others the rows are looked up.
    known = again.where("n = 1").select(F.col("first_id").alias("row_id")).unionByName(again.where("n = 2").select(F.explode(F.array("first_id", "last_id")).alias("row_id"))).unionByName(fresh.where("n = 2 and last_id <> first_id").select(F.col("last_id").alias("row_id")))
    many = again.withColumn("first_id", F.lit(None).cast("bigint")).unionByName(fresh).where("n > 2").select("bucket", "ident", "n", "first_id", F.lit(True).alias("many"))
    rows = lookup(named.select("bucket", "ident", "row_id"), many, ["bucket", "ident"], "n", F.col("row_id"))
    return known.unionByName(rows.where("many and (first_id is null or row_id <> first_id)").select("row_id"))
