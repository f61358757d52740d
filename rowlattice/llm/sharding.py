"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered 0 to n - 1 without a global sort: buckets of a hash, a
running count inside each, and the buckets' offsets (65,536 at most). The
number's place in the shuffle is a keyed permutation of 0 .. n - 1, an
alternating Feistel network over a x b >= n with cycle walking back into the
range. Place p is slot p div shards of shard p mod shards, so anyone can
compute either way, and counts differ by one at most.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlattice.llm._common import cut, table

ROUNDS, STEPS, SEED = 6, 48, 20240229


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def place(number: Column, n: int, seed: int = SEED) -> Column:
    """Place of a row number in the shuffle of n rows.

    At most a - 1 of the a * b numbers lie outside 0 .. n - 1, so a walk of
    more than STEPS steps does not occur in practice; were there one, the
    query fails rather than returns a wrong place.
    """
    a, b = sides(n)
    whole = lambda v: F.lit(v).cast("long")

    def one_round(s, j):
        side = F.when(j % 2 == 0, whole(a)).otherwise(whole(b))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(F.xxhash64(whole(seed), j, s["r"]), side), side).alias("r"))

    def permute(m):
        start = F.struct((m % whole(a)).alias("l"), F.floor(m / whole(a)).cast("long").alias("r"))
        return F.aggregate(F.sequence(whole(0), whole(ROUNDS - 1)), start, one_round, lambda s: s["r"] * whole(a) + s["l"])

    walked = F.aggregate(F.sequence(whole(1), whole(STEPS)), permute(number), lambda m, _: F.when(m < whole(n), m).otherwise(permute(m)))
    return F.when(walked < whole(n), walked).otherwise(F.raise_error(F.lit("the cycle walk did not end; take another seed")).cast("long"))


def place_of(number: int, n: int, seed: int = SEED) -> int:
    """The same on the driver, for one number."""
    import xxhash

    a, b = sides(n)
    m = number
    while True:
        left, right = m % a, m // a
        for j in range(ROUNDS):
            h = 42
            for v in (seed, j, right):
                h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
            side = b if j % 2 else a
            left, right = right, (left + (h - (h >> 63 << 64)) % side) % side
        m = right * a + left
        if m < n:
            return m


def numbered(rows: DataFrame, n: int, key: list[str], count: str = "n") -> DataFrame:
    """rows, each standing for `count` equal ones, with start: the first of their global row numbers."""
    buckets = min(65536, max(1, -(-n // 1024)))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    inside = Window.partitionBy("__bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bucket = dealt.groupBy("__bucket").agg(F.sum(count).alias("__size"))  # 65,536 rows at most
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_bucket.select(F.col("__bucket").alias("__b"), (F.sum("__size").over(before) - F.col("__size")).alias("__offset"))
    local = dealt.withColumn("__local", F.sum(count).over(inside) - F.col(count))
    return local.join(F.broadcast(offsets), F.col("__bucket") == F.col("__b")).withColumn("start", F.col("__offset") + F.col("__local")).drop("__bucket", "__b", "__offset", "__local")


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot: a row for each row of docs.

    size: bytes of the text plus 1 (a null text has none, and the checksum of
    an empty one). The outcome depends on doc_ids and texts alone, not on files
    or partitions. Equal rows are counted first, so that many of them make no
    hot bucket. An empty table gives an empty table.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = cut(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")))
    n = rows.agg(F.sum("n")).first()[0] or 0
    each = numbered(rows, n, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("row_number"))
    placed = each.withColumn("__p", place(F.col("row_number"), n, seed))
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("__p") % shards).cast("int").alias("shard"), F.floor(F.col("__p") / shards).cast("long").alias("slot"))


def op5(spark, sf_dir: str) -> DataFrame:
    made = shard(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
