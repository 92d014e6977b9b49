"""Sharding by extendible hashing; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Bits of the hash, and how many a round looks ahead.
BITS, STEP = 60, 10
LIMIT = 8 << 20


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, oversized.

    The directory is a binary trie over hash prefixes. A bucket over ``limit`` bytes splits on its next bit, others
    stay, so a shard is the shortest prefix whose rows fit; its name is that prefix in binary. A round sums bytes by
    the next STEP bits of the open buckets alone, and rolls these sums up to find the depth at which each fits.
    A single row above the limit is a shard by itself, marked oversized. Rows that repeat an identifier share a hash;
    where their bucket is still too large after BITS bits, a second hash of their place goes on splitting it.

    Null or empty text has 0 bytes; a null identifier hashes as an empty string; an empty table gives no rows.
    """
    digest = F.md5(F.concat(F.lit("shard:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    bits = lambda x: F.conv(F.substring(x, 1, BITS // 4), 16, 10).cast("bigint")
    place = F.md5(F.monotonically_increasing_id().cast("string"))
    rows = table(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"), bits(digest).alias("h"), bits(place).alias("again")), "shard-rows")
    binary = lambda x, n: F.when(F.lit(n) == 0, F.lit("")).otherwise(F.lpad(F.conv(x.cast("string"), 10, 2), n, "0"))
    done, left = [], rows.withColumn("name", F.lit(""))
    for depth in range(0, 2 * BITS, STEP):
        word = F.col("h") if depth < BITS else F.col("again")
        at = (F.shiftright(word, BITS - STEP - depth % BITS)).bitwiseAND((1 << STEP) - 1)
        keyed = left.withColumn("next", at)
        leaf = keyed.groupBy("name", "next").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        for j in range(0, STEP + 1):
            over = Window.partitionBy("name", F.shiftright("next", STEP - j))
            leaf = leaf.withColumns({f"b{j}": F.sum("b").over(over), f"n{j}": F.sum("n").over(over)})
        choice = None
        for j in range(STEP, -1, -1):
            own = F.struct(F.lit(depth + j).alias("depth"), F.concat("name", binary(F.shiftright("next", STEP - j), j)).alias("shard"), F.col(f"b{j}").alias("shard_bytes"), F.col(f"n{j}").alias("shard_docs"))
            fits = (F.col(f"b{j}") <= limit) | (F.col(f"n{j}") == 1)
            choice = F.when(fits, own) if choice is None else F.when(fits, own).otherwise(choice)
        leaf = table(leaf.select("name", "next", choice.alias("s")), f"shard-leaf{depth}")
        found = keyed.join(leaf, ["name", "next"])
        done.append(found.filter("s is not null").select("doc_id", "n_bytes", "s.shard", "s.depth", "s.shard_bytes", "s.shard_docs"))
        if leaf.filter("s is null").isEmpty():
            break
        left = table(found.filter("s is null").withColumn("name", F.concat("name", binary(F.col("next"), STEP))).select("doc_id", "n_bytes", "h", "again", "name"), f"shard-left{depth}")
    out = reduce(DataFrame.unionByName, done)
    return out.withColumn("oversized", F.col("shard_bytes") > limit)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as one folder of Parquet a shard below ``path``; returns the directory (shard, bytes, docs).

    Rows of one identifier go to the first of its shards.
    """
    found = table(shard(docs, limit, id_col, text_col), "shard-found")
    where = found.groupBy("doc_id").agg(F.min("shard").alias("shard")).withColumnRenamed("doc_id", "__id")
    name = F.concat(F.lit("s"), F.col("shard"))
    out = docs.join(where, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id").withColumn("shard", name)
    out.repartition("shard").write.partitionBy("shard").parquet(path)
    return found.select("shard", "depth", "shard_bytes", "shard_docs").distinct()
