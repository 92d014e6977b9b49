"""Merkle manifest of a table: supersteps of messages up the trees to a root, and of sibling paths down to the leaves."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Children of a node.
ARITY = 3
#: Levels that a superstep climbs: vertices are blocks of this many levels, so only every sixth level is a message.
LEVELS = 6
#: What a row is told beside its identifier.
SCHEMA = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def part(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(part, values)), 256)


def placed(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place of a row in its group ``g`` by ``order``, and n, the rows of the group.

    Rows are dealt by ranges of group and order, so that a hot group lies in many partitions; only counts by group and
    partition meet. Rows that are equal in all of these are dealt by number: which of them comes first doesn't matter.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("__deal", F.monotonically_increasing_id())
    keys = ["g", *order, "__deal"]
    ranged = spread.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__deal")
    held = table(ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), name)
    sizes = held.groupBy("g", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("m"))
    group = Window.partitionBy("g")
    before = F.sum("m").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    at = sizes.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(group).alias("n"))
    return held.join(at, ["g", "part"]).withColumn("idx", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def fold(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """The levels of one block of a group of ``n`` nodes, from its nodes up to its one top node.

    A block of a larger group climbs all its levels, even where one node is left; the only block of a group ends at one.
    """
    out = [digests]
    while len(out[-1]) > 1 or (n > ARITY**levels and len(out) <= levels):
        last = out[-1]
        out.append([digest(*last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return out


def path(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """From node ``i`` of a block to its top: at each level the node's place in its run, and the run's others."""
    out = []
    for level in levels[:-1]:
        start = i - i % ARITY
        run = level[start : start + ARITY]
        out.append((i - start, run[: i - start] + run[i - start + 1 :]))
        i //= ARITY
    return out


def refold(leaf: str, way: list) -> str:
    """The root that a leaf and its siblings give."""
    for at, others in way:
        leaf = digest(*others[:at], leaf, *others[at:])
    return leaf


def climb(nodes: DataFrame, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Supersteps upward: nodes (g, idx, digest, n) message their block, and full blocks fold and forward.

    Returns the nodes of each superstep, and (g, digest, depth) of the groups' tops with the superstep that found them.
    Each superstep's messages are a table, so a lost executor costs one superstep at most.
    """
    spark, parts, span = nodes.sparkSession, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ARITY**levels

    def up(block):
        (g, b), sent = block
        sent = sorted(sent)
        n = sent[0][2]
        return g, b, fold([d for _, d, _ in sent], n, levels)[-1][0], -(-n // span)

    steps, tops = [], []
    while True:
        steps.append(nodes)
        sent = nodes.select("g", "idx", "digest", "n").rdd.map(lambda r: ((r.g, r.idx // span), (r.idx, r.digest, r.n)))
        above = spark.createDataFrame(sent.groupByKey(parts).map(up), "g string, idx bigint, digest string, n bigint", verifySchema=False)
        above = table(above, f"{name}-up")
        tops.append(above.filter("n = 1").select("g", "digest", F.lit(len(steps) - 1).alias("depth")))
        nodes = above.filter("n > 1")
        if nodes.isEmpty():
            return steps, reduce(DataFrame.unionByName, tops)


def descend(steps: list[DataFrame], tops: RDD, finish, name: str, levels: int) -> RDD:
    """Supersteps downward: each block sends its nodes the way from them to the top of all; returns ``finish(row, way,
    note)`` of the nodes of the lowest superstep.

    ``tops`` has (g, depth, way, note): the way that goes on from a group's top, and what its nodes are told beside it.
    """
    spark, parts, span = steps[0].sparkSession, int(steps[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), ARITY**levels

    def down(depth):
        def run(met):
            sent, above = met[1]
            sent = sorted(sent, key=lambda r: r.idx)
            _, way, note = next(iter(above))
            block = fold([r.digest for r in sent], sent[0].n, levels)
            for i, r in enumerate(sent):
                full = path(block, i) + list(way)
                yield (r.g, r.idx, full, note) if depth else finish(r, full, note)

        return run

    ways = spark.sparkContext.emptyRDD()
    for depth in reversed(range(len(steps))):
        ended = tops.filter(lambda t, d=depth: t[1] == d).map(lambda t: ((t[0], 0), (0, t[2], t[3])))
        rows = steps[depth].rdd.map(lambda r: ((r.g, r.idx // span), r))
        ways = rows.cogroup(ended.union(ways), parts).flatMap(down(depth))
        if depth:
            held = spark.createDataFrame(ways, "g string, idx bigint, way array<struct<at:int,others:array<string>>>, note string", verifySchema=False)
            ways = table(held, f"{name}-down").rdd.map(lambda r: ((r.g, r.idx), (0, r.way, r.note)))
    return ways


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns=("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of ``columns``, each ``-`` if null, else its length in bytes, a colon and its value. The leaves
    of a group, by identifier, are folded in runs of three, level by level, to the group's subroot; subroots, by group
    with null first, likewise to the root. proof_sha256 digests a leaf's siblings from its level to the root.
    folded_root is worked out anew from these and from the row as it is, or as it is after tampering: rows whose
    identifier has an even CRC-32 lose the line feeds of their text. verified tells whether it is the root.

    Rows that repeat an identifier go by their leaves; a null identifier comes first and isn't tampered with; null and
    empty texts differ; other columns aren't read; an empty table has no root and gives no rows. A hot group is spread
    over blocks of 3**``levels`` leaves, and paths above a block are sent once a block.
    """
    spark = docs.sparkSession
    given = docs.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)], F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("g"), F.col(text_col).cast("string").alias("t"))
    values = [F.col(f"c{i}") for i in range(len(columns))]
    leaf = leaf_digest(*values)
    bad = leaf_digest(*[F.replace(v, F.lit("\n"), F.lit("")) if c == text_col else v for c, v in zip(columns, values)])
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("t", F.lit("\n"))
    group = F.coalesce(F.concat(F.lit("s"), "g"), F.lit("n"))
    leaves = table(given.select("doc_id", group.alias("g"), leaf.alias("digest"), F.when(tampered, bad).alias("bad")), "merkle-leaves")
    steps, tops = climb(placed(leaves, "merkle-placed", ["doc_id", "digest"]), "merkle", levels)
    sources = tops.select(F.lit("").alias("g"), F.col("g").alias("source"), "digest", "depth")
    upper, top = climb(placed(sources, "merkle-sources", ["source"]), "merkle-top", levels)
    end = top.first()
    if end is None:
        return spark.createDataFrame([], f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")
    root = end.digest
    above = descend(upper, spark.sparkContext.parallelize([("", end.depth, [], "")], 1), lambda r, way, _: (r.source, r.depth, way, r.digest), "merkle-top", levels)

    def check(r, way, subroot):
        folded = refold(r.bad or r.digest, way)
        return r.doc_id, r.digest, subroot, root, digest(*[x for _, others in way for x in others]), folded, folded == root

    out = descend(steps, above, check, "merkle", levels)
    return spark.createDataFrame(out, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}", verifySchema=False)
