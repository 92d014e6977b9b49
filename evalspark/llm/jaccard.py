"""N-gram Jaccard join by parity sketches: documents whose word shingles are alike, and their components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, frees, frees_group, table, texts
from .components import components
from .words import WordHashes, mix, windows

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union. Their difference is then at most (|a| + |b|) / 7.
PERCENT = 75
#: Sets up to this size are cut into single shingles; size bands above grow by RATIO.
SMALL, RATIO = 192, 4
#: Bits of a whole-set sketch at least, a power of two, and no fewer than the set has shingles. Up to WIDE bits there are
#: four for each shingle, so that few are hit twice and pairs just short of a link are told from those that have one.
SKETCH, WIDE = 512, 4096
#: A part that more sets share is not paired off but tied to one of them; what that can miss is searched after.
MANY = 16
#: Signatures that a task holds before it hands them on.
HOLD = 500_000
#: Members of a widely shared part, asking or asked, that are compared at once; members to a bucket of parts.
TILE, MEMBERS = 16_384, 32_768
#: Partners of a node that one task checks, and rows up to which the asked nodes go to each task as a table.
GROUP, BROADCAST = 64, 500_000


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """The set of hashed 5-word shingles, sorted; letters A to Z in lower case. Fewer words make one, none make none."""
    return np.unique(windows(hashes.of(text.encode().lower().split()), SHINGLE))


def band(n: int) -> int:
    """0 up to SMALL, then one more for each RATIO."""
    k, top = 0, SMALL
    while n > top:
        k, top = k + 1, top * RATIO
    return k


def parts(h: np.ndarray, k: int) -> np.ndarray:
    """Parity of each part of a set at band k, empty parts left out, in the order of the parts.

    The hash space is cut into equal parts, three for each shingle of the band's smallest set (single hashes at
    band 0); a part's signature is the XOR of its hashes. A shingle in one set and not the other changes one part.
    """
    if k == 0:
        return mix(h)
    number = np.uint64(3 * SMALL * RATIO ** (k - 1))
    part = (h >> np.uint64(32)) * number >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    # The number of the part and of the band go into the signature.
    return mix(np.bitwise_xor.reduceat(h, first) ^ mix(part[first] + np.uint64(k << 40)))


def signatures(h: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of a set and how many of them it can spare.

    At each band a set and its partners differ in at most d shingles, so in at most d parts. Of the first d + 1
    parts that aren't empty, one therefore agrees; both sets take parts in one order, so the one whose
    parts end first has it among the other's. Some more are taken so that shared passages can be passed over. A set
    near the bottom of its band also takes part in the band below.
    """
    n = len(h)
    own, out, spare = band(n), [], 1 << 30
    for k in {own, band(-(-PERCENT * n // 100))}:
        most = n * 100 // PERCENT if k == own else SMALL * RATIO**k
        need = (n + most) // 7 + 1
        extra = n if k == 0 else min(need, 64 + need // 8)
        taken = parts(h, k)[: need + extra]
        spare = min(spare, len(taken) - need)
        out.append(taken)
    return np.concatenate(out), spare


def sketch(h: np.ndarray) -> bytes:
    """Parity bits: each hash flips one, so two sketches differ in no more bits than the sets in shingles."""
    least = 1 << (max(len(h), 1) - 1).bit_length()
    bits = max(SKETCH, least, min(4 * least, WIDE))
    flips = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) cut to a size: the parities of halves add up."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def stacked(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit integers, cut to a size."""
    whole = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), len(sketches[0]))
    return np.ascontiguousarray(folded(whole, size)).view(np.uint64)


def distances(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Bits in which sketches differ, pair by pair, at the lesser of the two sizes."""
    out, sizes = np.zeros(len(xs), np.int64), np.array([(len(x), len(y)) for x, y in zip(xs, ys)], np.int64).reshape(-1, 2)
    for p, q in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == p) & (sizes[:, 1] == q))
        x, y = (stacked([of[i] for i in at], min(p, q)) for of in (xs, ys))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def key_of(h: np.ndarray) -> int:
    """64-bit name of a set; equal sets are one node from here on."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def emit(docs: DataFrame, buckets: int) -> DataFrame:
    """Signatures and sets of all documents, packed by bucket: few wide rows rather than one a signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bits = buckets.bit_length() - 1
    schema = f"bucket int, ids array<{kind}>, sig binary, node binary, size binary, spare binary, sketch array<binary>"
    arrow = arrow_schema(schema)

    def run(batches):
        hashes, sent = WordHashes(), set()
        sigs, nodes, held, ids, about = [], [], 0, [], []

        def flush():
            rows = []
            if sigs:
                sig, node = np.concatenate(sigs), np.concatenate(nodes)
                order = np.argsort(sig)
                sig, node = sig[order], node[order]
                at = (sig >> np.uint64(64 - bits)).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
                low = sig.astype(np.uint32)
                rows += [(int(at[s]), [], low[s:e].tobytes(), node[s:e].tobytes(), b"", b"", []) for s, e in zip(edge[:-1], edge[1:])]
            for at in range(0, len(ids), 512):
                part = about[at : at + 512]
                node, size, spare = (np.array([x[i] for x in part], np.int64).tobytes() for i in range(3))
                rows.append((part[0][0] % buckets, ids[at : at + 512], b"", node, size, spare, [x[3] for x in part]))
            sigs.clear(), nodes.clear(), ids.clear(), about.clear()
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1024]), arrow.types)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h = shingles(text, hashes)
                    node = key_of(h)
                    spare = 0
                    if len(h):
                        sig, spare = signatures(h)
                        if node not in sent:
                            sigs.append(sig)
                            nodes.append(np.full(len(sig), node, np.int64))
                            held += len(sig)
                            sent.add(node)
                    ids.append(i)
                    about.append((node, len(h), spare, sketch(h)))
                    if held >= HOLD or len(ids) >= 20_000:
                        yield from flush()
                        held = 0
                        sent.clear()
        yield from flush()

    return docs.mapInArrow(frees(run), schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def match(packed: DataFrame) -> DataFrame:
    """By bucket: documents (row 0), pairs of nodes that share parts, with how many (1 if the first is the least of those
    that share one, or else 3), and members of widely shared parts (2)."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    schema = f"row int, id {kind}, a bigint, b bigint, size bigint, spare bigint, sketch binary"
    arrow = arrow_schema(schema)

    def ints(row, a, b, n):
        k = len(a)
        return [pa.array(np.full(k, row, np.int32)), pa.nulls(k, arrow.types[1]), pa.array(a), pa.array(b), pa.array(n), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())]

    def one(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        sig, node, rows = [], [], []
        for r in group.select(["ids", "sig", "node", "size", "spare", "sketch"]).to_pylist():
            if r["sig"]:
                sig.append(np.frombuffer(r["sig"], np.uint32))
                node.append(np.frombuffer(r["node"], np.int64))
            else:
                rows.append((r["ids"], *(np.frombuffer(r[c], np.int64) for c in ("node", "size", "spare")), r["sketch"]))
        out = []
        if rows:
            ids = [i for r in rows for i in r[0]]
            n = len(ids)
            out.append([pa.array(np.zeros(n, np.int32)), pa.array(ids, arrow.types[1]), pa.array(np.concatenate([r[1] for r in rows])), pa.nulls(n, pa.int64()), *(pa.array(np.concatenate([r[k] for r in rows])) for k in (2, 3)), pa.array([c for r in rows for c in r[4]], pa.binary())])
        if sig:
            s, d = np.concatenate(sig), np.concatenate(node)
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
            s, d = s[new], d[new]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            count = np.diff(np.append(first, len(s)))
            size = np.repeat(count, count)
            lead = np.repeat(first, count)
            few = size <= MANY
            star = np.flatnonzero(lead != np.arange(len(s)))
            found = [(1, d[lead[star]], d[star])]
            a, b = [], []
            for gap in range(1, MANY - 1):
                i = np.flatnonzero((s[gap:] == s[:-gap]) & few[gap:]) if gap < len(s) else np.zeros(0, np.int64)
                i = i[lead[i] != i]
                a.append(d[i]), b.append(d[i + gap])
            found.append((3, np.concatenate(a), np.concatenate(b)))
            for row, a, b in found:
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
                out.append(ints(row, a[first], b[first], np.diff(np.append(first, len(a)))))
            wide = np.flatnonzero(~few)
            out.append(ints(2, (bucket << 32) | s[wide].astype(np.int64), d[wide], np.zeros(len(wide), np.int64)))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, arrow.types)], schema=arrow) for cols in out], schema=arrow)

    return packed.groupBy("bucket").applyInArrow(frees_group(one), schema)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches leave a link possible; sketches go to those only whose sizes do."""
    size = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"))
    sketch_ = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b").filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    joined = sized.join(sketch_("b"), "b").join(sketch_("a"), "a")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                t = batch.slice(first, 1024)
                most = (t.column("na").to_numpy() + t.column("nb").to_numpy()) // 7
                near = pa.array(distances(t.column("sa").to_pylist(), t.column("sb").to_pylist()) <= most)
                yield pa.RecordBatch.from_arrays([t.column(c).filter(near) for c in ("a", "b")], names=["a", "b"])

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(frees(run), "a bigint, b bigint")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by whole sets.

    Texts of the nodes go to their a once more, at most GROUP of them to a task's share of one a, and are cut into
    shingles there; so a node with very many partners is spread, and no set but that of a is held.
    """
    pairs = table(possible(pairs, nodes), "jaccard-pairs")
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("shares"))
    near = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.col("b").alias("node"), F.lit(1).alias("rank"))
    own = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("node"), F.lit(0).alias("rank"))
    asked = table(near.unionByName(own).join(nodes.select("node", F.col("doc_id").alias("of")), "node"), "jaccard-asked")
    side = F.broadcast(asked) if asked.count() <= BROADCAST else asked.hint("shuffle_hash")
    rows = docs.join(side, F.col("doc_id").eqNullSafe(F.col("of"))).select("a", "share", "rank", "node", "text")
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", "rank")

    def run(batches):
        hashes, at, held = WordHashes(), None, None
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, a, b = batch.slice(first, 256).to_pydict(), [], []
                for key, rank, node, text in zip(part["a"], part["rank"], part["node"], part["text"]):
                    h = shingles(text, hashes)
                    if key_of(h) != node:  # another row with this identifier
                        continue
                    if rank == 0:
                        at, held = key, h
                    elif at == key:
                        both = len(np.intersect1d(held, h, assume_unique=True))
                        if 100 * both >= PERCENT * (len(held) + len(h) - both):
                            a.append(key), b.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(frees(run), "a bigint, b bigint").distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes aren't in one component yet."""
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


class Members:
    """Nodes of one tile of a part: roots, sizes and sketches, these cut to lesser sizes where asked for."""

    def __init__(self, node, root, size, sketches: list[bytes]):
        self.node, self.root, self.size, self.sketches = node, root, size, sketches
        self.length = np.array([len(x) for x in sketches], np.int64)

    def near(self, asks: np.ndarray, others: np.ndarray, nearest: bool):
        """Pairs (i, j) of asks and others of other components that sizes and sketches leave possible.

        Nodes are compared by length of sketch, which for possible partners differ twofold at most, some rows of the
        matrix at a time.
        """
        found = []
        for p in np.unique(self.length[asks]).tolist():
            mine = asks[self.length[asks] == p]
            for q in (p // 2, p, 2 * p):
                theirs = others[self.length[others] == q]
                if not len(theirs):
                    continue
                x, y = (stacked([self.sketches[i] for i in of], min(p, q)) for of in (mine, theirs))
                n, step = self.size[theirs][None], max(1, 2_000_000 // (len(theirs) * x.shape[1]))
                for first in range(0, len(mine), step):
                    rows = mine[first : first + step]
                    far = np.bitwise_count(x[first : first + step][:, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                    m = self.size[rows][:, None]
                    i, j = np.nonzero((far <= (n + m) // 7) & (self.root[rows][:, None] != self.root[theirs][None]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)))
                    found.append((rows[i], theirs[j], far[i, j]))
        i, j, far = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        if nearest and len(i):
            order = np.lexsort((self.node[j], far, i))
            i, j = i[order], j[order]
            new = np.concatenate([[True], i[1:] != i[:-1]])
            i, j = i[new], j[new]
        return self.node[i], self.node[j]


def rest(wide: DataFrame, nodes: DataFrame, roots: DataFrame, nearest: bool) -> DataFrame:
    """Pairs that widely shared parts may still hide.

    A set with parts to spare, beyond its w widely shared ones, has met all its partners elsewhere. One without shares
    more than ``spare`` of those parts with each partner that it hasn't met, so w - spare of them are enough to look
    in: the least common ones. There it is compared by sketch with each member of another component, unless all the
    members are one component already. With ``nearest`` it gets the one of them that is least far by sketch: a first
    step that joins up most, so that few pairs are left for the whole search.

    A part with many members is cut into tiles of TILE asking ones by TILE members, which go to different tasks. Tiles
    are dealt to buckets of about MEMBERS rows; a pair that several tiles of one bucket have is given once.
    """
    from pyspark.sql.window import Window

    counts = wide.groupBy("b").agg(F.count(F.lit(1)).alias("w")).join(nodes.select(F.col("node").alias("b"), "spare"), "b")
    full = table(counts.filter("w > spare").select("b", (F.col("w") - F.greatest("spare", F.lit(0))).alias("ask")), "jaccard-full")
    member = table(wide.join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b")), "jaccard-wide")
    parts_ = member.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    asks = member.join(full, "b").join(parts_, "a")
    rank = F.row_number().over(Window.partitionBy("b").orderBy("n", "a"))
    asks = table(asks.withColumn("rank", rank).filter("rank <= ask and lo <> hi").select("a", "b", "n"), "jaccard-asks")
    tiles = asks.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("fs"), F.ceil(F.max("n") / TILE).cast("int").alias("ms"))
    share = lambda n: F.pmod(F.xxhash64("b", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tiled = member.select("a", "b").join(tiles, "a").join(asks.select("a", "b", F.lit(True).alias("ask")), ["a", "b"], "left")
    # In a part of one tile a row both asks and is asked; in others each goes to a row or a column of tiles.
    one_tile = (F.col("fs") == 1) & (F.col("ms") == 1)
    dealt = tiled.filter(one_tile).select("a", "b", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("ask").isNotNull().alias("full"), F.lit(True).alias("asked"))
    dealt = dealt.unionByName(tiled.filter(~one_tile).select("a", "b", every("fs").alias("i"), share("ms").alias("j"), F.lit(False).alias("full"), F.lit(True).alias("asked")))
    dealt = dealt.unionByName(tiled.filter(~one_tile & F.col("ask")).select("a", "b", share("fs").alias("i"), every("ms").alias("j"), F.lit(True).alias("full"), F.lit(False).alias("asked")))
    about = nodes.select(F.col("node").alias("b"), "size", "sketch").join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    buckets = max(40, member.count() // MEMBERS)
    rows = dealt.join(about, "b").withColumn("bucket", F.pmod(F.xxhash64("a", "i", "j"), F.lit(buckets)).cast("int"))

    def one(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in ("a", "i", "j", "b", "root", "size", "full", "asked")}
        sketches, found = group.column("sketch"), []
        order = np.lexsort((cols["j"], cols["i"], cols["a"]))
        key = np.stack([cols[c][order] for c in ("a", "i", "j")], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        for s, e in zip(edge[:-1], edge[1:]):
            rows = order[s:e]
            tile = Members(*(cols[c][rows] for c in ("b", "root", "size")), sketches.take(pa.array(rows)).to_pylist())
            asks, others = np.flatnonzero(cols["full"][rows]), np.flatnonzero(cols["asked"][rows])
            # In a large tile the greatest components first, each against the members outside it; then all that is left.
            kinds, count = np.unique(tile.root[asks], return_counts=True) if len(asks) * len(others) > 250_000 else ((), np.zeros(0))
            for root in np.array(kinds)[np.argsort(-count, kind="stable")][:8].tolist():
                mine = tile.root[asks] == root
                found.append(tile.near(asks[mine], others[tile.root[others] != root], nearest))
                asks = asks[~mine]
            found.append(tile.near(asks, others, nearest))
        x, y = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.table({c: pa.array(np.ascontiguousarray(pairs[:, k]), pa.int64()) for k, c in enumerate("ab")})

    return rows.groupBy("bucket").applyInArrow(frees_group(one), "a bigint, b bigint").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Documents with equal sets are one node, so copies cost nothing more. Null or empty texts, and texts without words,
    have no shingles and stay alone; a null identifier is reported but names no component unless alone in it. Rows that repeat an
    identifier are rows of their own. Shingles and sets are told apart by 64-bit hashes; links are counted on whole sets.
    """
    spark = docs.sparkSession
    plain = texts(docs, id_col, text_col)
    buckets = 1 << max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    found = table(match(emit(plain, buckets)), "jaccard-found")
    rows = found.filter("row = 0").select(F.col("id").alias("doc_id"), F.col("a").alias("node"), "size", "spare", "sketch")
    nodes = table(rows.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("spare").alias("spare"), F.first("sketch").alias("sketch")), "jaccard-nodes")
    pairs = table(found.filter("row in (1, 3)").groupBy("a", "b").agg(F.sum(F.when(F.col("row") == 1, F.col("size")).otherwise(0)).alias("n")), "jaccard-all")
    # First each node with the lesser one that it shares most parts with: that joins up nearly all that will be.
    best = pairs.filter("n > 0").groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    mark = len(WRITTEN)
    links = table(verified(best, nodes, plain), "jaccard-links")
    held = WRITTEN[-1]
    roots = components(links)
    discard(spark, mark, held, WRITTEN[-1])
    # Then all pairs that this left apart, and what widely shared parts still hide: the nearest of it, and then all.
    wide = found.filter("row = 2").select("a", "b")
    for more in (lambda: apart(pairs, roots), lambda: rest(wide, nodes, roots, True), lambda: rest(wide, nodes, roots, False)):
        asked = table(more(), "jaccard-more")
        if not asked.isEmpty():
            links = table(links.unionByName(verified(asked, nodes, plain)), "jaccard-links")
            held = WRITTEN[-1]
            roots = components(links)
            # What these were made of is done with.
            discard(spark, mark, held, WRITTEN[-1])
    least = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    # A table of their own, so that the join's rows of a large component can be split.
    names = table(least.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-names")
    named = least.join(names, "root").select("node", "component_id")
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest identifier; all columns kept.

    Rows are told apart by numbers of their own, which a table fixes: identifiers may be repeated or null (those come last).
    """
    held = table(docs.withColumn("__row", F.monotonically_increasing_id()), "jaccard-docs")
    found = near_components(held, "__row", text_col).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__part"))
    rows = table(found.join(held.select("__row", F.col(id_col).alias("__id")), "__row").select("__part", F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")).alias("at")), "jaccard-rows")
    first = rows.groupBy("__part").agg(F.min("at").alias("first"))
    gone = table(rows.join(first, "__part").filter(F.col("at.row") != F.col("first.row")).select(F.col("at.row").alias("__row")), "jaccard-gone")
    return held.join(gone, "__row", "left_anti").select(*docs.columns)
