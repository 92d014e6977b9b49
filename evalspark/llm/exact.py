"""Exact deduplication as a stateful stream over a log of digests."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WRITTEN, discard, located, settings, shared_dir, table

#: State lives in RocksDB on the executors' disks and is saved to the shared folder after each micro-batch; it never expires.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # A store is closed after its task: there are as many as partitions, and few micro-batches.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # Many small stores: space that each would set aside beforehand adds up.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Digests that a state store should have; a stream has no more stores than shuffle partitions.
STORE = 20_000
#: Repeated digests up to which they go to each task as a table of 64-bit hashes; beyond, nothing is filtered by them.
BROADCAST = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stream_state(out: str, schema, files: int, micro_batches: int, spark, stores: int) -> DataFrame:
    """Runs new files of the log through keyed state; per digest that they have: the smallest identifier with its locator,
    the locator that was seen first, and the rows seen.

    The state's key is the digest, its value (identifier, locator, first locator, count). Each micro-batch emits the keys
    that it changed; as identifiers only fall and counts only rise, the last word on a key is the minimum and the maximum.
    The stream goes on from its checkpoint, and a repeated micro-batch overwrites what it wrote. What earlier calls have
    emitted isn't read: each digest of this call's log is emitted anew.
    """
    ran: list[int] = []
    with settings(spark, STATE | {"spark.sql.shuffle.partitions": str(stores)}):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // micro_batches))).parquet(f"{out}/log")
        state = stream.groupBy("text_sha256").agg(F.min(F.struct("doc_id", "locator")).alias("kept"), F.min(F.struct("seq", "locator")).alias("first"), F.count(F.lit(1)).alias("n"))

        def upsert(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{out}/state/batch={batch}")
            ran.append(batch)

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(upsert).start()
        query.awaitTermination()
    empty = spark.createDataFrame([], f"text_sha256 string, kept struct<doc_id:{schema['doc_id'].dataType.simpleString()},locator:string>, first struct<seq:bigint,locator:string>, n bigint")
    seen = spark.read.schema(empty.schema).parquet(*[f"{out}/state/batch={b}" for b in sorted(set(ran))]) if ran else empty
    return seen.groupBy("text_sha256").agg(F.min("kept").alias("kept"), F.min("first").alias("first"), F.max("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, micro_batches: int = 2, state_dir: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when identical after each run of white space is one space. A log of (identifier, digest, locator)
    is streamed through keyed state; every digest that is hit again has the full bytes of its texts compared, and the
    rows of a digest whose texts differ are told apart by the texts themselves. A locator is a file and a place in it.

    With ``state_dir``, a folder that all executors share, the state stays there: a later call with more rows goes on
    from it, and finds their copies among the rows of all calls. Texts of a digest that an earlier call had are compared
    with the text that had it first, which is read through its locator: the files of earlier calls must stay as they
    were, with the same name for the text (rows that come from no file are kept below ``state_dir``). A call reads its own
    log, and of earlier ones only files with texts that are hit; digests whose texts have ever differed are worked out
    anew from all logs.

    Null text counts as empty; a null identifier sorts first; of rows that repeat an identifier and a text, the one
    with the smallest locator is kept. An empty table gives no rows. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    mark = len(WRITTEN)
    held = located(rows, "exact-docs")
    if state_dir and len(WRITTEN) > mark:
        path = f"{state_dir.rstrip('/')}/texts/{uuid.uuid4().hex}"
        rows.withColumnRenamed("text", text_col).write.parquet(path)
        discard(rows.sparkSession, mark)
        held = located(rows.sparkSession.read.parquet(path).select("doc_id", F.col(text_col).alias("text")), "exact-docs")
    return dedup_located(held, digest, micro_batches, state_dir, text_col)


def texts_at(spark: SparkSession, locators: DataFrame, text_col: str) -> DataFrame:
    """(locator, norm) of locators: their files are read, and of them the rows at these places."""
    at = locators.select("locator", *place_of(F.col("locator")))
    files = [r[0] for r in at.select("__file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "locator string, norm string")
    rows = spark.read.parquet(*files).select(normalised(F.col(text_col)).alias("norm"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    return rows.join(at, ["__file", "__place"]).select("locator", "norm")


def place_of(locator: Column) -> list[Column]:
    """Columns __file and __place of a locator."""
    at = F.split(locator, "#(?=[0-9]+$)")
    return [at[0].alias("__file"), at[1].cast("bigint").alias("__place")]


def dedup_located(docs: DataFrame, digest, micro_batches: int, state_dir: str | None, text_col: str = "text") -> DataFrame:
    """exact_dedup of (doc_id, text, __file, __place)."""
    spark, call, seq = docs.sparkSession, uuid.uuid4().hex, time.time_ns()
    out = state_dir.rstrip("/") if state_dir else f"{shared_dir(spark)}/exact-{call}"
    norm = normalised(F.col("text"))
    locator = F.concat_ws("#", "__file", F.lpad(F.col("__place").cast("string"), 12, "0"))
    every = docs.select("doc_id", digest(norm).alias("text_sha256"), locator.alias("locator"), norm.alias("norm"))
    rows = every.select("doc_id", "text_sha256", "locator", F.lit(seq).cast("bigint").alias("seq"))
    rows.write.parquet(f"{out}/log/call={call}")
    if not state_dir:
        WRITTEN.append(out)
    log = spark.read.schema(rows.schema).parquet(f"{out}/log/call={call}").drop("seq")
    files = log.select(F.input_file_name()).distinct().count()
    # State that is kept may grow, so it is dealt to as many stores as there are partitions.
    stores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not state_dir:
        stores = min(stores, max(2 * spark.sparkContext.defaultParallelism, -(-log.count() // STORE)))
    state = table(stream_state(out, rows.schema, files, micro_batches, spark, stores), "exact-state")

    # Full bytes on hits: each digest's texts, equal ones combined before the shuffle, so that a hot text is one row a task.
    hit = state.filter("group_size > 1").select(F.xxhash64("text_sha256").alias("hit")).distinct()
    texts = every.join(F.broadcast(hit), F.xxhash64("text_sha256") == F.col("hit"), "left_semi") if hit.count() <= BROADCAST else every
    own = texts.select("text_sha256", "norm")
    earlier = state.filter(F.col("first.seq") < seq).select("text_sha256", F.col("first.locator").alias("locator")) if state_dir else None
    if earlier is not None and not earlier.isEmpty():
        own = own.unionByName(earlier.join(texts_at(spark, earlier, text_col), "locator").select("text_sha256", "norm"))
    classes = own.groupBy("text_sha256", "norm").agg(F.count(F.lit(1)).alias("n"))
    differ = classes.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("text_sha256")
    if state_dir:  # digests whose texts differed stay known
        differ.write.mode("append").parquet(f"{out}/differ")
        differ = spark.read.schema(differ.schema).parquet(f"{out}/differ").distinct().join(state, "text_sha256", "left_semi")
    differ = table(differ, "exact-differ")
    joined = log.join(state, "text_sha256").drop("first")
    if not differ.isEmpty():
        apart = every.join(differ, "text_sha256", "left_semi")
        whole = apart
        if state_dir:
            logs = spark.read.schema(rows.schema).parquet(f"{out}/log").join(differ, "text_sha256", "left_semi")
            before = logs.filter(F.col("seq") < seq).select("doc_id", "text_sha256", "locator")
            whole = apart.unionByName(before.join(texts_at(spark, before.select("locator"), text_col), "locator").select(*apart.columns))
        classes = whole.groupBy("text_sha256", "norm").agg(F.min(F.struct("doc_id", "locator")).alias("kept"), F.count(F.lit(1)).alias("group_size"))
        joined = joined.join(differ, "text_sha256", "left_anti").unionByName(apart.join(classes, ["text_sha256", "norm"]).drop("norm"))
    return joined.select("doc_id", F.col("kept.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("kept.locator")).alias("kept"), "text_sha256", "locator")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, micro_batches: int = 2) -> DataFrame:
    """``docs`` without the rows that repeat another's text, all columns kept.

    Rows are told apart by their places in files, so identifiers may be null or repeat, with equal texts or others. An
    empty table stays empty; null and empty texts are copies of one another.
    """
    held = located(docs, "exact-docs")
    found = dedup_located(held.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "__file", "__place"), digest, micro_batches, None)
    gone = table(found.filter(~F.col("kept")).select(*place_of(F.col("locator"))), "exact-gone")
    return held.join(gone, ["__file", "__place"], "left_anti").select(*docs.columns)
