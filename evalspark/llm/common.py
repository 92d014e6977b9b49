"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space, and tab to carriage return. ``bytes.split()`` splits on exactly these.
SPACES = r"[\x20\x09-\x0D]+"
#: A word, by the same contracts.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where that is unset, as in tests, a folder of
    this machine, and on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not LOCAL:
            LOCAL.append(tempfile.mkdtemp(prefix="evalspark-"))
        folder = LOCAL[0]
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Cuts Arrow batches to Python at 4 MB, unless the session has a size of its own: buffers of long texts are held
    several times over, and the JVM's outlive their stages. The results may be worked out later, so the setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "4m")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def frees(run):
    """``run`` over the batches of a task; what it held goes back to the system at the end, as workers outlive tasks."""

    def outer(batches):
        yield from run(batches)
        trim()

    return outer


def frees_group(one):
    """The same for a function of a group."""

    def outer(group):
        out = one(group)
        trim()
        return out

    return outer


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Paths of the tables that this process has written.
WRITTEN: list[str] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, mark: int, *keep: str) -> None:
    """Deletes the tables written since there were ``mark`` of them, but for the paths to keep."""
    for path in [p for p in WRITTEN[mark:] if p not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.remove(path)


def located(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with __file and __place, the file of a row and its place there: the same for a row each time.

    Rows that don't come one by one from files (made here, exploded, put together) are written as a table first.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    try:
        if node.nodeName() == "LogicalRelation":
            return docs.select(*docs.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:  # no files, or of a kind that doesn't number rows, or columns that can't be told apart
        pass
    held = table(docs, name)
    return held.select(*held.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns of ``docs`` can't clash with an operator's own; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_texts(docs: DataFrame, make, schema: str, every: int = 256) -> DataFrame:
    """Applies a function of one text to each row of (doc_id, text).

    ``make()`` runs once a task and returns ``f(text) -> tuple`` for the columns of ``schema``, which follow doc_id.
    Rows are taken ``every`` at a time, so that a task holds few texts and results at once.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = f"doc_id {kind}, {schema}"

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, every):
                part = batch.slice(at, every)
                found = [f(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*found), types))], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(full))
    names, types = arrow.names, arrow.types[1:]
    return docs.mapInArrow(frees(run), full)


def joined_spans(spans) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
