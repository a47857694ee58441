"""Helpers shared by the corpus operators: table paths, scratch tables, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of a word: space, tab, line feed, vertical tab, form feed, return.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Rows of a scratch table's file at least, where the number of rows is known.
FILE_ROWS = 10_000
#: Parts that the rows of a key are dealt into where they meet what their group comes to.
DEALT = 64

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode without it, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    return _ROOTS[app]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand whole texts to Python 2,000 at a time, unless the session has a batch size of its own."""
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's default
        spark.conf.set(BATCH_ROWS, str(rows))


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim  # glibc alone has it
    except (OSError, AttributeError):
        return lambda _: 0


_TRIM = _trimmer()


def tidy() -> None:
    """Give back memory that a task held: its worker waits for tasks of other stages, beside a heap that grows."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/tidewright/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(clean)
    return path


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    rows: how many rows there are at most, if known; a table of few rows gets few files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the scratch table behind a DataFrame that ``materialize`` returned."""
    path = getattr(df, "_tidewright_path", None)
    if path:
        drop_path(df.sparkSession, path)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Rows with the least ``value`` of their ``key`` as ``name``; a null key goes.

    The rows of a key are dealt into 64 parts by their value, and the least value goes to each part that has
    rows, so a key that holds very many rows is the work of many tasks, which adaptive execution may split further.
    """
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(value), F.lit(DEALT)).cast("int"))
    parts = dealt.groupBy(key, "deal").agg(F.min(value).alias("low"))
    whole = parts.groupBy(key).agg(F.min("low").alias(name), F.collect_list("deal").alias("deals"))
    return dealt.join(whole.select(key, name, F.explode("deals").alias("deal")), [key, "deal"]).drop("deal")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b), by alternating large-star and small-star steps.

    Returns (node, root) for every node that has an edge, root being the smallest node of the
    component. A round is two joins with the least neighbour, written to the shared folder; the loop
    ends when a round leaves the edge set as it was. A node's edges are dealt over many tasks. Nothing
    but a count and a checksum is collected. Null ends and loops are ignored; an empty table gives an
    empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(edges.where("a > b").distinct(), "edges")
    before = None
    while True:
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before = after
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "m").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b").distinct()
        small = with_least(large, "a", "b", "m").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b")
        small = materialize(small.where("a > b").distinct(), "edges", 2 * after[0])
        release(now)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), where b < a and each a has one link: pointers doubled round by round.

    A round is one join, in which a root with very many nodes may be split. An empty table gives an empty result.
    """
    now = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "forest")
    n, moved = now.count(), True
    while moved and n:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = materialize(now.select("node", "root").join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "forest", n)
        release(now)
        now = new
        moved = not now.where("moved").isEmpty()
    return now.select("node", "root").unionByName(now.select(F.col("root").alias("node"), "root").distinct())


def joined_up(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, root) after ``edges`` (a, b) link more nodes; a node without a label is its own component.

    Only edges between different components are followed further, so what is joined already costs one join.
    """
    a, b = labels.toDF("a", "ra"), labels.toDF("b", "rb")
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    between = materialize(between.distinct(), "between", edges.count())
    if between.isEmpty():
        return labels
    over = materialize(components(between), "over")
    old = labels.join(over.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(old.unionByName(over.join(labels.select("node"), "node", "left_anti")), "labels")


def settle(linked: np.ndarray) -> np.ndarray:
    """The smallest position that each row of a symmetric matrix reaches."""
    root = np.arange(len(linked))
    far = len(root)
    while True:
        low = np.minimum(root, np.where(linked, root[None], far).min(axis=1, initial=far))
        low = low[low]
        if (low == root).all():
            return root
        root = low
