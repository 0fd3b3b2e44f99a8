"""Plan helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that is sent whole to every executor.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def local_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path of the file system, if it is one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for these tables; nothing may be read from them afterwards."""
    for df in tables:
        if path := getattr(df, "_written", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of texts that go to a Python worker at once, unless the session says otherwise.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller batches for Python workers than Spark's own default, which is meant for narrow rows; another number set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker gives the memory of its task back to the system: it lives on, idle or for other operators."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with every C library
        pass


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, counted now, stays under the limit for a broadcast."""
    return df.count() * row_bytes <= limit


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it is small enough; else df as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


def keep_ids(df: DataFrame, ids: DataFrame, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """left_semi or left_anti join of df with a one-column table of doc_id, which may hold each id once only."""
    ids = ids.select(F.col("doc_id").alias("__id"))
    side = checked_broadcast(ids, 24, limit)
    return df.join(side, df["doc_id"] == side["__id"], how)


#: Bits of a hash that a bitmap tells apart at most: 64 MB.
_MOST_BITS = 29


def bitmap(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for the upper bits of each hash, and how many those are; of one size from some number of seeds on, when it only lets more of the others through.

    Its pieces are made where the hashes are; only they come to the driver.
    """
    count = hashes.count()
    bits = int(min(_MOST_BITS, max(16, np.ceil(np.log2(16 * count + 1)))))
    piece = min(bits - 3, 16)
    schema = pa.schema([("piece", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            top = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            which, byte = (top >> np.uint64(piece + 3)).astype(np.int64), (top >> np.uint64(3)).astype(np.int64) & ((1 << piece) - 1)
            for k in np.unique(which).tolist():
                own = which == k
                np.bitwise_or.at(made.setdefault(k, np.zeros(1 << piece, np.uint8)), byte[own], np.uint8(1) << (top[own] & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in made.values()], pa.binary())], schema=schema)

    out = np.zeros(1 << (bits - 3), np.uint8)
    pieces = hashes.select("hash").repartition(F.shiftrightunsigned("hash", 64 - bits + 3 + piece) if bits > piece + 3 else F.lit(0)).mapInArrow(tidy(run), "piece int, bits binary")
    for r in pieces.toLocalIterator():
        out[r[0] << piece : (r[0] + 1) << piece] |= np.frombuffer(bytes(r[1]), np.uint8)
    return out, bits


def among(bitmap: np.ndarray, bits: int, g: np.ndarray) -> np.ndarray:
    top = g >> np.uint64(64 - bits)
    return (bitmap[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)) & 1 != 0


def hang_together(name: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each member the least name of all that links (left, right) connect it with."""
    least = name.copy()
    while True:
        low = least.copy()
        np.minimum.at(low, left, least[right])
        np.minimum.at(low, right, least[left])
        if (low == least).all():
            return least
        least = low


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group): connected groups of pairs, named by their lowest id; the lowest id itself has a row too.

    Every label is lowered to the lowest of its neighbours and then to that
    label's own label, until nothing changes; the steps needed grow with the
    logarithm of a group's width.
    """
    edges = pairs.select(F.col("doc_a").alias("x"), F.col("doc_b").alias("y"))
    edges = materialise(edges.union(edges.select("y", "x")), "edges")
    label = materialise(edges.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("l")), "labels")
    while True:
        side = checked_broadcast(label, 24)
        near = edges.join(side.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        low = label.join(near, "x").select("x", "l", F.least("l", "m").alias("m"))
        jump = side.select(F.col("x").alias("m"), F.col("l").alias("j"))
        new = materialise(low.join(jump, "m", "left").select("x", F.least("m", "j").alias("l"), F.col("l").alias("old")), "labels")
        discard(label)
        if new.filter("l <> old").isEmpty():
            discard(edges)
            return new.select(F.col("x").alias("doc_id"), F.col("l").alias("group"))
        label = new.select("x", "l")
        label._written = new._written


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
