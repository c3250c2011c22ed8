"""What several operators of this subpackage share: words, shared storage, doc_id ranges, memory of Python workers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: A-Z to a-z, all other bytes as they are.
FOLD = bytes.maketrans(_UPPER, _LOWER)
#: A-Z to a-z, and every ASCII byte that is neither letter nor digit to a blank.
FOLD_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text; none for null."""
    return text.translate(FOLD_ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; none for null."""
    return text.translate(FOLD).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, as in tests, a new one on this machine; on
    a cluster that fails, since executors would write to disks of their own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="assaykit-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again. With ``by``, rows of one value of that column
    lie apart, so that reading some of them leaves the others unread."""
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most ``rows`` rows and about ``size`` bytes: whole texts of any
    length go to Python, and a batch is held several times on its way. Smaller settings of the session stay."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if int(conf.get(key).removesuffix("b")) not in range(1, most + 1):
            conf.set(key, str(most))
    return df


def give_back() -> None:
    """Return this worker's free memory to the system: a worker stays for later tasks, and what Arrow and the C library
    keep for themselves would count until then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, after which the worker gives its free memory back, also if the task fails or its
    consumer stops early."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(held, schema)


def text_frame(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as bytes (no decoding in Python), and further columns."""
    return small_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def id_splits(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending doc_id bounds that cut the rows into ranges of about equal size."""
    probs = [i / parts for i in range(1, parts)]
    found = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", probs, 0.2 / parts) if probs else []
    return sorted({int(x) for x in found})


def longs(values: list[int]) -> F.Column:
    """A constant array of numbers, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def id_range(splits: list[int]) -> F.Column:
    """Number of the doc_id range (0 for null): ranges ascend with doc_id; a doc_id is in one range only.

    A binary search over the bounds: a row costs a comparison for each doubling of the number of ranges.
    """
    if not splits:
        return F.lit(0)
    bounds, key = longs(splits), F.col("doc_id").cast("long")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splits).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(key >= F.get(bounds, at + step - 1), at + step).otherwise(at))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` is read from, as far as Spark knows them before it runs; 0 for others."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # more means unknown


def text_partitions(docs: DataFrame, size: int = 128 << 20) -> int:
    """Partitions for a shuffle of whole texts: the session's number, or more where a partition would get over ``size``
    bytes of the (compressed) input."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // size))
