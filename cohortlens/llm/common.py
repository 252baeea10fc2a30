"""Helpers shared by the training-data operators.

Rows travel through ``mapInArrow``; inside a worker a batch is cut into slices
of :data:`SLICE` bytes of text, so numpy temporaries stay small whatever a batch holds. A text
longer than a slice is a slice of its own; kernels go through it piece by piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed odd multipliers of the 64-bit and 32-bit finalisers (public constants of MurmurHash3).
M64A, M64B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
M32A, M32B = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
S33 = np.uint64(33)
#: Bytes of text that a kernel looks at together.
SLICE = 1 << 18
#: Rows and bytes of an Arrow batch between Spark and a Python worker, about.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Freed memory goes back to the system: glibc's growing thresholds and Arrow's own pool would keep it in each worker.
WORKER_ENVIRONMENT = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Spark's setting by which the shuffle files of a query are deleted when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys of more rows than this are dealt over salts by :func:`hot_join`.
HOT_ROWS = 256
#: Hot keys that are broadcast at most, 24 bytes each.
BROADCAST_KEYS = 1_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that scrambles all bits; changes and returns ``x``."""
    x ^= x >> S33
    x *= M64A
    x ^= x >> S33
    x *= M64B
    x ^= x >> S33
    return x


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, shuffle files that go with their job, workers that give memory back; settings that the session or its user made stay."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if spark.conf.get(SHUFFLES_GO, "false") == "false":  # Spark's default: files stay until the driver collects garbage
        spark.conf.set(SHUFFLES_GO, "true")
    for name, value in WORKER_ENVIRONMENT.items():
        spark.sparkContext.environment.setdefault(name, value)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only on one machine a folder in the warehouse may take
    its place where that is unset; on a cluster it could be a local folder of each machine, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


#: Folders that this process has written and not yet deleted.
_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends here.

    The write is a committed Parquet table, so a lost executor costs no recomputation of
    what came before, and whatever a retry could do differently is fixed from here on.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A folder name for :func:`release`; what is left of it goes when the application ends."""
    path = shared_dir(spark)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    _written.append(path)
    return path


def hot_keys(rows: DataFrame, *keys: str) -> DataFrame | None:
    """The keys that hold more than HOT_ROWS of the rows, with ``_salts``, over how many salts each is dealt; None if none does."""
    return hot_of(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "_n", *keys)


def hot_of(counts: DataFrame, count: str, *keys: str) -> DataFrame | None:
    """:func:`hot_keys` of keys that are counted already. At most BROADCAST_KEYS are returned: the limit rises with the rows."""
    some = counts.where(F.col(count) > HOT_ROWS)
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    some = materialize(some.select(*keys, F.col(count).alias("_n")))
    total = some.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    most = max(HOT_ROWS, total // BROADCAST_KEYS)
    return some.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_salts"))


def hot_join(rows: DataFrame, other: DataFrame, keys: list[str], deal: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other``, which has one row for each key, when a few keys hold many of the rows.

    A key in ``hot`` (from :func:`hot_keys`) is dealt over salts by the hash of ``deal``, its row of ``other`` is repeated for each.
    """
    if hot is None:
        return rows.join(other, keys, how)
    hot = F.broadcast(hot)
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(deal), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    spread = other.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def written() -> int:
    """A mark for :func:`release`."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Delete the tables written after a mark, once what was computed from them is itself written; the last one may stay."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    last = len(_written) - 1 if keep_last else len(_written)
    for path in _written[since:last]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)
    del _written[since:last]


def settled(df: DataFrame, since: int) -> DataFrame:
    """The frame, written, with all tables of the shared folder that were made since the mark and led to it deleted."""
    out = materialize(df)
    release(df.sparkSession, since, keep_last=True)
    return out


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Exactly these columns, whatever else the table has, matched by exact name where names clash."""
    out = []
    for name in columns:
        found = [i for i, c in enumerate(df.columns) if c == name] or [
            i for i, c in enumerate(df.columns) if c.lower() == name.lower()
        ]
        if not found:
            raise ValueError(f"column {name!r} is missing; the table has {df.columns}")
        out.append(found[0])
    if sorted(out) == list(range(len(df.columns))) or len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*(F.col(f"`{df.columns[i]}`").alias(n) for i, n in zip(out, columns, strict=True)))
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{i}").alias(n) for i, n in zip(out, columns, strict=True)))


def crc_of(column: Column | str) -> Column:
    """Unsigned crc32 of a value's text form; null counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE, max_rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``max_bytes`` of one column's data (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    begin = 0
    while begin < n:
        before = ends[begin - 1] if begin else 0
        end = int(np.searchsorted(ends, before + max_bytes, side="right"))
        end = min(max(end, begin + 1), begin + max_rows, n)
        yield batch.slice(begin, end - begin)
        begin = end


def utf8(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes on end (null: empty) and the offsets of its rows, without copying per row."""
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    kind = arr.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return whole, offsets - offsets[0]


def held_by(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))
