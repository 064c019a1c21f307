"""What the operators share: the shared work folder and views of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Spark's settings for the size of a batch, and the one that drops an execution's shuffle files when it ends
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch that goes to a Python worker: long texts would make batches of 64 MB, held several times over."""
    if spark.conf.get(BATCH, None) != BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)


def work_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode without one, a temporary folder.

    On a cluster the setting is required: a folder of one machine is not seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="phraseloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage.

    A lost executor then costs a read, not a recomputation. The folder is removed when the
    application ends, the write's shuffle files at its end.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{work_dir(spark)}/phraseloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    del df
    jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece holds `limit` bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """The groups of equal keys (integers) of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        heads = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            key = tuple(int(v[a]) for v in values)
            if held and key != last:
                yield last, pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.concat_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, which ascend and do not overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + step, "right")))
        high = int(ends[to - 1])
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(BYTE_VALUES[data[low:high]] * powers(BASE, high - low), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * powers(BASE_INVERSE, high - low + 1)[s] + (e - s).astype(U64))
        at = to
    return out


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside`; no run crosses an offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return LOWER[data]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def passed(batch: pa.RecordBatch, keep: list[bool] | None = None, texts: list[str | None] | None = None) -> pa.RecordBatch:
    """The batch with new texts, whose lengths go to n_chars where there is such a column, and without the rows that are not kept."""
    if texts is not None:
        at = batch.schema.get_field_index("text")
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        n = batch.schema.get_field_index("n_chars")
        if n >= 0:
            changed = [t is not None and t != old for t, old in zip(texts, batch.column(at).to_pylist(), strict=True)]
            sizes = [len(t) if c else old for t, c, old in zip(texts, changed, columns[n].to_pylist(), strict=True)]
            columns[n] = pa.array(sizes, batch.schema.field(n).type)
        batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return batch if keep is None else batch.filter(pa.array(keep, pa.bool_()))
