"""Shared parts of the training-data operators.

Every operator takes a DataFrame plus the names of its id and text columns, selects just those columns (so further
columns, even ones named like an output, cannot clash) and returns one row per input row.  Null text counts as the
empty text, null ids pass through, repeated rows are treated as separate rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into Python objects or numpy arrays at a time (one longer text is taken whole).
SLICE_BYTES = 1 << 20

#: Environment of Python workers: arrays go back to the system when they are freed, so that a worker that is kept for
#: later tasks does not keep the memory of its largest slice.
ALLOCATION = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where only the driver's sys.path has it; keep Arrow batches small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, value in ALLOCATION.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Just id, text (null becomes empty) and the further named columns."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, *, size: int = SLICE_BYTES, column: str = "text") -> DataFrame:
    """mapInArrow over slices whose text column holds about ``size`` bytes; ``work`` returns the columns of a slice."""
    prepare(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size, column):
                got = work(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, type=f.type) for f, x in ((f, got[f.name]) for f in out)], schema=out)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow that keeps the table's schema: ``work`` gets slices by the text of ``column`` and returns some of their
    rows, or the rows with another text."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size, column):
                yield work(part)

    return df.mapInArrow(run, df.schema)


def filter_texts(df: DataFrame, keeps: Callable[[list[str]], list[bool]], text_col: str) -> DataFrame:
    """The rows whose text (null as empty) ``keeps`` approves of, with all their columns; no shuffle."""
    return map_rows(df, lambda part: part.filter(pa.array(keeps([x or "" for x in part.column(text_col).to_pylist()]), pa.bool_())), text_col)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    ends = np.cumsum(lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(raw(column)[0])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return at - at[0], np.zeros(0, np.uint8)
    return at - at[0], np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir); a local one is set only where none is, as in tests."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            where = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def _saved(df: DataFrame, path: str, compression: str) -> None:
    """Write a table, or add rows to it; the shuffle files of the plan are removed when they are there."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        df.write.mode("append").option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """A Parquet table in the shared folder, reread; ``drop`` deletes it."""
    return written_in_parts([df], name, compression)


def written_in_parts(parts: Iterable[DataFrame], name: str, compression: str = "zstd") -> DataFrame:
    """One such table of all rows of the parts, written one after another: just one part's shuffle files are there at a
    time.  Parts may be made when they are asked for."""
    import uuid

    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _saved(df, path, compression)
    out = spark.read.schema(schema).parquet(path)
    out.table_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------------------------------------------------- hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n-1 (at least) of the hash base, or of its inverse, modulo 2^64."""
    key = "inverse" if inverse else "base"
    have = _tables.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, np.uint64(_INVERSE if inverse else _BASE))
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 1 << 21:
            _tables[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2^64: entry i covers data[:i]."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), True)[start]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For a string column: hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts one after another, and where each text's words begin (one entry more than texts)."""
    at, data = raw(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    inner = at[(at > 0) & (at < len(data))]
    before[inner] = True
    starts = np.flatnonzero(~space & before)
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[inner - 1] = True
    ends = np.flatnonzero(~space & after) + 1
    return mix(span_hashes(prefix_hashes(data), starts, ends) + (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words; entry i covers words[i:i+n]."""
    size = max(0, len(words) - n + 1)
    out = np.full(size, np.uint64(n))
    for k in range(n):
        out = (out ^ words[k : k + size]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out)
