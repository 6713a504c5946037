"""Helpers that the training-data operators share: shared scratch tables, column hygiene, Arrow text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one vectorised step works on; a longer document makes a step of its own.
STEP_BYTES = 512 << 10
#: Bytes of an Arrow batch between Spark and Python, and Spark's own default as its configuration prints it.
BATCH_CONF, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, "67108864b"


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where all of Spark runs in this process and none
    is named, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage, survives lost executors, gives real sizes."""
    path = f"{scratch(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop(*stashed: DataFrame) -> None:
    """Remove stashed frames from the shared folder, once nothing reads them any more."""
    for df in stashed:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of a few rows that the driver holds; goes to Spark as one Arrow table, without a Python worker."""
    fields = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=to_arrow_schema(fields)), fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Leave out columns whose names clash (case-insensitively) with what an operator adds."""
    taken = {n.lower() for n in names}
    if not any(c.lower() in taken for c in df.columns):
        return df
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def bounded_rows(df: DataFrame, most: int, *keys: Column) -> DataFrame:
    """At most `most` rows, the same ones on every run: those with the smallest hashes of their keys."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(most)


# ---------------------------------------------------------------- text as flat arrays


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and len+1 offsets; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def flat_chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all texts and len+1 offsets."""
    data, off = flat_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), at


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Slices of about `step_bytes`, so that the arrays made from a batch stay small."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = (np.cumsum(sizes) - sizes) // step_bytes
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield texts.slice(a, b - a)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs where `space` is false; a run never crosses documents."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[off[:-1][off[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for i, base in enumerate((_BASE, inverse)):
            steps_ = np.full(n, base, np.uint64)
            steps_[0] = 1
            _POWERS[i] = np.cumprod(steps_)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for all ranges, by prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# ---------------------------------------------------------------- Arrow maps


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself; Arrow batches of the session are held to BATCH_BYTES, unless the session names a size of its own.

    Both ends of a Python worker's pipe hold whole batches, and texts make them large.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) == BATCH_DEFAULT:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return free memory to the system at the end of a task: the worker process lives on."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # as long as the longest text so far
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow of a function that knows columns by their places; their names may hold dots."""
    return small_batches(df).toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def append(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Add columns computed from a text column, batch by batch; clashing input columns give way.

    make() runs once in each task; what it returns maps a slice of texts to one Arrow array for each field.
    """
    text_at = df.columns.index(text_col)
    kept = without(df, [f.name for f in fields])
    keep_at = [df.columns.index(c) for c in kept.columns]
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            at = 0
            for part in steps(batch.column(text_at)):
                whole = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*(whole.column(i) for i in keep_at), *fn(part)], names=schema.names)
        give_back()

    return arrow_map(df, run, schema)
