"""Helpers the operators of this subpackage share: tables, Arrow texts, hashing of bytes, written steps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import new_work_folder

#: The bytes of one slice of a batch that is worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def _ship_code(spark: SparkSession) -> None:
    """Sends this package to the workers once per application, wherever the driver loaded it from."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


def arrow_map(
    rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``work`` on the Arrow batches of each partition. What it keeps in its worker ends with the partition."""
    _ship_code(rows.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return rows.mapInArrow(released, schema)


def written(rows: DataFrame, label: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """The rows as a table in the shared folder, which cuts the lineage.

    Lost executors then repeat what comes after it only. Written tables that nothing after it reads are ``done`` and
    their folders removed.
    """
    path = new_work_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._tidemark_path = path
    forget(*done)
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the folders of tables that ``written`` made."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_tidemark_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column end to end as bytes, and the n + 1 bounds. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if not len(column) or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most so many bytes together, or of one row."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_KEPT: dict[str, tuple[str, object]] = {}


#: What a worker keeps over partitions: of bounded size, and needed by every one.
_SMALL = "powers"
_SMALL_ITEMS = 1 << 21


def release() -> None:
    """Gives up what the worker keeps and hands free memory back to the system, for the stages that come after."""
    dropped = [k for k, (_, kept) in _KEPT.items() if k != _SMALL or len(kept[0]) > _SMALL_ITEMS]
    for kind in dropped:
        del _KEPT[kind]
    if dropped:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept_in_worker(kind: str, key: str, build: Callable[[], object]) -> object:
    """One object of a kind per Python worker and partition, built anew when the key changes."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT[kind] = (key, build())
    return _KEPT[kind][1]


# Hashing of bytes in numpy: sums of random values times powers of an odd number, modulo 2**64.

_STEP = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
_BYTES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
#: The same values with A-Z read as a-z.
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    forward, back = kept_in_worker(
        "powers",
        str(1 << max(20, int(len(data)).bit_length())),
        lambda: tuple(_powers(b, (1 << max(20, int(len(data)).bit_length())) + 1) for b in (_STEP, pow(_STEP, -1, 1 << 64))),
    )
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * forward[: len(data)], out=sums[1:])
    whole = (sums[ends] - sums[starts]) * back[starts]
    return mixed(whole ^ mixed((ends - starts).astype(np.uint64)))


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of texts laid end to end, and how many each text has."""
    solid = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))
