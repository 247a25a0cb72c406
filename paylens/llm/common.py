"""What the operators of this folder share: Arrow maps, words, numbers from hashes, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, StructType

ROOT = str(Path(__file__).resolve().parent.parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Name a checkpoint folder where the cluster names none, and let Python workers find this library.

    The cluster's folder is ``spark.checkpoint.dir``. Where it is unset (tests,
    one machine), a folder of the warehouse is used, which executors share too.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    known = context.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        context.environment["PYTHONPATH"] = f"{known}:{ROOT}".strip(":")
    return spark


def map_rows(
    df: DataFrame, schema: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]]
) -> DataFrame:
    """``mapInArrow`` of a function that yields columns as lists or Arrow arrays."""
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type
                    else pa.array(c, f.type)
                    for f in target
                ],
                schema=target,
            )

    return df.mapInArrow(run, schema)


#: Rows of an Arrow batch that are taken as Python values at once, where this matters for memory.
SLICE = 512
_AT_TASK_END: list[Callable[[], None]] = []


def at_task_end(clear: Callable[[], None]) -> None:
    """What a module keeps in a Python worker lives for one task: ``clear`` is called when that is over."""
    _AT_TASK_END.append(clear)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows; at the end of the task, what was kept for it goes back to the system.

    Python workers are used again by later stages, so that memory which one
    stage keeps is missing in all that follow.
    """
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE)
    finally:
        for clear in _AT_TASK_END:
            clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)


class Recent(dict):
    """Values by key, made when first asked for. At the bound, the older half is set aside, and dropped if not asked for."""

    def __init__(self, make: Callable, most: int, keep: Callable | None = None):
        super().__init__()
        self.make, self.half, self.keep = make, max(1, most // 2), keep
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if self.keep is not None and not self.keep(key):
                return value
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}


def by_place(df: DataFrame) -> DataFrame:
    """The frame with its columns named c0, c1 and so on, so that names with dots or of columns made here do no harm."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def map_texts(df: DataFrame, text: str, change: Callable[[list], tuple[list, list]], length: str | None = None) -> DataFrame:
    """Change the texts of some rows and drop others; all columns stay, of whatever name and type.

    ``change`` gets the texts of a batch and returns the new texts and a list of
    booleans: which rows stay. ``length`` names a column for the new code points.
    """
    at = df.columns.index(text)
    where = None if length is None else df.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            old = batch.column(at).to_pylist()
            new, stays = change(old)
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if where is not None:
                kept = batch.column(where).to_pylist()
                counts = [k if a == b else len(b) for k, a, b in zip(kept, old, new)]
                columns[where] = pa.array(counts, batch.schema.field(where).type)
            out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield out.filter(pa.array(stays, pa.bool_()))

    rows = by_place(df)
    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)


_ARROW = {
    "long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "float": pa.float32(), "short": pa.int16(), "byte": pa.int8(),
}


def _arrow_type(kind: DataType) -> pa.DataType:
    if isinstance(kind, ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return _ARROW[kind.typeName()]


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


_SEPARATORS = [b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]
#: Lower-cases A-Z and blanks ASCII other than letters and digits, byte by byte.
WORD_TABLE = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def letter_words(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII code points, A-Z in lower case, in UTF-8."""
    return text.encode().translate(WORD_TABLE).split()


def spaced_words(text: str) -> list[bytes]:
    """Runs between ASCII white space, A-Z in lower case, in UTF-8."""
    return text.encode().lower().split()


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits for each 64-bit number (the splitmix64 finaliser)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def streams(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    start = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
    return mixed(start) | np.uint64(1)
