"""What several operators share: mapping texts in Arrow batches, checkpoints, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handed to a function at once hold about this many bytes.
SLICE_BYTES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session, as in tests, gets one of its
    own; on a cluster it has to be set, as executors share no other folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return tempfile.mkdtemp(prefix="stratamill-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, mod: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % mod


def drawn(df: DataFrame, key: str, about: int) -> DataFrame:
    """About that many rows, or all if there are fewer: those with the smallest hashes of their key."""
    n = df.count()
    return df if n <= about else df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(2**40)) < about * 2**40 // n)


def small(df: DataFrame, cells: Column | None = None, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has no more rows than that, each of a few numbers, or no more values in all, where
    ``cells`` says how many a row has; otherwise joins shuffle it."""
    n = df.count() if cells is None else df.agg(F.coalesce(F.sum(cells) + F.count("*"), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most else df


def heavy_join(rows: DataFrame, values: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """rows with the columns of ``values``, which has each key once, and in ``rows`` how many rows have it. Keys of over
    one in ``share`` of the rows, of which there are fewer than ``share``, are sent to where the rows are; only the
    others' rows are shuffled. ``values`` should be a checkpoint, as it is read more than once."""
    total = values.agg(F.sum("rows")).first()[0] or 0
    heavy = F.col("rows") * share > total
    hot = F.broadcast(values.where(heavy).drop("rows"))
    rest = rows.join(F.broadcast(values.where(heavy).select(key)), key, "left_anti").join(values.where(~heavy).drop("rows"), key)
    return rows.join(hot, key).unionByName(rest)


def slices(sizes: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of values that have about that many bytes, one value at least."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


def lean(run: Callable) -> Callable:
    """A function over batches whose worker gives back what it held when its task ends. Spark keeps workers for later
    tasks, and next to other ones; without this each would stay as large as its largest task."""

    def wrapped(batches):
        try:
            for batch in run(batches):
                yield batch
                pa.default_memory_pool().release_unused()
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def sliced_texts(column: pa.Array, most: int = SLICE_BYTES):
    """Texts of an Arrow column as lists of about that many bytes, with where they begin and end."""
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_numpy(), most):
        yield a, b, column.slice(a, b - a).to_pylist()


def map_texts(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], arrow: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All columns of df, and those of ``fields`` made from the texts.

    ``make`` runs once in each task and returns a function from a list of texts (None for null) to one list or
    Arrow array for each field; with ``arrow`` the column is one of lists, and it gets them as they are. A column of df that has a new field's name gives way to it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    read = df.select(*(F.col(f"`{c}`") for c in keep), *([F.col(f"`{text_col}`")] if text_col in new else []))
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = keep + [f.name for f in fields]

    def run(batches):
        function = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            sizes = pc.fill_null(pc.list_value_length(column) if arrow else pc.binary_length(column), 0).to_numpy()
            for a, b in slices(sizes, slice_bytes):
                values = column.slice(a, b - a)
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(function(values if arrow else values.to_pylist()), kinds, strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=names)

    return read.mapInArrow(lean(run), T.StructType([*(df.schema[c] for c in keep), *fields]))


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))
