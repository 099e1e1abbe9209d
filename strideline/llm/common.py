"""What the corpus operators share: table access, shared scratch space, Arrow helpers and fixed-size count tables."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters that a Python task holds at once.
BATCH_ROWS, BATCH_CHARS = 512, 1_500_000

try:  # large arrays come from the system and go back to it, so that a worker that is used again doesn't keep them
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    _trim = _libc.malloc_trim
except (OSError, AttributeError):
    _trim = None


def give_back() -> None:
    """Return free memory to the system, at the end of a task or group: Spark keeps Python workers for the next tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; Spark alone reads it, so the folder may be in any store."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't have it on their path, and lower the session's Arrow batches to
    BATCH_ROWS rows where they are larger: texts and packed blocks are long rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    sc = spark.sparkContext
    on_path = root in os.environ.get("PYTHONPATH", "").split(":") or os.path.realpath(os.getcwd()) == os.path.realpath(root)
    if on_path or getattr(sc, "_strideline_shipped", False):
        return
    import shutil

    folder = tempfile.mkdtemp()
    name = Path(__file__).resolve().parents[1].name
    sc.addPyFile(shutil.make_archive(f"{folder}/{name}_package", "zip", root, name))
    sc._strideline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset and all run on this
    machine, one of our own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sc, "_strideline_scratch", None) or "file://" + tempfile.mkdtemp(prefix="strideline-")
        sc._strideline_scratch = base
    return f"{base.rstrip('/')}/strideline-{uuid.uuid4().hex}"


def saved(df: DataFrame, where: str | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._strideline_at = where
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what saved() wrote for these tables; only for tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._strideline_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_lists(data: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data, from one cut at a space after another, so that a very long text's words are not all objects at once."""
    at = 0
    while len(data) - at > most and (cut := _SPACE.search(data, at + most)):
        yield data[at : cut.start()].split()  # of bytes: only space and \x09-\x0d separate
        at = cut.end()
    yield data[at:].split()


def destroyed(*sent) -> None:
    """Take broadcast values from the executors, their Python workers included, once no job needs them any more."""
    for b in sent:
        b.destroy()


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text under fixed names, so that other columns of any name don't matter; a null text is empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: where fewer partitions hold rows (a file of one row group), its rows are dealt out anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores else df.repartition(cores)


def carried(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, str]:
    """two_columns, and a struct `rest` of the columns in carry with its type; the struct is null if there are none."""
    rest = F.struct(*(F.col(f"`{c}`").alias(c) for c in carry)) if carry else F.lit(None).cast("struct<none:int>")
    out = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    return out, out.schema["rest"].dataType.simpleString()


#: What tasks keep in their worker for the next tasks of the same kind: encoders and memos, by kind.
_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    return _kept.setdefault(kind, {})


def slices(batches: Iterable[pa.RecordBatch], kind: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's variable-length data stays small. What tasks of other kinds kept in this worker goes."""
    others = [c for k, c in _kept.items() if k != kind and c]
    for c in others:
        c.clear()
    if others:
        gc.collect()
        give_back()
    for b in batches:
        n = b.num_rows
        step = n if b.nbytes <= BATCH_CHARS else max(1, n * BATCH_CHARS // b.nbytes)
        for i in range(0, n, max(step, 1)):
            yield b.slice(i, step)
    give_back()


def map_docs(df: DataFrame, fn: Callable[[list, list], dict[str, list]], schema: str) -> DataFrame:
    """fn gets lists of ids and texts of a slice and returns columns; used where per-document Python is needed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = fn(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, out.field(i).type) for i, x in enumerate(got[f] for f in out.names)], schema=out)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


#: Parts in which a count table travels, so that no row is large.
PARTS = 64


def _narrow(c: np.ndarray) -> bytes:
    """Counters as the smallest unsigned numbers that hold them, compressed: most are small."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(c.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + zstandard.compress(c.astype(f"<u{width}").tobytes(), 1)


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x[1:]), f"<u{x[0]}").astype(np.int64)


def summed_counts(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], size: int) -> np.ndarray:
    """A table of `size` counters summed over all rows of df.

    Each task keeps one table and sends it in PARTS packed pieces; pieces meet in two rounds (64 salts, then one), so no
    task gets more than a 64th of a piece's senders. The result has a fixed size whatever the input's.
    """
    step = size // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, any_rows = np.zeros(size, np.int32), False
        for b in slices(batches):
            any_rows = True
            add(c, b)
        if any_rows:
            salt = TaskContext.get().partitionId() % 64  # the same when the task runs again
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([salt] * PARTS, pa.int32()), pa.array([_narrow(c[i * step : (i + 1) * step]) for i in range(PARTS)], pa.binary())], ["part", "salt", "c"])

    def add_up(keys: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for x in tab.column("c"):
            total += _wide(x.as_py())
        return pa.table({"part": pa.array([keys[0].as_py()], pa.int32()), "c": pa.array([_narrow(total)], pa.binary())})

    parts = df.mapInArrow(count, "part int, salt int, c binary")
    once = parts.groupBy("part", "salt").applyInArrow(add_up, "part int, c binary")
    rows = once.groupBy("part").applyInArrow(add_up, "part int, c binary").collect()  # PARTS rows of a fixed size
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["part"] * step : (r["part"] + 1) * step] = _wide(r["c"])
    return out


class Blocks:
    """Columns of numbers dealt into blocks by a number for each entry; a block's entries leave together, as packed bytes.

    One row for each block and flush takes the place of one row for each entry. add() returns batches when `most`
    entries are held, flush() the rest.
    """

    def __init__(self, n_blocks: int, types: list[str], most: int = 600_000):
        self.n, self.types, self.most, self.held, self.size = n_blocks, types, most, [], 0

    @staticmethod
    def schema(n: int) -> str:
        return "block long, " + ", ".join(f"c{i} binary" for i in range(n))

    def add(self, block: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((block, *columns))
        self.size += len(block)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        block, *columns = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        yield from self.pack((block, list(zip(columns, self.types, strict=True))))

    @staticmethod
    def pack(*groups: tuple[np.ndarray, list[tuple[np.ndarray, str]]]) -> Iterator[pa.RecordBatch]:
        """A row for each block: the bytes of its entries, in their order. Each group has its blocks and columns; a block
        may miss in a group, but the first has all."""
        sets = []
        for block, columns in groups:
            order = np.argsort(block, kind="stable")
            sets.append((block[order], [c[order].astype(t) for c, t in columns]))
        blocks = np.unique(sets[0][0])
        edges = [(np.searchsorted(b, blocks, "left").tolist(), np.searchsorted(b, blocks, "right").tolist()) for b, _ in sets]
        names = ["block", *(f"c{k}" for k in range(sum(len(c) for _, c in sets)))]
        for i in range(0, len(blocks), 16):
            cols = [pa.array([c[s:e].tobytes() for s, e in zip(lo[i : i + 16], hi[i : i + 16], strict=True)], pa.binary()) for (_, columns), (lo, hi) in zip(sets, edges, strict=True) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[i : i + 16], pa.int64()), *cols], names)

    @staticmethod
    def unpack(tab: pa.Table, types: list[str]) -> list[np.ndarray]:
        """The columns of one block."""
        return [np.frombuffer(b"".join(tab.column(f"c{i}").to_pylist()), t) for i, t in enumerate(types)]


def grid(df: DataFrame, entries: int, per_block: int = 400_000) -> int:
    """How many blocks keep a block's entries near per_block; at least two for each shuffle partition."""
    return max(-(-entries // per_block), 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
