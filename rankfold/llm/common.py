"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.session import ensure_checkpoint_dir, ship_package

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, return.
#: ``bytes.split()`` splits at exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) and nothing else; a null text stays null."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage and survives lost executors.  Used for whatever is read more than once and
    is dear to make.  The files live as long as the checkpoint folder, see :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._llm_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of frames made by :func:`stored` that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._llm_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of an :func:`id_bitmap`.
BITMAP = 24


def id_slot(col: str = "doc_id"):
    return F.pmod(F.xxhash64(col), F.lit(1 << BITMAP))


def id_bitmap(ids: DataFrame, col: str = "doc_id"):
    """Broadcast bitmap of the hash slots of ``ids``, of 2 MB whatever their number.

    A first filter before a join by id, so that texts without a partner aren't shuffled.  Slots of
    other ids may be set too, so the join must follow; the more ids, the less the filter saves.
    """
    words = ids.select(id_slot(col).alias("s")).groupBy(F.shiftright("s", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 31 AS int))")).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITMAP - 5), dtype=np.uint32)
    for r in words:
        bitmap[r["word"]] = r["bits"]
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def in_bitmap(bitmap: np.ndarray, slots: pa.Array) -> np.ndarray:
    s = slots.to_numpy(zero_copy_only=False)
    return (bitmap[s >> 5] >> (s & 31).astype(np.uint32)) & 1 > 0


_REMEMBERED: dict = {}


def remembered(name: str, make: Callable):
    """What this Python worker remembers between tasks, of one operator at a time: that of others goes,
    so that a worker which serves several operators doesn't hold them all."""
    if name not in _REMEMBERED:
        forget()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def forget() -> None:
    if _REMEMBERED:
        _REMEMBERED.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """What this Python worker has freed goes back to the system, as its allocators would keep it while the worker
    waits for other tasks, beside all other workers of the executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


#: Rows that a step with much output a row takes at a time.
FEW_ROWS = 500


def slices(batch: pa.RecordBatch, rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows."""
    yield from (batch.slice(a, rows) for a in range(0, batch.num_rows, rows)) if rows else (batch,)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[dict]]], schema: str, remembers: bool = False,
              rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with plain Python columns.

    ``make()`` runs once per task and gives a function from a dict of lists to an iterator of dicts
    of lists (or arrays), each of which becomes one Arrow batch.  ``rows`` bounds the rows of such a dict.
    """
    ship_package(df.sparkSession)
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in _parse(schema)])

    def run(batches):
        if not remembers:
            forget()
        step = make()
        for whole in batches:
            for batch in slices(whole, rows):
                for out in step({n: batch.column(i) for i, n in enumerate(batch.schema.names)}):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        step = whole = batch = out = None  # noqa: F841  what they hold is to go too
        give_back()

    return df.mapInArrow(run, schema)


def _parse(schema: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
          "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
          "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
