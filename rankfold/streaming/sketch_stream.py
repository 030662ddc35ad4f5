"""Structured Streaming: the one-pass sketch and exact column norms over a
stream of cell contributions (J1, J2).

Input rows are ``(mat, row, col, val)`` contributions; several may add to
the same cell (events of one user in one hour).

* J1 sketch: linear, so every contribution goes straight into running
  sums, 16 coordinates of a column in one row of state (``update`` mode);
  each micro-batch writes the columns it touched and no others.
* J2 norms: squares are not additive over contributions, so the running
  value of every cell is a native streaming sum (``update`` mode); each
  micro-batch writes only the cells that changed, in a folder of its own,
  and the norms are the sums of the squares of the latest values.  With a
  watermark the state of hours that are past is dropped, and deliveries
  that come twice within it can be told by their ids and count once.  Every
  few batches the latest values of all cells are written as a new base, so
  that a reader opens one base and few batches.

Both drivers use ``trigger(availableNow=True)`` and keep table and
checkpoint under a stable name that the caller gives, so the same call
resumes after a stop.  Every micro-batch writes a folder named by its id,
which a repeated batch writes again: nothing is lost or counted twice, and
no table is missing while a write is under way.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.operators.sketch import SLICE, checked_row, hadamard_entry, sign_column
from rankfold.session import ensure_checkpoint_dir


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int = 1) -> DataFrame:
    """Stream a Parquet table as its files arrive: one file, or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    fs, p = _file_system(spark, path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_sketch(contrib: DataFrame, coords: list[int], seed: int, n: int | None = None) -> DataFrame:
    """Streaming SRHT sketch of all contributions as rows (mat, col,
    slice, s ARRAY<DOUBLE>) of 16 coordinates; see :func:`sketch_of`.  With
    the padded length ``n``, row ids outside 0..n-1 are an error."""
    k = len(coords)
    if n is not None:
        contrib = contrib.withColumn("row", checked_row(n))
    width = min(k, SLICE)
    picked = [F.struct(F.lit(t).alias("slice"), F.array(*[F.lit(int(h)).cast("bigint") for h in coords[t * SLICE:(t + 1) * SLICE]]).alias("h"))
              for t in range(-(-k // SLICE))]
    # the sign is hashed once per contribution, below the explode
    e = contrib.select("mat", "col", "row", (sign_column(seed) * F.col("val")).alias("sv")) \
        .withColumn("c", F.explode(F.array(*picked)))
    sums = [F.sum(hadamard_entry(F.get("c.h", F.lit(c)), F.col("row")) * F.col("sv")).alias(f"s{c}") for c in range(width)]
    state = e.groupBy("mat", "col", F.col("c.slice").alias("slice")).agg(*sums)
    return state.select("mat", "col", "slice", F.array(*[F.col(f"s{c}") / F.lit(math.sqrt(k)) for c in range(width)]).alias("s"))


def stream_cells(contrib: DataFrame, watermark: str | None = None, event_time: str = "ts",
                 delivery: list[str] | None = None) -> DataFrame:
    """Running value (mat, row, col, val) of every cell.

    With ``watermark`` (e.g. ``"2 hours"``) a contribution later than that is
    dropped and the state of older windows of an hour is freed; without it
    every contribution counts and the state has one sum per cell.

    ``delivery`` names the columns that tell one contribution from another
    (an event's id and the cell).  Rows that agree in them and come within
    the watermark of each other are one contribution sent again, and the
    first counts; ids are forgotten after that time, so their state is
    bounded too.  It needs a watermark.
    """
    keys = ["mat", "row", "col"]
    if watermark is None:
        if delivery:
            raise ValueError("delivery needs a watermark, or the ids of all time would be kept")
        return contrib.groupBy(*keys).agg(F.sum("val").alias("val"))
    timed = contrib.withWatermark(event_time, watermark)
    if delivery:
        timed = timed.dropDuplicatesWithinWatermark(list(delivery))
    return timed.groupBy(F.window(event_time, "1 hour").alias("hour"), *keys).agg(F.sum("val").alias("val")).drop("hour")


CELL = ["mat", "row", "col"]
SKETCH = ["mat", "col", "slice"]


def _numbered(spark: SparkSession, folder: str) -> dict[int, str]:
    """{number: path} of the complete ``name=number`` folders in ``folder``."""
    fs, p = _file_system(spark, folder)
    if not fs.exists(p):
        return {}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in fs.listStatus(p)]
    return {int(f.getName().rsplit("=", 1)[1]): f.toString() for f in found if "=" in f.getName() and fs.exists(path(f, "_SUCCESS"))}


def _bases(out: str) -> str:
    return out.rstrip("/") + "-base"


def files_in_use(spark: SparkSession, path: str) -> tuple[str | None, dict[int, str]]:
    """The newest base of a table of :func:`run_updates` and the batches after it."""
    bases, batches = _numbered(spark, _bases(path)), _numbered(spark, path)
    last = max(bases, default=None)
    return bases.get(last), {b: f for b, f in batches.items() if last is None or b > last}


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of every key of a table of :func:`run_updates`, with its batch."""
    base, batches = files_in_use(spark, path)
    parts = [spark.read.parquet(base)] if base else []
    if batches:
        rows = spark.read.option("basePath", path).parquet(*[batches[b] for b in sorted(batches)])
        parts.append(rows.withColumn("batch", F.col("batch").cast("bigint")))
    if not parts:
        raise ValueError(f"no batch has been written to {path}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not batches:
        return rows
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"), F.max("batch").alias("batch")) \
        .select(*keys, "last.*", "batch")


def norms_of(spark: SparkSession, path: str) -> DataFrame:
    """Squared column norms (mat, col, norm2) from the table of :func:`run_updates`."""
    return latest_rows(spark, path, CELL).groupBy("mat", "col").agg(F.sum(F.col("val") * F.col("val")).alias("norm2"))


def sketch_of(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The sketch (mat, col, t, s) of ``k`` coordinates from the table of :func:`run_updates` (keys ``SKETCH``)."""
    e = latest_rows(spark, path, SKETCH).select("mat", "col", "slice", F.posexplode("s").alias("c", "s"))
    return e.select("mat", "col", (F.col("slice") * SLICE + F.col("c")).alias("t"), "s").where(F.col("t") < k)


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Write the latest row of every key as a new base.  What the base
    before it covered is removed; what only the new one covers stays until
    the next, so that a reader that has just chosen its files finds them."""
    bases, batches = _numbered(spark, _bases(path)), _numbered(spark, path)
    before, newest = max(bases, default=-1), max(batches, default=-1)
    if newest <= before:  # a repeated batch: its base stands
        return
    latest_rows(spark, path, keys).write.mode("overwrite").parquet(os.path.join(_bases(path), f"through={newest}"))
    old = [f for b, f in bases.items() if b < before] + [f for b, f in batches.items() if b <= before]
    for folder in old:
        fs, p = _file_system(spark, folder)
        fs.delete(p, True)


def _paths(spark: SparkSession, name: str, base: str | None) -> tuple[str, str]:
    root = base or ensure_checkpoint_dir(spark)
    return os.path.join(root, "tables", name), os.path.join(root, "stream-ckpt", name)


def _run(stream_df: DataFrame, mode: str, write, ckpt: str) -> None:
    q = (stream_df.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(stream_df: DataFrame, name: str, base: str | None = None, compact_every: int = 16,
                keys: list[str] = CELL) -> str:
    """Run a streaming aggregate over what is available; each micro-batch
    writes the rows that changed to ``<table>/batch=<id>``, and every
    ``compact_every``-th one is followed by :func:`compact`.  ``keys`` are
    the aggregate's keys.  Resumes where the run of the same name stopped.
    Returns the table path."""
    spark = stream_df.sparkSession
    out, ckpt = _paths(spark, name, base)

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))
        if (batch_id + 1) % compact_every == 0:
            compact(spark, out, keys)

    _run(stream_df, "update", write, ckpt)
    return out
