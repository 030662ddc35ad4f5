"""Streams: final state equals the batch answer, even when a cell arrives in parts."""

import math
import os
import tempfile

from pyspark.sql import functions as F

from rankfold.operators import norms as N
from rankfold.operators import sketch as K
from rankfold.streaming.sketch_stream import CELL, SKETCH, compact, files_in_use, norms_of, read_table_stream, run_updates, sketch_of, stream_cells, stream_sketch


def _write_parts(spark, folder):
    # the same cells split over three files; cell (A, 0, 1) arrives in two parts
    parts = [
        [("A", 0, 1, 1.5), ("B", 0, 2, 2.0), ("A", 3, 1, -1.0)],
        [("A", 0, 1, 2.5), ("B", 5, 2, 1.0)],
        [("B", 0, 2, 0.5), ("A", 7, 4, 3.0)],
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "mat string, row bigint, col bigint, val double") \
            .write.parquet(os.path.join(folder, f"part{k}"))
    flat = [r for p in parts for r in p]
    return spark.createDataFrame(flat, "mat string, row bigint, col bigint, val double")


def test_stream_norms_and_sketch_equal_batch(spark):
    folder = tempfile.mkdtemp(prefix="rankfold-stream-")
    allrows = _write_parts(spark, folder)
    schema = allrows.schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "part*"))
    batch_cells = allrows.groupBy("mat", "row", "col").agg(F.sum("val").alias("val"))

    got = {(r["mat"], r["col"]): r["norm2"] for r in norms_of(spark, run_updates(stream_cells(src), "n", folder + "-out")).collect()}
    want = {(r["mat"], r["col"]): r["norm2"] for r in N.col_norms2(batch_cells).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)

    coords = K.pick_coords(1, 8, 4)
    src2 = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "part*"))
    table = run_updates(stream_sketch(src2, coords, 1, 8), "s", folder + "-out", keys=SKETCH)
    gs = {(r["mat"], r["col"], r["t"]): r["s"] for r in sketch_of(spark, table, 4).collect()}
    ws = {(r["mat"], r["col"], r["t"]): r["s"] for r in K.srht_sketch_cells(batch_cells, coords, 1).collect()}
    assert gs.keys() == ws.keys()
    assert all(math.isclose(gs[k], ws[k], abs_tol=1e-12) for k in ws)


def test_events_stream_reader(spark):
    df = read_table_stream(spark, "/root/testdata/sf0.001", "events")
    assert df.isStreaming



def test_table_in_a_folder_of_files_and_resuming(spark):
    """A folder table is streamed whole over several triggers, and a second
    run of the same name goes on where the first stopped."""
    folder = tempfile.mkdtemp(prefix="rankfold-stream-")
    rows = [("A", r, c, float(r + c)) for r in range(6) for c in range(4)] * 2
    schema = "mat string, row bigint, col bigint, val double"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{folder}/cells.parquet")

    def run():
        return norms_of(spark, run_updates(stream_cells(read_table_stream(spark, folder, "cells", 2)), "norms", folder + "-out"))

    def batch():
        cells = spark.read.parquet(f"{folder}/cells.parquet").groupBy("mat", "row", "col").agg(F.sum("val").alias("val"))
        return {(r["mat"], r["col"]): r["norm2"] for r in N.col_norms2(cells).collect()}

    assert {(r["mat"], r["col"]): r["norm2"] for r in run().collect()} == batch()
    spark.createDataFrame([("A", 0, 1, 5.0), ("B", 2, 2, 1.0)], schema).write.mode("append").parquet(f"{folder}/cells.parquet")
    assert {(r["mat"], r["col"]): r["norm2"] for r in run().collect()} == batch()


def test_watermark_frees_state_and_keeps_closed_hours(spark):
    folder = tempfile.mkdtemp(prefix="rankfold-stream-")
    schema = "mat string, row bigint, col bigint, val double, ts timestamp"
    for k in range(4):
        spark.sql(f"SELECT 'A' AS mat, {k}L AS row, 1L AS col, {k + 1}D AS val, timestamp'2024-01-01 0{2 * k}:30:00' AS ts") \
            .coalesce(1).write.parquet(f"{folder}/p{k}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p*")
    got = norms_of(spark, run_updates(stream_cells(src, "1 hour"), "wm", folder + "-out")).collect()
    assert [(r["col"], r["norm2"]) for r in got] == [(1, 30.0)]


def test_row_ids_outside_the_row_space_are_errors(spark):
    import pytest
    bad = spark.createDataFrame([("A", 8, 1, 1.0)], "mat string, row bigint, col bigint, val double")
    with pytest.raises(Exception, match="row id outside"):
        K.srht_sketch_cells(bad, K.pick_coords(1, 8, 4), 1, n=8).collect()


def test_repeated_deliveries_count_once(spark):
    """A stream in which events are sent again equals the batch answer over distinct events."""
    import pytest
    folder = tempfile.mkdtemp(prefix="rankfold-stream-")
    schema = "id bigint, mat string, row bigint, col bigint, val double, ts timestamp"
    sent = [[(1, 0, 10), (2, 0, 20), (1, 0, 10)], [(2, 0, 20), (3, 0, 5), (4, 1, 70)], [(3, 0, 5), (4, 1, 70), (5, 1, 80)]]
    for k, rows in enumerate(sent):
        spark.createDataFrame([(i, "A", h, 1, float(i)) for i, h, _ in rows], "id bigint, mat string, row bigint, col bigint, val double") \
            .join(spark.createDataFrame(list({(i, m) for i, _, m in rows}), "id bigint, m int"), "id") \
            .withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)")).drop("m") \
            .coalesce(1).write.parquet(f"{folder}/p{k}")
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p*")
    got = norms_of(spark, run_updates(stream_cells(src(), "3 hours", delivery=["id", "mat", "row", "col"]), "once", folder + "-out")).collect()
    assert [(r["mat"], r["col"], r["norm2"]) for r in got] == [("A", 1, (1 + 2 + 3) ** 2 + (4 + 5.0) ** 2)]
    with pytest.raises(ValueError, match="watermark"):
        stream_cells(src(), delivery=["id"])


def test_compaction_bounds_the_files_read(spark):
    folder = tempfile.mkdtemp(prefix="rankfold-stream-")
    schema = "mat string, row bigint, col bigint, val double"
    for k in range(11):
        spark.createDataFrame([("A", 0, 1, 1.0), ("B", k, 2, 2.0)], schema).coalesce(1).write.parquet(f"{folder}/p{k:02d}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p*")
    path = run_updates(stream_cells(src), "c", folder + "-out", compact_every=4)
    base, batches = files_in_use(spark, path)
    assert base.endswith("through=7") and sorted(batches) == [8, 9, 10]
    assert sorted(os.listdir(path + "-base")) == ["through=3", "through=7"]
    assert sorted(int(f.split("=")[1]) for f in os.listdir(path)) == [4, 5, 6, 7, 8, 9, 10]
    want = [("A", 1, 121.0), ("B", 2, 44.0)]
    norms = lambda: sorted((r["mat"], r["col"], r["norm2"]) for r in norms_of(spark, path).collect())
    assert norms() == want
    # a base whose writing was killed is not read, and is written again
    os.makedirs(path + "-base/through=10")
    assert files_in_use(spark, path)[0].endswith("through=7") and norms() == want
    compact(spark, path, CELL)
    assert files_in_use(spark, path)[0].endswith("through=10") and files_in_use(spark, path)[1] == {} and norms() == want
    # a batch below the base that is repeated after a stop changes nothing
    spark.createDataFrame([("A", 0, 1, 2.0)], schema).write.mode("overwrite").parquet(f"{path}/batch=1")
    assert norms() == want


def test_sketch_resumes_and_writes_touched_columns_only(spark):
    """37 coordinates (three slices): a second run goes on from the first's sums and writes the one column it touched."""
    folder = tempfile.mkdtemp(prefix="rankfold-stream-")
    schema = "mat string, row bigint, col bigint, val double"
    spark.createDataFrame([(m, r, c, float(r - c)) for m in "AB" for r in range(64) for c in range(5)], schema) \
        .coalesce(1).write.parquet(f"{folder}/cells.parquet")
    coords = K.pick_coords(3, 64, 37)

    def run(every):
        src = read_table_stream(spark, folder, "cells")
        return run_updates(stream_sketch(src, coords, 3, 64), "s", folder + "-out", every, SKETCH)

    def batch():
        cells = spark.read.parquet(f"{folder}/cells.parquet").groupBy("mat", "row", "col").agg(F.sum("val").alias("val"))
        return {(r["mat"], r["col"], r["t"]): r["s"] for r in K.srht_sketch_cells(cells, coords, 3).collect()}

    def same(table):
        got, want = {(r["mat"], r["col"], r["t"]): r["s"] for r in sketch_of(spark, table, 37).collect()}, batch()
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)

    same(run(16))
    spark.createDataFrame([("B", 9, 2, 4.0), ("B", 10, 2, 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/cells.parquet")
    table = run(16)
    same(table)
    assert [spark.read.parquet(f"{table}/batch={k}").count() for k in (0, 1)] == [10 * 3, 3]
    spark.createDataFrame([("A", 1, 7, 4.0)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/cells.parquet")
    same(run(3))
    assert files_in_use(spark, table)[1] == {}
