"""Small matrices that several test modules share."""

# golden 4 x 3 example (FIXTURES.md §3)
A_ROWS = [(1, 2, 0), (0, 1, 3), (2, 0, 1), (1, 1, 1)]
B_ROWS = [(2, 0, 1), (1, 1, 0), (0, 3, 1), (1, 0, 2)]


def dense_cells(spark, a_rows=A_ROWS, b_rows=B_ROWS, keep_zeros=False):
    data = []
    for mat, rows in (("A", a_rows), ("B", b_rows)):
        for r, vals in enumerate(rows):
            for c, v in enumerate(vals):
                if v != 0 or keep_zeros:
                    data.append((mat, r, c, float(v)))
    return spark.createDataFrame(data, "mat string, row bigint, col bigint, val double")
