"""Frames that several test files build."""


def lines_df(spark, rows, name="x.log"):
    """rows: list of raw strings -> lines frame numbered from 1."""
    data = [(f"mem://{name}", name, i + 1, r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "source_path string, source_file string, line_number long, raw string")
