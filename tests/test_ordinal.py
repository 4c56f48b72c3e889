"""ordinal_within (bounded-slice row numbers) against plain Python ranks."""
from hypothesis import given, settings
from hypothesis import strategies as st

from logevidence.operators.ordinal import ordinal_within


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(0, 10_000)),
                min_size=1, max_size=120, unique_by=lambda t: t), st.integers(1, 50))
def test_ordinal_matches_python_ranks(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, o long")
    got = {(r["k"], r["o"]): (r["pos"], r["n"]) for r in ordinal_within(df, ["k"], "o", width=width, total="n").collect()}
    for k in {k for k, _ in rows}:
        ordered = sorted(o for kk, o in rows if kk == k)
        for i, o in enumerate(ordered):
            assert got[(k, o)] == (i, len(ordered))
