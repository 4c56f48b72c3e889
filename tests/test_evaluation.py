from logevidence.operators.evaluation import phenomenon_counts, precision_at_k

GRID = {"Q01": "PRR", "Q02": "PPR", "Q03": "RRR", "Q04": "NNN", "Q05": "PPP", "Q06": "NNN", "Q07": "NNN",
        "Q08": "RPR", "Q09": "PNN", "Q10": "PPP", "Q11": "NNN", "Q12": "PPN"}


def test_precision_golden(spark):
    w = {"R": 1.0, "P": 0.5, "N": 0.0}
    rows = [(q, i + 1, lab, w[lab]) for q, labs in GRID.items() for i, lab in enumerate(labs)]
    df = spark.createDataFrame(rows, "query_id string, rank int, label string, weight double")
    r = precision_at_k(df, 3).first()
    assert r["n_queries"] == 12
    assert r["p1_strict"] == round(2 / 12, 4) and r["p1_r_or_p"] == round(8 / 12, 4)
    assert r["p1_weighted"] == round(5 / 12, 4) and r["p3_weighted"] == round(14.5 / 36, 4)
    assert r["success3"] == round(8 / 12, 4)


def test_phenomena(spark):
    rows = [(404, "GET", "/a", "be/s"), (503, "OPTIONS", "/api/x", "be/<NOSRV>"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "status_code int, method string, path string, backend string")
    got = {r["phenomenon"]: r["n_events"] for r in phenomenon_counts(
        df, [("n404", "status_code = 404"), ("nosrv", "backend LIKE '%<NOSRV>%' AND status_code >= 500"),
             ("api", "path LIKE '/api%'")]).collect()}
    assert got == {"all_events": 3, "n404": 1, "nosrv": 1, "api": 1}
