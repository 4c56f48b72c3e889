import pytest

import __spark_entry__ as E


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 30


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 5
    assert {"chunk_id", "score", "document", "rank"} <= set(df.columns)
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))


def test_operators_are_optional(tmp_path, monkeypatch):
    """A module that isn't there is left out; one that fails inside is not."""
    import __spark_entry__ as entry

    (tmp_path / "broken_operator.py").write_text("import a_module_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._optional("no_such_package.queries") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_operator")
