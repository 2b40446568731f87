import __spark_entry__ as entry


def test_one_query_per_operator_and_the_pipeline():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
