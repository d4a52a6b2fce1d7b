import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {"evaluate_full", "client_signal", "similarity_components"} <= set(oracles)
