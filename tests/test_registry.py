"""Every query of the library against its SQL on the smallest tables."""

import pytest

from barsmith.plans import registry


def text(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    rows = sorted(tuple(text(r[c]) for c in cols) for r in got.collect())
    if name in registry.ORACLE_SQL:
        want = duck.sql(f"select {', '.join(cols)} from ({registry.ORACLE_SQL[name]})").fetchall()
        assert rows == sorted(tuple(map(text, r)) for r in want)
    else:
        assert rows


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
