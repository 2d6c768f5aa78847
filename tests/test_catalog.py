"""Every query of the engine against its SQL on the smallest tables, and the contract's shape."""

import pytest

from maskwright.plans import catalog

from .conftest import SMALL

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: What queries without SQL must hold; their detectors are tested on cases in test_detect, and by identifier_spans against SQL.
CHECKED = {"rule_class_counts": lambda got: set(got["cls"]) <= set("PTEDAIC") and (got["findings"] > 0).all()}


def canonical(df):
    df = df[sorted(df.columns)]
    text = lambda x: "" if x is None or str(x) in ("nan", "<NA>", "NaT", "None") else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert name in CHECKED, f"{name} has neither SQL nor a check"
        assert CHECKED[name](got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
