"""Queries on clients whose numbers have more than five digits, and on clients whose first-choice codes are the same."""

import duckdb
import pytest

from maskwright.plans import catalog
from maskwright.plans.cards import code_sql

from .test_catalog import canonical

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: The telephones of 682202 and 767951 have one first-choice code, and so have 'сидоров 9767' and 'сидоров 105317' as persons.
WIDE, SHARED = (7, 9767, 123456, 899999), (7, 9767, 105317, 682202, 767951)
SECOND = " || '#1'"
CASES = [
    ("card_tokenize", WIDE),
    ("card_spans", WIDE),
    ("protect_cards", WIDE),
    ("protect_keyed", WIDE),
    ("protect_counts", WIDE),
    ("protect_registry", WIDE),
    ("registry_upsert", SHARED),
    ("health", SHARED),
    ("restore_allowed_only", SHARED),
    ("restored_response", SHARED),
    ("restored_arguments", SHARED),
]


@pytest.mark.parametrize("name,keys", CASES)
def test_query(spark, tmp_path, name, keys):
    con = duckdb.connect()
    con.execute(f"create table customer as select unnest({list(keys)})::bigint as c_custkey, 'c' as c_name, 3 as c_nationkey, 1500.5 as c_acctbal, 'BUILDING' as c_mktsegment")
    con.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    want = con.execute(SQL[name]).df()
    assert canonical(QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(want)


@pytest.mark.parametrize("name", ["dry_run", "protect_cards", "protect_keyed", "protect_registry", "protect_counts"])
def test_no_two_telephones_get_one_code(spark, tmp_path, name):
    """The SQL knows no collisions. Of two telephones with one first-choice code the later one gets its next candidate, or neither could be restored; all else is as in SQL."""
    con = duckdb.connect()
    con.execute(f"create table customer as select unnest({list(SHARED)})::bigint as c_custkey, 'c' as c_name, 3 as c_nationkey, 1500.5 as c_acctbal, 'BUILDING' as c_mktsegment")
    con.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    first, after = con.execute(f"select {code_sql('T', 'p')}, {code_sql('T', 'p', SECOND)} from (select '79000767951' as p)").fetchone()
    want = con.execute(SQL[name]).df()
    if name == "protect_counts":
        want.loc[want["cls"] == "T", "moved"] = 1
    else:
        key, column = {"dry_run": ("req_id", "body"), "protect_registry": ("identity", "token")}.get(name, ("doc_id", "masked"))
        later = want[key].astype(str).isin(["767951", "79000767951"]) & want[column].str.contains(first)
        assert later.sum() == 1 and want[column].str.contains(first).sum() == 2
        want.loc[later, column] = want.loc[later, column].str.replace(first, after)
    assert canonical(QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(want)
