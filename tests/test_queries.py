import pytest

import __spark_entry__ as entry
from millrace.plans import registry

from .conftest import SF


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(name, spark, same):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


def test_entry_runs(spark):
    assert entry.entry(spark).columns
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_multi_cap_is_the_greedy_pass(spark):
    rows = registry.read(spark, SF, "orders").select("o_custkey", "o_orderpriority", "o_orderkey").collect()
    import hashlib

    rows = sorted((hashlib.md5(f"caps|{r.o_orderkey}".encode()).hexdigest(), r.o_orderkey, r.o_custkey, r.o_orderpriority) for r in rows)
    used, want = {}, set()
    for _, key, cust, prio in rows:
        if used.get(cust, 0) < 3 and used.get(prio, 0) < 200:
            want.add(key)
            used[cust], used[prio] = used.get(cust, 0) + 1, used.get(prio, 0) + 1
    assert {r.o_orderkey for r in registry.multi_cap(spark, SF).collect()} == want


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=entry.__file__.rsplit("/", 1)[0])
