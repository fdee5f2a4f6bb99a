"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

from helpers import ROOT, SF001

sys.path.insert(0, os.path.join(ROOT, "tools"))


def test_all_queries_match_duckdb(spark):
    from check_oracles import compare

    results = list(compare(spark, SF001))
    bad = [r for r in results if r[1] not in ("OK", "ROWS-ONLY")]
    assert not bad, bad
    import __spark_entry__ as E

    assert {r[0] for r in results if r[1] == "ROWS-ONLY"} == set(E.queries()) - set(E.oracle_sql())
