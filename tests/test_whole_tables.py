"""Queries without a selecting predicate answer for every row of their table."""

import pyarrow.parquet as pq
import pytest

from lathe.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()
WHOLE = {f"quantified_{a}_{b}": "part" for a in ("gt", "ge", "lt", "le", "eq", "ne") for b in ("all", "any")}
WHOLE |= dict.fromkeys("projection_expressions arith_division arith_div_mod pred_null case_simple cast_values date_interval fn_null fn_format fn_to_char".split(), "orders")
WHOLE |= {"concat_operator": "customer", "subquery_scalar": "customer", "fn_numeric": "lineitem"}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_every_row(spark, name):
    assert QUERIES[name](spark, DATA).count() == pq.read_metadata(f"{DATA}/{WHOLE[name]}.parquet").num_rows
