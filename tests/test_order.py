"""Sorted queries: the rows come in the order that SQL gives."""

import pytest

from check_oracle import connect, norm
from gridsurvey.checks import QUERIES, SQL

ORDERS = {
    "sort_multi": "pba3_block NULLS LAST, breeding_rank DESC NULLS LAST, common_name, checklist_id",
    "agg_count": "breeding_category NULLS FIRST, protocol_name NULLS FIRST",
    "win_add_count": "n DESC, checklist_id",
    "limit_head": "n DESC, checklist_id",
    "cal_safe_dates": "date_probable_start NULLS LAST, common_name",
    "progress_table": "block_region NULLS LAST, block_county NULLS LAST, block_name NULLS LAST",
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, small, name):
    keys = [k.split()[0] for k in ORDERS[name].split(", ")]
    result = connect(small).execute(f"SELECT {', '.join(keys)} FROM ({SQL[name]}) ORDER BY {ORDERS[name]}").fetchall()
    got = QUERIES[name](spark, small).collect()
    assert [tuple(norm(r[k]) for k in keys) for r in got] == [tuple(map(norm, r)) for r in result]
    assert len(got) > 1
