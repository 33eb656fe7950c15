"""Many key checks over one reading, against the single reports."""

import random

import pytest

from gridsurvey.operators import quality


def parts(df):
    return {r[0]: (r[1], r[2]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_single_reports(spark, seed):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    rows = [(i if rng.random() < 0.9 else i - 1, pick("a", "b", "c", "d", None), pick(1, 2, 3, None), pick(True, False)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, l string, r int, flag boolean")
    other = spark.createDataFrame([(pick("a", "e", None), i % 4) for i in range(5)], "l string, r int")
    got = parts(quality.key_reports(
        df, {"id": ["id"], "whole": ["id", "l", "r"], "flag": ["flag"]}, [("l", "r"), ("id", "l")], {"other": (other, ["l"]), "pairs": (other, ["l", "r"])}))
    want = {}
    for name, keys in (("id", ["id"]), ("whole", ["id", "l", "r"]), ("flag", ["flag"])):
        want |= parts(quality.unique_report(df, keys, name))
    want |= parts(quality.one_to_one_report(df, "l", "r")) | parts(quality.one_to_one_report(df, "id", "l"))
    for name, keys in (("other", ["l"]), ("pairs", ["l", "r"])):
        sides = list(parts(quality.coverage_report(df, other, keys)).values())
        want |= {f"all in {name}": sides[0], f"all of {name}": sides[1]}
    assert got == want


def test_empty_tables_pass_and_nothing_is_refused(spark):
    df = spark.createDataFrame([], "id int, l string")
    got = parts(quality.key_reports(df, {"id": ["id"]}, [("id", "l")], {"same": (df, ["l"])}))
    assert set(got.values()) == {(0, True)} and len(got) == 5
    with pytest.raises(ValueError):
        quality.key_reports(df)


def test_one_scan_and_one_exchange_by_key(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    report = quality.key_reports(
        orders, {"order": ["o_orderkey"], "customer and day": ["o_custkey", "o_orderdate"]},
        [("o_orderkey", "o_custkey"), ("o_clerk", "o_orderpriority")] if "o_clerk" in orders.columns else [("o_orderkey", "o_custkey")])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    report.collect()


def test_partners_of_texts_need_no_sort(spark):
    """Texts as partners leave the grouping sets to a hash aggregate, and texts, bytes and missing ones stay told apart."""
    rows = [(1, "a", b"x"), (1, "a", b"y"), (2, "b", None), (2, "b", b"z"), (3, "c", b"q"), (3, "d", b"q"), (4, None, b"r"), (4, None, b"r")]
    df = spark.createDataFrame(rows, "id int, l string, r binary")
    report = quality.key_reports(df, {"id": ["id"]}, [("id", "l"), ("id", "r")])
    assert "SortAggregate" not in report._jdf.queryExecution().executedPlan().toString()
    want = parts(quality.one_to_one_report(df, "id", "l")) | parts(quality.one_to_one_report(df, "id", "r"))
    got = parts(report)
    assert {name: got[name] for name in want} == want and got["id -> l"] == (1, False) and got["id -> r"] == (2, False)
