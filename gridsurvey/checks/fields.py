"""Scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import numbers, times
from ..functions import text as texts
from .registry import query, r6


@query(
    "fn_string",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squished, contains(text, 'data') AS has_word,
  md5(regexp_replace(text, '[0-9]+', '')) AS without_number, nullif(regexp_extract(text, '[A-Z][a-z]+', 0), '') AS first_name,
  source || '/' || lang AS place, 'https://blocks.example/' || doc_id::VARCHAR AS link,
  doc_id::VARCHAR || ' has ' || n_chars::VARCHAR || ' characters' AS message,
  TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '-?([0-9]+\.?[0-9]*|\.[0-9]+)', 0), '') AS DOUBLE) AS first_number
FROM documents""",
)
def fn_string(spark, sf):
    c = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(texts.squish(c)).alias("squished"),
        c.contains("data").alias("has_word"),
        F.md5(F.regexp_replace(c, r"(?s)^(.*?)[0-9]+", "$1")).alias("without_number"),
        F.nullif(F.regexp_extract(c, "[A-Z][a-z]+", 0), F.lit("")).alias("first_name"),
        F.concat("source", F.lit("/"), "lang").alias("place"),
        texts.block_link(F.col("doc_id").cast("string"), "https://blocks.example/").alias("link"),
        F.format_string("%d has %d characters", "doc_id", "n_chars").alias("message"),
        texts.parse_number(c).alias("first_number"),
    )


@query(
    "fn_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%b') AS month_label, year(o_orderdate)::BIGINT AS obs_year,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS obs_ym, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
  strftime(o_orderdate + to_minutes((o_orderkey % 1440)::INTEGER), '%H:%M:%S') AS clock,
  strftime(strptime('1996-' || strftime(o_orderdate, '%-d-%b'), '%Y-%-d-%b'), '%Y-%m-%d') AS that_day_1996,
  strftime(o_orderdate - INTERVAL 40 MINUTE, '%Y-%m-%d %H:%M:%S') AS earlier
FROM orders""",
)
def fn_date(spark, sf):
    day = F.to_date("o_orderdate")
    late = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        times.month_label(day).alias("month_label"),
        F.year(day).cast("bigint").alias("obs_year"),
        times.year_month(day).cast("string").alias("obs_ym"),
        times.release_month_end(F.date_format(day, "MMM-yyyy")).cast("string").alias("month_end"),
        times.clock_text(late).alias("clock"),
        times.day_month_of_year(F.date_format(day, "d-MMM"), 1996).cast("string").alias("that_day_1996"),
        F.date_format(F.col("o_orderdate") - F.expr("INTERVAL 40 MINUTES"), "yyyy-MM-dd HH:mm:ss").alias("earlier"),
    )


@query(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 2) AS two_decimals,
  round_even(l_quantity / 2, 0) AS half_even, round(exp(l_discount), 6) AS e, round(ln(l_quantity), 6) AS l,
  abs(l_discount - l_tax) > 0 AS differ, l_partkey // 1000 AS chunk,
  CASE WHEN l_linenumber % 3 <> 0 THEN round(l_quantity / (l_linenumber % 3), 6) ELSE NULL END AS share,
  l_linenumber % 3 = 0 AS by_zero
FROM lineitem""",
)
def fn_math(spark, sf):
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    share = numbers.ratio(q, line % 3)
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.col("l_extendedprice") / 7, 2).alias("two_decimals"),
        F.bround(q / 2).alias("half_even"),
        r6(F.exp("l_discount")).alias("e"),
        r6(F.ln("l_quantity")).alias("l"),
        (F.abs(F.col("l_discount") - F.col("l_tax")) > 0).alias("differ"),
        F.expr("l_partkey div 1000").alias("chunk"),
        F.when(share < float("inf"), r6(share)).alias("share"),
        (share == float("inf")).alias("by_zero"),
    )


@query(
    "fn_null",
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(q, p) AS first_known, coalesce(q, 0) AS filled, q IS NULL AS missing
FROM (SELECT *, CASE WHEN l_quantity <= 45 THEN l_quantity END AS q, CASE WHEN l_tax > 0.02 THEN l_tax END AS p FROM lineitem)
WHERE p IS NOT NULL""",
)
def fn_null(spark, sf):
    df = fx.table(spark, sf, "lineitem").withColumns(
        {"q": F.when(F.col("l_quantity") <= 45, F.col("l_quantity")), "p": F.when(F.col("l_tax") > 0.02, F.col("l_tax"))}
    )
    df = df.dropna(subset=["p"]).withColumns({"first_known": F.coalesce("q", "p"), "missing": F.isnull("q"), "filled": F.col("q")})
    return df.fillna({"filled": 0.0}).select("l_orderkey", "l_linenumber", "l_partkey", "first_known", "filled", "missing")


@query(
    "fn_conditional",
    """SELECT event_type, CASE WHEN value BETWEEN 10 AND 100 THEN 'inside' WHEN NOT (value BETWEEN 10 AND 100) THEN 'outside'
  ELSE 'unknown' END AS range, CASE WHEN event_type IN ('click','view') THEN 'light' ELSE 'heavy' END AS weight, count(*) AS n
FROM events GROUP BY ALL""",
)
def fn_conditional(spark, sf):
    inside = F.col("value").between(10, 100)
    return (
        fx.table(spark, sf, "events")
        .select(
            "event_type",
            F.when(inside, "inside").when(~inside, "outside").otherwise("unknown").alias("range"),
            F.when(F.col("event_type").isin("click", "view"), "light").otherwise("heavy").alias("weight"),
        )
        .groupBy("event_type", "range", "weight")
        .agg(F.count("*").alias("n"))
    )


@query(
    "fn_row",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(q, 0) + coalesce(p, 0) + l_discount, 6) AS row_total,
  (q > 5 AND p > 0.03 AND l_discount >= 0) AS all_hold
FROM (SELECT *, CASE WHEN l_quantity <= 45 THEN l_quantity END AS q, CASE WHEN l_tax > 0.02 THEN l_tax END AS p FROM lineitem)""",
)
def fn_row(spark, sf):
    df = fx.table(spark, sf, "lineitem").withColumns(
        {"q": F.when(F.col("l_quantity") <= 45, F.col("l_quantity")), "p": F.when(F.col("l_tax") > 0.02, F.col("l_tax"))}
    )
    total = numbers.row_sum(F.col("q"), F.col("p"), F.col("l_discount"))
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        r6(total).alias("row_total"),
        numbers.all_true(F.col("q") > 5, F.col("p") > 0.03, F.col("l_discount") >= 0).alias("all_hold"),
    )


@query(
    "fn_array",
    """SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_quantity::BIGINT::VARCHAR, ',' ORDER BY l_linenumber DESC, l_quantity DESC) AS by_line,
  count(*) FILTER (WHERE l_quantity > 25) AS large, max(l_quantity)::BIGINT AS most, sum(l_quantity)::BIGINT AS total
FROM lineitem GROUP BY 1""",
)
def fn_array(spark, sf):
    """Rows of an order nested, ordered, transformed, filtered and folded."""
    row = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("bigint").alias("quantity"))
    nested = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("rows"))
    ordered = F.sort_array("rows", asc=False)
    quantities = F.transform("rows", lambda r: r.quantity)
    return nested.select(
        "l_orderkey",
        F.array_join(F.transform(ordered, lambda r: F.concat_ws(":", r.line.cast("string"), r.quantity.cast("string"))), ",").alias("by_line"),
        F.size(F.filter("rows", lambda r: r.quantity > 25)).cast("bigint").alias("large"),
        F.array_max(quantities).alias("most"),
        F.aggregate(quantities, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"),
    )
