"""Quarterly reports of suppliers, made from their line items: the shape of a statement channel where there is none.

revenue is net sales, gross and profit what is left after fixed shares of the list price, assets and the like follow from
quantities; announcement is thirty days after the quarter's end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: column -> the same expression for either engine
MEASURES = {
    "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 6)",
    "profit": "round(sum(l_extendedprice * (0.3 - 2 * l_discount - l_tax)), 6)",
    "assets": "round(sum(l_quantity) * 2000, 6)",
    "equity": "round(sum(l_quantity) * 800 + 1000, 6)",
    "cash_flow": "round(sum(l_extendedprice * (0.25 - 3 * l_tax)), 6)",
    "debt": "round(sum(l_quantity * (1 + l_tax)) * 500, 6)",
    "shares": "cast(count(*) * 100 as double)",
    "price": "round(avg(l_extendedprice / l_quantity), 4)",
    "gross": "round(sum(l_extendedprice * (0.4 - l_discount)), 6)",
    "current": "round(sum(l_quantity) / count(*), 6)",
}


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """(supplier, idx: quarters since year 0, measures), quarters with rows only."""
    q = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), q.alias("idx")).agg(*(F.expr(e).alias(m) for m, e in MEASURES.items()))


def report_panel(spark: SparkSession, d: str) -> DataFrame:
    """Dense in quarters from a supplier's first to its last."""
    own = quarterly(spark, d)
    spans = own.groupBy("supplier").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    grid = spans.select("supplier", F.explode(F.sequence("a", "b")).alias("idx"))
    return grid.join(own, ["supplier", "idx"], "left")


def report_sql() -> str:
    cols = ", ".join(f"{e} as {m}" for m, e in MEASURES.items())
    return f"""with own as (select l_suppkey as supplier, cast(year(l_shipdate) * 4 + quarter(l_shipdate) as int) as idx, {cols} from lineitem group by all),
spans as (select supplier, min(idx) as a, max(idx) as b from own group by 1),
grid as (select supplier, cast(unnest(range(a, b + 1)) as int) as idx from spans),
reports as (select * from grid left join own using (supplier, idx))"""
