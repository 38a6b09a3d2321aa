"""One query for each factor, and the whole library in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.duck_backend import select
from ..plans.factors import FACTORS, REPORTS, fields_of, needs_group
from ..plans.nodes import Node
from ..plans.spark_backend import evaluate
from ..sources.panel import dense_panel, panel_sql
from ..sources.reports import report_panel, report_sql

KEYS = ["ts_code", "trade_date"]


def rounded(df: DataFrame, keys: list[str], signals: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *((F.round(s, digits) + 0.0).alias(s) for s in signals))


def panel_query(signals: dict[str, Node], digits: int = 6, placed: bool = False):
    fields = sorted({f for n in signals.values() for f in fields_of(n)})
    group = any(needs_group(n) for n in signals.values())

    def query(spark: SparkSession, d: str) -> DataFrame:
        return rounded(evaluate(dense_panel(spark, d, fields, group, placed), signals, placed=placed), KEYS, list(signals), digits)

    return query, panel_sql(fields, group) + select("panel", signals, KEYS, digits=digits)


def report_query(signals: dict[str, Node]):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = evaluate(report_panel(spark, d), signals, instrument="supplier", order="idx", session="idx", group=None)
        return rounded(df, ["supplier", "idx"], list(signals))

    return query, report_sql() + select("reports", signals, ["supplier", "idx"], instrument="supplier", order="idx", session="idx")


QUERIES, SQL = {}, {}
for _name, (_, _node) in FACTORS.items():
    QUERIES[f"fac_{_name}"], SQL[f"fac_{_name}"] = panel_query({"value": _node})
for _name, (_, _node) in REPORTS.items():
    QUERIES[f"fac_{_name}"], SQL[f"fac_{_name}"] = report_query({"value": _node})

#: All price and volume factors as columns of one frame: windows and shuffles are shared.
BATCH = {name: node for name, (_, node) in FACTORS.items()}


QUERIES["fac_batch"], SQL["fac_batch"] = panel_query(BATCH, 7, placed=True)
