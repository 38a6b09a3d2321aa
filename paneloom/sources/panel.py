"""Dense (instrument, session) panels of the daily tables.

Dense means: from an instrument's first session to its last one, every open session has a row, so that "k rows ago" is "k
sessions ago". Grid rows and facts meet in the aggregate that also settles repeated rows: one shuffle for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, instrument_code
from .tables import table

DAILY = {"open": "open", "high": "high", "low": "low", "close": "close", "pre_close": "pre_close", "volume": "vol", "amount": "amount"}
BASIC = {"turnover": "turnover_rate", "pe_ttm": "pe_ttm", "pb": "pb", "market_cap": "total_mv", "circ_mv": "circ_mv"}
FACTOR = {"adj": "adj_factor"}
LIMIT = {"up_limit": "up_limit", "down_limit": "down_limit"}


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """(trade_date, idx): the open days, numbered; at most the days of a calendar, hence one window."""
    cal = table(spark, d, "trade_cal").filter("is_open = 1")
    return cal.select(F.col("cal_date").alias("trade_date"), F.row_number().over(Window.orderBy("cal_date")).alias("idx"))


def dense_panel(spark: SparkSession, d: str, fields: list[str] | None = None, industry: bool = False, placed: bool = False) -> DataFrame:
    """ts_code, trade_date, idx and the wanted fields (all of DAILY unless given), NaN as null, absent sessions null.

    Of repeated daily rows the one ingested last counts; rows of other tables that repeat are equal. Rows on days that are
    no session are left out. Only the tables that hold a wanted field are read. ``placed``: the one shuffle is by instrument,
    into spark.sql.shuffle.partitions parts, so that what goes by instrument needs no other.
    """
    fields = list(DAILY) if fields is None else fields
    days = sessions(spark, d)
    parts = []
    for name, columns in (("daily", DAILY), ("daily_basic", BASIC), ("adj_factor", FACTOR), ("stk_limit", LIMIT)):
        wanted = {f: c for f, c in columns.items() if f in fields}
        if not wanted and name != "daily":
            continue
        raw = table(spark, d, name)
        at = F.coalesce("ingested_at", F.lit("0001-01-02").cast("timestamp")) if name == "daily" else F.lit(None).cast("timestamp")
        rows = raw.select(instrument_code("ts_code").alias("ts_code"), F.translate(F.trim("trade_date"), "-", "").alias("trade_date"), at.alias("_at"), *(finite(c).alias(f) for f, c in wanted.items()))
        rows = rows.join(days, "trade_date").drop("trade_date")
        if name == "daily":
            spans = rows.groupBy("ts_code").agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"))
            parts.append(spans.select("ts_code", F.explode(F.sequence("_a", "_b")).alias("idx"), F.lit(1).alias("_in")))
        parts.append(rows)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    if placed:
        both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ts_code")
    # only daily rows have a time, so that max_by sees no others
    aggs = [F.max_by(f, "_at").alias(f) if f in DAILY else F.max(f).alias(f) for f in fields]
    panel = both.groupBy("ts_code", "idx").agg(F.max("_in").alias("_in"), *aggs).filter("_in = 1").drop("_in").join(days, "idx")
    if industry:
        static = table(spark, d, "stock_basic").select(instrument_code("ts_code").alias("ts_code"), "industry", "exchange")
        panel = panel.join(static, "ts_code", "left")
    return panel


def panel_sql(fields: list[str] | None = None, industry: bool = False) -> str:
    """The same panel in DuckDB's SQL: ``with ... panel as (...)``."""
    fields = list(DAILY) if fields is None else fields
    code = "replace(replace(replace(upper(regexp_replace(ts_code, '\\s', '', 'g')), '.XSHG', '.SH'), '.XSHE', '.SZ'), '.BJSE', '.BJ')"
    fin = lambda c: f"case when isfinite({c}) then {c} end"
    d = [f for f in fields if f in DAILY]
    pick = "".join(f", max_by(struct_pack(v := {fin(DAILY[f])}), ingested_at).v as {f}" for f in d)
    sql = f"""with cal as (select cal_date as trade_date, cast(row_number() over (order by cal_date) as int) as idx from trade_cal where is_open = 1),
rows_ as (select {code} as ts_code, idx{pick} from daily join cal using (trade_date) group by all),
spans as (select ts_code, min(idx) as a, max(idx) as b from rows_ group by 1),
grid as (select ts_code, cast(unnest(range(a, b + 1)) as int) as idx from spans)"""
    joins = " left join rows_ using (ts_code, idx)"
    for name, columns in (("daily_basic", BASIC), ("adj_factor", FACTOR), ("stk_limit", LIMIT)):
        wanted = {f: c for f, c in columns.items() if f in fields}
        if wanted:
            cols = ", ".join(f"max({fin(c)}) as {f}" for f, c in wanted.items())
            sql += f",\nt_{name} as (select {code} as ts_code, idx, {cols} from {name} join cal on cal.trade_date = {name}.trade_date group by all)"
            joins += f" left join t_{name} using (ts_code, idx)"
    extra = ", s.industry, s.exchange" if industry else ""
    if industry:
        joins += f" left join (select {code} as ts_code, industry, exchange from stock_basic) s using (ts_code)"
    return sql + f",\npanel as (select ts_code, idx, trade_date{''.join(', ' + f for f in fields)}{extra} from grid join cal using (idx){joins})"
