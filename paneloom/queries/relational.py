"""Queries of joins, cleaning, resampling and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import day_number, instrument_code
from ..operators import relational as R
from ..operators.versions import attributes_at
from ..sources.panel import dense_panel, panel_sql, sessions
from ..sources.reports import quarterly, report_sql
from ..sources.tables import coded, table
from .problem_sql import CODE, _date, _day

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _date_of(c: str):
    return F.to_date(c, "yyyyMMdd")


P = panel_sql()
_ANN = f"ann as (select {CODE} as ts_code, {_day('ann_date')} as ann, div_id, cash_div from dividend where ann_date is not null)"
_PD = ", pd as (select *, strptime(trade_date, '%Y%m%d')::date as d from panel)"


def _announced(spark: SparkSession, d: str) -> DataFrame:
    return coded(table(spark, d, "dividend").select("ts_code", "ann_date", "div_id", "cash_div"), "ann_date").filter("ann_date is not null")


def _closes(spark: SparkSession, d: str) -> DataFrame:
    return dense_panel(spark, d, ["close"]).withColumn("day", day_number("trade_date"))


@query(P + _PD + f", {_ANN}, one as (select * from ann qualify row_number() over (partition by ts_code, ann order by div_id desc) = 1) select p.ts_code, p.trade_date, o.div_id, o.cash_div from pd p asof left join one o on p.ts_code = o.ts_code and p.d >= o.ann")
def rel_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return R.asof(_closes(spark, d), _announced(spark, d), "ts_code", "day", "ann_date", ["div_id", "cash_div"]).select("ts_code", "trade_date", "div_id", "cash_div")


@query(P + _PD + f", {_ANN}, one as (select * from ann qualify row_number() over (partition by ts_code, ann order by div_id desc) = 1) select p.ts_code, p.trade_date, case when p.d - o.ann <= 180 then o.div_id end as div_id from pd p asof left join one o on p.ts_code = o.ts_code and p.d >= o.ann")
def rel_asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return R.asof(_closes(spark, d), _announced(spark, d), "ts_code", "day", "ann_date", ["div_id"], tolerance=180).select("ts_code", "trade_date", "div_id")


@query(P + _PD + f", {_ANN}, one as (select ts_code, ann, case when count(distinct cash_div) = 1 then max(cash_div) end as cash_div from ann group by all) select p.ts_code, p.trade_date, case when p.d - o.ann <= 28 then o.cash_div end as cash_div from pd p asof left join one o on p.ts_code = o.ts_code and p.d > o.ann")
def rel_asof_strict_lifetime(spark: SparkSession, d: str) -> DataFrame:
    """Strictly after the announcement, for four weeks; announcements of one day that differ are no announcement."""
    clear = R.agreed_or_null(_announced(spark, d), ["ts_code", "ann_date"], ["cash_div"])
    return R.asof(_closes(spark, d), clear, "ts_code", "day", "ann_date", ["cash_div"], tolerance=28, strict=True).select("ts_code", "trade_date", "cash_div")


@query(P + _PD + f", {_ANN}, one as (select * from ann qualify row_number() over (partition by ts_code, ann order by div_id desc) = 1), held as (select p.ts_code, p.idx, p.trade_date, o.cash_div from pd p asof left join one o on p.ts_code = o.ts_code and p.d >= o.ann) select ts_code, trade_date, lag(cash_div) over (partition by ts_code order by idx) as cash_div from held")
def rel_asof_next_session(spark: SparkSession, d: str) -> DataFrame:
    """Announced states become effective one session later."""
    held = R.asof(_closes(spark, d), _announced(spark, d), "ts_code", "day", "ann_date", ["div_id", "cash_div"])
    return held.select("ts_code", "trade_date", F.lag("cash_div").over(Window.partitionBy("ts_code").orderBy("idx")).alias("cash_div"))


@query(f"select {CODE} as ts_code, trade_date, max_by(struct_pack(v := close), ingested_at).v as close from daily where ingested_at <= strptime(trade_date, '%Y%m%d') + interval 33 hour group by all")
def rel_bitemporal(spark: SparkSession, d: str) -> DataFrame:
    """What was known of a session at nine the next morning."""
    rows = table(spark, d, "daily").select(instrument_code("ts_code").alias("ts_code"), "trade_date", "close", "ingested_at")
    clock = F.to_timestamp("trade_date", "yyyyMMdd") + F.expr("interval 33 hours")
    return R.visible_at(rows, ["ts_code", "trade_date"], "close", "ingested_at", clock)


@query(P + _PD + f""", nm as (select nc_id, {CODE} as ts_code, name, {_day('start_date')} as s, {_day('end_date')} as e, {_day('ann_date')} as k from namechange),
hit as (select p.ts_code, p.trade_date, n.name, row_number() over (partition by p.ts_code, p.trade_date order by n.s desc, n.k desc nulls last, n.nc_id desc) as rn
from pd p join nm n on n.ts_code = p.ts_code and n.s <= p.d and (n.e is null or n.e >= p.d) and (n.k is null or n.k <= p.d))
select p.ts_code, p.trade_date, coalesce(regexp_matches(h.name, 'ST|PT|退'), false) as special from pd p left join (select * from hit where rn = 1) h using (ts_code, trade_date)""")
def rel_scd2_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether the name that was known in each session marks special treatment."""
    names = coded(table(spark, d, "namechange"), "start_date", "end_date", "ann_date")
    met = attributes_at(_closes(spark, d), names, "ts_code", "day", F.col("start_date"), F.col("end_date"), F.col("ann_date"), ["name"], [F.col("nc_id")])
    return met.select("ts_code", "trade_date", F.coalesce(F.col("attrs.name").rlike("ST|PT|退"), F.lit(False)).alias("special"))


@query(P + _PD + f", b as (select {CODE} as ts_code, {_day('list_date')} as lo, {_day('delist_date')} as hi from stock_basic) select trade_date, count(*) as members from pd p join b using (ts_code) where p.d >= b.lo and (b.hi is null or p.d < b.hi) group by 1")
def rel_lifecycle_members(spark: SparkSession, d: str) -> DataFrame:
    life = coded(table(spark, d, "stock_basic").select("ts_code", "list_date", "delist_date"), "list_date", "delist_date")
    met = _closes(spark, d).join(life, "ts_code").filter((F.col("day") >= F.col("list_date")) & (F.col("delist_date").isNull() | (F.col("day") < F.col("delist_date"))))
    return met.groupBy("trade_date").agg(F.count(F.lit(1)).alias("members"))


@query(P + " select ts_code, trade_date, close from panel")
def rel_dense_grid(spark: SparkSession, d: str) -> DataFrame:
    return dense_panel(spark, d, ["close"]).select("ts_code", "trade_date", "close")


@query("select c_custkey, sum(o_totalprice) as total, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by 1".replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)"))
def rel_left_join(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["orders"])


@query("select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def rel_dictionary_map(spark: SparkSession, d: str) -> DataFrame:
    """Code to group: dimension tables small enough for Spark's own size check are broadcast by it."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_custkey is not null)")
def rel_anti_join(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("select distinct c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def rel_semi_join(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("select o_orderdate, o_orderkey, o_totalprice from orders where o_orderdate not in (select o_orderdate from orders where o_orderstatus = 'P') union all select o_orderdate, o_orderkey, o_totalprice * 2 from orders where o_orderstatus = 'P'")
def rel_overlay_dates(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    newer = base.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return R.overlay(base.drop("o_orderstatus"), newer.drop("o_orderstatus"), "o_orderdate")


@query("select coalesce(l.k, o.k) as k, coalesce(l.v, 0) + coalesce(o.v, 0) as v from (select l_suppkey as k, round(sum(l_quantity), 2) as v from lineitem group by 1) l full join (select o_custkey as k, cast(count(*) as double) as v from orders group by 1) o on l.k = o.k")
def rel_outer_align(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("v"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return R.aligned_sum([a, b], ["k"], "v")


@query(f"with a as (select distinct {CODE} as c, {_date('trade_date')} as t from stk_limit), b as (select distinct {CODE} as c, {_date('trade_date')} as t from daily_basic) select (select count(*) from a where (c, t) not in (select (c, t) from b)) as only_a, (select count(*) from b where (c, t) not in (select (c, t) from a)) as only_b, (select count(*) from a where (c, t) in (select (c, t) from b)) as both")
def rel_same_members(spark: SparkSession, d: str) -> DataFrame:
    a, b = (coded(table(spark, d, t).select("ts_code", "trade_date")) for t in ("stk_limit", "daily_basic"))
    return R.same_members(a, b, ["ts_code", "trade_date"])


@query("select user_id, event_type, value, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def rel_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return R.keep_last(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value", "event_id")


@query("select l_orderkey, l_linenumber, case when count(distinct l_quantity) = 1 and count(l_quantity) = count(*) then max(l_quantity) end as l_quantity from lineitem group by all")
def rel_conflict_to_null(spark: SparkSession, d: str) -> DataFrame:
    return R.agreed_or_null(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity"])


@query(P + ", top as (select ts_code, avg(amount) as m from panel group by 1 having avg(amount) is not null order by m desc, ts_code limit 20) select ts_code, trade_date, amount from panel where ts_code in (select ts_code from top)")
def rel_top_universe(spark: SparkSession, d: str) -> DataFrame:
    panel = dense_panel(spark, d, ["amount"])
    return panel.join(R.top_by_mean(panel, "ts_code", "amount", 20), "ts_code", "left_semi").select("ts_code", "trade_date", "amount")


@query(f"select exchange, {CODE} as ts_code from stock_basic qualify row_number() over (partition by exchange order by sha256('panel:' || {CODE}), {CODE}) <= 10")
def rel_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_sample(coded(table(spark, d, "stock_basic").select("ts_code", "exchange")), "ts_code", "exchange", "panel", 10)


@query(f"select {CODE} as ts_code, case when regexp_matches({CODE}, '^(600|601|603|605)') then 'main_sh' when regexp_matches({CODE}, '^(688|689)') then 'star' when regexp_matches({CODE}, '^(000|001|002|003)') then 'main_sz' when regexp_matches({CODE}, '^(300|301)') then 'growth' when {CODE} like '%.BJ' then 'beijing' end as board from (select distinct ts_code from stk_factor) group by all")
def rel_board(spark: SparkSession, d: str) -> DataFrame:
    codes = coded(table(spark, d, "stk_factor").select("ts_code")).distinct()
    return codes.withColumn("board", R.board(F.col("ts_code")))


@query(panel_sql(["turnover"]) + ", q as (select trade_date, quantile_cont(turnover, 0.01) as a, quantile_cont(turnover, 0.99) as b from panel group by 1) select ts_code, trade_date, round(case when turnover is not null then greatest(a, least(b, turnover)) end, 6) as turnover from panel join q using (trade_date)")
def rel_winsorise_session(spark: SparkSession, d: str) -> DataFrame:
    panel = dense_panel(spark, d, ["turnover"])
    return panel.select("ts_code", "trade_date", F.round(R.winsorised(panel, "turnover", ["trade_date"]), 6).alias("turnover"))


@query(panel_sql(["turnover"]) + ", q as (select ts_code, quantile_cont(turnover, 0.01) as a, quantile_cont(turnover, 0.99) as b, count(turnover) as n from panel group by 1) select ts_code, trade_date, round(case when n < 20 then turnover when turnover is not null then greatest(a, least(b, turnover)) end, 6) as turnover from panel join q using (ts_code)")
def rel_winsorise_history(spark: SparkSession, d: str) -> DataFrame:
    panel = dense_panel(spark, d, ["turnover"])
    return panel.select("ts_code", "trade_date", F.round(R.winsorised(panel, "turnover", ["ts_code"], least=20), 6).alias("turnover"))


@query(panel_sql(["turnover"]) + " select ts_code, trade_date, last_value(turnover ignore nulls) over (partition by ts_code order by idx) as filled, last_value(turnover ignore nulls) over (partition by ts_code order by idx rows 5 preceding) as filled_5, first_value(turnover ignore nulls) over (partition by ts_code order by idx rows between current row and unbounded following) as back from panel")
def rel_fill(spark: SparkSession, d: str) -> DataFrame:
    return dense_panel(spark, d, ["turnover"]).select("ts_code", "trade_date", R.filled_forward("turnover", "ts_code", "idx").alias("filled"), R.filled_forward("turnover", "ts_code", "idx", 5).alias("filled_5"), R.filled_backward("turnover", "ts_code", "idx").alias("back"))


@query(panel_sql(["open", "close", "adj"]) + " select ts_code, trade_date, round(open * f, 6) as open, round(close * f, 6) as close from (select *, coalesce(first_value(adj ignore nulls) over (partition by ts_code order by idx rows between current row and unbounded following), 1.0) as f from panel)")
def rel_adjusted_prices(spark: SparkSession, d: str) -> DataFrame:
    panel = R.adjusted(dense_panel(spark, d, ["open", "close", "adj"]), ["open", "close"], "adj")
    return panel.select("ts_code", "trade_date", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"))


_WEEK = ", w as (select *, date_trunc('week', strptime(trade_date, '%Y%m%d'))::date + 6 as week from panel)"
_BARS = ", bars as (select ts_code, week, arg_min(open, trade_date) filter (open is not null) as open, max(high) as high, min(low) as low, arg_max(close, trade_date) filter (close is not null) as close, sum(volume) as volume, sum(amount) as amount from w group by all)"


@query(P + _WEEK + _BARS + " select ts_code, strftime(week, '%Y%m%d') as week, open, high, low, close, round(volume, 4) as volume, round(amount, 4) as amount from bars")
def rel_weekly_bars(spark: SparkSession, d: str) -> DataFrame:
    bars = R.weekly_bars(dense_panel(spark, d), _date_of("trade_date"))
    return bars.select("ts_code", F.date_format("week", "yyyyMMdd").alias("week"), "open", "high", "low", "close", F.round("volume", 4).alias("volume"), F.round("amount", 4).alias("amount"))


@query(P + _WEEK + _BARS + ", m as (select ts_code, week, close / lag(close) over (partition by ts_code order by week) - 1 as r from bars where close > 0), lst as (select ts_code, week, max(trade_date) as trade_date from w group by all), sig as (select l.ts_code, l.trade_date, m.r from lst l join m using (ts_code, week)) select p.ts_code, p.trade_date, round(last_value(s.r ignore nulls) over (partition by p.ts_code order by p.idx), 6) as weekly_return from panel p left join sig s using (ts_code, trade_date)")
def rel_weekly_to_daily(spark: SparkSession, d: str) -> DataFrame:
    """A weekly signal on the week's last session, carried forward."""
    panel = dense_panel(spark, d)
    bars = R.weekly_bars(panel, _date_of("trade_date")).filter("close > 0")
    r = F.col("close") / F.lag("close").over(Window.partitionBy("ts_code").orderBy("week")) - 1
    last = panel.groupBy("ts_code", R.week_end(_date_of("trade_date")).alias("week")).agg(F.max("trade_date").alias("trade_date"))
    signal = bars.select("ts_code", "week", r.alias("r")).join(last, ["ts_code", "week"]).drop("week")
    met = panel.select("ts_code", "trade_date", "idx").join(signal, ["ts_code", "trade_date"], "left")
    return met.select("ts_code", "trade_date", F.round(R.filled_forward("r", "ts_code", "idx"), 6).alias("weekly_return"))


@query("select strftime(max(strptime(cal_date, '%Y%m%d')), '%Y%m%d') as rebalance, count(*) as sessions from trade_cal where is_open = 1 group by date_trunc('week', strptime(cal_date, '%Y%m%d'))")
def rel_rebalance_days(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).groupBy(R.week_end(_date_of("trade_date"))).agg(F.max("trade_date").alias("rebalance"), F.count(F.lit(1)).alias("sessions")).select("rebalance", "sessions")


@query(P + ", o as (select ts_code, close, (row_number() over (partition by ts_code order by idx) - 1) // 20 as block from panel where close is not null) select ts_code, block, round(avg(close), 6) as mean, count(*) as n from o group by all")
def rel_blocks_of_20(spark: SparkSession, d: str) -> DataFrame:
    rows = dense_panel(spark, d, ["close"]).filter("close is not null")
    block = F.floor((F.row_number().over(Window.partitionBy("ts_code").orderBy("idx")) - 1) / 20)
    return rows.withColumn("block", block).groupBy("ts_code", "block").agg(F.round(F.avg("close"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("with g as (select o_custkey, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate) as gap from orders) select o_custkey, round(365.25 / median(gap), 6) as periods from g where gap > 0 group by 1")
def rel_periods_per_year(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gaps = table(spark, d, "orders").select("o_custkey", F.date_diff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap")).filter("gap > 0")
    return gaps.groupBy("o_custkey").agg(F.round(365.25 / F.percentile("gap", F.lit(0.5)), 6).alias("periods"))


_Q = "q as (select l_suppkey as k, cast(year(l_shipdate) as int) as y, cast(quarter(l_shipdate) as int) as q, round(sum(l_extendedprice), 2) as v from lineitem group by all), cum as (select k, y, q, round(sum(v) over (partition by k, y order by q), 2) as v from q)"


@query(f"with {_Q}, s as (select *, case when q = 1 then v when lag(q) over (partition by k, y order by q) = q - 1 then v - lag(v) over (partition by k, y order by q) end as single from cum) select k, y, q, round(single, 2) as single, round(case when count(single) over f = 4 and max(y * 4 + q) over f - min(y * 4 + q) over f = 3 then sum(single) over f end, 2) as ttm from s window f as (partition by k order by y * 4 + q rows 3 preceding)")
def rel_ttm(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative statements to single quarters and trailing twelve months."""
    q = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    cum = q.withColumn("v", F.round(F.sum("v").over(Window.partitionBy("k", "y").orderBy("q")), 2))
    return R.single_quarters(cum, "k", "y", "q", "v").select("k", "y", "q", F.round("single", 2).alias("single"), F.round("ttm", 2).alias("ttm"))


@query(P + _PD + f", {_ANN}, ev as (select a.ts_code, min(c.idx) as idx, a.div_id, a.cash_div from ann a join cal c on strptime(c.trade_date, '%Y%m%d')::date >= a.ann group by all), per as (select ts_code, idx, sum(cash_div) as s from ev group by all) select ts_code, trade_date, round(lag(v) over (partition by ts_code order by idx), 6) as cash_div_sum_60 from (select p.ts_code, p.idx, p.trade_date, coalesce(sum(e.s) over (partition by p.ts_code order by p.idx rows 59 preceding), 0.0) as v from panel p left join per e using (ts_code, idx))")
def rel_event_window(spark: SparkSession, d: str) -> DataFrame:
    """Cash announced in the last 60 sessions, known one session later."""
    # each calendar day with the session that comes on or after it: an equi-join instead of a range join
    cal = table(spark, d, "trade_cal").select("cal_date", "is_open").join(sessions(spark, d).withColumnRenamed("trade_date", "cal_date"), "cal_date", "left")
    after = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row a calendar day
    nxt = cal.withColumn("day", day_number("cal_date")).select("day", F.min("idx").over(after).alias("idx")).filter("idx is not null")
    first = nxt.agg(F.min("day")).first()[0]
    ev = _announced(spark, d).withColumn("day", F.greatest("ann_date", F.lit(first))).join(nxt, "day").select("ts_code", "idx", "cash_div")
    out = R.event_window(dense_panel(spark, d, ["close"]), ev, "ts_code", "idx", "cash_div", 60)
    return out.select("ts_code", "trade_date", F.round("cash_div_sum_60", 6).alias("cash_div_sum_60"))


@query(panel_sql(["close", "up_limit"]) + ", f as (select *, close >= up_limit - 0.005 as hit from panel) select ts_code, trade_date, idx - last_value(case when hit then idx end ignore nulls) over (partition by ts_code order by idx) as since_limit_up from f")
def rel_days_since_event(spark: SparkSession, d: str) -> DataFrame:
    hit = F.when(F.col("close") >= F.col("up_limit") - 0.005, F.col("idx"))
    last = F.last(hit, ignorenulls=True).over(Window.partitionBy("ts_code").orderBy("idx"))
    return dense_panel(spark, d, ["close", "up_limit"]).select("ts_code", "trade_date", (F.col("idx") - last).alias("since_limit_up"))


@query(panel_sql(["turnover"], True) + " select ts_code, trade_date, round(turnover - avg(turnover) over (partition by trade_date, industry), 6) as deviation from panel")
def rel_peer_deviation(spark: SparkSession, d: str) -> DataFrame:
    panel = dense_panel(spark, d, ["turnover"], True)
    return panel.select("ts_code", "trade_date", F.round(F.col("turnover") - F.avg("turnover").over(Window.partitionBy("trade_date", "industry")), 6).alias("deviation"))


@query(panel_sql(["open", "close", "up_limit"]) + ", f as (select *, coalesce(close >= up_limit - 0.005, false) as l, lag(close) over (partition by ts_code order by idx) as prev from panel), g as (select *, coalesce(lag(l) over (partition by ts_code order by idx), false) as was, case when prev > 0 then open / prev - 1 end as gap from f) select trade_date, count(*) as names, cast(sum(l::int) as bigint) as limit_up, round(avg((gap > 0)::int), 6) as open_up, round(avg(case when was then gap end), 6) as premium from g where close is not null group by 1")
def rel_market_breadth(spark: SparkSession, d: str) -> DataFrame:
    b = R.market_breadth(dense_panel(spark, d, ["open", "close", "up_limit"]))
    return b.select("trade_date", "names", "limit_up", F.round("open_up", 6).alias("open_up"), F.round("premium", 6).alias("premium"))


@query(panel_sql(["amount"], True) + " select industry, trade_date, round(sum(amount), 3) as amount, count(amount) as n from panel group by all")
def rel_two_way_sums(spark: SparkSession, d: str) -> DataFrame:
    return dense_panel(spark, d, ["amount"], True).groupBy("industry", "trade_date").agg(F.round(F.sum("amount"), 3).alias("amount"), F.count("amount").alias("n"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by cube (l_returnflag, l_linestatus)")
def rel_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("select o_orderstatus, o_orderpriority, count(distinct o_custkey) as customers from orders group by rollup (o_orderstatus, o_orderpriority)")
def rel_rollup_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("select user_id, cast(sum(case when event_type = t then 1 else 0 end) as bigint) as n, t as event_type from events, (select distinct event_type as t from events) group by user_id, t")
def rel_pivot_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Long to wide and back, zero where a pair has no row."""
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of kinds
    wide = e.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0)
    return wide.unpivot("user_id", kinds, "event_type", "n")


@query("(select c_custkey as k from customer union select o_custkey from orders) except select l_suppkey from lineitem")
def rel_set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select("o_custkey"), table(spark, d, "lineitem").select("l_suppkey")
    return a.union(b).distinct().subtract(c)


@query(P + " select trade_date, ts_code, amount from panel where amount is not null qualify row_number() over (partition by trade_date order by amount desc, ts_code) <= 5")
def rel_top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = dense_panel(spark, d, ["amount"]).filter("amount is not null")
    return R.top_k(rows, ["trade_date"], [F.col("amount").desc(), F.col("ts_code")], 5).select("trade_date", "ts_code", "amount")


@query(f"select {CODE} as ts_code, cast(count(*) as bigint) as n, cast(sum((o <> a)::int) as bigint) as odd from (select ts_code, {CODE} as a, ts_code as o from stk_factor) group by all")
def rel_code_notation(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "stk_factor").select("ts_code", instrument_code("ts_code").alias("c"))
    return raw.groupBy(F.col("c").alias("ts_code")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ts_code") != F.col("c")).cast("int")).alias("odd"))


@query(report_sql() + ", r as (select *, make_date((idx - 1) // 4, ((idx - 1) % 4) * 3 + 1, 1) + interval 3 month + interval 29 day as ann from own), o as (select o_custkey % 100 + 1 as supplier, o_orderkey, o_orderdate as t from orders) select o.o_orderkey, r.revenue, r.idx from o asof left join r on o.supplier = r.supplier and o.t >= r.ann")
def rel_asof_reports(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the last report that its supplier had announced, thirty days after the quarter."""
    q = quarterly(spark, d)
    end = F.add_months(F.make_date(F.floor((F.col("idx") - 1) / 4).cast("int"), (F.pmod(F.col("idx") - 1, F.lit(4)) * 3 + 1).cast("int"), F.lit(1)), 3)
    reports = q.select("supplier", "idx", "revenue", F.unix_date(F.date_add(end, 29)).alias("ann"))
    orders = table(spark, d, "orders").select((F.col("o_custkey") % 100 + 1).alias("supplier"), "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    return R.asof(orders, reports, "supplier", "day", "ann", ["revenue", "idx"]).select("o_orderkey", "revenue", "idx")
