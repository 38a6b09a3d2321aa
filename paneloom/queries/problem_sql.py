"""DuckDB SQL for the queries of the data problems, written from their definitions and not from the operators."""

CODE = "replace(replace(replace(upper(regexp_replace(ts_code, '\\s', '', 'g')), '.XSHG', '.SH'), '.XSHE', '.SZ'), '.BJSE', '.BJ')"


def _date(c: str) -> str:
    return f"nullif(replace(trim({c}), '-', ''), '')"


def _day(c: str) -> str:
    return f"try_cast(try_strptime({_date(c)}, '%Y%m%d') as date)"


def _finite(c: str) -> str:
    return f"case when isnan({c}) or isinf({c}) then null else {c} end"


DAILY = f"""
daily_last as (
  select {CODE} as ts_code, {_date("trade_date")} as trade_date, max_by(struct_pack(c := close, a := amount), ingested_at) as r
  from daily group by all)"""

P1 = f"""
with {DAILY},
side as (
  select ts_code, trade_date, 'close' as field, 1 as side, {_finite("r.c")} as v from daily_last
  union all select {CODE}, {_date("trade_date")}, 'close', 2, {_finite("close")} from stk_factor
  union all select {CODE}, {_date("trade_date")}, 'adj_factor', 1, {_finite("adj_factor")} from adj_factor
  union all select {CODE}, {_date("trade_date")}, 'adj_factor', 2, {_finite("adj_factor")} from stk_factor),
met as (
  select ts_code, trade_date, field, bool_or(side = 1) as l, bool_or(side = 2) as r, max(v) filter (side = 1) as a, max(v) filter (side = 2) as b
  from side group by all),
told as (
  select ts_code, trade_date, field, case
    when not r then 'only_left' when not l then 'only_right' when (a is null) <> (b is null) then 'value'
    when abs(a - b) > case field when 'close' then 0.005 else 0.0005 end then 'value' end as diff
  from met)
select * from told where diff is not null"""

_NAMES = f"""
names as (
  select nc_id, {CODE} as ts_code, name, change_reason, {_day("start_date")} as s, {_day("end_date")} as e, {_day("ann_date")} as k from namechange)"""

_MOMENTS = f"""
moments as (
  select div_id, {CODE} as ts_code, 'ann' as moment, {_day("ann_date")} as t from dividend
  union all select div_id, {CODE}, 'ex', {_day("ex_date")} from dividend)"""

_HELD = """
held as (
  select m.div_id, m.moment, m.t, n.nc_id, n.name, n.change_reason,
    row_number() over (partition by m.div_id, m.moment order by n.s desc, n.k desc nulls last, n.nc_id desc) as rn
  from moments m join names n on n.ts_code = m.ts_code and n.s <= m.t and (n.e is null or n.e >= m.t) and (n.k is null or n.k <= m.t))"""

P2_FOUND = f"with {_NAMES}, {_MOMENTS}, {_HELD} select distinct div_id, moment, nc_id from held where rn = 1"
P2_ATTRIBUTES = f"""with {_NAMES}, {_MOMENTS}, {_HELD}
select m.div_id, m.moment, strftime(m.t, '%Y%m%d') as on_date, h.nc_id, h.name, h.change_reason
from moments m left join (select * from held where rn = 1) h using (div_id, moment)"""

_ROLL = f"""{DAILY},
act as (select ts_code, {_day("trade_date")} as day, coalesce({_finite("r.a")}, 0) as amount from daily_last),
turn as (select {CODE} as ts_code, {_day("trade_date")} as day, coalesce(max({_finite("turnover_rate")}), 0) as turnover_rate from daily_basic group by all),
span as (select ts_code, min(day) as lo, max(day) as hi from act group by 1),
grid as (
  select ts_code, lo, unnest(generate_series(lo - interval 29 day, hi::timestamp, interval 1 day))::date as day from span),
dense as (
  select g.ts_code, g.day, g.lo, coalesce(a.amount, 0) as amount, coalesce(t.turnover_rate, 0) as turnover_rate
  from grid g left join act a using (ts_code, day) left join turn t using (ts_code, day)),
roll as (
  select ts_code, day, lo, date_diff('day', lo, day) + 1 as day_no,
    sum(amount) over w7 as a7, sum(amount) over w30 as a30, sum(turnover_rate) over w7 as t7, sum(turnover_rate) over w30 as t30
  from dense
  window w7 as (partition by ts_code order by day rows 6 preceding), w30 as (partition by ts_code order by day rows 29 preceding)
  qualify day >= lo)"""

P3_ROLLING = f"""with {_ROLL}
select ts_code, strftime(day, '%Y%m%d') as cal_date, round(a7, 4) as amount_total_7, round(a30, 4) as amount_total_30,
  round(t7, 4) as turnover_rate_total_7, round(t30, 4) as turnover_rate_total_30, round(a7 / 7, 6) as amount_mean_7, round(a30 / 30, 6) as amount_mean_30,
  round(t7 / 7, 6) as turnover_rate_mean_7, round(t30 / 30, 6) as turnover_rate_mean_30
from roll"""

P3_FOUND = f"""with {_ROLL},
told as (
  select ts_code, day, 'idle' as kind from roll where a7 < 1e-6
  union all select ts_code, day, 'amount_burst' from roll where day_no >= 30 and a30 > 1e-6 and a7 / 7 >= 2 * a30 / 30
  union all select ts_code, day, 'turnover_burst' from roll where day_no >= 30 and t30 > 1e-6 and t7 / 7 >= 2 * t30 / 30)
select ts_code, strftime(day, '%Y%m%d') as cal_date, kind from told"""

_LISTED = f"""
listed as (
  select {CODE} as ts_code, {_day("list_date")} as lo, coalesce({_day("delist_date")}, date '9999-12-31') as hi from stock_basic),
cut as (
  select n.*, greatest(n.s, l.lo) as a, least(coalesce(n.e, date '9999-12-31'), l.hi) as b, l.lo, l.hi
  from names n join listed l using (ts_code) where n.s is not null and (n.e is null or n.e >= n.s))"""

P5 = f"""
with {_NAMES}, {_LISTED},
ends as (select *, max(b) over (partition by ts_code order by a, b rows between unbounded preceding and 1 preceding) as reach from cut where a <= b),
runs as (select *, sum(case when reach is null or a > reach + 1 then 1 else 0 end) over (partition by ts_code order by a, b rows unbounded preceding) as run from ends),
cover as (select ts_code, run, min(a) as a, max(b) as b from runs group by all),
edges as (
  select l.ts_code, l.lo, l.hi, c.a, c.b, lead(c.a) over (partition by l.ts_code order by c.a) as nxt, row_number() over (partition by l.ts_code order by c.a) as rn
  from listed l left join cover c using (ts_code)),
told as (
  select ts_code, 'covered' as kind, a, b from cover
  union all select ts_code, 'gap', lo, hi from edges where a is null and lo <= hi
  union all select ts_code, 'gap', lo, a - 1 from edges where rn = 1 and a > lo
  union all select ts_code, 'gap', b + 1, coalesce(nxt - 1, hi) from edges where b < hi and (nxt is null or nxt > b + 1))
select ts_code, kind, strftime(a, '%Y%m%d') as from_date, strftime(b, '%Y%m%d') as to_date from told"""

# DuckDB has NFC only; the widths that NFKC folds are translated here, as they occur in names.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
P6 = f"""
with {_NAMES}, {_LISTED},
good as (select * from cut where a <= b),
marks as (select distinct ts_code, unnest([a, case when b < date '9999-12-31' then b + 1 end]) as x from good),
cells as (select ts_code, x, coalesce(lead(x) over (partition by ts_code order by x) - 1, date '9999-12-31') as y from marks where x is not null),
best as (
  select c.ts_code, c.x, c.y, regexp_replace(translate(g.name, '{_WIDE}', '{_NARROW}'), '[\\s\\x{{3000}}\\x{{00a0}}]', '', 'g') as name
  from cells c join good g on g.ts_code = c.ts_code and g.a <= c.x and g.b >= c.x
  qualify row_number() over (partition by c.ts_code, c.x order by g.s desc, g.k desc nulls last, g.nc_id desc) = 1),
turns as (select *, case when lag(y) over w + 1 = x and lag(name) over w is not distinct from name then 0 else 1 end as new from best window w as (partition by ts_code order by x)),
runs as (select *, sum(new) over (partition by ts_code order by x) as run from turns)
select ts_code, name, strftime(min(x), '%Y%m%d') as valid_from, strftime(max(y), '%Y%m%d') as valid_to from runs group by ts_code, name, run"""

_FILL = "(9999.0, 99999.0, 999999.0, 9999999.0, 9999.99, 99999.99, 999999.99, 8888.88, 88888.88, 888888.88, 8888.0, 88888.0, 888888.0)"


def _real(c: str, positive: bool) -> str:
    bad = f"{c} is null or isnan({c}) or isinf({c}) or abs({c}) in {_FILL} or {c} in (-999, -99)" + (f" or {c} <= 0" if positive else "")
    return f"case when {bad} then null else {c} end"


_WORDS = "('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', 'nan', 'nil', '-', '--', '?', 'missing', 'tbd', '未知', '无', '不详')"
P7 = f"""
with cells as (
  select 'daily_basic' as tbl, {CODE} as key1, {_date("trade_date")} as key2, 'free_share' as field, {CODE} as grp, {_real("free_share", True)} is not null as held, true as ask from daily_basic
  union all select 'stk_limit', {CODE}, {_date("trade_date")}, 'up_limit', {CODE}, {_real("up_limit", True)} is not null, up_limit is not null or down_limit is not null from stk_limit
  union all select 'factor_performance', experiment_id, factor_id, 'regime_bear_icir', factor_id, {_real("regime_bear_icir", False)} is not null, true from factor_performance
  union all select 'factor_performance', experiment_id, factor_id, 'category', factor_id, category is not null and lower(trim(category)) not in {_WORDS}, true from factor_performance),
told as (select *, bool_or(held) over (partition by tbl, field, grp) as helped from cells)
select distinct tbl, key1, key2, field from told where not held and ask and helped"""

SQL = {"p1_found": P1, "p2_found": P2_FOUND, "p2_attributes": P2_ATTRIBUTES, "p3_found": P3_FOUND, "p3_rolling": P3_ROLLING, "p5_found": P5, "p6_found": P6, "p7_found": P7}
