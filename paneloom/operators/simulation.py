"""Portfolios over time: target weights, turnover limits, an account with lots and fees, and recursions that need state.

What needs no memory is windows. What does runs as a keyed scan: one account (or instrument) is one ordered stream of rows, accounts
run side by side, and only an account's holdings are in memory.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import keyed_scan


def target_weights(scored: DataFrame, session: str, key: str, score: str, n: int, gross: float = 1.0, most: float = 1.0, industry: str | None = None, cap: float = 1.0) -> DataFrame:
    """(session, key, ``weight``) of the best ``n`` names by score. Names tied at the cutoff share what is left of the n places; no
    weight exceeds ``most``; an industry that exceeds ``cap`` is scaled to it. Null scores take no part; with fewer than n
    names each has an equal part of ``gross``."""
    own = scored.filter(F.col(score).isNotNull())
    day = Window.partitionBy(session)
    own = own.withColumns({"_r": F.rank().over(day.orderBy(F.col(score).desc())), "_m": F.count(F.lit(1)).over(Window.partitionBy(session, score)), "_n": F.least(F.count(F.lit(1)).over(day), F.lit(n))})
    left = F.col("_n") - F.col("_r") + 1
    weight = F.when(left >= F.col("_m"), gross / F.col("_n")).when(left > 0, gross * left / F.col("_n") / F.col("_m"))
    own = own.withColumn("weight", F.least(weight, F.lit(most))).filter(weight.isNotNull())
    if industry and cap < 1:
        total = F.sum("weight").over(Window.partitionBy(session, industry))
        own = own.withColumn("weight", F.when(total > cap, F.col("weight") * cap / total).otherwise(F.col("weight")))
    return own.select(session, key, "weight")


def turnover_limited(targets: DataFrame, account: str, session: str, key: str, weight: str, budget: float) -> DataFrame:
    """Weights after each session when the distance (sum of absolute changes) from the weights before may not exceed
    ``budget``: all changes are scaled alike. (account, session, key, ``weight``), weights above 1e-12."""

    def start() -> dict:
        return {"now": None, "want": {}, "held": {}, "out": []}

    def close(state: dict) -> None:
        held, want = state["held"], state["want"]
        names = sorted(set(held) | set(want))
        gap = sum(abs(want.get(s, 0.0) - held.get(s, 0.0)) for s in names)
        scale = min(1.0, budget / gap) if gap > 0 and held else 1.0
        new = {s: held.get(s, 0.0) + scale * (want.get(s, 0.0) - held.get(s, 0.0)) for s in names}
        state["held"] = {s: w for s, w in new.items() if abs(w) > 1e-12}
        state["out"] += [(state["now"], s, w) for s, w in state["held"].items()]
        state["want"] = {}

    def step(state: dict, row: tuple) -> None:
        _, now, name, w = row
        if state["now"] is not None and now != state["now"]:
            close(state)
        state["now"] = now
        if name is not None and w is not None:
            state["want"][name] = float(w)

    def finish(group: tuple, state: dict) -> list[tuple]:
        close(state)
        return [(group[0], *r) for r in state["out"]]

    kinds = dict(targets.dtypes)
    schema = f"`{account}` {kinds[account]}, `{session}` {kinds[session]}, `{key}` {kinds[key]}, weight double"
    return keyed_scan(targets.select(account, session, key, weight), [account], [session, key], start, step, finish, schema)


def held_returns(scored: DataFrame, order: str, key: str, score: str, ret: str, n: int, every: int, cost: float) -> DataFrame:
    """Equal-weight best ``n`` names, chosen every ``every`` sessions (ties: score, then key), held until the next choice: (order,
    ``gross``, ``turnover``, ``net``). ``ret`` is the return of the session after the row's. No state: the choice joins its
    holding sessions, turnover is what the last choice did not hold, paid on the first day."""
    block = F.floor(F.col(order) / every).cast("int")
    picks = scored.filter((F.col(order) % every == 0) & F.col(score).isNotNull())
    picks = picks.withColumn("_r", F.row_number().over(Window.partitionBy(order).orderBy(F.col(score).desc(), key))).filter(F.col("_r") <= n).select(block.alias("_b"), key)
    before = picks.select((F.col("_b") + 1).alias("_b"), key, F.lit(1).alias("_was"))
    change = picks.join(before, ["_b", key], "left").groupBy("_b").agg((1 - F.count("_was") / F.count(F.lit(1))).alias("_t"))
    daily = scored.withColumn("_b", block).join(picks, ["_b", key]).groupBy(order, "_b").agg(F.avg(ret).alias("gross"))
    met = daily.join(change, "_b")
    turnover = F.when(F.col(order) % every == 0, F.col("_t")).otherwise(0.0)
    return met.select(order, "gross", turnover.alias("turnover"), (F.col("gross") - turnover * cost).alias("net"))


def lot_rule(code: str) -> tuple[int, int, int]:
    """(least buy, step, greatest order) in shares of the code's board."""
    if code.startswith(("688", "689")):
        return 200, 1, 100_000
    if code.endswith(".BJ"):
        return 100, 1, 1_000_000
    return 100, 100, 300_000 if code.startswith("30") else 1_000_000


def _money(x: Decimal) -> Decimal:
    return x.quantize(Decimal("0.01"), ROUND_HALF_UP)


class Account:
    """Cash and shares of one account in exact decimals. Shares bought in a session are free the next one. ``tax`` on sales is a rate,
    or (first session, rate) pairs in order."""

    def __init__(self, cash: str, commission: str = "0.0003", least_commission: str = "5", tax: str | list[tuple[int, str]] = "0.0005", slippage: str = "0.0005", participation: str = "0.05") -> None:
        self.cash = Decimal(cash)
        self.commission, self.least, self.slippage, self.participation = (Decimal(x) for x in (commission, least_commission, slippage, participation))
        self.taxes = [(int(at), Decimal(rate)) for at, rate in tax] if isinstance(tax, list) else [(0, Decimal(tax))]
        self.shares: dict[str, int] = {}
        self.fresh: dict[str, int] = {}
        self.last: dict[str, Decimal] = {}
        self.claims: list[tuple[int, int, str, Decimal, int]] = []
        self.refused, self.now = 0, 0

    def begin(self, now: int) -> None:
        """A new session: yesterday's shares are free, claims that are due are paid and credited."""
        self.now, self.fresh = now, {}
        for _, due, name, money, quantity in [c for c in self.claims if c[1] <= now]:
            self.cash += money
            if quantity:
                self.shares[name] = self.shares.get(name, 0) + quantity
        self.claims = [c for c in self.claims if c[1] > now]

    def entitle(self, name: str, cash: Decimal, stock: Decimal, ex: int, paid: int, listed: int) -> None:
        """Claims of what is held at the close of the record session: cash and whole new shares for each share, counted in the
        account's value from the ex session on."""
        held = self.shares.get(name, 0)
        if held and cash:
            self.claims.append((ex, max(paid, ex), name, _money(cash * held), 0))
        if held and int(stock * held):
            self.claims.append((ex, max(listed, ex), name, Decimal(0), int(stock * held)))

    def _price(self, price: Decimal, side: int) -> Decimal:
        return (price * (1 + side * self.slippage)).quantize(Decimal("0.01"), ROUND_HALF_UP)

    def trade(self, bars: dict[str, dict], weights: dict[str, float]) -> int:
        """Sells first, then buys, at the session's open; returns the fills. Names that are paused or open at their limit, and
        shares bought this session, don't trade; volume before and the board's greatest order cap what does. Without a price
        for a holding, nothing trades."""
        nav = self.value(bars, "open")
        if nav is None:
            self.refused += 1
            return 0
        fills = 0
        want = {s: int(Decimal(str(w)) * nav / bars[s]["open"]) for s, w in weights.items() if bars.get(s, {}).get("open")}
        for side in (-1, 1):
            for s in sorted(set(want) | set(self.shares)):
                bar = bars.get(s, {})
                gap = want.get(s, 0) - self.shares.get(s, 0)
                if gap * side <= 0:
                    continue
                price = bar.get("open")
                limit = bar.get("up" if side > 0 else "down")
                if not price or not bar.get("before") or (limit and (price - limit) * side >= 0):
                    self.refused += 1
                    continue
                quantity = min(abs(gap), int(bar["before"] * self.participation))
                least, step, most = lot_rule(s)
                quantity = min(quantity, most)
                if side < 0:
                    quantity = min(quantity, self.shares[s] - self.fresh.get(s, 0))
                if side > 0 or quantity < self.shares[s]:  # an odd rest may be sold whole
                    quantity = quantity // step * step if quantity >= least else 0
                paid = self._price(price, side)
                if side > 0:
                    room = int(self.cash / (paid * (1 + self.commission)))
                    quantity = min(quantity, room // step * step)
                    quantity = quantity if quantity >= least else 0
                if not quantity:
                    continue
                amount = paid * quantity
                fee = max(self.least, _money(amount * self.commission)) + (_money(amount * self._tax()) if side < 0 else 0)
                if side > 0 and amount + fee > self.cash:
                    continue
                self.cash -= side * amount + fee
                self.shares[s] = self.shares.get(s, 0) + side * quantity
                if not self.shares[s]:
                    del self.shares[s]
                if side > 0:
                    self.fresh[s] = self.fresh.get(s, 0) + quantity
                fills += 1
        return fills

    def _tax(self) -> Decimal:
        return max((at, rate) for at, rate in self.taxes if at <= self.now or at == self.taxes[0][0])[1]

    def value(self, bars: dict[str, dict], at: str) -> Decimal | None:
        """Cash, claims from their ex session on, and shares at their last price; None where a holding never had one."""
        for s, bar in bars.items():
            if bar.get(at):
                self.last[s] = bar[at]
        own = [(s, q, Decimal(0)) for s, q in self.shares.items()] + [(s, q, money) for ex, _, s, money, q in self.claims if ex <= self.now]
        if any(q and s not in self.last for s, q, _ in own):
            return None
        return self.cash + sum((money + (self.last[s] * q if q else 0) for s, q, money in own), Decimal(0))


def simulate_accounts(rows: DataFrame, account: str, order: str, key: str, cash: str = "1000000", tax: str | list[tuple[int, str]] = "0.0005", entitlements: DataFrame | None = None) -> DataFrame:
    """(account, order, ``nav``, ``cash``, ``positions``, ``fills``, ``refused``) by session. ``rows`` has for each account, session and
    name: ``weight`` (to be held from this session's open; null: no decision that day), ``open``, ``close``, ``before`` (the
    volume of the session before, in shares), ``up_limit``, ``down_limit``. A name without a price keeps its last one, ``nav`` is null
    where it never had one. ``entitlements`` (key, order of the record session, ``cash`` and ``stock`` for each share, and the sessions
    ``ex``, ``paid``, ``listed``), one row for a key and session, give what is held at that close its claims."""
    cols, claims = ["weight", "open", "close", "before", "up_limit", "down_limit"], ["cash", "stock", "ex", "paid", "listed"]
    if entitlements is None:
        rows = rows.withColumns({c: F.lit(None).cast("double" if c in ("cash", "stock") else "int") for c in claims})
    else:
        rows = rows.join(entitlements.select(order, key, *claims), [order, key], "left")

    def start() -> dict:
        return {"account": Account(cash, tax=tax), "now": None, "bars": {}, "weights": {}, "claims": [], "decided": False, "out": []}

    def close(state: dict) -> None:
        own: Account = state["account"]
        own.begin(int(state["now"]))
        fills = own.trade(state["bars"], state["weights"]) if state["decided"] else 0
        nav = own.value(state["bars"], "close")
        for claim in state["claims"]:
            own.entitle(*claim)
        state["out"].append((state["now"], None if nav is None else float(_money(nav)), float(_money(own.cash)), len(own.shares), fills, own.refused))
        state.update(bars={}, weights={}, claims=[], decided=False)

    def step(state: dict, row: tuple) -> None:
        _, now, name, weight, o, c, before, up, down, paid_cash, stock, ex, paid, listed = row
        if state["now"] is not None and now != state["now"]:
            close(state)
        state["now"] = now
        money = lambda x: Decimal(str(round(x, 4))) if x is not None and x > 0 else None
        state["bars"][name] = {"open": money(o), "close": money(c), "before": money(before), "up": money(up), "down": money(down)}
        if ex is not None:
            whole = lambda x: Decimal(str(round(x or 0.0, 8)))
            state["claims"].append((name, whole(paid_cash), whole(stock), int(ex), int(paid if paid is not None else ex), int(listed if listed is not None else ex)))
        if weight is not None:
            state["decided"] = True
            if weight > 0:
                state["weights"][name] = weight

    def finish(group: tuple, state: dict) -> list[tuple]:
        close(state)
        return [(group[0], *r) for r in state["out"]]

    kinds = dict(rows.dtypes)
    schema = f"`{account}` {kinds[account]}, `{order}` {kinds[order]}, nav double, cash double, positions int, fills int, refused int"
    return keyed_scan(rows.select(account, order, key, *cols, *claims), [account], [order, key], start, step, finish, schema)


def ledger_balances(events: DataFrame, account: str, at: Column, event_id: str, amount: str, payload: list[str]) -> DataFrame:
    """Running balance of an event-sourced ledger in exact decimals: (account, event id, ``balance``, ``conflict``). Repeated events
    count once; the same id with another content is a ``conflict`` and counts with its least content. Balances run over an account's
    events in order of time and id."""
    own = events.withColumn("_h", F.sha2(F.to_json(F.struct(*payload)), 256)).withColumn("_at", at)
    one = own.groupBy(account, event_id).agg(F.min(F.struct("_h", "_at", F.col(amount).cast("decimal(38,4)").alias("_v"))).alias("_e"), (F.min("_h") != F.max("_h")).alias("conflict"))
    w = Window.partitionBy(account).orderBy("_e._at", event_id).rowsBetween(Window.unboundedPreceding, 0)
    return one.select(account, event_id, F.sum("_e._v").over(w).alias("balance"), "conflict")


def parabolic_stop(panel: DataFrame, key: str = "ts_code", order: str = "idx", n: int = 4, first: float = 0.02, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """(key, order, ``buy``, ``sell``): turns of a stop that trails the extreme of a trend ever closer and flips when it is
    crossed, to the extreme of the last ``n`` + 1 rows. Rows without prices are passed over."""

    def start() -> dict:
        return {"s": None, "recent": [], "out": []}

    def take(state: dict, row: tuple) -> None:
        _, at, hi, lo = row
        if hi is None or lo is None:
            return
        recent = state["recent"] = (state["recent"] + [(hi, lo)])[-(n + 1) :]
        if state["s"] is None:
            state["s"] = (lo, 1, hi, first)
            state["out"].append((at, 0, 0))
            return
        stop, trend, extreme, pace = state["s"]
        stop, was = stop + pace * (extreme - stop), trend
        if (stop > lo) if trend > 0 else (stop < hi):
            trend = -trend
            stop = max(x for x, _ in recent) if trend < 0 else min(y for _, y in recent)
            extreme, pace = (lo if trend < 0 else hi), first
        elif (hi > extreme) if trend > 0 else (lo < extreme):
            extreme, pace = (hi if trend > 0 else lo), min(pace + step, most)
        state["s"] = (stop, trend, extreme, pace)
        state["out"].append((at, int(trend > was), int(trend < was)))

    kind = dict(panel.dtypes)
    schema = f"`{key}` {kind[key]}, `{order}` {kind[order]}, buy int, sell int"
    return keyed_scan(panel.select(key, order, "high", "low"), [key], [order], start, take, lambda g, s: [(g[0], *r) for r in s["out"]], schema)
