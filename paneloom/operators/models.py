"""Neutralisation, redundancy, regressions, clusters, nearest neighbours, regimes and crowding."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neutralised(scored: DataFrame, session: str, group: str, score: str, control: str) -> DataFrame:
    """``scored`` with ``residual``: of a regression by session on group dummies and one control. Both sides are demeaned by
    group first, so that the slope is a ratio of sums and all of it is windows."""
    fine = F.col(score).isNotNull() & F.col(control).isNotNull() & F.col(group).isNotNull()
    cell, day = Window.partitionBy(session, group), Window.partitionBy(session)
    own = scored.withColumns({"_y": F.when(fine, F.col(score)), "_x": F.when(fine, F.col(control))})
    own = own.withColumns({"_dy": F.col("_y") - F.avg("_y").over(cell), "_dx": F.col("_x") - F.avg("_x").over(cell)})
    sxx = F.sum(F.col("_dx") * F.col("_dx")).over(day)
    slope = F.when(sxx > 1e-12, F.sum(F.col("_dx") * F.col("_dy")).over(day) / F.when(sxx != 0, sxx)).otherwise(0.0)
    return own.withColumn("residual", F.col("_dy") - slope * F.col("_dx")).drop("_y", "_x", "_dy", "_dx")


def residual_on(scored: DataFrame, session: str, y: str, xs: list[str], ridge: float = 0.0, least: int = 10) -> DataFrame:
    """``ts_code``, session, ``residual`` and ``r2`` of y on standardised xs by session (ridge > 0: penalised). A session's
    regressors are k columns of its names: one Arrow group a session."""
    own = scored.select("ts_code", session, y, *xs).dropna()

    def fit(part: pa.Table) -> pa.Table:
        n = part.num_rows
        res, r2 = np.full(n, np.nan), np.nan
        if n >= max(least, len(xs) + 2):
            target = part.column(y).to_numpy()
            x = np.stack([part.column(c).to_numpy() for c in xs], 1)
            x = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
            t = target - target.mean()
            beta = np.linalg.lstsq(x.T @ x + ridge * n * np.eye(len(xs)), x.T @ t, rcond=None)[0]
            res = t - x @ beta
            r2 = 1 - (res @ res) / (t @ t) if t @ t > 0 else np.nan
        return pa.table({"ts_code": part.column("ts_code"), session: part.column(session), "residual": pa.array(res, from_pandas=True), "r2": pa.array(np.full(n, r2), from_pandas=True)})

    kind = dict(scored.dtypes)[session]
    return own.groupBy(session).applyInArrow(fit, f"ts_code string, `{session}` {kind}, residual double, r2 double")


def clusters(pairs: DataFrame, one: str, other: str, spark_nodes: list[str]) -> dict[str, str]:
    """Connected components of the pairs of a library of signals (k names, so on the driver): name -> least name of its cluster."""
    root = {n: n for n in spark_nodes}

    def find(a: str) -> str:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs.select(one, other).toLocalIterator():
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in spark_nodes}


def nearest(vectors: DataFrame, key: str, vector: str, k: int, every: int = 50, block: int = 4096) -> DataFrame:
    """(``query``, ``neighbour``, ``rank``, ``cosine``): the ``k`` nearest by cosine to each row whose key is divisible by ``every``,
    against all rows. Queries go out in blocks of at most ``block`` vectors; each task keeps the best k of its rows for
    each query, so that what is shuffled does not grow with the rows. Null, empty and zero vectors are left out."""
    unit = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, e: s + e * e))
    own = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn("_u", unit).filter("_u > 0").select(F.col(key).cast("long").alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    queries = own.filter(F.col("_k") % every == 0)
    spark = vectors.sparkSession
    out = None
    for ids, rows in _blocks(queries, block):
        shared = spark.sparkContext.broadcast((ids, rows))

        def best(batches):
            q_ids, q = shared.value
            keep_id, keep_c = np.full((len(q_ids), 0), -1), np.zeros((len(q_ids), 0))
            for batch in batches:
                ks = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy().reshape(len(ks), -1)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                c = q @ v.T
                c[q_ids[:, None] == ks[None, :]] = -2
                all_id, all_c = np.concatenate([keep_id, np.broadcast_to(ks, c.shape)], 1), np.concatenate([keep_c, c], 1)
                order = np.lexsort((all_id, -all_c), axis=1)[:, :k]
                keep_id, keep_c = np.take_along_axis(all_id, order, 1), np.take_along_axis(all_c, order, 1)
            if keep_id.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, keep_id.shape[1])), pa.array(keep_id.ravel()), pa.array(keep_c.ravel())], names=["query", "neighbour", "cosine"])

        part = own.mapInArrow(best, "query long, neighbour long, cosine double").filter("cosine > -2")
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour"))).filter(F.col("rank") <= k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query long, neighbour long, cosine double, rank int")


def _blocks(queries: DataFrame, block: int):
    """Query vectors in blocks, one block on the driver at a time."""
    ids, rows = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0]), rows.append(r[1])
        if len(ids) == block:
            yield np.array(ids), _unit(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids), _unit(rows)


def _unit(rows: list) -> np.ndarray:
    v = np.array(rows, float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fingerprint(scored: DataFrame, session: str, score: str, size: int = 32, seed: int = 11) -> DataFrame:
    """Behaviour fingerprint of a signal: its ranks projected on seeded pseudo-random directions, one row of ``size`` numbers.
    The direction of an instrument and session comes from the bits of a hash, so that any two signals share it without a
    table; fingerprints are compared by :func:`likeness`."""
    own = scored.filter(F.col(score).isNotNull()).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "ts_code", session).cast("binary")))
    draw = lambda i: F.when(F.substring("_h", i + 1, 1) < "8", 1.0).otherwise(-1.0)
    return own.agg(F.array(*(F.sum((F.col(score) - 0.5) * draw(i)) / F.sqrt(F.count(F.lit(1))) for i in range(size))).alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Cosine of two fingerprints; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, e: s + e)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return dot(a, b) / F.when(size > 0, size)


def lasso_by_time(scored: DataFrame, order: str, xs: list[str], y: str, folds: int = 5, penalties: tuple[float, ...] = (1e-4, 3e-4, 1e-3, 3e-3, 1e-2), mixes: tuple[float, ...] = (1.0, 0.5)) -> tuple[dict[str, float], float, float]:
    """Elastic net whose penalty and mix are chosen on later data: (weights of standardised xs, penalty, mix).

    Sessions are cut into equal stretches; each penalty is fitted on all stretches before one and judged by the squared error on
    it. Spark sums products by stretch in one scan; fits are coordinate descent on k by k sums."""
    full = scored.select(order, *xs, y).dropna()
    span = full.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    if span["a"] is None:
        return dict.fromkeys(xs, 0.0), penalties[0], mixes[0]
    cols, wide = ["_1", *xs, y], (span["b"] - span["a"] + 1) / folds
    full = full.withColumns({"_1": F.lit(1.0), "_f": F.least(F.floor((F.col(order) - span["a"]) / wide), F.lit(folds - 1)).cast("int")})
    sums = full.groupBy("_f").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)).collect()
    k, per = len(cols), np.zeros((folds, len(cols), len(cols)))
    for r in sums:
        for i in range(k):
            for j in range(i, k):
                per[r["_f"], i, j] = per[r["_f"], j, i] = r[f"{i}_{j}"]

    def fit(m: np.ndarray, penalty: float, mix: float) -> np.ndarray:
        """Intercept and weights on the columns as they are."""
        n = m[0, 0]
        mu = m[0, 1:] / n
        c = m[1:, 1:] / n - np.outer(mu, mu)
        sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
        scale = np.where(sd > 1e-12, sd, 1.0)
        g, v, b = c[:-1, :-1] / np.outer(scale, scale), c[:-1, -1] / scale, np.zeros(k - 2)
        for _ in range(1000):
            old = b.copy()
            for i in range(k - 2):
                if sd[i] > 1e-12:
                    rest = v[i] - g[i] @ b + g[i, i] * b[i]
                    b[i] = np.sign(rest) * max(abs(rest) - penalty * mix, 0) / (g[i, i] + penalty * (1 - mix))
            if np.abs(b - old).max(initial=0) < 1e-12:
                break
        w = b / scale
        return np.concatenate([[mu[-1] - w @ mu[:-1]], w])

    def error(m: np.ndarray, w: np.ndarray) -> float:
        u = np.append(w, -1.0)
        return float(u @ m @ u)

    def judged(penalty: float, mix: float) -> float:
        ready = [f for f in range(1, folds) if per[:f, 0, 0].sum() > k and per[f, 0, 0] > 0]
        return sum(error(per[f], fit(per[:f].sum(0), penalty, mix)) for f in ready)

    best = min(((judged(p, m), -p, m) for p in penalties for m in mixes))
    whole = per.sum(0)
    w = fit(whole, -best[1], best[2])[1:]
    sd = np.sqrt(np.maximum(np.diag(whole)[1:-1] / whole[0, 0] - (whole[0, 1:-1] / whole[0, 0]) ** 2, 0))
    return dict(zip(xs, (w * sd).tolist())), -best[1], best[2]


def survivorship(panel: DataFrame, session: str, key: str, value: str) -> DataFrame:
    """First and last session, count, and share of sessions in the lowest tenth of ``value`` by session, of each key."""
    own = panel.filter(F.col(value).isNotNull())
    own = own.withColumn("_p", F.percent_rank().over(Window.partitionBy(session).orderBy(value)))
    return own.groupBy(key).agg(F.min(session).alias("first"), F.max(session).alias("last"), F.count(F.lit(1)).alias("n"), F.avg((F.col("_p") < 0.1).cast("double")).alias("fragile"))


def exposure(holdings: DataFrame, session: str, group: str, weight: str) -> DataFrame:
    """Weight of each group by session and its change from the group's last session."""
    own = holdings.groupBy(session, group).agg(F.sum(weight).alias("weight"))
    return own.withColumn("drift", F.col("weight") - F.lag("weight").over(Window.partitionBy(group).orderBy(session)))


def market_crowding(panel: DataFrame, session: str, amount: str, top: float = 0.05, n: int = 20) -> DataFrame:
    """Share of the amount that the most traded ``top`` of the names took, and its trailing mean."""
    w = Window.partitionBy(session)
    own = panel.filter(F.col(amount).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(F.col(amount).desc(), "ts_code"))).withColumn("_n", F.count(F.lit(1)).over(w))
    per = own.groupBy(session).agg((F.sum(F.when(F.col("_r") <= F.greatest(F.ceil(F.col("_n") * top), F.lit(1)), F.col(amount))) / F.when(F.sum(amount) != 0, F.sum(amount))).alias("share"))
    frame = Window.orderBy(session).rowsBetween(-(n - 1), 0)  # one row a session
    return per.withColumn("crowding", F.when(F.count("share").over(frame) == n, F.avg("share").over(frame)))


def doability(panel: DataFrame, session: str, ret: str, n: int = 60) -> DataFrame:
    """Dispersion of returns, concentration of gains and share of the best tenth by session, with a trailing z of the dispersion."""
    w = Window.partitionBy(session)
    own = panel.filter(F.col(ret).isNotNull()).withColumn("_g", F.greatest(F.col(ret), F.lit(0.0)))
    own = own.withColumns({"_r": F.row_number().over(w.orderBy(F.col(ret).desc(), "ts_code")), "_n": F.count(F.lit(1)).over(w)})
    total = F.when(F.sum("_g") > 0, F.sum("_g"))
    per = own.groupBy(session).agg(F.stddev_samp(ret).alias("dispersion"), (F.sum(F.col("_g") * F.col("_g")) / (total * total)).alias("hhi"), (F.sum(F.when(F.col("_r") <= F.ceil(F.col("_n") * 0.1), F.col("_g"))) / total).alias("head"))
    frame = Window.orderBy(session).rowsBetween(-(n - 1), 0)
    z = (F.col("dispersion") - F.avg("dispersion").over(frame)) / F.when(F.stddev_samp("dispersion").over(frame) > 1e-12, F.stddev_samp("dispersion").over(frame))
    return per.withColumn("z", F.when(F.count("dispersion").over(frame) == n, z))


def walk_forward_ridge(scored: DataFrame, order: str, xs: list[str], y: str, train: int, embargo: int, every: int, ridge: float = 1.0) -> DataFrame:
    """Out-of-sample ridge predictions: each block of ``every`` sessions is predicted from the ``train`` sessions that end
    ``embargo`` before it. Moments are summed by session in Spark; a fit is k by k. (``ts_code``, order, ``prediction``)."""
    own = scored.dropna(subset=xs)
    full = own.filter(F.col(y).isNotNull())
    cols = [*xs, "_1"]
    full = full.withColumn("_1", F.lit(1.0))
    sums = full.groupBy(order).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j), *(F.sum(F.col(a) * F.col(y)).alias(f"y_{i}") for i, a in enumerate(cols)))
    per = sums.orderBy(order).toPandas()  # one row a session
    if not len(per):
        return scored.sparkSession.createDataFrame([], f"ts_code string, `{order}` int, prediction double")
    k, first, last = len(cols), int(per[order].min()), int(per[order].max())
    fits = []
    for at in range(first + train + embargo, last + 1, every):
        block = per[(per[order] >= at - embargo - train) & (per[order] < at - embargo)]
        if not len(block):
            continue
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = block[f"{i}_{j}"].sum()
        penal = ridge * np.eye(k)
        penal[-1, -1] = 0
        fits.append((at, [float(b) for b in np.linalg.lstsq(m + penal, np.array([block[f"y_{i}"].sum() for i in range(k)]), rcond=None)[0]]))
    if not fits:
        return scored.sparkSession.createDataFrame([], f"ts_code string, `{order}` int, prediction double")
    betas = scored.sparkSession.createDataFrame(fits, "_at int, _b array<double>")
    slot = first + train + embargo + F.floor((F.col(order) - (first + train + embargo)) / every) * every
    met = own.withColumn("_at", slot.cast("int")).join(betas, "_at")
    value = F.col("_b")[k - 1]
    for i, x in enumerate(xs):
        value = value + F.col("_b")[i] * F.col(x)
    return met.select("ts_code", order, value.alias("prediction"))


def walk_forward_trees(scored: DataFrame, order: str, xs: list[str], y: str, train: int, embargo: int, every: int, trees: int) -> DataFrame:
    """Out-of-sample predictions of gradient-boosted trees of depth 3: each block of ``every`` sessions is predicted from all
    sessions that end ``embargo`` before it, ``train`` at least. (``ts_code``, order, ``prediction``)."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    spark = scored.sparkSession
    data = VectorAssembler(inputCols=xs, outputCol="_x").transform(scored.dropna(subset=xs)).select("ts_code", order, "_x", F.col(y).alias("_y"))
    full = data.dropna(subset=["_y"])
    first, last = (full.agg(F.min(order)).first()[0], data.agg(F.max(order)).first()[0])

    def block(at: int) -> DataFrame | None:
        past = full.filter(F.col(order) < at - embargo)
        if past.isEmpty():
            return None
        model = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=3, stepSize=0.05, seed=7).fit(past)
        return model.transform(data.filter((F.col(order) >= at) & (F.col(order) < at + every))).select("ts_code", order, "prediction")

    starts = range(first + train + embargo, last + 1, every) if first is not None else ()
    with ThreadPool(4) as pool:  # the fits don't depend on each other
        parts = [p for p in pool.map(inheritable_thread_target(spark)(block), starts, 1) if p is not None]
    if not parts:
        return spark.createDataFrame([], f"ts_code string, `{order}` int, prediction double")
    return functools.reduce(DataFrame.unionByName, parts)


def double_ml(scored: DataFrame, session: str, y: str, x: str, controls: list[str]) -> DataFrame:
    """Partial-linear effect of x on y given controls: both residualised by session, then one slope. One row (``n``, ``effect``, ``t``)."""
    a = residual_on(scored, session, y, controls).select("ts_code", session, F.col("residual").alias("_a"))
    b = residual_on(scored, session, x, controls).select("ts_code", session, F.col("residual").alias("_b"))
    met = a.join(b, ["ts_code", session]).dropna()
    effect = F.sum(F.col("_a") * F.col("_b")) / F.when(F.sum(F.col("_b") * F.col("_b")) > 0, F.sum(F.col("_b") * F.col("_b")))
    out = met.agg(F.count(F.lit(1)).alias("n"), effect.alias("effect"), F.sum(F.col("_b") * F.col("_b")).alias("_s"), F.sum(F.col("_a") * F.col("_a")).alias("_y"))
    noise = F.sqrt((F.col("_y") - F.col("effect") * F.col("effect") * F.col("_s")) / (F.col("n") - 2) / F.col("_s"))
    return out.withColumn("t", F.when(noise > 0, F.col("effect") / noise)).drop("_s", "_y")


def regimes_by_mixture(values: np.ndarray, states: tuple[int, ...] = (3, 4, 5), rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian hidden Markov states of a session series (one number a session): (state of each session by the forward-backward
    pass, means), the number of states by the Bayesian information criterion. States are ordered by mean."""
    best = None
    for k in states:
        mean, sd = np.quantile(values, (np.arange(k) + 0.5) / k), np.full(k, values.std() + 1e-9)
        move, start = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), np.full(k, 1 / k)
        for _ in range(rounds):
            like = np.exp(-0.5 * ((values[:, None] - mean) / sd) ** 2) / sd + 1e-300
            a, c = np.zeros_like(like), np.zeros(len(values))
            for t in range(len(values)):
                a[t] = (start if t == 0 else a[t - 1] @ move) * like[t]
                c[t] = a[t].sum()
                a[t] /= c[t]
            b = np.ones_like(like)
            for t in range(len(values) - 2, -1, -1):
                b[t] = move @ (like[t + 1] * b[t + 1]) / c[t + 1]
            g = a * b
            g /= g.sum(1, keepdims=True)
            x = (a[:-1].T @ (like[1:] * b[1:] / c[1:, None])) * move
            move, start = x / x.sum(1, keepdims=True), g[0]
            mean = (g * values[:, None]).sum(0) / g.sum(0)
            sd = np.sqrt((g * (values[:, None] - mean) ** 2).sum(0) / g.sum(0)) + 1e-6
        score = np.log(c).sum() - 0.5 * (k * k + 2 * k - 1) * np.log(len(values))
        if best is None or score > best[0]:
            order = np.argsort(mean)
            best = score, np.argsort(order)[g.argmax(1)], mean[order]
    return best[1], best[2]


def decay_alerts(ic: DataFrame, order: str, value: str, recent: int = 20, drop: float = 0.5) -> DataFrame:
    """Sessions at which the mean of the last ``recent`` values is below ``drop`` times the mean of all before them."""
    w = Window.orderBy(order)  # one row a session
    now, past = w.rowsBetween(-(recent - 1), 0), w.rowsBetween(Window.unboundedPreceding, -recent)
    own = ic.filter(F.col(value).isNotNull()).withColumns({"now": F.avg(value).over(now), "past": F.avg(value).over(past), "_n": F.count(value).over(past)})
    return own.filter((F.col("_n") >= recent) & (F.abs("past") > 1e-12)).select(order, "now", "past", (F.col("now") / F.col("past") < drop).alias("alert"))


