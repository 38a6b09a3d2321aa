"""Filling of missing cells from similar records: k-prototypes clusters, medians or modes within a group's cluster.

Rows are clustered on their observed numeric features (standardised) and categorical features. Centres are a few rows of
numbers on the driver; each round is one scan of the features in Arrow batches and one aggregate of k rows.
A missing cell takes the median (mode) of its group's rows in its cluster, else of its group, else of its cluster. All
cells of a table share one fit and one written table of features, values and clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..session import written

#: Centres have settled when none moves farther than this, in standard deviations.
SETTLED = 0.05


@dataclass
class Cell:
    """A column to be filled: ``real`` is its value where it is a real one, else null; ``fillable`` says which missing cells are to
    be filled; ``scale`` is what values are proportional to, such as a price."""

    real: Column
    fillable: Column | None = None
    scale: Column | None = None


@dataclass
class Prototypes:
    """k centres: a list of numeric means and a list of modes for each."""

    numeric: list[str]
    categorical: list[str]
    mean: list[float]
    sd: list[float]
    centres: list[tuple[list[float], list[str | None]]] = field(default_factory=list)
    gamma: float = 0.5
    rounds: int = 0
    settled: bool = True

    def assign(self) -> Column:
        """Number of the nearest centre over the features that the row has; 0 where it has none."""
        options = []
        for i, (nums, cats) in enumerate(self.centres):
            parts = [F.coalesce(F.pow((F.col(f) - m) / s - c, 2), F.lit(0.0)) for f, m, s, c in zip(self.numeric, self.mean, self.sd, nums)]
            parts += [F.when(F.col(f).isNotNull() & (F.col(f) != F.lit(c)), self.gamma).otherwise(0.0) for f, c in zip(self.categorical, cats) if c is not None]
            options.append(F.struct(sum(parts, F.lit(0.0)).alias("d"), F.lit(i).alias("i")))
        return F.least(*options)["i"] if len(options) > 1 else F.lit(0)


def _moved(rows: DataFrame, fit: Prototypes) -> list[tuple[list[float], list[str | None]]]:
    """Centres after one round: means and modes of the rows nearest to each. Distances are taken in numpy: as column expressions
    with other numbers each round they would be compiled anew each round."""
    nums, cats, centres = fit.numeric, fit.categorical, fit.centres
    middle = np.array([c for c, _ in centres]).reshape(len(centres), len(nums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, counts = len(centres), {}
        sums, n = np.zeros((len(nums), k)), np.zeros((len(nums), k))
        for batch in batches:
            x = [(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) - m) / s for f, m, s in zip(nums, fit.mean, fit.sd)]
            codes = [batch.column(c).dictionary_encode() for c in cats]
            d = np.zeros((k, batch.num_rows))
            for v, own in zip(x, middle.T):
                d += np.nan_to_num((v - own[:, None]) ** 2)
            found = []
            for j, c in enumerate(codes):
                names, at = c.dictionary.to_pylist(), c.indices.fill_null(len(c.dictionary)).to_numpy()
                for i, (_, own) in enumerate(centres):
                    if own[j] is not None:
                        d[i] += fit.gamma * np.array([name != own[j] for name in names] + [False])[at]
                found.append((names, at))
            near = d.argmin(0)
            for f, v in enumerate(x):
                there = ~np.isnan(v)
                sums[f] += np.bincount(near[there], v[there], k)
                n[f] += np.bincount(near[there], minlength=k)
            for j, (names, at) in enumerate(found):
                for pair, times in zip(*np.unique(near * (len(names) + 1) + at, return_counts=True)):
                    i, v = divmod(int(pair), len(names) + 1)
                    if v < len(names):
                        counts[i, len(nums) + j, names[v]] = counts.get((i, len(nums) + j, names[v]), 0) + int(times)
        made = [(i, f, None, n[f, i], sums[f, i]) for f in range(len(nums)) for i in range(k)] + [(i, f, v, float(c), 0.0) for (i, f, v), c in counts.items()]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made), kinds)], names=["i", "f", "v", "n", "s"])

    summed = rows.mapInArrow(run, "i int, f int, v string, n double, s double").groupBy("i", "f", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = summed.filter("n > 0").groupBy("i", "f").agg(F.max_by(F.struct("v", F.col("s") / F.col("n")), F.struct("n", "v")).alias("to")).collect()
    new = [(list(c), list(m)) for c, m in centres]
    for r in best:
        if r["f"] < len(nums):
            new[r["i"]][0][r["f"]] = r["to"][1]
        else:
            new[r["i"]][1][r["f"] - len(nums)] = r["to"][0]
    return new


def fit_prototypes(rows: DataFrame, numeric: list[str], categorical: list[str], k: int, rounds: int) -> Prototypes:
    """k-prototypes over all rows: one scan for scale and start, then scans until no centre moves by SETTLED, at most ``rounds``
    (``Prototypes.settled`` says whether they did). Starts are joint quantiles, so that a fit is repeatable. An empty table
    gives one centre, as does one without features."""
    if not numeric and not categorical:
        return Prototypes([], [], [], [], [([], [])])
    at = [(i + 0.5) / k for i in range(k)]
    aggs = [a for f in numeric for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.percentile_approx(f, at, 1000).alias(f"q_{f}"))]
    first = rows.agg(F.count(F.lit(1)).alias("n"), *aggs, *(F.mode(c, True).alias(f"c_{c}") for c in categorical)).first()
    mean, sd = [first[f"m_{f}"] or 0.0 for f in numeric], [first[f"s_{f}"] or 1.0 for f in numeric]
    fit = Prototypes(numeric, categorical, mean, sd)
    starts = {
        tuple((first[f"q_{f}"][i] - m) / s if first[f"q_{f}"] else 0.0 for f, m, s in zip(numeric, mean, sd))
        for i in range(k)
    }
    fit.centres = [(list(s), [first[f"c_{c}"] for c in categorical]) for s in sorted(starts)]
    for fit.rounds in range(1, (rounds if first["n"] else 0) + 1):
        old, fit.centres = fit.centres, _moved(rows, fit)
        fit.settled = all(c == o and max((abs(x - y) for x, y in zip(n, m)), default=0.0) < SETTLED for (n, c), (m, o) in zip(fit.centres, old))
        if fit.settled:
            break
    return fit


def fill_from_similar(df: DataFrame, group: str, cells: dict[str, Cell], numeric: dict[str, Column], categorical: dict[str, Column], k: int = 6, rounds: int = 12) -> DataFrame:
    """``df`` with each column of ``cells`` filled and, for each, ``{name}_filled`` (boolean), ``{name}_method`` (``cluster``, ``group``,
    ``overall`` or null) and ``{name}_cluster`` (number of the row's cluster where it was filled).

    A string column is filled with modes, any other with medians. With a ``scale`` medians are taken of value/scale and
    multiplied back; rows without a positive scale take the plain median of the group. ``cluster`` and ``group`` mean that
    rows of the same group held real values, in the row's cluster or only elsewhere; ``overall`` that only other groups
    did, which needs a row of the same cluster; a null group has no rows of its own group. Cells that stay missing are
    null and unmarked; no row is dropped, repeated rows are kept and count in the medians. Medians are approximate
    (1 in 10,000). Columns of ``df`` may have any names.
    """
    feats = {f"_n{i}": finite(c) for i, c in enumerate(numeric.values())} | {f"_c{i}": c for i, c in enumerate(categorical.values())}
    made, kinds = {}, dict(df.dtypes)
    for i, (name, cell) in enumerate(cells.items()):
        made[f"_y{i}"] = cell.real
        made[f"_f{i}"] = cell.real.isNull() & (F.coalesce(cell.fillable, F.lit(True)) if cell.fillable is not None else F.lit(True))
        if cell.scale is not None:
            made[f"_u{i}"] = F.when(cell.scale > 0, cell.scale)
    rows = written(df.withColumns({"_g": F.col(group), **feats, **made}).drop(*cells))
    nums, cats = [f"_n{i}" for i in range(len(numeric))], [f"_c{i}" for i in range(len(categorical))]
    fit = fit_prototypes(rows.select(*nums, *cats), nums, cats, k, rounds)
    rows = rows.withColumn("_cl", fit.assign())
    asked = reduce(lambda a, b: a | b, (F.col(f"_f{i}") for i in range(len(cells))))
    out, columns, plain = rows.filter(asked), {}, {}  # the other rows are not shuffled
    for i, (name, cell) in enumerate(cells.items()):
        text, y, filled = kinds[name] == "string", f"_y{i}", f"_f{i}"
        scaled = lambda c, i=i: c if cells[list(cells)[i]].scale is None else c / F.col(f"_u{i}")
        back = lambda c, i=i: F.col(c) if cells[list(cells)[i]].scale is None else F.col(c) * F.col(f"_u{i}")
        held = rows.filter(F.col(y).isNotNull()).select("_g", "_cl", F.col(y).alias("_y"), scaled(F.col(y)).alias("_z"))
        middle = (lambda c: F.mode(c, True)) if text else (lambda c: F.percentile_approx(c, 0.5, 10_000))
        keyed = held.filter(F.col("_g").isNotNull())
        near = keyed.groupBy("_g", "_cl").agg(middle("_z").alias(f"_near{i}")).withColumn(filled, F.lit(True))
        own = keyed.groupBy("_g").agg(F.count("_y").alias(f"_held{i}"), middle("_z").alias(f"_own{i}"), middle("_y").alias(f"_plain{i}")).withColumn(filled, F.lit(True))
        over = held.groupBy("_cl").agg(middle("_z").alias(f"_over{i}")).withColumn(filled, F.lit(True))  # k rows
        # rows that aren't to be filled have no partner
        out = out.join(near, ["_g", "_cl", filled], "left").join(own, ["_g", filled], "left").join(F.broadcast(over), ["_cl", filled], "left")
        new = F.coalesce(back(f"_near{i}"), back(f"_own{i}"), F.col(f"_plain{i}"), back(f"_over{i}"))
        method = F.when(F.col(f"_held{i}") > 0, F.when(back(f"_near{i}").isNotNull(), "cluster").otherwise("group")).when(back(f"_over{i}").isNotNull(), "overall")
        none = F.lit(None).cast
        plain |= {name: F.col(y).cast(kinds[name]), f"{name}_filled": F.lit(False), f"{name}_method": none("string"), f"{name}_cluster": none("int")}
        columns |= {name: F.coalesce(new, F.col(y)).cast(kinds[name]), f"{name}_filled": method.isNotNull(), f"{name}_method": method, f"{name}_cluster": F.when(method.isNotNull(), F.col("_cl"))}
    marks = [c for c in columns if c not in cells]
    whole = lambda d, of: d.select(*(of[c].alias(c) if c in cells else F.col(f"`{c}`") for c in df.columns), *(of[c].alias(c) for c in marks))
    return whole(out, columns).unionByName(whole(rows.filter(~asked), plain))


def held_out_error(df: DataFrame, keys: list[str], group: str, name: str, cell: Cell, numeric: dict[str, Column], categorical: dict[str, Column], share: float = 0.1, **fit: int) -> DataFrame:
    """One row: (``hidden``, ``cluster_error``, ``group_error``), how well known cells are found again. A ``share`` of the real values of
    ``name``, drawn by a hash of the row's ``keys``, is hidden and filled from the group's cluster and from the group alone; the
    errors are mean absolute differences relative to the value (of a string column: shares of wrong fills)."""
    drawn = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = df.withColumns({"_true": cell.real, "_hide": drawn & cell.real.isNotNull()})
    ask = Cell(F.when(~F.col("_hide"), cell.real), F.col("_hide"), cell.scale)
    wrong = (F.col(name) != F.col("_true")).cast("double") if dict(df.dtypes)[name] == "string" else F.abs(F.col(name) - F.col("_true")) / F.abs("_true")
    parts = []
    for label, nums, cats in (("cluster_error", numeric, categorical), ("group_error", {}, {})):
        filled = fill_from_similar(rows, group, {name: ask}, nums, cats, **fit).filter(F.col("_hide") & F.col(f"{name}_method").isin("cluster", "group"))
        parts.append(filled.agg(F.count(F.lit(1)).alias("hidden"), F.avg(F.nanvl(wrong, F.lit(None))).alias(label)))
    return parts[0].join(parts[1].drop("hidden").withColumn("_one", F.lit(1)), F.col("_one") == 1, "left").drop("_one")
