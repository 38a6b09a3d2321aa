"""Choosing among factors: validation in stages, screening by clusters, stacking by beam search. Series and correlations come from
Spark; what is chosen from are a few names and k by k numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import statistics as S


def correlations(scored: DataFrame, session: str, names: list[str], least: int) -> np.ndarray:
    """Mean rank correlation of each pair by session, as a matrix; 0 where no session has enough pairs."""
    m = np.eye(len(names))
    for one, other, value in S.correlation_matrix(scored, session, sorted(names), least).select("one", "other", "correlation").collect():  # k (k - 1) / 2 rows
        i, j = names.index(one), names.index(other)
        m[i, j] = m[j, i] = value or 0.0
    return m


def merged_clusters(gap: np.ndarray, most: float) -> list[list[int]]:
    """Ward clusters of a k by k distance matrix: the two whose merger adds least are merged while that is at most ``most``."""
    square, members = gap.astype(float) ** 2, [[i] for i in range(len(gap))]
    while len(members) > 1:
        pairs = [(square[i, j], i, j) for i in range(len(members)) for j in range(i + 1, len(members))]
        least, i, j = min(pairs)
        if math.sqrt(max(least, 0.0)) > most:
            break
        a, b = len(members[i]), len(members[j])
        for x in range(len(members)):
            if x not in (i, j):
                c = len(members[x])
                square[i, x] = square[x, i] = ((a + c) * square[i, x] + (b + c) * square[j, x] - c * least) / (a + b + c)
        members[i] = sorted(members[i] + members[j])
        del members[j]
        square = np.delete(np.delete(square, j, 0), j, 1)
    return members


def three_stage_screen(icir: dict[str, float], corr: np.ndarray, windows: dict[str, list[float]], least: float = 0.1, most: float = 0.5, hits: float = 0.6) -> dict[str, str]:
    """Name -> ``kept`` or the stage that drops it: ``weak`` (absolute information ratio below ``least``), ``cluster`` (another of its
    Ward cluster on 1 - |correlation| is stronger), ``unstable`` (the mean's sign holds in fewer than ``hits`` of the windows)."""
    names = list(icir)
    out = {n: "weak" for n in names}
    strong = [i for i, n in enumerate(names) if abs(icir[n]) >= least]
    if not strong:
        return out
    for members in merged_clusters(1 - np.abs(corr[np.ix_(strong, strong)]), most):
        own = [names[strong[i]] for i in members]
        best = max(own, key=lambda n: (abs(icir[n]), n))
        for n in own:
            agree = np.mean([w * icir[n] > 0 for w in windows[n]]) if windows[n] else 0.0
            out[n] = "cluster" if n != best else "kept" if agree >= hits else "unstable"
    return out


def beam_stack(corr: np.ndarray, with_label: np.ndarray, n: int, width: int = 3, most: int = 5) -> tuple[list[int], float]:
    """Factors whose joint regression on the label has the least BIC, by beam search: sets grow by one factor, the best ``width`` of
    each size go on. All from correlations of standardised columns over ``n`` rows; (sorted indices, BIC)."""

    def bic(own: tuple[int, ...]) -> float:
        a = corr[np.ix_(own, own)] + 1e-9 * np.eye(len(own))
        explained = float(with_label[list(own)] @ np.linalg.solve(a, with_label[list(own)]))
        return n * math.log(max(1 - explained, 1e-12)) + len(own) * math.log(n)

    best, found, beam = 0.0, (), [()]
    for _ in range(min(most, len(with_label))):
        grown = {tuple(sorted((*own, i))) for own in beam for i in range(len(with_label)) if i not in own}
        beam = sorted(grown, key=lambda own: (bic(own), own))[:width]
        if beam and bic(beam[0]) < best:
            best, found = bic(beam[0]), beam[0]
    return list(found), best


STAGES = ("fast", "library", "duplicate", "replaced", "joint", "significance")


def validated(ics: DataFrame, corr: np.ndarray, names: list[str], pool: list[str], skeletons: dict[str, str], least: float = 0.01, sections: int = 30, near: float = 0.7, alpha: float = 0.05) -> dict[str, tuple[str, float, float]]:
    """Candidates (``names`` without ``pool``) through six stages: name -> (first stage failed or ``passed``, mean, p).

    ``ics`` has (``factor``, ``ic``), one row a factor and session. ``fast``: fewer ``sections`` or a smaller absolute mean than ``least``.
    ``library``: a pool factor correlates by ``near`` and is at least as strong. ``duplicate``: an earlier candidate has the same
    skeleton. ``replaced``: a stronger candidate correlates by ``near``. ``joint``: together the chosen leave nothing of it (a partial
    correlation with none left). ``significance``: Benjamini-Hochberg at ``alpha`` over the rest."""
    s = {r[0]: r[1:] for r in ics.groupBy("factor").agg(F.count("ic"), F.avg("ic"), F.stddev_samp("ic")).collect()}  # k rows
    n, mean, sd = ({f: (s[f][j] if f in s and s[f][j] is not None else 0.0) for f in names} for j in range(3))
    t = {f: mean[f] / sd[f] * math.sqrt(n[f]) if sd[f] > 1e-12 else 0.0 for f in names}
    p = {f: math.erfc(abs(t[f]) / math.sqrt(2)) for f in names}
    near_to = lambda a, b: abs(corr[names.index(a), names.index(b)]) >= near
    failed: dict[str, str] = {}
    todo = [f for f in names if f not in pool]
    for f in todo:
        if n[f] < sections or abs(mean[f]) < least:
            failed[f] = "fast"
        elif any(near_to(f, q) and abs(t[q]) >= abs(t[f]) for q in pool):
            failed[f] = "library"
        elif any(skeletons[f] == skeletons[g] for g in todo[: todo.index(f)] if g not in failed):
            failed[f] = "duplicate"
    left = [f for f in todo if f not in failed]
    for f in left:
        if any(g != f and near_to(f, g) and (abs(t[g]), g) > (abs(t[f]), f) for g in left):
            failed[f] = "replaced"
    left = sorted((f for f in left if f not in failed), key=lambda f: (-abs(t[f]), f))
    held: list[str] = []
    for f in left:
        at = [names.index(g) for g in held]
        i = names.index(f)
        beta = np.linalg.lstsq(corr[np.ix_(at, at)], corr[at, i], rcond=None)[0] if at else np.zeros(0)
        if 1 - float(beta @ corr[at, i]) < 0.1:
            failed[f] = "joint"
        else:
            held.append(f)
    order = sorted(held, key=lambda f: (p[f], f))
    passed = max((k + 1 for k, f in enumerate(order) if p[f] <= alpha * (k + 1) / len(order)), default=0)
    failed |= dict.fromkeys(order[passed:], "significance")
    return {f: (failed.get(f, "passed"), mean[f], p[f]) for f in todo}
