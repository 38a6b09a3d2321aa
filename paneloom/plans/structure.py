"""Structure of expressions: skeletons, fingerprints, duplicates, edits."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .nodes import Node

WINDOW_CHOICES = (3, 5, 10, 20, 40, 60, 120)
SYMMETRIC = {"add", "mul", "max2", "min2", "eq", "ne", "and", "or"}


def skeleton(node: Node) -> str:
    """The expression without constants and windows; arguments of symmetric operators in one order."""
    if node.op == "field":
        return node.par[0]
    if node.op == "const":
        return "#"
    parts = [skeleton(a) for a in node.args]
    return f"{node.op}({','.join(sorted(parts) if node.op in SYMMETRIC else parts)})"


def subtree_fingerprints(node: Node) -> set[str]:
    return {hashlib.sha256(skeleton(n).encode()).hexdigest()[:16] for n in node.walk() if n.args}


def similarity(a: Node, b: Node) -> float:
    """Jaccard similarity of the subtrees."""
    x, y = subtree_fingerprints(a), subtree_fingerprints(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def library(spark: SparkSession, named: dict[str, Node]) -> DataFrame:
    """(name, skeleton, size, depth, lookback, fingerprint of each subtree): a library as a table to scan and join."""
    rows = [(n, skeleton(x), x.size, x.depth, x.lookback, sorted(subtree_fingerprints(x))) for n, x in named.items()]
    return spark.createDataFrame(rows, "name string, skeleton string, size int, depth int, lookback int, subtrees array<string>")


def near_duplicates(lib: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of a library whose subtrees overlap by at least ``least``: an equi-join on subtrees, no cross join. Subtrees that
    all expressions share still join only where they occur."""
    each = lib.select("name", F.size("subtrees").alias("n"), F.explode("subtrees").alias("sub"))
    met = each.alias("a").join(each.alias("b"), F.expr("a.sub = b.sub and a.name < b.name"))
    met = met.groupBy(F.col("a.name").alias("one"), F.col("b.name").alias("other"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).agg(F.count(F.lit(1)).alias("shared"))
    return met.withColumn("similarity", F.col("shared") / (F.col("x") + F.col("y") - F.col("shared"))).filter(F.col("similarity") >= least).select("one", "other", "similarity")


def _replaced(node: Node, old: Node, new: Node) -> Node:
    if node is old or node == old:
        return new
    return Node(node.op, tuple(_replaced(a, old, new) for a in node.args), node.par)


def edits(node: Node, fields: Iterable[str]) -> list[tuple[str, Node]]:
    """All single edits: another window, another field, an operator swapped, a wrap around the root, an unwrap of it."""
    out: list[tuple[str, Node]] = []
    swaps = {"mean": "median", "min": "max", "max": "min", "add": "sub", "sub": "add", "mul": "div", "div": "mul", "xrank": "xrank_mid"}
    for n in dict.fromkeys(node.walk()):
        if n.op == "field":
            out += [("field", _replaced(node, n, Node("field", (), (f,)))) for f in fields if f != n.par[0]]
        elif n.par and isinstance(n.par[0], int) and not isinstance(n.par[0], bool):
            for w in WINDOW_CHOICES:
                if w != n.par[0]:
                    par = (w, min(n.par[1], w) if n.par[1] != n.par[0] else w, *n.par[2:]) if len(n.par) > 1 else (w,)
                    out.append(("window", _replaced(node, n, Node(n.op, n.args, par))))
        if n.op in swaps:
            out.append(("operator", _replaced(node, n, Node(swaps[n.op], n.args, n.par))))
    out += [("wrap", Node(o, (node,))) for o in ("neg", "xrank")]
    out += [("unwrap", a) for a in node.args if a.args]
    return out


def crossover(a: Node, b: Node, rng: random.Random) -> Node:
    """``a`` with one of its subtrees replaced by one of ``b``."""
    return _replaced(a, rng.choice([n for n in a.walk() if n.args or n.op == "field"]), rng.choice([n for n in b.walk() if n.op != "const"]))
