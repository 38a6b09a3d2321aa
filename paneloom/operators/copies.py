"""Differences between two copies of a data set, found by comparing checksums of key ranges.

Keys are spread over a ring of 64-bit hashes, so that a key range holds about as many rows as any other however skewed
the keys are. A round takes the checksums (row count and xor of row hashes) of the parts of each open range on both
sides and keeps the parts that differ; the rows of the leaves that remain are compared field by field. Checksums are
taken of values rounded to a fifth of the tolerance: values further apart than the tolerance never share a checksum, values closer than that at worst open a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..session import written

FANOUT_BITS = 8


def _canonical(df: DataFrame, keys: Sequence[str], fields: Mapping[str, float]) -> DataFrame:
    """One row for each key: key columns, fields, ring position and row hash."""
    one = df.groupBy(*keys).agg(*(F.max(finite(f)).alias(f) for f in fields))
    marks = [F.coalesce(F.round(F.col(f) * (5.0 / tol)).cast("decimal(38,0)").cast("string"), F.lit("-")) for f, tol in fields.items()]
    ring = F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys))
    return one.withColumn("_ring", ring).withColumn("_sum", F.xxhash64("_ring", *marks))


def _node(ring: Column, bits: int) -> Column:
    return F.shiftrightunsigned(ring, 64 - bits).cast("int") if bits else F.lit(0)


def mismatched_ranges(sides: DataFrame, bits: int) -> DataFrame:
    """Leaves (``_leaf``) in which the two copies differ. ``sides`` has the canonical rows of both, ``_s`` 1 or -1.

    Each round splits the ranges found so far into 2**FANOUT_BITS, takes the checksums of the parts on both sides (their
    difference in rows and xor, in one aggregate that is combined before the shuffle) and keeps the parts that differ.
    """
    open_, depth = None, 0
    while True:
        at = min(depth + FANOUT_BITS, bits)
        rows = sides.select(_node(F.col("_ring"), at).alias("_leaf"), "_s", "_sum")
        if open_ is not None:
            rows = rows.withColumn("_up", F.shiftright("_leaf", at - depth)).join(open_, "_up", "left_semi")
        found = rows.groupBy("_leaf").agg(F.sum("_s").alias("_dn"), F.bit_xor("_sum").alias("_dx"))
        found = written(found.filter((F.col("_dn") != 0) | (F.col("_dx") != 0)).select("_leaf"))
        if at == bits:
            return found
        open_, depth = found.withColumnRenamed("_leaf", "_up"), at


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Mapping[str, float], rows: int, leaf_rows: int = 64) -> DataFrame:
    """Columns ``keys``, ``field``, ``diff`` (``only_left``, ``only_right``, ``value``) of what two copies disagree on.

    ``fields`` gives each field's tolerance; ``rows`` is about how many rows a side has and sets the depth of the tree.
    A key that one side lacks gives one row for each field. Values differ if they are further apart than the tolerance
    or just one is null; NaN and infinities count as null. Repeated rows of a key count once, with the greatest value
    of each field. A null in a key is a key value like any other. An empty side makes all keys of the other ``only_``.
    Other columns are ignored, whatever their names.
    """
    keep = [*keys, *fields]
    bits = max(0, min(28, math.ceil(math.log2(max(1, rows / leaf_rows)))))
    tagged = [_canonical(df.select(*keep), keys, fields).withColumn("_s", F.lit(s)) for s, df in ((1, left), (-1, right))]
    sides = written(tagged[0].unionByName(tagged[1]))
    leaves = mismatched_ranges(sides, bits)
    rows_ = sides.withColumn("_leaf", _node(F.col("_ring"), bits)).join(leaves, "_leaf", "left_semi")
    met = rows_.groupBy(*keys).agg(
        F.sum("_s").alias("_in"),
        *(F.max(F.when(F.col("_s") == s, F.col(f))).alias(f"_{name}_{f}") for f in fields for s, name in ((1, "l"), (-1, "r"))),
    )

    def verdict(f: str, tol: float) -> Column:
        a, b = F.col(f"_l_{f}"), F.col(f"_r_{f}")
        return (
            F.when(F.col("_in") == 1, "only_left").when(F.col("_in") == -1, "only_right")
            .when(a.isNull() != b.isNull(), "value").when(F.abs(a - b) > tol, "value")
        )

    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), verdict(f, tol).alias("diff")) for f, tol in fields.items())))
    return met.select(*keys, each.alias("_d")).select(*keys, "_d.field", "_d.diff").filter(F.col("diff").isNotNull())
