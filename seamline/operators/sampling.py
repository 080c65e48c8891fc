"""Samples that depend on keys alone: blocks by position and exact k-samples per stratum by hash."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import floor
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the position column that rows are counted and numbered by, so that no task numbers a whole table.
PARTS = 1024


def _taken(df: DataFrame, order: str, spans: Callable[[int], list[tuple[str | int, int, int]]]) -> DataFrame:
    """The rows at the positions [lo, hi) of spans(number of rows), which are (block, lo, hi), with their `block`.

    Positions go from 0 in the order of a unique, non-null integer column; rows with a null order are left out. Values are
    cut into PARTS ranges of equal width, which the driver counts (PARTS numbers); only ranges that hold a part of a span
    are read again, numbered and joined to the spans, so the cost follows the sample. Ranges are as even as the values.
    """
    spark = df.sparkSession
    edge = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    kind = "int" if not spans(0) or isinstance(spans(0)[0][0], int) else "string"
    if edge["lo"] is None:
        return df.limit(0).withColumn("block", F.lit(None).cast(kind))
    width = (edge["hi"] - edge["lo"]) // PARTS + 1
    part = F.floor((F.col(order) - F.lit(edge["lo"])) / F.lit(width))
    counts = {r["part"]: r["n"] for r in df.filter(F.col(order).isNotNull()).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = [(b, lo, hi) for b, lo, hi in spans(sum(counts.values())) if hi > lo]
    rows, before = [], 0
    for p in sorted(counts):
        rows += [(p, before, b, lo, hi) for b, lo, hi in wanted if lo < before + counts[p] and hi > before]
        before += counts[p]
    if not rows:
        return df.limit(0).withColumn("block", F.lit(None).cast(kind))
    held = sorted({p for p, *_ in rows})
    firsts = [p for k, p in enumerate(held) if not k or held[k - 1] != p - 1]
    lasts = [p for k, p in enumerate(held) if k + 1 == len(held) or held[k + 1] != p + 1]
    ranges = [(F.col(order) >= edge["lo"] + p * width) & (F.col(order) < edge["lo"] + (q + 1) * width) for p, q in zip(firsts, lasts, strict=True)]
    ranges = reduce(or_, ranges)  # at most as many as spans; they reach the scan
    blocks = F.broadcast(spark.createDataFrame(rows, f"_part long, _before long, block {kind}, _lo long, _hi long"))  # spans and PARTS at most
    d = df.filter(ranges).withColumn("_part", part).withColumn("_pos", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    d = d.join(blocks, "_part").withColumn("_pos", F.col("_pos") + F.col("_before")).filter("_pos >= _lo and _pos < _hi")
    return d.drop("_part", "_before", "_pos", "_lo", "_hi")


def block_sample(df: DataFrame, order: str, limit: int, blocks: int) -> DataFrame:
    """limit // blocks rows at each of `blocks` evenly spaced positions, with their `block`; a remainder is dropped.

    Blocks are spans of rows // blocks; a block never reads into the next one. With fewer rows than blocks the result is
    empty.
    """
    each = limit // blocks
    return _taken(df, order, lambda n: [(k, k * (n // blocks), k * (n // blocks) + min(each, n // blocks)) for k in range(blocks)])


def three_blocks(df: DataFrame, order: str, size: int, slack: float = 1.20) -> DataFrame:
    """Head, middle and tail blocks of `size` rows; the tail starts `size * slack` rows before the end. Blocks of a small
    table overlap, and a row in several of them comes out with each."""
    at = lambda n: {"head": 0, "middle": n // 2, "tail": max(floor(n - size * slack), 0)}
    return _taken(df, order, lambda n: [(name, lo, min(lo + size, n)) for name, lo in at(n).items()])


def stratified(df: DataFrame, strata: list[str], key: Column, k: int, seed: str) -> DataFrame:
    """k rows of each stratum, every set of k equally likely: those with the smallest hash of seed and key.

    `rank` is the place in that order. Each task keeps k rows of a stratum before they are gathered.
    """
    h = F.md5(F.concat(F.lit(seed), F.lit("|"), key))
    w = Window.partitionBy(*strata).orderBy("_h", key)
    return df.withColumn("_h", h).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_h")


def shuffled(df: DataFrame, key: Column, seed: str) -> DataFrame:
    """`df` sorted by a hash of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.lit("|"), key)), key)
