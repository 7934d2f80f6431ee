"""Missingness patterns: which observations each cell has, as chunked bitmaps; X'X once a pattern; patterns of batches merged.

A pattern is the set of observations with a reading that is not missing. It is held as bitmaps of 32,768 observations each,
built by bit aggregates, so a reading that comes twice counts once; equal bitmaps are equal sets, nothing is hashed. Bitmaps
are merged before the shuffle. Observation numbers are whole numbers and not null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridols.operators.clean import attach_design
from gridols.operators.products import packed, pairs
from gridols.operators.ranking import numbered
from gridols.sources.folders import kept


def cell_bits(rows: DataFrame) -> DataFrame:
    """(cell, bits, n): each cell's observed observations as an array of (chunk, bitmap), and how many they are."""
    seen = rows.where("y <> 0").groupBy("cell", F.bitmap_bucket_number("obs").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("obs")).alias("bitmap"))
    return seen.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("chunk", "bitmap"))).alias("bits"), F.sum(F.bitmap_count("bitmap")).alias("n"))


def dictionary(bits: DataFrame) -> DataFrame:
    """(pattern_id, bits, n): the different patterns, numbered by their first cell from 1."""
    first = bits.groupBy("bits").agg(F.min("cell").alias("first"), F.min("n").alias("n"))
    return numbered(first, "first", "pattern_id").select("pattern_id", "bits", "n")


def patterns(rows: DataFrame) -> DataFrame:
    """(cell, pattern_id, n): cells with the same n observed observations share a pattern."""
    bits = kept(cell_bits(rows), "bits")
    return bits.drop("n").join(dictionary(bits), "bits").select("cell", "pattern_id", "n")


def members(patterns_of: DataFrame) -> DataFrame:
    """(pattern_id, obs) of (pattern_id, bits): the observations of each pattern."""

    def run(batches):
        for b in batches:
            for pattern, chunks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c in chunks:
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(c["bitmap"], np.uint8), bitorder="little"))
                    # numbers above 0 begin at 1 in chunk 1, the others count down from 0 in chunk 0
                    obs = (c["chunk"] - 1) * 32768 + at + 1 if c["chunk"] > 0 else c["chunk"] * 32768 - at
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(obs), pattern)), pa.array(obs.astype(np.int64))], ["pattern_id", "obs"])

    return patterns_of.select("pattern_id", "bits").mapInArrow(run, "pattern_id long, obs long")


def pattern_products(patterns_of: DataFrame, design: DataFrame, xs: list[str]) -> DataFrame:
    """(pattern_id, xx_0_0, ...): X'X of each pattern's observations."""
    spread = attach_design(members(patterns_of), design.select("obs", *xs))
    return spread.groupBy("pattern_id").agg(*(F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"xx_{i}_{j}") for i, j in pairs(len(xs))))


def forms_by_pattern(rows: DataFrame, design: DataFrame, xs: list[str]) -> DataFrame:
    """Product forms with X'X computed once a pattern and looked up by cell: pays where patterns are far fewer than cells.

    The readings are read once: bitmaps and the sums of y come from one aggregate. A reading that comes twice counts once in
    n and X'X, and twice in the sums of y.
    """
    p = len(xs)
    y = F.col("y")
    sums = [F.count("*").alias("n_rows"), *(F.sum(F.col(x) * y).alias(f"xy_{i}") for i, x in enumerate(xs)), F.sum(y * y).alias("yty")]
    chunk = rows.groupBy("cell", F.bitmap_bucket_number("obs").alias("chunk")).agg(F.bitmap_construct_agg(F.when(y != 0, F.bitmap_bit_position("obs"))).alias("bitmap"), *sums)
    some = F.when(F.bitmap_count("bitmap") > 0, F.struct("chunk", "bitmap"))
    added = [F.sum(c).alias(c) for c in ("n_rows", *(f"xy_{i}" for i in range(p)), "yty")]
    own = kept(chunk.groupBy("cell").agg(F.sort_array(F.collect_list(some)).alias("bits"), F.sum(F.bitmap_count("bitmap")).alias("n"), *added), "cells")
    known = kept(dictionary(own.where("n > 0")), "patterns")
    xx = pattern_products(known, design, xs)
    return packed(own.join(known.drop("n"), "bits").join(xx, "pattern_id"), ["cell", "pattern_id"], p)


def batch_forms(rows: DataFrame, design: DataFrame, xs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells (cell, pattern_id), dictionary (pattern_id, n, xtx)) of one batch of observations."""
    bits = kept(cell_bits(rows), "bits")
    known = kept(dictionary(bits), "patterns")
    p, xx = len(xs), pattern_products(known, design, xs)
    full = F.array(*(F.col(f"xx_{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)))
    return bits.join(known, "bits").select("cell", "pattern_id"), known.join(xx, "pattern_id").select("pattern_id", "n", full.alias("xtx"))


def combine_patterns(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cell, pattern_id) of two batches' pattern maps together: cells alike in both batches share a number; 0 is absence."""
    cells, pairs_of = paired(a, b)
    return cells.join(pairs_of.select("pa", "pb", "pattern_id"), ["pa", "pb"]).select("cell", "pattern_id")


def paired(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cell, pa, pb), (pa, pb, pattern_id)): each cell's patterns in two batches, and the different pairs, numbered by their first cell."""
    both = a.select("cell", F.col("pattern_id").alias("pa")).join(b.select("cell", F.col("pattern_id").alias("pb")), "cell", "full").fillna(0, ["pa", "pb"])
    return both, numbered(both.groupBy("pa", "pb").agg(F.min("cell").alias("first")), "first", "pattern_id")


def merge(current: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(cells, dictionary) of two batches together. X'X of a pair of patterns is the sum of theirs, absence counting 0.

    Only dictionaries are added up, never readings: a pattern that the new batch does not touch keeps its numbers as they
    are. Batches are of different observations; any number of them may be merged one after the other.
    """
    cells, pairs_of = paired(current[0], new[0])
    side = lambda d, k: d.select(F.col("pattern_id").alias(f"p{k}"), F.col("n").alias(f"n{k}"), F.col("xtx").alias(f"x{k}"))
    both = pairs_of.join(side(current[1], "a"), "pa", "left").join(side(new[1], "b"), "pb", "left")
    xtx = F.when(F.col("xb").isNull(), F.col("xa")).when(F.col("xa").isNull(), F.col("xb")).otherwise(F.zip_with("xa", "xb", lambda x, y: x + y))
    n = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))
    merged = kept(both.select("pattern_id", "pa", "pb", n.alias("n"), xtx.alias("xtx")), "merged")
    return kept(cells.join(merged, ["pa", "pb"]).select("cell", "pattern_id"), "merged-cells"), merged.select("pattern_id", "n", "xtx")


def overlap(patterns_of: DataFrame, pairs_of: DataFrame) -> DataFrame:
    """(a, b, common, only_a, only_b, distance, a_within_b) of pairs (a, b) of patterns; patterns_of: (pattern_id, bits, n).

    Bitmaps of a chunk meet by chunk and are joined by a bit aggregate, so no set of observations is ever listed.
    """
    each = patterns_of.select("pattern_id", F.explode("bits").alias("c")).select("pattern_id", "c.chunk", "c.bitmap")
    sides = pairs_of.select("a", "b", F.explode(F.array("a", "b")).alias("pattern_id"))
    union = sides.join(each, "pattern_id").groupBy("a", "b", "chunk").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).groupBy("a", "b").agg(F.sum(F.bitmap_count("bitmap")).alias("either"))
    size = lambda k: patterns_of.select(F.col("pattern_id").alias(k), F.col("n").alias(f"n_{k}"))
    told = union.join(size("a"), "a").join(size("b"), "b")
    common = F.col("n_a") + F.col("n_b") - F.col("either")
    return told.select("a", "b", common.alias("common"), (F.col("n_a") - common).alias("only_a"), (F.col("n_b") - common).alias("only_b"), (F.col("either") - common).alias("distance"), (common == F.col("n_a")).alias("a_within_b"))
