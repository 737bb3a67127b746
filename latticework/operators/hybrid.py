"""Coefficients with one row an address: an array over all bins where an address is full, sorted pairs of bin and value where it is sparse.

Which form a row has is decided by its bytes: a full one has a value for every bin, a pair a bin besides its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.spec import GridSpec

#: Bytes of a stored value and of a stored bin.
VALUE, BIN = 8, 4


def pack(coefs: DataFrame, spec: GridSpec) -> DataFrame:
    """(l.., k.., full, bins, sums) of (l.., k.., bin, ic): ``full`` or ``bins`` and ``sums`` is null. Equal bins of an address are added up, zeros are left out."""
    added = coefs.groupBy(*spec.keys, "bin").agg(F.sum("ic").alias("ic")).filter("ic <> 0")
    rows = added.groupBy(*spec.keys).agg(F.array_sort(F.collect_list(F.struct("bin", "ic"))).alias("pairs"))  # at most all bins
    dense = F.size("pairs") * (VALUE + BIN) >= spec.n_bins * VALUE
    by_bin = F.map_from_entries("pairs")
    every = F.transform(F.sequence(F.lit(0), F.lit(spec.n_bins - 1)), lambda b: F.coalesce(F.try_element_at(by_bin, b), F.lit(0).cast("long")))
    return rows.select(*spec.keys, F.when(dense, every).alias("full"), F.when(~dense, F.col("pairs.bin")).alias("bins"), F.when(~dense, F.col("pairs.ic")).alias("sums"))


def unpack(rows: DataFrame, spec: GridSpec) -> DataFrame:
    """(l.., k.., bin, ic), without zeros."""
    sparse = F.arrays_zip(F.col("bins").alias("bin"), F.col("sums").alias("ic"))
    dense = F.transform("full", lambda v, i: F.struct(i.cast("int").alias("bin"), v.alias("ic")))
    pairs = rows.select(*spec.keys, F.explode(F.coalesce(dense, sparse)).alias("p"))
    return pairs.select(*spec.keys, "p.bin", "p.ic").filter("ic <> 0")


def add(one: DataFrame, other: DataFrame, spec: GridSpec) -> DataFrame:
    """The sum of two tables of rows; a row may change its form by it."""
    return pack(unpack(one, spec).unionByName(unpack(other, spec)), spec)


def value(bin_: Column) -> Column:
    """A row's value of a bin, 0 where it has none."""
    at = F.array_position("bins", bin_)
    sparse = F.when(at > 0, F.try_element_at("sums", at.cast("int")))
    return F.coalesce(F.try_element_at("full", bin_.cast("int") + 1), sparse, F.lit(0).cast("long"))


def lookup(rows: DataFrame, asked: DataFrame, spec: GridSpec) -> DataFrame:
    """asked (l.., k.., bin, ..) with ic, 0 where there is none: one row a lookup, joined by address, whatever an address holds."""
    found = asked.join(rows, spec.keys, "left")
    return found.select(*asked.columns, value(F.col("bin")).alias("ic"))


def size(rows: DataFrame) -> DataFrame:
    """One row: n_full, n_sparse, and bytes of values and bins as stored (bytes), as pairs only (as_pairs), as arrays of all bins only (as_full takes spec.n_bins a row)."""
    pairs = F.when(F.col("full").isNull(), F.size("bins")).otherwise(F.size(F.filter("full", lambda v: v != 0)))
    own = F.when(F.col("full").isNull(), F.size("bins") * (VALUE + BIN)).otherwise(F.size("full") * VALUE)
    return rows.agg(
        F.count("full").alias("n_full"), F.count("bins").alias("n_sparse"), F.sum(own).alias("bytes"), F.sum(pairs * (VALUE + BIN)).alias("as_pairs"), F.count(F.lit(1)).alias("n_rows")
    )
