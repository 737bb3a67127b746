"""What is known of a grid before any data is read."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class GridSpec:
    """Extents, number of bins and value range of a grid; coordinates are columns x0, x1, ..., bins a column bin."""

    dims: tuple[int, ...]
    n_bins: int
    vmin: float | None = None
    vmax: float | None = None

    @property
    def axes(self) -> list[str]:
        return [f"x{d}" for d in range(len(self.dims))]

    @property
    def keys(self) -> list[str]:
        """Columns that name a coefficient: its levels and its place within them."""
        return [f"{c}{d}" for c in "lk" for d in range(len(self.dims))]

    def levels(self, d: int) -> int:
        """ceil(log2 n) + 1."""
        return (self.dims[d] - 1).bit_length() + 1

    def padded(self, d: int) -> int:
        return 1 << (self.levels(d) - 1)

    def support(self, d: int, level: int) -> int:
        """Padded coordinates under one coefficient of a level."""
        return 1 << (self.levels(d) - max(level, 1))

    @property
    def size(self) -> int:
        out = 1
        for d in range(len(self.dims)):
            out *= self.padded(d)
        return out

    @property
    def n_wavelets(self) -> int:
        out = 1
        for d in range(len(self.dims)):
            out *= self.levels(d)
        return out

    @property
    def depth(self) -> int:
        """Levels of the block tree below its root."""
        return min(self.levels(d) for d in range(len(self.dims))) - 1

    @property
    def threshold(self) -> float:
        """The least size of a coefficient that a single unit cell gives rise to."""
        return self.size**-0.5

    def decoded(self, padded: bool) -> tuple[int, ...]:
        """Extents of a decoded field: padded from the wavelet store, those of the data from the SAT store."""
        return tuple(self.padded(d) for d in range(len(self.dims))) if padded else self.dims

    @classmethod
    def of(cls, points: DataFrame, n_bins: int) -> GridSpec:
        """With the extents of points (x0 ..), found by one scan of their coordinates: each axis reaches to the greatest (an axis without any has one cell)."""
        axes = [c for c in points.columns if c[0] == "x" and c[1:].isdigit()]
        row = points.agg(*(F.max(c).alias(c) for c in axes)).first()
        return cls(tuple((row[c] or 0) + 1 for c in axes), n_bins)

    def with_range(self, df: DataFrame, value: str) -> GridSpec:
        """With the range found by one scan of a column (one row comes back). NaN counts as null; without values the range is None, and no value has a bin."""
        v = F.col(value).cast("double")
        v = F.when(~F.isnan(v), v)
        row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        return replace(self, vmin=row["lo"], vmax=row["hi"])

    def table(self, spark: SparkSession) -> DataFrame:
        """One row: dims, n_bins, vmin, vmax."""
        return spark.createDataFrame([(list(self.dims), self.n_bins, self.vmin, self.vmax)], "dims array<int>, n_bins int, vmin double, vmax double")

    def level_table(self, spark: SparkSession) -> DataFrame:
        """(dim, level, support, coefs, base): coefficients of each level and where they begin in the global order."""
        rows = []
        for d in range(len(self.dims)):
            for level in range(self.levels(d)):
                rows.append((d, level, self.support(d, level), 1 if level < 2 else 1 << (level - 1), 0 if level == 0 else 1 << (level - 1)))
        return spark.createDataFrame(rows, "dim int, level int, support long, coefs long, base long")

    def lattice(self, spark: SparkSession, bins: int | None = None, axes: tuple[int, ...] | None = None) -> DataFrame:
        """Every coordinate (of some axes), and every bin if bins is given: one long range, spread over tasks and taken apart by arithmetic."""
        axes = tuple(range(len(self.dims))) if axes is None else axes
        sizes = [self.dims[d] for d in axes] + ([bins] if bins else [])
        names = [f"x{d}" for d in axes] + (["bin"] if bins else [])
        total = 1
        for n in sizes:
            total *= n
        out, rest = [], F.col("id")
        for name, n in zip(names, sizes, strict=True):
            out.append((rest % n).cast("int").alias(name))
            rest = F.floor(rest / n)
        return spark.range(total).select(*out)
