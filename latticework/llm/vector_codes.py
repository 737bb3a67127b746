"""Compression of vectors to codes by product quantisation, with nearest entries found by segment-mean lower bounds.

Components become integers, vectors are cut into equal parts, and each part has a codebook of its own. To find a part's nearest entry, distances are bounded below
from coarse to fine. A run of n components with sums X and Y is at least (X - Y)^2 / n away, and what remains after the runs' means are taken off, at least the square
of the difference of the two remainders' norms. Both are known before the components are looked at:

* with one run for the whole part, every entry gets a bound; the entry with the least one gets its exact distance, and entries whose bound lies above it go;
* each further level halves the runs and bounds the entries that are left; the one with the least bound gets its exact distance, and more entries go;
* those that survive all levels get exact integer distances; of equal ones the lower index wins.

Bounds are lowered by more than their rounding error, so no entry that could win is ever dropped. Rows stay where they are: a round is one pass that gives every task's
sums of each entry (entries times tasks, whatever the number of rows), added up by Spark; only the codebooks go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

#: Vectors that are compared at once.
AT_ONCE = 1024
#: Sizes of integer components below which all squared distances are exact in 64 bits, for vectors of up to 4096 components.
LARGEST = 1 << 24
#: Labels up to this number are sent to all tasks (8 bytes of label or so and 8 of sum each); more are joined by a shuffle.
FEW_LABELS = 10_000
#: Tasks over which the rows of one label are spread when labels are many.
SALTS = 16


def levels(size: int) -> list[int]:
    """Numbers of runs from coarse to fine: 1, 2, 4 .., as long as they divide the part and a run has more than two components."""
    out = [1]
    while size % (out[-1] * 2) == 0 and size // (out[-1] * 2) > 2:
        out.append(out[-1] * 2)
    return out


def outlines(rows: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the runs of each row, and the norm of what is left when the runs' means are taken off."""
    n = rows.shape[1] // runs
    sums = rows.reshape(len(rows), runs, n).sum(axis=2).astype(float)
    rest = (rows.astype(float) ** 2).sum(axis=1) - (sums**2).sum(axis=1) / n
    return sums, np.sqrt(np.maximum(rest, 0))


class Codebook:
    """Entries of one part, with their outlines at all levels."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = levels(entries.shape[1])
        self.outlines = [outlines(entries, k) for k in self.levels]
        self.norm = float((entries.astype(float) ** 2).sum(axis=1).max(initial=0))

    def _bound(self, level: int, sums: list[np.ndarray], rest: np.ndarray, own: tuple[list[np.ndarray], np.ndarray], slack: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances; sums are given run by run."""
        out = (rest - own[1]) ** 2 - slack
        for x, y in zip(sums, own[0], strict=True):
            out += (x - y) ** 2 * (self.levels[level] / self.entries.shape[1])
        return out

    def _far(self, rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows and entries."""
        apart = rows - self.entries[entry]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry, the lowest if several are, and the squared distance."""
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = [outlines(rows, k) for k in self.levels]
        # The sums are exact below 2^53; what is squared, divided and rooted from them is wrong by some 2^-50 of the squares' sizes, its roots by 2^-25.
        squares = (rows.astype(float) ** 2).sum(axis=1)
        slack = (squares + self.norm) * 1e-6 + 1e-6
        most = np.full(len(rows), np.iinfo(np.int64).max)
        left = np.ones((len(rows), len(self.entries)), bool)
        for level, runs in enumerate(self.levels):
            sums, rest = self.outlines[level]
            if level and left.sum() * 8 < left.size:
                break
            low = self._bound(level, [own[level][0][:, [k]] for k in range(runs)], own[level][1][:, None], ([sums[:, k] for k in range(runs)], rest), slack[:, None])
            low[~left] = np.inf
            # the entry with the least bound of a row gets its exact distance, by which others go
            most = np.minimum(most, self._far(rows, low.argmin(axis=1)))
            left &= low <= most[:, None]
        else:
            level += 1
        row, entry = np.nonzero(left)
        for level in range(level, len(self.levels)):  # few are left: pair by pair
            (sums, rest), runs = self.outlines[level], range(self.levels[level])
            low = self._bound(level, [own[level][0][row, k] for k in runs], own[level][1][row], ([sums[entry, k] for k in runs], rest[entry]), slack[row])
            stay = low <= most[row]
            row, entry = row[stay], entry[stay]
        if len(row) * 8 > left.size and max(squares.max(), self.norm) < 1 << 50:  # many are left: whole numbers below 2^53, so a product of matrices is exact
            dots = (rows.astype(float) @ self.entries.T.astype(float))[row, entry]
            exact = (squares[row] + (self.entries.astype(float) ** 2).sum(axis=1)[entry] - 2 * dots).astype(np.int64)
        else:
            exact = self._far(rows[row], entry)
        first = np.searchsorted(row, np.arange(len(rows)))  # every row keeps the entry nearest so far
        least = np.minimum.reduceat(exact, first) if len(row) else exact
        best = np.flatnonzero(exact == least[row])
        best = best[np.append(True, row[best][1:] != row[best][:-1])] if len(best) else best
        return entry[best], exact[best]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _books(entries: np.ndarray, parts: int) -> list[Codebook]:
    """entries: (part, index, component)."""
    return [Codebook(entries[p]) for p in range(parts)]


def entry_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): of the rows' parts nearest to each entry. Every task gives a row for each entry at most; Spark adds them up."""
    parts, size = books.shape[0], books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _books(books, parts)
        sums, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * size)
            for lo in range(0, len(x), AT_ONCE):
                for p, coder in enumerate(coders):
                    own = x[lo : lo + AT_ONCE, p * size : (p + 1) * size]
                    near = coder.nearest(own)[0]
                    order = np.argsort(near, kind="stable")
                    used, first = np.unique(near[order], return_index=True)
                    sums[p, used] += np.add.reduceat(own[order], first)
                    n[p] += np.bincount(near, minlength=books.shape[1])
        p, e = np.nonzero(n)
        if len(p):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(p) + 1) * size, size, dtype=np.int32)), pa.array(sums[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), lists], names=["part", "entry", "n", "sums"])

    found = shared.mapped(rows.select("x"), run, "part int, entry int, n long, sums array<long>")
    each = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return each.groupBy("part", "entry").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda c: c["s"]).alias("sums"))


def trained(rows: DataFrame, parts: int, size: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, index, component) after so many rounds. rows: (vec_id, x), whole numbers; the first entries are the rows of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # at most ``entries`` rows; Spark keeps so many a task
    books = np.array([r["x"] for r in first], np.int64).reshape(-1, parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in entry_sums(rows, books).collect():  # at most parts * entries rows
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label, x) as (vec_id, label, code, error)."""
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _books(books, parts)
        for batch in batches:
            x = _matrix(batch.column(2), parts * size)
            codes, errors = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for lo in range(0, len(x), AT_ONCE):
                for p, coder in enumerate(coders):
                    near, far = coder.nearest(x[lo : lo + AT_ONCE, p * size : (p + 1) * size])
                    codes[lo : lo + AT_ONCE, p] = near
                    errors[lo : lo + AT_ONCE] += far
            shown = codes.tobytes().hex()
            shown = [shown[i : i + 2 * parts] for i in range(0, len(shown), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return shared.mapped(rows.select("vec_id", "label", "x"), run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows (written) with label_error, the sum of error over equal labels, nulls together. Sums are made before any shuffle; few labels go to all tasks, many are salted."""
    totals = shared.written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS and totals.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "date"):
        right = F.broadcast(totals.withColumnRenamed("label", "own"))
        return rows.join(right, F.col("label").eqNullSafe(F.col("own"))).drop("own")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    right = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"label": "own", "salt": "salt2"})
    return left.join(right, F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("salt2"))).drop("own", "salt", "salt2")


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, one row per row of vectors that is kept.

    Dropped: vectors that are null or hold null or non-finite components, and vectors whose length isn't that of the kept vector with the smallest id. Components become
    floor(scale * x); beyond 2^24 in size (where squares could leave 64 bits), or where the length isn't a multiple of ``parts``, or for more than 256 entries, it is an
    error. Rows with one vec_id, or none, are rows of their own; where rows tie for the first entries, the smaller vector comes first, null ids last. With fewer rows than
    entries, codebooks are that short. Unused entries stay. An empty table, or one of which nothing is kept, gives an empty one; other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    rows = shared.picked(vectors, vec_id=vec_id, label=label, x=vector)
    good = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.filter(good).withColumn("x", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("long")))
    rows = shared.written(rows, "codes-rows")
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).select(F.size("x").alias("n")).collect()
    dims = head[0]["n"] if head else parts
    if dims % parts or not dims:
        raise ValueError(f"vectors of {dims} components don't have {parts} equal parts")
    kept = rows.filter(F.size("x") == dims)
    large = kept.filter(F.exists("x", lambda c: (c > LARGEST) | (c < -LARGEST))).limit(1).count()
    if large or dims > 4096:
        raise ValueError("squared distances would leave 64 bits")
    books = trained(kept, parts, dims // parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = shared.written(coded(kept, books), "codes-found")
    out = with_label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    shared.drop(rows)
    return out


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same with all distances: a book is rows (p, e, c), and every round joins all parts with it."""
    nearest = "SELECT vec_id, n, label, k.p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT k.*, b.e, CAST(list_sum(list_transform(list_zip(k.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM part k JOIN {book} b ON b.p = k.p) k GROUP BY vec_id, n, label, k.p"
    out = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS n FROM kept),
 part AS MATERIALIZED (SELECT vec_id, n, label, CAST(p AS INTEGER) AS p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v FROM ranked, range({parts}) r(p)),
 b0 AS MATERIALIZED (SELECT p, n - 1 AS e, v AS c FROM part WHERE n <= {entries})"""
    for i in range(rounds):
        out += f""",
 near{i} AS MATERIALIZED ({nearest.format(book=f"b{i}")}),
 sums{i} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT k.p, a.e, u.i, CAST((sum(k.v[u.i]) - (sum(k.v[u.i]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
   FROM part k JOIN near{i} a USING (n, p), (SELECT unnest(range(1, (SELECT max(len(v)) FROM part) + 1)) AS i) u GROUP BY ALL) GROUP BY p, e),
 b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN sums{i} s USING (p, e))"""
    return (
        out
        + f""",
 last AS MATERIALIZED ({nearest.format(book=f"b{rounds}")}),
 rows AS (SELECT vec_id, n, label, string_agg(lower(lpad(to_hex(CAST(e AS BIGINT)), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id, n, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
   (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM rows"""
    )


OP12_SQL = _sql()
