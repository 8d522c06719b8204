"""Whitening of embeddings with components from the exact characteristic polynomial of their scatter matrix.

Entries become integers, so that counts, sums and products are exact: with n vectors, sums S and products P, the integer matrix
``n P - S S'`` is n^2 times the covariance. Its characteristic polynomial is found modulo many primes (Hessenberg
reduction, one row a prime) and put together by Chinese remainders, one group a coefficient. All its roots are real, so the sign changes
of its coefficients moved to x count the roots above x without error: the k-th root is isolated by bisection on integers, to
``ROOT_BITS`` bits behind the point. Components solve (matrix - root) v = 0 by inverse iteration in fixed-point integers.

Every step over the vectors is one scan; what reaches the driver is of the size of the matrix. Defined cases: a vector that is null, empty, of another
length than most (of equally frequent lengths the greater) or holds a null, non-finite or unusably large entry (2^40 or more
after scaling) is left out; repeated rows and ids count each; components of variance 0 do not exist, so one vector alone,
equal vectors or an empty table give no rows; roots that agree in all computed bits share a space and get orthonormal vectors of it;
a deviation beyond a long is null; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.llm.common import partitions

ENTRY_BITS = 40      # scaled entries below 2^40 are usable, so that sums of products fit decimal(38)
LIMB = 20            # bits of the parts that are multiplied in floating point without rounding
EXACT_ROWS = 1 << (53 - 2 * LIMB - 2)
ROOT_BITS = 96
FIXED_BITS = 320     # of the fixed-point numbers of the inverse iteration
STEPS = 3


@dataclass(frozen=True)
class WhitenParams:
    scale: int = 64            # x = floor(scale * entry) + shift
    shift: int = 1_000_000
    components: int = 32


# --- exact sums ---


def usable(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows whose vector has only finite entries of usable size, as array<double> in column ``vector``."""
    doubles = F.col(f"`{vector}`").cast("array<double>")
    low = -float(1 << ENTRY_BITS) / scale
    fine = F.forall(doubles, lambda c: F.coalesce((c > low) & (c < -low), F.lit(False)))   # not for NaN, which is greater than all
    return vectors.withColumn(vector, doubles).filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * entry) of a column of vectors, one row each."""
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).astype(np.int64)


def _products(y: np.ndarray) -> list[list[int]]:
    """Sum of y y' over the rows, exact: entries part into limbs whose products floating point adds without rounding."""
    high, low = y >> LIMB, y & ((1 << LIMB) - 1)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    limbs = [(low.astype(float), 0)] + ([(high.astype(float), LIMB)] if high.any() else [])
    for a, s in limbs:
        for b, t in limbs:
            part = np.zeros((y.shape[1], y.shape[1]), np.int64)
            for at in range(0, len(y), EXACT_ROWS):
                part += (a[at: at + EXACT_ROWS].T @ b[at: at + EXACT_ROWS]).astype(np.int64)
            total += part.astype(object) << (s + t)
    return total


def _sums(width: int, scale: int):
    """Per task: (-1, -1, rows), (i, -1, sum of entries i), (i, j, sum of products) for j from i on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                y = _integers(batch.column(0).slice(at, 1 << 16), width, scale)
                n, s, p = n + len(y), s + y.sum(axis=0).astype(object), p + _products(y)
        if n:
            rows = [(-1, -1, n), *[(i, -1, s[i]) for i in range(width)], *[(i, j, p[i, j]) for i in range(width) for j in range(i, width)]]
            i, j, v = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))], ["i", "j", "v"])
    return run


@dataclass(frozen=True)
class Scatter:
    """n, S and the integer matrix n^2 V."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(self.matrix[i][i] for i in range(len(self.sums)))


def scatter(vectors: DataFrame, vector: str, width: int, scale: int) -> Scatter:
    added = vectors.select(vector).mapInArrow(_sums(width, scale), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = {(r["i"], r["j"]): int(r["v"]) for r in added.collect()}      # width^2 / 2 numbers
    n, sums = found[-1, -1], [found[i, -1] for i in range(width)]
    return Scatter(n, sums, [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)])


# --- the characteristic polynomial ---


def is_prime(x: int) -> bool:
    """For x below 3,215,031,751."""
    if x < 2 or any(x % p == 0 for p in (2, 3, 5, 7)):
        return x in (2, 3, 5, 7)
    odd, twos = x - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        y = pow(base, odd, x)
        if y not in (1, x - 1) and not any((y := y * y % x) == x - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The greatest primes below 2^31 whose product exceeds bound."""
    out, product, x = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(x):
            out.append(x)
            product *= x
        x -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo the prime p below 2^31, from the constant on, by Hessenberg reduction."""
    h, d = matrix.copy(), len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factor = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:, m - 1:] = (h[m + 1:, m - 1:] - factor[:, None] * h[m, m - 1:] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * factor % p).sum(axis=1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)     # row k: the polynomial of the leading k rows and columns
    found[0, 0] = 1
    for k in range(1, d + 1):
        found[k, 1:] = found[k - 1, :-1]
        weights, run = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):             # the entry above, times the subdiagonal between
            weights[i] = int(h[i, k - 1]) * run % p
            run = run * int(h[i, i - 1]) % p if i else 0
        found[k] = (found[k] - (weights[:, None] * found[:k] % p).sum(axis=0)) % p
    return found[d]


def _residues(matrix: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                c = polynomial_mod(np.array([[x % p for x in row] for row in matrix], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(c), pa.int64()), pa.array(range(len(c)), pa.int32()), pa.array(c)], ["p", "k", "r"])
    return run


def remainder(primes: list[int], residues: list[int]) -> int:
    """The number of least absolute value with these residues."""
    value, product = 0, 1
    for p, r in zip(primes, residues):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def _put_together(group: pa.Table) -> pa.Table:
    value = remainder(group["p"].to_pylist(), group["r"].to_pylist())
    return pa.table({"k": pa.array([group["k"][0].as_py()], pa.int32()), "c": [hex(value)]})


def characteristic_polynomial(spark: SparkSession, s: Scatter) -> list[int]:
    """Coefficients from the constant on. Roots are not negative and add up to the trace, which bounds every coefficient."""
    d = len(s.sums)
    bound = 2 * max(math.comb(d, k) * (s.trace // d + 1) ** k for k in range(d + 1)) + 1
    primes = primes_beyond(bound)
    spread = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), partitions(spark)))
    found = spread.mapInArrow(_residues(s.matrix), "p long, k int, r long").groupBy("k").applyInArrow(_put_together, "k int, c string").collect()
    return [c for _, c in sorted((r["k"], int(r["c"], 16)) for r in found)]


# --- roots and components ---


def roots_above(coefficients: list[int], x: int) -> int:
    """How many roots of a polynomial with real roots only are greater than x: sign changes of its coefficients moved to x."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += x * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def kth_root(coefficients: list[int], k: int, bits: int, top: int) -> int:
    """floor(2^bits root) of the k-th greatest root, or one less where that is the root itself; roots lie in (0, top]."""
    d = len(coefficients) - 1
    scaled = [c << bits * (d - i) for i, c in enumerate(coefficients)]
    low, high = 0, top << bits                     # above(low) >= k > above(high)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if roots_above(scaled, middle) >= k else (low, middle)
    return low


def _roots(coefficients: list[int], bits: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([hex(kth_root(coefficients, k, bits, top))])], ["k", "root"])
    return run


def _factor(a: list[list[int]], bits: int) -> tuple[list[list[int]], list[int]]:
    """LU with row exchanges of a fixed-point matrix, in place; a pivot of 0 becomes the smallest number."""
    d, order = len(a), list(range(len(a)))
    for m in range(d):
        best = max(range(m, d), key=lambda r: abs(a[r][m]))
        a[m], a[best], order[m], order[best] = a[best], a[m], order[best], order[m]
        top = a[m]
        top[m] = top[m] or 1
        for r in range(m + 1, d):
            row = a[r]
            if row[m]:
                f = row[m] = (row[m] << bits) // top[m]
                row[m + 1:] = [x - (f * y >> bits) for x, y in zip(row[m + 1:], top[m + 1:])]
    return a, order


def _solve(lu: list[list[int]], order: list[int], v: list[int], bits: int) -> list[int]:
    x = [v[o] for o in order]
    for r, row in enumerate(lu):
        x[r] -= sum(f * y for f, y in zip(row[:r], x)) >> bits
    for r in range(len(lu) - 1, -1, -1):
        x[r] = ((x[r] << bits) - sum(f * y for f, y in zip(lu[r][r + 1:], x[r + 1:]))) // lu[r][r]
    return x


def _unit(v: list[int], bits: int, against: list[list[int]]) -> list[int]:
    """v without its shares of the unit vectors in ``against``, at length 1."""
    size = max(1, max(abs(x) for x in v))
    v = [(x << bits) // size for x in v]
    for _ in range(2):
        for u in against:
            share = sum(a * b for a, b in zip(u, v)) >> bits
            v = [a - (share * b >> bits) for a, b in zip(v, u)]
    length = max(1, math.isqrt(sum(x * x for x in v)))
    return [(x << bits) // length for x in v]


def null_space(matrix: list[list[int]], root: int, root_bits: int, count: int, bits: int = FIXED_BITS) -> list[list[float]]:
    """``count`` orthonormal vectors that matrix - (root + 1/2) / 2^root_bits all but takes to 0."""
    d, shift = len(matrix), (2 * root + 1) << (bits - root_bits - 1)
    lu, order = _factor([[(x << bits) - (shift if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)], bits)
    found: list[list[int]] = []
    for c in range(count):
        v = [((i + 1) * (c + 3) * 2654435761 % 65521 - 32768) << bits for i in range(d)]
        for _ in range(STEPS):
            v = _unit(_solve(lu, order, _unit(v, bits, found), bits), bits, found)
        found.append(v)
    return [[x / (1 << bits) for x in v] for v in found]


def _components(matrix: list[list[int]], root_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, root in zip(*[c.to_pylist() for c in batch.columns]):
                vectors = null_space(matrix, int(root, 16), root_bits, count)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + count), pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], ["k", "vector"])
    return run


@dataclass(frozen=True)
class Basis:
    """Greatest components first: eigenvalues of n^2 V with ``bits`` bits behind the point, and unit vectors."""

    scatter: Scatter
    roots: list[int]
    bits: int
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [(2 * r + 1) / (self.scatter.trace << (self.bits + 1)) for r in self.roots]

    @property
    def deviations(self) -> np.ndarray:
        """Square roots of the eigenvalues of n^2 V."""
        return np.array([math.sqrt((2 * r + 1) / (1 << (self.bits + 1))) for r in self.roots])


def basis(spark: SparkSession, s: Scatter, components: int) -> Basis:
    """The components of positive variance, at most so many."""
    coefficients = characteristic_polynomial(spark, s)
    rank = len(coefficients) - 1 - next(i for i, c in enumerate(coefficients) if c)
    wanted = min(components, rank)
    tasks = min(max(1, wanted), partitions(spark))
    ks = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k int").repartition(tasks)
    found = ks.mapInArrow(_roots(coefficients, ROOT_BITS, s.trace + 1), "k int, root string").collect()
    roots = [r for _, r in sorted((x["k"], int(x["root"], 16)) for x in found)]
    groups = [(k, roots.count(r), hex(r)) for k, r in enumerate(roots) if roots.index(r) == k]
    spread = spark.createDataFrame(groups, "k int, size int, root string").repartition(tasks)
    held = {x["k"]: x["vector"] for x in spread.mapInArrow(_components(s.matrix, ROOT_BITS), "k int, vector array<double>").collect()}
    return Basis(s, roots, ROOT_BITS, np.array([held[k] for k in range(wanted)]).reshape(wanted, len(s.sums)))


# --- projection ---


def _project(column: pa.Array, b: Basis, scale: int) -> tuple[np.ndarray, np.ma.MaskedArray]:
    """Whitened values of a column of vectors, and n^2 times the square of their distance to the mean."""
    s = b.scatter
    y = _integers(column, len(s.sums), scale)
    reach = max(abs(int(y.min())), abs(int(y.max())), *[abs(x) // s.n + 1 for x in s.sums]) if len(y) else 0
    if 2 * reach * s.n < 1 << 62:
        z = s.n * y - np.array(s.sums, np.int64)
        about = (z.astype(float) ** 2).sum(axis=1)
        square = np.ma.array((z * z).sum(axis=1), mask=about >= 2.0 ** 63)     # whole numbers wrap around, so below 2^63 they are right
        for i in np.flatnonzero(np.abs(about / 2.0 ** 63 - 1) < 1e-9):
            exact = sum(int(x) ** 2 for x in z[i])
            square[i] = exact if exact < 1 << 63 else np.ma.masked
    else:
        z = s.n * y.astype(object) - np.array(s.sums, object)
        exact = (z * z).sum(axis=1)
        square = np.ma.array([x if x < 1 << 63 else 0 for x in exact], np.int64, mask=[x >= 1 << 63 for x in exact])
    return z.astype(float) @ b.vectors.T / b.deviations, square


def _whiten(b: Basis, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(b.roots)
        for batch in batches:
            if batch.num_rows:
                w, square = _project(batch.column(1), b, scale)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(w).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(square.data, pa.int64(), mask=np.ma.getmaskarray(square)), values], ["id", "deviation", "whitened"])
    return run


def _moments(b: Basis, scale: int):
    """Per task: sums (i, -1) and products (i, j) of whitened values; products are of values less the batch's mean, plus the mean's share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(b.roots)
        first, second, rows = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            if batch.num_rows:
                w, _ = _project(batch.column(0), b, scale)
                mean = w.mean(axis=0)
                centred = w - mean
                first, second, rows = first + w.sum(axis=0), second + centred.T @ centred + len(w) * np.outer(mean, mean), rows + len(w)
        if rows:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((np.arange(k), i)), pa.int32()), pa.array(np.concatenate((np.full(k, -1), j)), pa.int32()),
                pa.array(np.concatenate((first, second[i, j])))], ["i", "j", "v"])
    return run


def identity_error(vectors: DataFrame, vector: str, b: Basis, scale: int) -> float:
    """The largest absolute entry of the whitened values' covariance less the identity."""
    added = vectors.select(vector).mapInArrow(_moments(b, scale), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {r["i"]: r["v"] / b.scatter.n for r in added if r["j"] < 0}
    return max(abs(r["v"] / b.scatter.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in added if r["j"] >= 0)


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", params: WhitenParams = WhitenParams(),
) -> tuple[DataFrame, Basis | None, float | None]:
    """(key, deviation, whitened array) of every usable vector, the fitted basis and its identity error."""
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")), "v", params.scale)
    lengths = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("width")).first()
    schema = f"id {dict(rows.dtypes)['id']}, deviation long, whitened array<double>"
    if most is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key), None, None
    rows = rows.filter(F.size("v") == most["width"])
    fitted = basis(spark, scatter(rows, "v", most["width"], params.scale), params.components)
    if not fitted.roots:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key), fitted, None
    out = rows.select("id", "v").mapInArrow(_whiten(fitted, params.scale), schema)
    return out.withColumnRenamed("id", key), fitted, identity_error(rows, "v", fitted, params.scale)


def components(vectors: DataFrame, params: WhitenParams = WhitenParams()) -> DataFrame:
    """One row per vector and component: vec_id, component from 1, n, deviation, whitened, explained, identity_error."""
    rows, fitted, error = whiten(vectors, params=params)
    explained = F.array(*[F.lit(x) for x in (fitted.explained if fitted else [])]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.scatter.n if fitted else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
