"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter n*sum(x x') - sum(x) sum(x)' is an exact integer matrix, summed over all rows in Spark. Its characteristic polynomial is
found modulo many primes, each by a Hessenberg reduction in a task of its own, and put together by Chinese remaindering. All roots of
it are real, so the sign changes of the shifted polynomial (Descartes) count the roots above a place exactly, with multiplicity: bisection isolates each
eigenvalue and narrows it to far more digits than a double has. A component spans the null space of the scatter less its
eigenvalue: it is found by inverse iteration in fixed-point integers of several hundred bits, a block of vectors where a root is multiple.

What reaches the driver has a size set by the number of dimensions, not of rows: the sums, the remainders and the components.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries are multiplied by SCALE; OFFSET is added to what is returned as x, and takes no part in sums about the mean.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Eigenvalues are narrowed to this relative width, in bits; roots closer than it are one of that multiplicity.
ROOT_BITS = 160
#: Primes begin below this, so that sums of products of two remainders stay below 2^63.
PRIME_BELOW = 1 << 28
#: A row is used if its entries stay below this in x, so that a long holds them.
LARGEST = 1 << 62
#: Bits of the lower limb of an exact sum; either limb is summed as a decimal of 38 digits.
LIMB = 60


class Whitening(NamedTuple):
    """n rows with sums S of x - OFFSET; components as rows (unit vectors, falling eigenvalue), eigenvalues of the covariance, their shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """df with x_ (array of floor(SCALE * entry)), without rows whose vector is null or empty, holds null or non-finite entries or such beyond LARGEST, or has another length than most.

    Of two lengths that are equally common the longer one stays.
    """
    entries = F.transform(F.col(f"`{vector_col}`"), lambda c: F.floor(c.cast("double") * SCALE))
    fine = F.forall(F.col(f"`{vector_col}`"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST))
    kept = df.filter(F.coalesce(fine, F.lit(False)) & (F.size(F.col(f"`{vector_col}`")) > 0)).withColumn("x_", entries)
    lengths = kept.groupBy(F.size("x_").alias("d")).count().collect()
    common = max(((r["count"], r["d"]) for r in lengths), default=(0, 0))[1]
    return kept.filter(F.size("x_") == common)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def exact_product(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers: by doubles where every sum stays below 2^53, else in base 2^20."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:
        return (x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64).astype(object)
    if most < 1 << 20:
        half = len(x) // 2
        return exact_product(x[:half]) + exact_product(x[half:]) if half else x.T.astype(object) @ x.astype(object)
    high, low = x >> 20, x & ((1 << 20) - 1)
    both = exact_product(np.hstack([high, low]))
    d = x.shape[1]
    return (both[:d, :d] << 40) + ((both[:d, d:] + both[d:, :d]) << 20) + both[d:, d:]


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    small = int(np.abs(x).max(initial=0)) * len(x) < 1 << 63
    return x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)


def moments(kept: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(rows, sums, sums of products) of x_, exact: each task adds up its rows, and Spark adds up the tasks by entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b["x_"])
                n, sums, products = n + len(x), sums + exact_sum(x), products + exact_product(x)
        if n:
            d = len(sums)
            entries = [(-1, -1, n), *((-1, i, int(sums[i])) for i in range(d)), *((i, j, int(products[i, j])) for i in range(d) for j in range(i, d))]
            i, j, value = zip(*entries, strict=True)
            high, low = ([str(v) for v in part] for part in zip(*(divmod(v, 1 << LIMB) for v in value), strict=True))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, pa.string()), pa.array(low, pa.string())], names=["i", "j", "high", "low"])

    parts = kept.select("x_").mapInArrow(add, "i int, j int, high string, low string")
    rows = parts.groupBy("i", "j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()
    found = {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in rows}
    n = found.pop((-1, -1), 0)
    d = sum(i == -1 for i, _ in found)
    products = np.array([[found[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], dtype=object).reshape(d, d)
    return n, [found[-1, i] for i in range(d)], products


def primes(bits: int) -> list[int]:
    """Primes whose product has more than so many bits, falling from PRIME_BELOW."""
    out: list[int] = []
    have, at = 0.0, PRIME_BELOW - 1
    while have <= bits + 1:
        if all(pow(a, at - 1, at) == 1 for a in (2, 3, 5, 7)) and _is_prime(at):
            out.append(at)
            have += math.log2(at)
        at -= 2
    return out


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test, exact below 3.2e9 with these bases."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, constant first, of det(t - matrix) modulo a prime, from the Hessenberg form of the matrix."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factors = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factors[:, None] * h[k]) % p
        # The inverse operation on columns; the sum is taken in halves, as d products of two remainders may pass 2^63.
        h[:, k] = (h[:, k] + _dot_mod(h[:, k + 1 :], factors, p)) % p
    rows = np.zeros((d + 1, d + 1), np.int64)
    rows[0, 0] = 1
    for k in range(d):
        # The polynomial of the leading block of size k + 1: (t - h[k,k]) times that of size k, less the paths that come back to it.
        rows[k + 1, 1:] = rows[k, :-1]
        rows[k + 1] = (rows[k + 1] - int(h[k, k]) * rows[k]) % p
        path = 1
        for i in range(k - 1, -1, -1):
            path = path * int(h[i + 1, i]) % p
            if not path:
                break
            rows[k + 1] = (rows[k + 1] - path * int(h[i, k]) % p * rows[i]) % p
    return rows[d].tolist()


def _dot_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b modulo p."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], 64):
        out = (out + (a[:, at : at + 64] * b[at : at + 64] % p).sum(axis=1)) % p
    return out


def polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, constant first, of det(t - matrix) of a symmetric integer matrix without negative eigenvalues: a task for some primes each, then Chinese remaindering."""
    d = len(matrix)
    # The k-th coefficient is a sum of the products of k eigenvalues, so at most (1 + trace/d)^d all told.
    trace = int(sum(matrix[i, i] for i in range(d)))
    wanted = primes(d * (trace // max(1, d) + 2).bit_length() + 2)
    shared = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])
    frame = spark.createDataFrame([(p,) for p in wanted], "p long").repartition(min(len(wanted), 64))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(shared.value, dtype=object)
        for b in batches:
            found = [polynomial_mod((own % p).astype(np.int64), p) for p in b["p"].to_pylist()]
            yield pa.record_batch([b["p"], pa.array(found, pa.list_(pa.int64()))], names=["p", "rest"])

    product, values = 1, [0] * (d + 1)
    for r in frame.mapInArrow(reduce, "p long, rest array<long>").collect():
        p, inverse = r["p"], pow(product, -1, r["p"])
        values = [v + product * ((x - v) * inverse % p) for v, x in zip(values, r["rest"], strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def roots_above(coefficients: list[int], at: int, bits: int = 0) -> int:
    """Roots above at / 2^bits, with multiplicity, of a polynomial whose roots are all real: the sign changes after the shift."""
    d = len(coefficients) - 1
    c = [v << (bits * (d - i)) for i, v in enumerate(coefficients)]
    if at:
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(coefficients: list[int], at: int, bits: int) -> int:
    """The sign of the polynomial at at / 2^bits."""
    value = 0
    d = len(coefficients) - 1
    for i in range(d, -1, -1):
        value = value * at + (coefficients[i] << (bits * (d - i)))
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], wanted: int, root_bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """(at, bits, multiplicity) of the largest positive roots at / 2^bits, falling, until `wanted` are found; all roots must be real."""
    zeros = next(i for i, v in enumerate(coefficients) if v)
    coefficients = coefficients[zeros:]
    d = len(coefficients) - 1
    if not d:
        return []
    top = 1 << (abs(coefficients[d - 1]).bit_length() + 1)
    out: list[tuple[int, int, int]] = []
    # Half-open intervals (low, high] in units of 2^-bits, with the roots above either end; the highest is taken first.
    todo = [(0, top, 0, d, 0)]
    while todo and sum(x[2] for x in out) < wanted:
        low, high, bits, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1 and low:
            out.append((*_narrowed(coefficients, low, high, bits, above_high, root_bits), 1))
        elif low and (high - low) << root_bits <= low:
            out.append((high, bits, inside))
        else:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            above = roots_above(coefficients, middle, bits)
            todo += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]
    return out


def _narrowed(coefficients: list[int], low: int, high: int, bits: int, above_high: int, root_bits: int) -> tuple[int, int]:
    """The one root in (low, high] by bisection on the sign, which tells how many roots lie above."""
    while (high - low) << root_bits > low:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        sign = _sign(coefficients, middle, bits)
        if not sign:
            return middle, bits
        if (sign > 0) == (above_high % 2 == 0):
            high = middle
        else:
            low = middle
    return high, bits


def null_vectors(matrix: np.ndarray, at: int, bits: int, multiplicity: int, precision: int) -> np.ndarray:
    """Unit vectors, as rows of doubles, that span the null space of matrix - at / 2^bits: inverse iteration of a block in integers of so many bits behind the point."""
    d = len(matrix)
    size = max(int(max(abs(v) for row in matrix for v in row)), 1).bit_length()
    one = 1 << precision
    shift = precision - size

    def scaled(value: int, by: int) -> int:
        return value << by if by >= 0 else value >> -by

    a = np.array([[scaled(int(v), shift) for v in row] for row in matrix], dtype=object)
    root = scaled(at, shift - bits)
    for i in range(d):
        a[i, i] -= root
    draw = random.Random(d)
    block = np.array([[draw.randrange(-one, one) for _ in range(multiplicity)] for _ in range(d)], dtype=object)
    order, factors = [], []
    for k in range(d):
        pivot = k + int(np.argmax([abs(v) for v in a[k:, k]]))
        order.append(pivot)
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        # An exhausted column: the matrix is singular to all its digits.
        a[k, k] = a[k, k] or 1
        f = (a[k + 1 :, k] << precision) // a[k, k]
        a[k + 1 :, k:] -= (f[:, None] * a[k, k:]) >> precision
        factors.append(f)
    for _ in range(3):
        block = _orthonormal(block, precision)
        for k in range(d):
            if order[k] != k:
                block[[k, order[k]]] = block[[order[k], k]]
            block[k + 1 :] -= (factors[k][:, None] * block[k]) >> precision
        for k in range(d - 1, -1, -1):
            block[k] = ((block[k] << precision) - (a[k, k + 1 :, None] * block[k + 1 :]).sum(axis=0)) // a[k, k]
    block = _orthonormal(block, precision)
    return np.array([[float(v / one) for v in column] for column in block.T])


def _orthonormal(block: np.ndarray, precision: int) -> np.ndarray:
    """The columns made orthonormal (Gram and Schmidt, twice each), with `precision` bits behind the point."""
    out: list[np.ndarray] = []
    for column in block.T:
        for _ in range(2):
            column = _unit(column, precision)
            for other in out:
                column = column - ((other * (int((other * column).sum()) >> precision)) >> precision)
        out.append(_unit(column, precision))
    return np.array(out, dtype=object).T


def _unit(column: np.ndarray, precision: int) -> np.ndarray:
    length = math.isqrt(int((column * column).sum())) or 1
    return (column << precision) // length


def fit(spark: SparkSession, kept: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The components of largest eigenvalue over all rows of usable(); those of eigenvalue zero are none, as they cannot be whitened."""
    n, sums, products = moments(kept)
    d = len(sums)
    none = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    if not n:
        return none
    s = np.array(sums, dtype=object)
    scatter = n * products - s[:, None] * s
    trace = int(sum(scatter[i, i] for i in range(d)))
    if not trace:
        return none
    vectors, values = [], []
    precision = 2 * ROOT_BITS + 2 * trace.bit_length()
    for at, bits, multiplicity in largest_roots(polynomial(spark, scatter), components):
        vectors.append(null_vectors(scatter, at, bits, multiplicity, precision))
        values += [(at, bits)] * multiplicity
    shares = [at / (trace << bits) if bits >= 0 else 0.0 for at, bits in values][:components]
    eigenvalues = [at / ((n * n) << bits) for at, bits in values][:components]
    return Whitening(n, sums, np.vstack(vectors)[:components], np.array(eigenvalues), np.array(shares))


def _projected(x: np.ndarray, own: Whitening) -> np.ndarray:
    """Whitened values: rows less the mean, from the exact integer n*x - S, on the components, over the roots of their eigenvalues."""
    return (_about_mean(x, own) / own.n) @ (own.vectors / np.sqrt(own.eigenvalues)[:, None]).T


def _about_mean(x: np.ndarray, own: Whitening) -> np.ndarray:
    """n*x - S, as int64 where it fits and Python integers else."""
    sums = np.array(own.sums, dtype=object)
    most = own.n * int(np.abs(x).max(initial=0)) + max((abs(v) for v in own.sums), default=0)
    return own.n * x - sums.astype(np.int64) if most < 1 << 62 else own.n * x.astype(object) - sums


def _deviations(x: np.ndarray, own: Whitening) -> list[int | None]:
    """Sums of the squares of n*x - S; null where a long cannot hold one."""
    about = _about_mean(x, own)
    if about.dtype != object and (int(np.abs(about).max(initial=0)) ** 2) * max(1, x.shape[1]) < 1 << 63:
        return (about * about).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (int(t) for t in (about.astype(object) ** 2).sum(axis=1))]


def identity_error(kept: DataFrame, own: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance, divisor n, less the identity."""
    k = len(own.vectors)
    shared = kept.sparkSession.sparkContext.broadcast(own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                w = _projected(_matrix(b["x_"]), shared.value).astype(np.float64)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    found = np.zeros((k + 1, k))
    for r in kept.select("x_").mapInArrow(add, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        found[r["i"], r["j"]] = r["value"] / own.n
    # The rows are about the mean already; what rounding leaves of it is taken off.
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max(initial=0.0))


def whitened(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """(df's usable rows with deviation and whitened, the fitted Whitening); whitened is an array of a value for each component, at most `components`.

    Rows whose vector is null or empty, holds null or non-finite entries or such that x is no long, or has another length than
    most are dropped. Repeated rows and null ids are rows like others. Components have eigenvalues above zero, so there are fewer
    of them in tables of few dimensions or dependent ones, and none where all vectors are equal; an empty table gives an empty result. deviation is the sum
    over the dimensions of (n*x - S)^2, null where a long cannot hold it. Columns named deviation, whitened or x_ are replaced, others pass through.
    """
    rest = [c for c in df.columns if c.lower() not in ("deviation", "whitened", "x_")]
    kept = usable(df.select(*(F.col(f"`{c}`") for c in rest)), vector_col)
    own = fit(df.sparkSession, kept, components)
    shared = df.sparkSession.sparkContext.broadcast(own)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*(f"`{c}`" for c in rest)).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b["x_"])
                w = _projected(x, shared.value).astype(np.float64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.record_batch([*(b[c] for c in rest), pa.array(_deviations(x, shared.value), pa.int64()), values], names=[*rest, "deviation", "whitened"])

    return kept.mapInArrow(run, f"{fields}, deviation long, whitened array<double>"), own


def op11_exact_whitening(spark, sf_dir: str) -> DataFrame:
    """A row for each usable embedding and component."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found, own = whitened(embeddings)
    error = identity_error(usable(embeddings, "embedding"), own)
    explained = F.array(*(F.lit(float(v)) for v in own.explained)) if len(own.explained) else F.lit(None).cast("array<double>")
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(own.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
