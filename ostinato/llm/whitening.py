"""Whitening of embeddings with components from the exact characteristic polynomial of their scatter.

Vectors become whole numbers, so their scatter matrix is exact. Its characteristic polynomial is
found modulo many primes, a Hessenberg reduction each, spread over tasks, and put together by
Chinese remaindering. All roots are real; those wanted are isolated by exact sign counts and
narrowed by bisection, and each gives its components by inverse iteration in long fixed-point numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: Bits to which roots are known beyond their leading one, and of the fixed-point numbers of the iteration.
ROOT_BITS, FIXED_BITS = 128, 320
_FORMS = ("<i2", "<i4", "<i8")


# --- whole-number vectors ---------------------------------------------------------------------


def _whole_vectors(column: pa.Array, scale: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a usable vector, and these vectors as whole numbers, padded to ``size``."""
    column = column.cast(pa.large_list(pa.float64()))
    values = column.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    offsets = column.offsets.to_numpy()
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = np.flatnonzero(whole & (ends[offsets[1:]] == ends[offsets[:-1]]))
    lengths = np.diff(offsets)[good]
    out = np.zeros((len(good), size))
    at = np.arange(size)[None, :] < lengths[:, None]
    source = (offsets[:-1][good][:, None] + np.arange(size)[None, :])[at]
    out[at] = np.floor(scale * values[source])
    if np.abs(out).max(initial=0) >= 2.0**62:
        raise OverflowError("an entry times the scale does not fit a long")
    return good, out.astype(np.int64)


def _keys(vectors: np.ndarray) -> list[bytes]:
    """Bytes that name each vector: equal for equal vectors only, and short for small entries."""
    top = np.abs(vectors).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(vectors)
    for k, (form, low, high) in enumerate(zip(_FORMS, (-1, 2**15 - 1, 2**31 - 1), (2**15 - 1, 2**31 - 1, 2**63 - 1), strict=True)):
        rows = np.flatnonzero((top > low) & (top <= high))
        head = bytes([k])
        for i, row in zip(rows.tolist(), vectors[rows].astype(form), strict=True):
            out[i] = head + row.tobytes()
    return out


def _vectors(keys: pa.Array, size: int) -> np.ndarray:
    out = np.empty((len(keys), size), np.int64)
    if not size:
        return out
    for k, key in enumerate(keys.to_pylist()):
        out[k] = np.frombuffer(key, _FORMS[key[0]], size, 1)
    return out


def _scatter_sums(fit: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and sums of products of the fit list, exact. At most size * (size + 3) / 2 + 1
    numbers reach the driver."""
    low, high = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, products = 0, np.zeros(size, object), np.zeros(len(low), object)
        for batch in batches:
            x = _vectors(batch.column("key"), size)
            if not len(x):
                continue
            rows, sums = rows + len(x), sums + x.astype(object).sum(axis=0)
            top = int(np.abs(x).max(initial=0))
            if len(x) * top * top < 2**53:  # exact in doubles
                y = x.astype(float)
                part = (y.T @ y).astype(np.int64).astype(object)
            elif len(x) * top * top < 2**63:
                part = (x.T @ x).astype(object)
            else:
                part = x.astype(object).T @ x.astype(object)
            products = products + part[low, high]
        # as text, since they may be longer than a long
        flat = [rows, *sums.tolist(), *products.tolist()] if rows else []
        yield pa.RecordBatch.from_pydict(
            {
                "place": pa.array(range(len(flat)), pa.int32()),
                "value": pa.array([str(v) for v in flat], pa.string()),
            }
        )

    parts = fit.mapInArrow(work, "place int, value string")
    found = {r.place: int(r.value) for r in parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    if not found:
        return 0, [0] * size, [[0] * size for _ in range(size)]
    products = [[0] * size for _ in range(size)]
    for k, (i, j) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        products[i][j] = products[j][i] = found[1 + size + k]
    return found[0], [found[1 + i] for i in range(size)], products


# --- characteristic polynomial ----------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Exact for n below 3,215,031,751 with these bases."""
    if n < 8 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    d = n - 1
    r = (d & -d).bit_length() - 1
    d >>= r
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(limit: int, product_over: int) -> list[int]:
    """Largest primes below ``limit`` whose product is more than ``product_over``."""
    found, product, n = [], 1, limit - 1 | 1
    while product <= product_over:
        n -= 2
        if _is_prime(n):
            found.append(n)
            product *= n
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(x - matrix) modulo a prime below 2 ** 31: reduction to
    Hessenberg form by similarity, then the recurrence over its leading blocks."""
    h = np.array(matrix % p, np.int64)
    n = len(h)
    for k in range(1, n - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        # the inverse step on columns; sums of products are reduced term by term
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    blocks = np.zeros((n + 1, n + 1), np.int64)
    blocks[0, 0] = 1
    for k in range(1, n + 1):
        row = np.zeros(n + 1, np.int64)
        row[1:] = blocks[k - 1, :-1]
        row = (row - h[k - 1, k - 1] * blocks[k - 1]) % p
        weights, chain = [], 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            weights.append(chain * int(h[i - 1, k - 1]) % p)
        if weights:
            used = blocks[np.arange(k - 2, -1, -1)]
            row = (row - (np.array(weights, np.int64)[:, None] * used % p).sum(axis=0)) % p
        blocks[k] = row
    return blocks[n]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of det(x - matrix) for a symmetric matrix of whole numbers
    without negative eigenvalues. The elementary symmetric sums of such eigenvalues are below
    (1 + mean) ** size, which says how many primes are needed; each is one row of a Spark job."""
    n = len(matrix)
    if n == 0:
        return [1]
    mean = -(-sum(matrix[i][i] for i in range(n)) // n)
    primes = primes_below(2**31, 2 * (1 + mean) ** n)
    shared = spark.sparkContext.broadcast(np.array(matrix, object))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "p": batch.column("p"),
                    "coefficients": pa.array([polynomial_modulo(shared.value, p).tolist() for p in listed], pa.list_(pa.int64())),
                }
            )

    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(max(1, min(len(primes), spark.sparkContext.defaultParallelism)), "p")
    images = sorted((r.p, r.coefficients) for r in rows.mapInArrow(work, "p bigint, coefficients array<bigint>").collect())
    value, modulus = [0] * (n + 1), 1
    for p, image in images:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((c - v) * inverse % p) for v, c in zip(value, image, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


# --- roots ------------------------------------------------------------------------------------


def roots_above(polynomial: list[int], a: int) -> int:
    """How many roots, with multiplicity, are above ``a``. If all are real, it is exactly the
    number of sign changes in the coefficients of the polynomial of x + a."""
    c = list(polynomial)
    if a:
        for i in range(len(c) - 1):
            for j in range(len(c) - 2, i - 1, -1):
                c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(polynomial: list[int], a: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * a + c
    return total


def leading_roots(polynomial: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """(numerator, shift, multiplicity) of the largest positive roots of a polynomial that only has real
    roots, falling, until ``wanted`` are covered: a root lies within one unit of numerator / 2 ** shift,
    which has over ROOT_BITS bits. Roots that are nearer to one another count as one."""
    total = roots_above(polynomial, 0)
    top = 1
    while roots_above(polynomial, top):
        top *= 2
    found, covered, degree = [], 0, len(polynomial) - 1
    while covered < min(wanted, total):
        low, high, shift, scaled = 0, top, 0, polynomial
        above_low, above_high = total, 0
        # the largest root not yet found: more than ``covered`` roots lie above low, not so above high
        sign = None
        while True:
            while high - low > 1:
                mid = (low + high) // 2
                if above_low - above_high == 1:  # isolated: the sign tells on which side it is
                    if sign is None:
                        right = _value(scaled, high)
                        if right == 0:  # the root itself
                            low = high - 1
                            break
                        sign = right > 0
                    value = _value(scaled, mid)
                    over = above_low if value and (value > 0) != sign else above_high
                else:
                    over = roots_above(scaled, mid)
                if over > covered:
                    low, above_low = mid, over
                else:
                    high, above_high = mid, over
            more = ROOT_BITS - high.bit_length()
            if more <= 0:
                break
            low, high, shift = low << more, high << more, shift + more
            scaled = [c << shift * (degree - k) for k, c in enumerate(polynomial)]
            sign = None
        found.append((high, shift, above_low - above_high))
        covered = above_low
    return found


# --- components -------------------------------------------------------------------------------


def _null_vectors(matrix: list[list[int]], root: int, shift: int, count: int) -> list[list[int]]:
    """Fixed-point vectors that span the space of a root: inverse iteration from fixed uneven
    starts, each made orthogonal to those before it."""
    n = len(matrix)
    bits = max(1, max(abs(x) for row in matrix for x in row).bit_length())
    move = FIXED_BITS - bits
    a = np.array([[x << move for x in row] for row in matrix], object)
    eigenvalue = root << (move - shift) if move >= shift else root >> (shift - move)
    for i in range(n):
        a[i, i] -= eigenvalue
    order = np.arange(n)
    for k in range(n):
        pivot = k + max(range(n - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # the smallest number there is
        if k + 1 < n:
            factor = np.array([(x << FIXED_BITS) // a[k, k] for x in a[k + 1 :, k]], object)
            a[k + 1 :, k + 1 :] -= (factor[:, None] * a[k, k + 1 :]) >> FIXED_BITS
            a[k + 1 :, k] = factor

    def solve(v: np.ndarray) -> np.ndarray:
        x = v[order].copy()
        for k in range(n - 1):
            x[k + 1 :] -= (a[k + 1 :, k] * x[k]) >> FIXED_BITS
        for k in range(n - 1, -1, -1):
            x[k] = (x[k] << FIXED_BITS) // a[k, k]
            x[:k] -= (a[:k, k] * x[k]) >> FIXED_BITS
        return x

    def unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        size = max(1, max(abs(int(x)) for x in v).bit_length())
        v = np.array([int(x) << FIXED_BITS >> size for x in v], object)
        for _ in range(2):
            for u in others:
                v = v - (u * ((u * v).sum() >> FIXED_BITS) >> FIXED_BITS)
        norm = math.isqrt(int((v * v).sum())) or 1
        return np.array([(int(x) << FIXED_BITS) // norm for x in v], object)

    found: list[np.ndarray] = []
    for c in range(count):
        start = np.array([(1 << FIXED_BITS) + ((i + 1) * (c + 1) * 2654435761 % 1009 << FIXED_BITS - 9) for i in range(n)], object)
        v = unit(start, found)
        for _ in range(3):
            v = unit(solve(v), found)
        found.append(v)
    return [v.tolist() for v in found]


@dataclass
class Whitening:
    """Fitted components: whitened value k is sum((n * x - sums) * components[k]) / root of eigenvalues[k]."""

    scale: int
    n: int
    sums: list[int]
    eigenvalues: list[float]  # of n times the scatter, falling; over n * n they are those of the covariance
    explained: list[float]
    components: np.ndarray  # a row each


def fit_components(spark: SparkSession, n: int, sums: list[int], products: list[list[int]], wanted: int, scale: int) -> Whitening:
    size = len(sums)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    trace = sum(matrix[i][i] for i in range(size))
    values, explained, components = [], [], []
    if trace:
        for root, shift, count in leading_roots(characteristic_polynomial(spark, matrix), wanted):
            for v in _null_vectors(matrix, root, shift, min(count, wanted - len(values))):
                # whole numbers divide with one rounding
                values.append(root / (1 << shift))
                explained.append(root / (trace << shift))
                components.append([x / (1 << FIXED_BITS) for x in v])
    return Whitening(scale, n, sums, values, explained, np.array(components).reshape(len(values), size))


def _project(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact squared deviations of n * x from the sums, and whitened values, a row each."""
    size = x.shape[1]
    top = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums), default=0)
    if top < 2**62 and size * top * top < 2**63:
        apart = model.n * x - np.array(model.sums, np.int64)
        squares = (apart * apart).sum(axis=1)
    else:
        apart = model.n * x.astype(object) - np.array(model.sums, object)
        exact = (apart * apart).sum(axis=1)
        if len(exact) and max(exact) >= 2**63:
            raise OverflowError("a deviation does not fit a long")
        squares = exact.astype(np.int64)
    return squares, apart.astype(float) @ model.components.T / np.sqrt(model.eigenvalues)


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry are dropped; a shorter vector
    is read as if zeros followed, an empty one as all zeros. Entries become floor(scale * entry) and
    must fit a long, as must deviations; else OverflowError. The fit list is each distinct vector
    once. Only components of positive eigenvalue are returned, so a table with fewer than two
    distinct vectors gives no rows. Null and repeated ids are rows like any other.
    What reaches the driver is bounded by the vector length: its square in numbers, plus a polynomial
    a prime. ``identity_error`` is the largest entry of the whitened fit list's covariance less the identity.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    usable = F.col("embedding").isNotNull()
    size = rows.filter(usable).agg(F.max(F.size("embedding"))).first()[0] or 0

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _whole_vectors(batch.column("embedding"), scale, size)
            yield pa.RecordBatch.from_pydict({"key": pa.array(_keys(x), pa.binary())})

    fit = materialise(rows.select("embedding").mapInArrow(code, "key binary").distinct())
    model = fit_components(spark, *_scatter_sums(fit, size), components, scale)
    shared = spark.sparkContext.broadcast(model)
    found = len(model.eigenvalues)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whitened = _project(shared.value, _vectors(batch.column("key"), size))[1]
            yield pa.RecordBatch.from_pydict({f"w{k}": pa.array(np.ascontiguousarray(whitened[:, k])) for k in range(found)})

    error = 0.0
    if found:
        pairs = [(i, j) for i in range(found) for j in range(i, found)]
        frame = fit.mapInArrow(check, ", ".join(f"w{k} double" for k in range(found)))
        spread = frame.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(spread, pairs, strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            good, x = _whole_vectors(batch.column("embedding"), scale, size)
            squares, whitened = _project(model, x)
            count = len(good) * found
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(good, found))),
                    "component": pa.array(np.tile(np.arange(1, found + 1), len(good)), pa.int32()),
                    "n": pa.array(np.full(count, model.n), pa.int64()),
                    "deviation": pa.array(np.repeat(squares, found), pa.int64()),
                    "whitened": pa.array(whitened.ravel()),
                    "explained": pa.array(np.tile(np.array(model.explained, float), len(good))),
                    "identity_error": pa.array(np.full(count, error)),
                }
            )

    columns = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(work, f"vec_id {kind}, {columns}")
