"""Whitening of integer vectors by the exact characteristic polynomial of their scatter matrix."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import written

#: Bits of one part of a large entry; products of two parts over 2**13 rows are exact in a double.
PART = 20
#: Sums travel as numbers to this base, least part first.
LIMB = 60
#: A root is known to this many bits beyond its first.
ROOT_BITS = 120
#: Decimal digits of the inverse iteration.
DIGITS = 90


def integer_entries(vec: Column) -> Column:
    """floor(256 * c) of each entry; null for a vector that is null or holds null or non-finite entries.

    Entries outside the range of a long become its ends.
    """
    good = F.forall(vec, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.when(good, F.transform(vec, lambda c: F.floor(c.cast("double") * 256.0).cast("bigint")))


def common_length(rows: DataFrame) -> int | None:
    """The commonest length of the vectors ``x``, the larger of two that are as common."""
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    first = sizes.head(1)
    return first[0].d if first else None


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def gram(x: np.ndarray) -> np.ndarray:
    """The exact x' x as Python numbers."""
    parts, rest, shift = [], x, 0
    while rest.size and max(-int(rest.min()), int(rest.max())) >= 1 << PART:
        parts.append((shift, rest & ((1 << PART) - 1)))
        rest, shift = rest >> PART, shift + PART
    parts.append((shift, rest))
    out = np.zeros((x.shape[1],) * 2, object)
    for i in range(0, len(x), 1 << 13):
        some = [(s, p[i : i + (1 << 13)].astype(np.float64)) for s, p in parts]
        for s, a in some:
            for t, b in some:
                out += (a.T @ b).astype(np.int64).astype(object) * (1 << (s + t))
    return out


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, n * sum of x x' - sums sums') over all rows of ``fit``, exact.

    A task sends one row for each pair of dimensions, which are added up in Spark.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            x = matrix(batch.column(0), d)
            total += gram(np.hstack([np.ones((len(x), 1), np.int64), x]))
        i, j = np.triu_indices(d + 1)
        sums = [int(v) for v in total[i, j]]
        low = (1 << LIMB) - 1
        limbs = [[v & low for v in sums], [v >> LIMB & low for v in sums], [v >> 2 * LIMB for v in sums]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], ["i", "j", "a", "b", "c"])

    sums = fit.select("x").mapInArrow(partial, "i int, j int, a bigint, b bigint, c bigint")
    sums = sums.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "abc"])
    g = np.zeros((d + 1, d + 1), object)
    for r in sums.collect():  # (d + 1)(d + 2) / 2 rows
        g[r.i, r.j] = g[r.j, r.i] = int(r.a) + (int(r.b) << LIMB) + (int(r.c) << 2 * LIMB)
    n, s = g[0, 0], g[0, 1:]
    return n, [int(v) for v in s], n * g[1:, 1:] - np.outer(s, s)


def is_prime(n: int) -> bool:
    """By the bases that decide every number below 2**32."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        if base % n and (y := pow(base, odd, n)) not in (1, n - 1) and not any((y := y * y % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than so many bits."""
    out, held, p = [], 0.0, 1 << 31
    while held <= bits + 1:
        p -= 1
        if is_prime(p):
            out.append(p)
            held += math.log2(p)
    return out


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - a) modulo p, constant first: Hessenberg form by similar row and column steps, then its recurrence."""
    d = len(a)
    h = (a % p).astype(np.int64)
    for m in range(1, d - 1):
        pivot = m + int(np.argmax(h[m:, m - 1] != 0))
        if not h[pivot, m - 1]:
            continue
        h[[m, pivot]] = h[[pivot, m]]
        h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # of the leading submatrices
    poly[0, 0] = 1
    for k in range(d):
        below, way = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            below[i] = h[i, k] * way % p
            way = way * int(h[i, i - 1]) % p if i else way
        poly[k + 1, 1:] = poly[k, :-1]
        poly[k + 1] = (poly[k + 1] - (below[:, None] * poly[: k + 1] % p).sum(0)) % p
    return [int(c) for c in poly[d]]


def characteristic_polynomial(spark, a: np.ndarray) -> list[int]:
    """The integer coefficients of det(x - a), constant first, of a matrix without negative eigenvalues.

    No coefficient is larger than that of (x + trace/d)^d, which tells how many primes are
    needed. Each prime is a row of a Spark job; only residues come to the driver.
    """
    d, trace = len(a), int(np.trace(a))
    mean = -(-trace // d)
    bits = max(math.comb(d, k) * mean**k for k in range(d + 1)).bit_length() + 1
    primes = primes_beyond(bits)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            polys = [polynomial_mod(a, primes[i]) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(polys, pa.list_(pa.int64()))], ["id", "poly"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(residues, "id bigint, poly array<bigint>").collect()
    product = math.prod(primes)
    out = [0] * (d + 1)
    for r in rows:
        rest = product // primes[r.id]
        unit = rest * pow(rest, -1, primes[r.id])
        out = [c + v * unit for c, v in zip(out, r.poly)]
    return [c - product if 2 * c > product else c for c in (c % product for c in out)]


@dataclass(frozen=True)
class Root:
    """A root within [low, low + 1) / 2**shift."""

    low: int
    shift: int
    times: int


def above(poly: list[int], m: int, shift: int) -> int:
    """How many roots of a real-rooted polynomial are larger than m / 2**shift, by the signs of the shifted coefficients."""
    n = len(poly) - 1
    c = [v << shift * (n - k) for k, v in enumerate(poly)]
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            c[k] += m * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(poly: list[int], m: int, shift: int) -> int:
    value = 0
    for k, c in enumerate(reversed(poly)):
        value = value * m + (c << shift * k)
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int) -> list[Root]:
    """The positive roots that hold the ``most`` largest places, largest first, each once with its multiplicity.

    For a polynomial with real roots Descartes' rule is exact, so a bisection that counts sign changes isolates them.
    A simple root is then refined by the polynomial's sign. Roots nearer to each other than 2**-ROOT_BITS of their size are one.
    """
    while len(poly) > 1 and poly[0] == 0:
        poly = poly[1:]
    found: list[Root] = []
    held, n = 0, len(poly) - 1
    bound = 1 << abs(poly[-2]).bit_length() if n else 0  # at least the sum of the roots
    while held < min(most, n):
        low, high, shift = 0, bound, 0  # more than ``held`` roots are above low, ``held`` are above high
        count = n
        while True:
            if high - low == 1:
                low, high, shift = low * 2, high * 2, shift + 1
            middle = (low + high) // 2
            c = above(poly, middle, shift)
            if c > held:
                low, count = middle, c
            else:
                high = middle
            exact = low and (low.bit_length() > ROOT_BITS and high - low == 1)
            if exact or (low and count == held + 1 and sign_at(poly, low, shift) * sign_at(poly, high, shift) < 0):
                break
        if not exact:
            rising = sign_at(poly, high, shift)
            while low.bit_length() <= ROOT_BITS or high - low > 1:
                if high - low == 1:
                    low, high, shift = low * 2, high * 2, shift + 1
                middle = (low + high) // 2
                low, high = (low, middle) if sign_at(poly, middle, shift) == rising else (middle, high)
        found.append(Root(low, shift, count - held))
        held = count
    return found


def null_space(a: np.ndarray, root: Root) -> list[list[Decimal]]:
    """Orthonormal eigenvectors of the root, by inverse iteration on a - root in many digits."""
    d = len(a)
    value = Decimal(2 * root.low + 1) / Decimal(2) ** (root.shift + 1)
    rng = random.Random(d)
    x = np.array([[Decimal(rng.randrange(-999, 1000)) for _ in range(root.times)] for _ in range(d)], object)
    start = np.array([[Decimal(int(v)) for v in row] for row in a], object)
    start[np.diag_indices(d)] -= value
    tiny = max(abs(v) for v in start.flat) * Decimal(10) ** (-DIGITS) or Decimal(1)
    for _ in range(3):
        m = np.hstack([start, x])
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
            m[[k, pivot]] = m[[pivot, k]]
            m[k, k] = m[k, k] or tiny
            m[k + 1 :, k:] -= np.outer(m[k + 1 :, k] / m[k, k], m[k, k:])
        for k in range(d - 1, -1, -1):
            x[k] = (m[k, d:] - m[k, k + 1 : d] @ x[k + 1 :]) / m[k, k]
        for j in range(root.times):
            for i in range(j):
                x[:, j] -= x[:, i] * (x[:, i] @ x[:, j])
            x[:, j] /= (x[:, j] @ x[:, j]).sqrt()
    return [list(x[:, j]) for j in range(root.times)]


@dataclass(frozen=True)
class Whitening:
    """Components of the fit list: ``n`` vectors, their ``sums``, unit ``axes`` (a row each), eigenvalues and their shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: list[float]
    explained: list[float]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each axis, over the root of its eigenvalue."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.axes.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sums)^2; None where no long holds it."""
        most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * self.n + max(map(abs, self.sums))
        if most * most * x.shape[1] < 1 << 63:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        sums = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in sums]


def fit_whitening(fit: DataFrame, d: int, most: int) -> Whitening:
    """The ``most`` largest components with eigenvalues above 0 of the distinct integer vectors ``x`` of length d."""
    n, sums, a = scatter(fit, d)
    if not n or not np.trace(a):
        return Whitening(n, sums, np.zeros((0, d)), [], [])
    with localcontext() as digits:
        digits.prec = DIGITS
        trace, axes, values = Decimal(int(np.trace(a))), [], []
        for root in largest_roots(characteristic_polynomial(fit.sparkSession, a), most):
            axes += null_space(a, root)
            values += [Decimal(2 * root.low + 1) / Decimal(2) ** (root.shift + 1)] * root.times
        axes, values = axes[:most], values[:most]
        return Whitening(
            n, sums, np.array(axes, np.float64), [float(v / n / n) for v in values], [float(v / trace) for v in values])


def identity_error(fit: DataFrame, d: int, w: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list minus the identity."""
    k = len(w.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            y = w.apply(matrix(batch.column(0), d))
            y = np.hstack([np.ones((len(y), 1)), y])
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) ** 2), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    rows = fit.select("x").mapInArrow(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # (k + 1)^2 rows
    total = np.zeros((k + 1) ** 2)
    for r in rows:
        total[r.i] = r.s
    total = total.reshape(k + 1, k + 1) / w.n
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 4) -> DataFrame:
    """Every vector on the largest components of the distinct integer vectors floor(256 c).

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each row of
    ``table`` and each of the ``most`` largest components. The fit list is each distinct integer vector
    once, found by one shuffle that combines copies before it, and written. Its scatter is
    summed exactly, its characteristic polynomial computed modulo as many primes as the coefficients need, the
    largest roots are isolated exactly, and the components found by inverse iteration in ``DIGITS`` digits. Only numbers
    bounded by the square of the vectors' length come to the driver, and time there grows with its fourth power at most.

    Rows with a vector that is null or holds null or non-finite entries are dropped; so are vectors of
    another length than the commonest (of two as common, the larger). Repeated rows each give their rows; a row without an id
    keeps its null. Components with eigenvalue 0 are none: a single distinct vector, like an empty table, gives no rows, and few distinct ones fewer
    components. Equal eigenvalues share an orthonormal basis. ``deviation`` is null where a long cannot hold it.
    Other columns are ignored, whatever their names.
    """
    rows = table.select(F.col(id_col).alias("vec_id"), integer_entries(F.col(vec_col)).alias("x")).filter("x is not null")
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    d = common_length(rows)
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == d)
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    w = fit_whitening(fit, d, most)
    if not w.values:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, d, w)
    k = len(w.values)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, w.n), pa.int64()),
                pa.array(w.deviations(x), pa.int64()).take(each), pa.array(w.apply(x).ravel()), pa.array(np.tile(w.explained, m)),
                pa.array(np.full(m * k, error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(rows_of, schema)
