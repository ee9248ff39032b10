"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Components become whole numbers, so the scatter n * sum(u u') - T T' of the different vectors is an integer matrix, summed
exactly over all tasks. Its characteristic polynomial is found modulo primes, each by reduction to Hessenberg form, and put
together by Chinese remainders; enough primes are taken for a proven bound on its coefficients. A scatter has only real
roots of 0 or more, and for such polynomials the changes of sign among the coefficients of p(x + a) count the roots
above a exactly, with their multiplicities: so each of the largest roots is found by halving, first by counts until it
stands alone, then by the sign of p, to PRECISION bits. A root that does not come apart from its neighbour within these
bits is one eigenvalue of several dimensions. Components are null vectors of the matrix less the root, by inverse iteration
in whole numbers of still more bits, so close eigenvalues do not blur them.

Primes, roots and null vectors are rows that Spark deals to tasks; the driver sees the matrix (dimensions squared), one
residue polynomial for each prime, and the components. Rows are read three times: for the different vectors, for the
scatter and error over these, and for the result; only different vectors are shuffled, and equal ones meet in their task first.

Defined results: rows whose vector is null, empty, or holds null or non-finite components, or ones whose 64-fold leaves 62 bits,
give no rows; so do vectors of another length than the commonest (the shorter one, if two are as common). There are as many
components as positive eigenvalues, 16 at most, so none for fewer than two different vectors. Rows of equal or null ids are rows of
their own. ``deviation`` is null where it leaves 63 bits. Each component's largest entry is positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import configure, fields, map_rows, stored

SCALE, COMPONENTS = 64, 16
#: Bits to which a root is found, against the sum of all; further bits of the inverse iteration.
PRECISION, GUARD = 192, 320
#: Rows of one exact product.
CHUNK = 2048


def whole_numbers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, u): components floor(64 c) of the vectors that take part. Scatter, deviation and components do not
    change if the same number is added to all entries, so none is added."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**56)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", finite))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * SCALE).cast("long")).alias("u"))


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of an Arrow batch, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(u: np.ndarray) -> list[list[int]]:
    """u' u exactly, as Python integers: parts of 20 bits are multiplied as doubles, whose sums stay below 2^53."""
    limbs = []
    while True:
        low = (u + 2**19 & 2**20 - 1) - 2**19
        limbs.append(low.astype(float))
        u = u - low >> 20
        if not u.any():
            break
    out = np.zeros((limbs[0].shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            part = (a.T @ b).astype(np.int64)
            out = out + (part.astype(object) * (1 << 20 * (i + j)))
    return out.tolist()


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums, and sums of products, exact. What is shuffled is one number for each pair of
    dimensions and task; what the driver sees is one for each pair."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, pairs = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            u = matrix(b.column(0)) if b.num_rows else np.zeros((0, dims), np.int64)
            for at in range(0, len(u), CHUNK):
                part = u[at : at + CHUNK]
                total += len(part)
                sums = sums + np.array([sum(c) for c in part.T.tolist()], object)
                pairs = pairs + np.array(products(part), object)
        if not total:
            return
        i, j = np.triu_indices(dims)
        values = [total, *sums.tolist(), *pairs[i, j].tolist()]
        low, high = [v % 2**60 for v in values], [v >> 60 for v in values]
        keys = [(-1, -1), *((-1, k) for k in range(dims)), *zip(i.tolist(), j.tolist(), strict=True)]
        decimals = pa.decimal128(38, 0)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())]
        columns += [pa.array([Decimal(x) for x in v], decimals) for v in (low, high)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "low", "high"])

    parts = fit.select("u").mapInArrow(summed, "i int, j int, low decimal(38,0), high decimal(38,0)")
    found = {(r.i, r.j): int(r.low) + (int(r.high) << 60) for r in parts.groupBy("i", "j").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect()}  # dims squared
    if not found:
        return 0, [0] * dims, []
    pairs = [[found[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)]
    return found[-1, -1], [found[-1, k] for k in range(dims)], pairs


def is_prime(n: int) -> bool:
    """For n below 2^32, certain."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(a: list[list[int]]) -> list[int]:
    """Primes whose product is over twice any coefficient's size: roots are 0 or more and sum up to the trace, so the k-th
    elementary symmetric sum is at most that of equal roots."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    out, product, p = [], 1, 2**31
    while product <= 2 * bound:
        p -= 1
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - a) modulo p < 2^31, the constant first, by reduction to Hessenberg form."""
    h, d = a.astype(np.int64) % p, len(a)
    for m in range(1, d - 1):
        rows = np.flatnonzero(h[m:, m - 1])
        if not len(rows):
            continue
        if (i := m + int(rows[0])) != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    # leading minors' polynomials, each from those before
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        own = np.zeros(d + 1, np.int64)
        own[1:] = polys[k - 1, :-1]
        own = (own - h[k - 1, k - 1] * polys[k - 1] % p) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            own = (own - int(h[i - 1, k - 1]) * below % p * polys[i - 1] % p) % p
        polys[k] = own
    return polys[d].tolist()


def remaindered(primes: list[int], residues: list[list[int]]) -> list[int]:
    """The whole numbers of least size with these residues, a list for each prime."""
    product = math.prod(primes)
    weights = [(w := product // p) * pow(w, -1, p) for p in primes]
    out = []
    for column in zip(*residues, strict=True):
        x = sum(w * r for w, r in zip(weights, column, strict=True)) % product
        out.append(x - product if 2 * x > product else x)
    return out


def characteristic(spark, a: list[list[int]]) -> list[int]:
    """The polynomial of ``a``, primes dealt to tasks."""
    primes = primes_for(a)

    def make():
        def work(ps):
            return {"p": ps, "c": [polynomial_mod(np.array([[x % p for x in row] for row in a], np.int64), p) for p in ps]}

        return work

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), max(2, spark.sparkContext.defaultParallelism)))
    found = {r.p: r.c for r in map_rows(rows, make, fields(p=LongType(), c=ArrayType(LongType()))).collect()}
    return remaindered(primes, [found[p] for p in primes])


class Roots:
    """The roots of a polynomial that are all real and 0 or more, counted and found on a grid of 2^-bits."""

    def __init__(self, coefficients: list[int], bits: int):
        self.zeros = next(k for k, c in enumerate(coefficients) if c)
        own = coefficients[self.zeros :]
        self.degree, self.bits = len(own) - 1, bits
        self.scaled = [c << bits * (self.degree - k) for k, c in enumerate(own)]
        # the second coefficient is the sum of the roots
        self.most = (-own[-2] << bits) + 1 if self.degree else 1

    def above(self, at: int) -> int:
        """How many roots are over at / 2^bits: changes of sign after a shift."""
        c = self.scaled[::-1]
        for end in range(len(c), 1, -1):
            for k in range(1, end):
                c[k] += at * c[k - 1]
        signs = [x > 0 for x in c if x]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def value(self, at: int) -> int:
        out = 0
        for c in reversed(self.scaled):
            out = out * at + c
        return out

    def largest(self, rank: int) -> tuple[int, int, int]:
        """(low, high, m) of the rank-th largest root: it and the m roots it does not come apart from lie in (low, high]."""
        low, high, over, under = 0, self.most, self.degree, 0
        while high - low > 1 and over - under > 1:
            at = low + high >> 1
            n = self.above(at)
            if n >= rank:
                low, over = at, n
            else:
                high, under = at, n
        if high - low > 1:
            # alone: p has one sign left of it and another right of it
            right = self.value(high)
            if not right:
                return high - 1, high, 1
            while high - low > 1:
                at = low + high >> 1
                v = self.value(at)
                if not v or (v > 0) == (right > 0):
                    high = at
                else:
                    low = at
                if not v:
                    return high - 1, high, 1
        return low, high, over - under


def null_vectors(a: list[list[int]], low: int, high: int, bits: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors that ``a`` stretches by the root in (low, high] / 2^bits, by inverse iteration."""
    d, w = len(a), PRECISION + GUARD
    m = [[((x << bits + 1) - (low + high if i == j else 0)) << GUARD for j, x in enumerate(row)] for i, row in enumerate(a)]
    order, factors = list(range(d)), []
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(m[i][k]))
        m[k], m[best] = m[best], m[k]
        order[k], order[best] = order[best], order[k]
        for f in factors:
            f[k], f[best] = f[best], f[k]
        pivot, row = m[k][k] or 1, m[k]
        m[k][k] = pivot
        own = [0] * d
        for i in range(k + 1, d):
            if m[i][k]:
                f = own[i] = (m[i][k] << w) // pivot
                m[i] = [0] * (k + 1) + [x - (f * y >> w) for x, y in zip(m[i][k + 1 :], row[k + 1 :], strict=True)]
        factors.append(own)
    unit = 1 << w

    def solved(b: list[int]) -> list[int]:
        x = [b[i] << 2 * w for i in order]
        for k in range(d):
            xk = x[k]
            for i in range(k + 1, d):
                if f := factors[k][i]:
                    x[i] -= f * xk >> w
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] - sum(y * z for y, z in zip(m[k][k + 1 :], x[k + 1 :], strict=True))) // m[k][k])
        return x

    def normal(x: list[int], others: list[list[int]]) -> list[int]:
        cut = max(0, max(map(abs, x)).bit_length() - 2 * w)
        x = [v >> cut for v in x]
        for _ in range(2):
            for o in others:
                dot = sum(p * q for p, q in zip(x, o, strict=True))
                x = [p - (dot * q >> 2 * w) for p, q in zip(x, o, strict=True)]
        length = math.isqrt(sum(v * v for v in x)) or 1
        return [(v << w) // length for v in x]

    found: list[list[int]] = []
    for k in range(count):
        # any start that is not orthogonal to the root's vectors does: entries spread by a fixed step
        x = normal([((i + 1) * (2 * k + 1) * 0x9E3779B97F4A7C15 >> 7) % 2**32 - 2**31 for i in range(d)], [])
        for _ in range(3):
            x = normal(solved(x), found)
        found.append(x)
    out = []
    for x in found:
        lead = max(range(d), key=lambda i: (abs(x[i]) >> GUARD, -i))
        sign = -1 if x[lead] < 0 else 1
        out.append([sign * v / unit for v in x])
    return out


def components(spark, a: list[list[int]], most: int = COMPONENTS) -> list[tuple[int, int, list[float]]]:
    """(numerator, bits, vector) of the largest positive eigenvalues of ``a``, numerator / 2^bits each, falling."""
    p = characteristic(spark, a)
    trace = -p[-2]
    bits = max(64, PRECISION - trace.bit_length())
    rank = len(a) - Roots(p, 0).zeros

    def roots():
        own = Roots(p, bits)
        return lambda ks: {"k": ks, **dict(zip(("low", "high", "m"), zip(*([str(x) for x in own.largest(k)] for k in ks), strict=True), strict=True))}

    ranks = spark.createDataFrame([(k,) for k in range(1, min(most, rank) + 1)], "k int").repartition(min(most, rank) or 1)
    text = StringType()
    found = sorted(map_rows(ranks, roots, fields(k=IntegerType(), low=text, high=text, m=text)).collect())
    spaces: dict[tuple[str, str, str], int] = {}
    for r in found:
        spaces[r.low, r.high, r.m] = spaces.get((r.low, r.high, r.m), 0) + 1

    def vectors():
        def work(at, lows, highs, ms):
            sets = [null_vectors(a, int(lo), int(hi), bits, int(m)) for lo, hi, m in zip(lows, highs, ms, strict=True)]
            return {"at": at, "v": sets}

        return work

    # the first rank of each eigenvalue; one of several dimensions gives them together
    rows = [(i, *key) for i, key in enumerate(spaces)]
    df = spark.createDataFrame(rows, "at int, low string, high string, m string").repartition(len(rows) or 1)
    own = {r.at: r.v for r in map_rows(df, vectors, fields(at=IntegerType(), v=ArrayType(ArrayType(DoubleType())))).collect()}
    out = []
    for i, ((low, high, _), n) in enumerate(spaces.items()):
        out += [(int(low) + int(high), bits + 1, v) for v in own[i][:n]]
    return out


def centred(u: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n u - T, exact: 64-bit integers where they suffice, else Python's."""
    if n * int(np.abs(u).max(initial=0)) + max(map(abs, sums)) < 2**62:
        return u * n - np.array(sums, np.int64)
    return u.astype(object) * n - np.array(sums, object)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that takes part and component."""
    spark = configure(vectors.sparkSession)
    rows = whole_numbers(vectors, key, vector)
    lengths = rows.groupBy(F.size("u").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    schema = StructType([
        StructField("vec_id", rows.schema["vec_id"].dataType), StructField("component", IntegerType()), StructField("n", LongType()),
        StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
    ])
    empty = spark.createDataFrame([], StructType([*schema.fields, StructField("identity_error", DoubleType())]))
    if lengths is None:
        return empty
    dims = lengths.dims
    rows = rows.where(F.size("u") == dims)
    fit = stored(rows.select("u").distinct(), "fit")
    n, sums, pairs = moments(fit, dims)
    scatter = [[n * pairs[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    common = math.gcd(*(x for row in scatter for x in row))
    if not common:
        return empty
    found = components(spark, [[x // common for x in row] for row in scatter], most)
    trace = sum(scatter[i][i] for i in range(dims))
    values = [common * x / (n * n << bits) for x, bits, _ in found]
    explained = [common * x / (trace << bits) for x, bits, _ in found]
    turn = np.array([v for _, _, v in found]).T / np.sqrt(values)
    k = len(found)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                white = centred(matrix(b.column(0)), n, sums).astype(float) / n @ turn
                total[:k] += white.T @ white
                total[k] += white.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    parts = fit.select("u").mapInArrow(errors, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # k squared
    total = np.array([r.v for r in parts]).reshape(k + 1, k)
    mean = total[k] / n
    error = float(np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = centred(matrix(b.column(1)), n, sums)
            if z.dtype == object or int(np.abs(z).max()) ** 2 * dims >= 2**63:
                squares = [sum(v * v for v in row) for row in z.tolist()]
                squares = [v if v < 2**63 else None for v in squares]
            else:
                squares = (z * z).sum(axis=1).tolist()
            white = z.astype(float) / n @ turn
            each = np.repeat(np.arange(len(z)), k)
            columns = [
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(len(each), n)),
                pa.array(squares, pa.int64()).take(pa.array(each)), pa.array(white.ravel()), pa.array(np.tile(explained, len(z))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("vec_id", "u").mapInArrow(whitened, schema).withColumn("identity_error", F.lit(error))
